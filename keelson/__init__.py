"""keelson: software-architecture analytics expressed as Spark queries."""
