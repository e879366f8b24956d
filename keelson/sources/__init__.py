"""Where logical tables come from: source trees, manifests, histories, configuration."""
