"""Query plans: adapters from tables to the logical model, and the catalogue of queries."""
