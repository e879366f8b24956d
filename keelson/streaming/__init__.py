"""A code base that is measured while it changes."""
