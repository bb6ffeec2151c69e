"""Reports over the marketplace tables."""
