"""CSV source and table store."""
