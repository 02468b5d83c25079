"""Reading registries, document folders and index state."""
