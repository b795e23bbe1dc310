"""Reading tables, identifying them and writing immutable versions."""
