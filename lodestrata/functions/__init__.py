"""Column functions: geometry, coordinate reference systems, templates and property transformations."""
