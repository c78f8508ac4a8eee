"""Column functions; all but ``signal`` and ``containment`` are built-in expressions."""
