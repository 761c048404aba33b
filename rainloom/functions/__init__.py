"""Column functions: no input or output, no shuffle."""
