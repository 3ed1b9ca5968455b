"""Column builders and numpy kernels for special statistics."""
