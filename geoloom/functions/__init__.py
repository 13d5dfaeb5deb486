"""Column functions: vectors, pixels, map projection."""
