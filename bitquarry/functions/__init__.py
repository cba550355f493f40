"""Column functions, the kernels below them, and their SQL names."""
