"""Column-level helpers and numeric kernels."""
