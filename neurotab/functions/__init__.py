"""Column functions and Arrow-batched kernels."""
