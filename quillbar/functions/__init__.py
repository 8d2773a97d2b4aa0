"""Column kernels over one symbol's rows."""
