"""Column expressions and the NumPy kernels used inside tasks."""
