"""Vectorised kernels for what built-in expressions cannot say."""
