"""Column expressions: mask algebra, scaling, spectral indices."""
