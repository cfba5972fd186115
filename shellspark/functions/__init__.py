"""Column functions: geometry, histogram scalars and reproducible uniforms."""
