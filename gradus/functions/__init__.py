"""Column expressions: numbers and arrays in kernels, text in text."""
