"""Column builders: sequence similarity, curves, vectors, text matching."""
