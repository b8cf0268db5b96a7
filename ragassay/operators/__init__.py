"""DataFrame -> DataFrame building blocks, one module per pipeline phase."""
