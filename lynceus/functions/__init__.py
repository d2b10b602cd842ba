"""Column functions: vocabulary, narrative grammar, names and similarity."""
