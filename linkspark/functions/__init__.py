"""Column functions: text normalisation, similarity and number comparison."""
