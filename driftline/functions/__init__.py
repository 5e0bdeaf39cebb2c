"""Column functions with the null and truth rules of the record language."""
