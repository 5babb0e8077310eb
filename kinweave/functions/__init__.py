"""Column functions: text normalisation, token statistics, string similarity."""
