"""Extension: linkage of a stream of query records against a static pool."""
