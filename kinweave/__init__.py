"""Record linkage and candidate-graph analytics as Spark DataFrame transformations."""
