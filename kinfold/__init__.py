"""Record linkage as Spark DataFrame transformations."""
