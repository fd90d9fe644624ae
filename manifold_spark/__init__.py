"""manifold_spark: embedding and point-cloud analytics expressed as Spark plans."""
