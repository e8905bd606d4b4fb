"""kgivm: incremental maintenance of a provenance graph, as Spark DataFrame plans."""
