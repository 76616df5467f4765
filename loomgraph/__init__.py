"""Property-graph, text and history analytics expressed as Spark plans."""
