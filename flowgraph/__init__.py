"""flowgraph: program-flow analytics as Spark DataFrame operators."""
