"""tabgraph: relational tables to similarity graphs, as Spark DataFrame plans."""
