"""Research-reading, search, graph and process jobs as Spark DataFrame operators."""
