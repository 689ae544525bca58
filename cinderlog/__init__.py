"""cinderlog: log incident analytics as Spark DataFrame operators."""
