"""Population genetics and corpus analytics as Spark DataFrame operators."""
