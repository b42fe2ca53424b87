"""Contest, small-area and corpus analytics as Spark DataFrame operators."""
