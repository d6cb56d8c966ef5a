"""Travel-time distributions and mode comparison as Spark DataFrame operators."""
