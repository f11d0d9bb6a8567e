"""lamina: ordered, semi-structured analytics as plain PySpark DataFrame operators."""
