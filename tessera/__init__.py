"""Quiz-content and gameplay analytics as Spark DataFrame operators."""
