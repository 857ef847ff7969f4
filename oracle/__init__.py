"""Independent SQL statements that check the Spark queries by value."""
