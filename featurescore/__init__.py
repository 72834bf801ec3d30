"""Feature vectorisation and model scoring over Spark tables and streams."""
