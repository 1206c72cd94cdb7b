"""Column functions of the feed engine: all JVM-side, no Python UDF."""
