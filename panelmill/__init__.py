"""Entity x period panel analytics as Spark jobs."""
