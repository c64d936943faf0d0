"""Quarry: retrieval and knowledge-base analytics as Spark jobs."""
