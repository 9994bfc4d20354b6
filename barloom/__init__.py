"""Market-bar analytics and training-data operations as Spark jobs."""
