"""Security analytics over log data, as Spark DataFrame transformations."""
