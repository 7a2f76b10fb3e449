"""Event and news analytics over pairs of entities, as plain Spark DataFrame operators."""
