"""Organisation questionnaire analytics as plain Spark DataFrame transforms."""
