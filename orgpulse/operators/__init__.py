"""DataFrame -> DataFrame operators of the report analysis."""
