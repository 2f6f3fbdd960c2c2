"""DataFrame -> DataFrame operators, grouped by pipeline phase."""
