"""DataFrame -> DataFrame operators, grouped by the part of the application they serve."""
