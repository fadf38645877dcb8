"""DataFrame -> DataFrame operators. Column names are parameters; ``keys`` lead every grouping."""
