"""drawgraph: DataFrame operators for engineering-drawing knowledge graphs."""
