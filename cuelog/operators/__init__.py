"""DataFrame-in, DataFrame-out operators, by subject."""
