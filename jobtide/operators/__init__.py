"""DataFrame in, DataFrame out: the analysis steps."""
