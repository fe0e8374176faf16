"""DataFrame-in, DataFrame-out retention operators."""
