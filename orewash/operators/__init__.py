"""DataFrame in, DataFrame out; no actions, no paths."""
