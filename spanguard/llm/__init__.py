"""Training-data operators. Nothing else in spanguard imports this subpackage."""
