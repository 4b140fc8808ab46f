"""Training-data operators: each module has one operator, its options and its result columns in the docstring."""
