"""The analysis chains, each a sequence of DataFrame transformations."""
