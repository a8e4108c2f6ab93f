"""Column expressions: spans, checks, keyed digests, context words and span transformations."""
