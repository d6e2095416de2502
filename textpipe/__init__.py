"""A text-sanitization engine on Spark: versioned pipelines of text operations as Catalyst programs."""
