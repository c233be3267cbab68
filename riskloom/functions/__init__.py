"""Column expressions: text and path normal forms, severities, categories, identity keys, detectors."""
