"""Column functions: text, identifiers, paths, search tokens, summaries."""
