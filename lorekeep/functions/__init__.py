"""Column functions: text, identifiers, scores and vectors."""
