"""Column functions: text, labels, access, scores, redaction. All are built-in expressions."""
