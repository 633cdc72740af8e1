"""Column functions: text, paths, addresses, labels."""
