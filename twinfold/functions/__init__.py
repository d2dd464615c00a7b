"""Column functions: scores, text parses, order statistics, digests."""
