"""Column functions: tokens, scores, quantised impacts, sizes of encodings."""
