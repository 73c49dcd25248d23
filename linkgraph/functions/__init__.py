"""Column functions: text folding, title keys, similarity, rendering."""
