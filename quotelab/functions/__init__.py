"""Column functions: numbers, predicates, text, fixed value lists."""
