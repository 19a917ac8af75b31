"""Table operators: selection, joins, counts, windows and reshaping."""
