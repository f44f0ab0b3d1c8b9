"""DataFrame operators: cleaning, reshaping, joins, windows, splits, scaling and evaluation."""
