"""Column helpers and the ordered (prefix-sum, rank-cut, quantile) building blocks."""
