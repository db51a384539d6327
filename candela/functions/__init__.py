"""Building blocks shared by the operators: chunked windows, guards, exact quantiles."""
