"""DataFrame -> DataFrame operators.  None of them prints, caches or collects
rows; the few that need a scalar (a quantile cut, a row count) aggregate first
and bring back only that scalar."""
