"""The operators applied to generic test tables, with the same results stated in SQL."""
