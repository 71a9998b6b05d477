"""The registered queries of record linkage and the same in SQL."""
