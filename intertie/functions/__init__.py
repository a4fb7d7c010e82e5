"""Column builders: no joins, no aggregation, no Python at run time."""
