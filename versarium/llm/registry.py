"""Queries of this subpackage and their SQL twins, kept apart from the rest of the library."""

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add
