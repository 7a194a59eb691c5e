"""Named queries and their SQL twins."""

from versarium.session import TEXT_KEYS, load, spread

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


def projected(query_name, table, keys, sql, /, **columns):
    """Register a plain projection: key columns plus named expressions."""

    @query(query_name, sql)
    def run(spark, sf_dir):
        made = [fn().alias(name) for name, fn in columns.items()]
        df = load(spark, sf_dir, table)
        if table in TEXT_KEYS:
            df = spread(df, *TEXT_KEYS[table])
        return df.select(*keys, *made)
    return run
