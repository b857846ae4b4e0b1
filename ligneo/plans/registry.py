"""Registry of the demonstration queries and of the SQL that checks them."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a query `(spark, sf_dir) -> DataFrame` and, when there is one, its SQL."""

    def register(function):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
