"""All registered queries of the signal, picture and event operators."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under a name."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict:
    return _SQL


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from wavegrid.plans import event_queries, kernel_queries, literal_queries, run_queries, table_queries  # noqa: E402, F401  they register themselves
