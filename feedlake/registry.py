"""All queries of the library's own operators: name -> (function of (spark, sf_dir), DuckDB SQL)."""

from __future__ import annotations

from .plans import extensions, ingest_queries, library_queries, parsing, table_queries


def _utc(query):
    """Dates without an offset are UTC, so the session's zone is, while the query is made; expressions keep it."""

    def run(spark, sf_dir):
        name = "spark.sql.session.timeZone"
        before = spark.conf.get(name)
        spark.conf.set(name, "UTC")
        try:
            return query(spark, sf_dir)
        finally:
            spark.conf.set(name, before)

    return run


REGISTRY = {name: (_utc(f), sql) for module in (parsing, library_queries, ingest_queries, table_queries, extensions) for name, (f, sql) in module.QUERIES.items()}
