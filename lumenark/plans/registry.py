"""Registry of the engine's own queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenark.sources.views import PRELUDE, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "search_shortlist"


def query(oracle: str | None = None, recursive: bool = False):
    """Register ``f(views) -> DataFrame`` under its name; ``oracle`` is a DuckDB
    SELECT over the tables and the views of ``PRELUDE``, whose parts may be ``recursive``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = (PRELUDE.replace("WITH", "WITH RECURSIVE", 1) if recursive else PRELUDE) + oracle
        return f

    return add


from lumenark.plans import catalog_queries, edit_queries, graph_queries, lint_queries, ranked_queries, stream_queries, text_queries  # noqa: E402, F401
