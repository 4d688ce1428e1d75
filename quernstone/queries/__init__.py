"""Every operator of the archive as a query over the generated tables, beside its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.sources import bindings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """Archive tables, and generated ones, of one folder: t.messages, t("orders")."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return bindings.table(self.spark, self.sf_dir, name)

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, tables: str = ""):
    """Registers a function of Tables under its own name. sql may use the named archive tables, and any generated one."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = sql.strip()
            if tables:
                head = bindings.sql(*tables.split())
                body = f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
            SQL[f.__name__] = body
        return f

    return register


from quernstone.queries import lifecycle, logs, parsing, states, tables, written  # noqa: E402, F401  (they register themselves)
