"""Queries of the engine by name. `run` applies one to given tables; `queries` and `oracle_sql` are what the driver reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import joins, palette, structure, tokens, typography
from weftline.functions import text
from weftline.sources.shared import written
from weftline.streaming import limiter

from . import checks, lanes, reports, trees
from .dialect import Dialect, check_sql, doubles

FLAGSHIP = "h7_palette_roles"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> function of a dialect that gives the SQL.
PLANS: dict = {**palette.PLANS, **typography.PLANS, **tokens.PLANS, **joins.PLANS, **structure.PLANS, **text.PLANS, **limiter.PLANS}
#: name -> function (spark, sf_dir) of the operators that SQL does not express.
FUNCTIONS: dict = {**limiter.FUNCTIONS, **trees.QUERIES, **checks.QUERIES, **reports.QUERIES, **lanes.QUERIES}


def run(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A plan over the given tables; only the tables it names are looked at."""
    prefix = f"w{uuid.uuid4().hex[:12]}_"
    d = Dialect(True, {"": prefix} | {t: prefix + t for t in tables})
    last = PLANS[name](d)
    every = " ".join([*(x for x in d.steps.values() if isinstance(x, str)), last])
    made = [t for t in tables if prefix + t in every]
    try:
        for t in made:
            tables[t].createOrReplaceTempView(prefix + t)
        for step, sql in d.steps.items():
            made.append(step)
            if isinstance(sql, tuple):
                source, function, schema = sql
                rows = spark.table(prefix + source)
                key = rows.schema["capture_id"].dataType.simpleString()
                df = rows.groupBy("capture_id").applyInPandas(function, schema.replace("capture_id bigint", f"capture_id {key}"))
            else:
                df = spark.sql(doubles(sql))
            (written(df) if step in d.cuts else df).createOrReplaceTempView(prefix + step)
        return spark.sql(doubles(last))
    finally:
        for t in made:
            spark.catalog.dropTempView(prefix + t)


class _Lazy(dict):
    """Tables that are opened when they are named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.dir = spark, sf_dir

    def __iter__(self):
        return iter(TABLES)

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def queries() -> dict:
    return {name: (lambda spark, sf_dir, name=name: run(spark, name, _Lazy(spark, sf_dir))) for name in PLANS} | FUNCTIONS


def oracle_sql() -> dict:
    return {name: check_sql(plan) for name, plan in PLANS.items()} | checks.ORACLES | reports.ORACLES | lanes.ORACLES
