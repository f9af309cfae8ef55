"""Rule tables as queries: every order stands for one case of the table, so the rule runs over a whole table.

The expected outcomes are stated as VALUES in SQL, worked out by hand from the
rule, and joined to the same orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources import tables


def over_orders(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """Each order with the case of its key; the table of cases is written out in the query, which bounds the broadcast."""
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "case_no int, " + schema)
    orders = tables.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % len(rows)).cast("int").alias("case_no"))
    # one small number per row is dealt over all cores before the rule is worked out
    orders = orders.repartition(spark.sparkContext.defaultParallelism)
    return orders.join(F.broadcast(cases), "case_no")


def tallied(df: DataFrame, **outcomes: Column) -> DataFrame:
    """The outcomes of each case and how many orders came to them."""
    named = df.select("case_no", *[c.alias(name) for name, c in outcomes.items()])
    return named.groupBy("case_no", *outcomes).agg(F.count(F.lit(1)).alias("n"))


def _literal(v, kind: type) -> str:
    if v is None:
        return f"CAST(NULL AS {({int: 'INTEGER', bool: 'BOOLEAN'}).get(kind, 'VARCHAR')})"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def expected(columns: list[str], rows: list[tuple]) -> str:
    """SQL for what tallied() must give."""
    kinds = [next((type(r[k]) for r in rows if r[k] is not None), str) for k in range(len(columns))]
    values = ", ".join(f"({i}, {', '.join(map(_literal, r, kinds))})" for i, r in enumerate(rows))
    names = ", ".join(columns)
    return f"SELECT case_no, {names}, count(*) AS n FROM (VALUES {values}) v(case_no, {names}) JOIN orders ON o_orderkey % {len(rows)} = case_no GROUP BY ALL"
