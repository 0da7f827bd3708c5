"""Wide account rows, cells and registries derived from the TPC-H-like tables.

One customer is one borrower. Orders of 1995-2000 are six history periods and
2001 is the outcome period. Everything is a projection or one aggregate on the
customer key, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.definitions import WIDE_PERIODS
from riskpanel.functions.frames import as_rows

SOURCE_ID = "orders_by_customer"
LATEST_YEAR = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per customer with three measures in six periods.

    Orders are summed per customer before the join, so a customer with very
    many orders costs one partial row per map task.
    """
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey",
        "o_orderstatus",
        f"year(o_orderdate) - {LATEST_YEAR} AS period",
        "CAST(floor(o_totalprice) AS BIGINT) AS amount",
    )
    measures = []
    for p in WIDE_PERIODS:
        measures += [
            f"count_if(period = {p.offset} AND o_orderstatus = 'P') AS {p.status}",
            f"sum(CASE WHEN period = {p.offset} THEN amount END) AS {p.bill}",
            f"sum(CASE WHEN period = {p.offset} AND o_orderstatus = 'F' THEN amount END) AS {p.payment}",
        ]
    outcome = "max(CASE WHEN period = 1 AND o_orderstatus = 'P' THEN 1 END) AS outcome"
    history = orders.groupBy("o_custkey").agg(*[F.expr(m) for m in (*measures, outcome)])
    joined = table(spark, sf_dir, "customer").join(history, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.selectExpr(
        "c_custkey + 1 AS id",
        "CAST(floor(abs(c_acctbal) * 100) AS BIGINT) + 10000 AS limit_bal",
        "c_custkey % 2 + 1 AS sex",
        "CAST(c_nationkey % 7 AS BIGINT) AS education",
        "CAST(c_nationkey % 4 AS BIGINT) AS marriage",
        "c_custkey % 60 + 21 AS age",
        *[f"coalesce({p.status}, 0L) - 1 AS {p.status}" for p in WIDE_PERIODS],
        *[f"coalesce({p.bill}, 0L) AS {p.bill}" for p in WIDE_PERIODS],
        *[f"coalesce({p.payment}, 0L) AS {p.payment}" for p in WIDE_PERIODS],
        "CAST(coalesce(outcome, 0) AS BIGINT) AS default_payment_next_month",
        f"'{SOURCE_ID}' AS source_id",
        f"sha2('{SOURCE_ID}', 256) AS source_file_sha256",
        "c_custkey + 3 AS source_row_number",
    )


def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows ``(row_no, id, user, amount, k)`` from events, with damaged cells.

    Damage depends on the values themselves: a few values of ``k`` blank the
    id, break the amount, put the user out of range, repeat an earlier id, or write
    numbers with exponents and with fractions that no double can hold.
    """
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    k, event = F.col("k"), F.col("event_id")
    row = F.struct(
        event.alias("row_no"),
        F.when(k == "13", "").when(k == "23", F.floor(event / 2).cast("string")).otherwise(event.cast("string")).alias("id"),
        F.when(k == "17", "9999999999")
        .when(k == "29", "2147483647.0000000001")
        .when(k == "31", F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".50e3 ")))
        .otherwise(F.col("user_id").cast("string"))
        .alias("user"),
        F.when(k == "19", "n/a")
        .when(k == "37", "1.00000000000000001")
        .when(k == "41", "+120e-1")
        .when(k == "43", "15e-1")
        .when(F.col("event_type") == "error", F.format_string("%.2f", F.col("value")))
        .otherwise(F.floor("value").cast("string"))
        .alias("amount"),
        k,
    )
    # Laid out as rows so that later filters read the finished text and do not
    # repeat the work that makes it.
    return as_rows(events, [row])


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registered source per supplier, with the rows it delivered."""
    delivered = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "supplier").join(delivered, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select(
        F.col("s_name").alias("source_id"),
        F.sha2(F.col("s_name").cast("binary"), 256).alias("file_sha256"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("data_row_count"),
        F.col("s_nationkey").cast("bigint").alias("column_count"),
    )


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run status events: user = run, event type = step of the run."""
    status = (
        F.when(F.col("event_type") == "signup", "building")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("succeeded")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        status.alias("status"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("sequence"),
        F.floor("value").cast("bigint").alias("rejected_rows"),
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage nodes: orders, customers, nations and regions."""

    def part(name: str, key: str, prefix: str, node_type: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("canonical_name"),
            F.lit(node_type).alias("node_type"),
        )

    nodes = (
        part("orders", "o_orderkey", "o", "Result")
        .unionByName(part("customer", "c_custkey", "c", "Table"))
        .unionByName(part("nation", "n_nationkey", "n", "Transformation"))
        .unionByName(part("region", "r_regionkey", "r", "Source"))
    )
    return nodes.select(
        F.lit("data_lineage").alias("graph_scope"),
        "node_type",
        "canonical_name",
        F.lit("1").alias("version"),
        F.lit("validated").alias("status"),
        F.lit("Data").alias("owner"),
        F.concat(F.lit("table/"), F.col("canonical_name")).alias("path_or_object"),
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency edges ``o -> c -> n -> r`` by node name."""

    def part(name: str, child: str, child_prefix: str, parent: str, parent_prefix: str, edge_type: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(child_prefix), F.col(child).cast("string")).alias("from_name"),
            F.concat(F.lit(parent_prefix), F.col(parent).cast("string")).alias("to_name"),
            F.lit(edge_type).alias("edge_type"),
        )

    edges = (
        part("orders", "o_orderkey", "o", "o_custkey", "c", "computed_from")
        .unionByName(part("customer", "c_custkey", "c", "c_nationkey", "n", "validated_by"))
        .unionByName(part("nation", "n_nationkey", "n", "n_regionkey", "r", "computed_from"))
    )
    text = F.lit(None).cast("string")
    return edges.select(
        F.lit("data_lineage").alias("graph_scope"),
        "from_name",
        "to_name",
        "edge_type",
        text.alias("expected_sign"),
        F.lit(None).cast("int").alias("lag_months"),
        F.concat(F.lit("evidence/"), F.col("from_name")).alias("evidence_reference"),
        F.lit("2005-09-30").cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.lit("validated").alias("status"),
    )
