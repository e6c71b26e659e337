"""The property graph on the TPC-H-like tables: kinds as labels, foreign keys and line items as edges, dates as updates.

Vertex id = kind * 10**9 + key, label = kind: 1 region, 2 nation, 3 customer, 4 supplier, 5 part, 6 order.
Edge labels: 1 order-customer, 2 order-part, 3 part-supplier, 4 order-supplier, 5 supplier-nation, 6 customer-nation,
7 nation-region; 5 to 7 are there from the start, the others come at their (first) date, and an order-part edge goes 30 days
after its last shipment if all its lines were returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.functions.storage import discard, materialize, number_rows
from braidgraph.operators.stream import attach_updates

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = range(1, 7)
_written: dict[tuple[str, str, str], DataFrame] = {}


def _id(kind: int, column: str) -> F.Column:
    return (F.lit(kind * 1_000_000_000) + F.col(column)).cast("long")


def _day(column: str) -> F.Column:
    return F.unix_date(F.col(column).cast("date")).cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def declared_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds 1 to 5; orders are declared by nobody and get the next label, which is theirs."""
    parts = [read(spark, sf_dir, t).select(_id(kind, key).alias("id"), F.lit(kind).alias("label")) for kind, t, key in ((REGION, "region", "r_regionkey"), (NATION, "nation", "n_nationkey"), (CUSTOMER, "customer", "c_custkey"), (SUPPLIER, "supplier", "s_suppkey"), (PART, "part", "p_partkey"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def dated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, elabel, ins_day (null: from the start), del_day (null: never)."""
    lines, never, start = read(spark, sf_dir, "lineitem"), F.lit(None).cast("long"), F.lit(None).cast("long")
    columns = ["src", "dst", "elabel", "ins_day", "del_day"]
    ordered = read(spark, sf_dir, "orders").select(_id(CUSTOMER, "o_custkey"), _id(ORDER, "o_orderkey"), F.lit(1), _day("o_orderdate"), never).toDF(*columns)

    def supported(a: F.Column, b: F.Column, elabel: int, gone: F.Column) -> DataFrame:
        made = lines.select(a.alias("src"), b.alias("dst"), _day("l_shipdate").alias("day"), (F.col("l_returnflag") == "R").alias("returned"))
        made = made.groupBy("src", "dst").agg(F.min("day").alias("ins_day"), F.max("day").alias("last"), F.bool_and("returned").alias("returned"))
        return made.select("src", "dst", F.lit(elabel).alias("elabel"), "ins_day", gone.alias("del_day"))

    order_part = supported(_id(PART, "l_partkey"), _id(ORDER, "l_orderkey"), 2, F.when(F.col("returned"), F.col("last") + 30))
    part_supplier = supported(_id(SUPPLIER, "l_suppkey"), _id(PART, "l_partkey"), 3, never)
    order_supplier = supported(_id(SUPPLIER, "l_suppkey"), _id(ORDER, "l_orderkey"), 4, never)
    static = [read(spark, sf_dir, t).select(_id(ka, a), _id(kb, b), F.lit(elabel), start, never).toDF(*columns) for t, ka, a, kb, b, elabel in (("supplier", NATION, "s_nationkey", SUPPLIER, "s_suppkey", 5), ("customer", NATION, "c_nationkey", CUSTOMER, "c_custkey", 6), ("nation", REGION, "n_regionkey", NATION, "n_nationkey", 7))]
    out = ordered
    for part in (order_part, part_supplier, order_supplier, *static):
        out = out.union(part)
    return out.where("src is not null and dst is not null")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges that ever were: src, dst, elabel, src_label, dst_label. Written once, so that patterns with many edges
    keep small plans and their label filters reach a Parquet scan."""
    return _once(spark, sf_dir, "edges", lambda: with_kinds(dated_edges(spark, sf_dir).select("src", "dst", "elabel")))


def with_kinds(df: DataFrame) -> DataFrame:
    kind = lambda c: F.floor(F.col(c) / 1_000_000_000).cast("int").alias(f"{c}_label")
    return df.select("*", kind("src"), kind("dst"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """update_id, op, src, dst, elabel, src_label, dst_label: by day, deletions first, then by label and ends."""
    def build() -> DataFrame:
        dated = dated_edges(spark, sf_dir)
        events = F.array(F.struct(F.col("ins_day").alias("day"), F.lit("+").alias("op")), F.struct(F.col("del_day").alias("day"), F.lit("-").alias("op")))
        log = dated.select("src", "dst", "elabel", F.inline(events)).where("day is not null")
        return number_rows(spark, log, [F.col("day"), F.desc("op"), F.col("elabel"), F.col("src"), F.col("dst")], "update_id", "updates").select("update_id", "op", "src", "dst", "elabel")

    return with_kinds(_once(spark, sf_dir, "updates", build, own=True))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge instances with validity [ins, del) in update ids."""
    return _once(spark, sf_dir, "instances", lambda: attach_updates(with_kinds(dated_edges(spark, sf_dir).where("ins_day is null").select("src", "dst", "elabel")), updates(spark, sf_dir)))


def _once(spark: SparkSession, sf_dir: str, name: str, build, own: bool = False) -> DataFrame:
    """Written once for an application and input, then read: numbering sorts the whole log. `own`: intermediates that `build` wrote go then."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        built = build()
        _written[key] = materialize(spark, built, name)
        if own:
            discard(spark, built)
    return _written[key]


def forget() -> None:
    """After the shared folder was cleared: write the tables again when they are asked for."""
    _written.clear()
