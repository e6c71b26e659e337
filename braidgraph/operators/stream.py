"""Updates as edge instances with validity intervals, and what depends on the order of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidgraph.functions.pattern import Pattern
from braidgraph.functions.storage import prefix_sums
from braidgraph.operators.graph import both_ways

FOREVER = 9223372036854775807


def attach_updates(initial: DataFrame, updates: DataFrame, policy: str = "ignore") -> DataFrame:
    """Edge instances (src, dst, elabel, src_label, dst_label, ins, del) from the edges at the start and an update log.

    An edge is known by (src, dst, elabel). Inserting a present edge or deleting a missing one is ignored, or an
    error under policy "error" (raised when the plan runs). Only an edge's own updates are sorted together.
    """
    edge = ["src", "dst", "elabel", "src_label", "dst_label"]
    turned = updates.select("update_id", "op", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "elabel", F.when(F.col("src") <= F.col("dst"), F.col("src_label")).otherwise(F.col("dst_label")).alias("src_label"), F.when(F.col("src") <= F.col("dst"), F.col("dst_label")).otherwise(F.col("src_label")).alias("dst_label"))
    start = initial.select(F.lit(0).cast("long").alias("update_id"), F.lit("+").alias("op"), *edge)
    by_edge = Window.partitionBy("src", "dst", "elabel").orderBy("update_id")
    log = start.union(turned).withColumn("before", F.coalesce(F.lag("op").over(by_edge), F.lit("-")))
    if policy == "error":
        log = log.withColumn("op", F.when(F.col("op") == F.col("before"), F.raise_error(F.concat(F.lit("update of an edge in that state already: "), F.col("update_id").cast("string")))).otherwise(F.col("op")))
    changes = log.where("op <> before").withColumn("del", F.coalesce(F.lead("update_id").over(by_edge), F.lit(FOREVER)))
    return changes.where("op = '+'").select(*edge, F.col("update_id").alias("ins"), "del")


def relevant(spark: SparkSession, updates: DataFrame, p: Pattern) -> DataFrame:
    """Updates whose label triple occurs in the pattern."""
    triples = spark.createDataFrame(sorted(p.triples()), "src_label int, elabel int, dst_label int")
    return updates.join(F.broadcast(triples), ["src_label", "elabel", "dst_label"], "left_semi")  # 2 rows a pattern edge at most


def anchors(spark: SparkSession, updates: DataFrame, p: Pattern) -> DataFrame:
    """Updates with the orbits of directed pattern edges that they can anchor: orbit number and size."""
    rows = []
    for i, orbit in enumerate(p.edge_orbits):
        u, v = orbit[0]
        rows.append((i, len(orbit), p.labels[u], p.adjacent[u][v], p.labels[v]))
    orbits = spark.createDataFrame(rows, "orbit int, orbit_size int, src_label int, elabel int, dst_label int")
    return updates.join(F.broadcast(orbits), ["src_label", "elabel", "dst_label"])


def matching_edges(spark: SparkSession, updates: DataFrame, p: Pattern) -> DataFrame:
    """Updates with every directed pattern edge (qsrc, qdst) that their labels allow."""
    rows = [(a, b, p.labels[a], k, p.labels[b]) for u, v, k in p.edges for a, b in ((u, v), (v, u))]
    directed = spark.createDataFrame(rows, "qsrc int, qdst int, src_label int, elabel int, dst_label int")
    return updates.join(F.broadcast(directed), ["src_label", "elabel", "dst_label"])  # 2 rows a pattern edge


def running_size(updates: DataFrame, initial: DataFrame) -> DataFrame:
    """Edges of each label after each of its updates: sums inside ranges of the log, however many updates a label has."""
    start = initial.groupBy("elabel").agg(F.count("*").alias("start"))
    steps = updates.select("update_id", "op", "elabel", F.when(F.col("op") == "+", 1).otherwise(-1).alias("step"))
    return prefix_sums(updates.sparkSession, steps, ["elabel"], ["update_id"], "step", "change", "running").join(start, "elabel", "left").select("update_id", "op", "elabel", (F.coalesce("start", F.lit(0)) + F.col("change")).cast("long").alias("size"))


def candidate_flips(spark: SparkSession, instances: DataFrame, p: Pattern) -> DataFrame:
    """(update_id, qv, id, gained): updates by which a vertex becomes or stops being a candidate of a query vertex.

    Each requirement (edge label, neighbour label, count) of a query vertex is a running count around a data vertex; the number of
    requirements met is a second running sum, and a flip is where it reaches or leaves the number needed.
    """
    rows = [(v, p.labels[v], k, label, n, len(p.neighbour_counts(v))) for v in range(p.n) for (k, label), n in p.neighbour_counts(v).items()]
    needs = spark.createDataFrame(rows, "qv int, src_label int, elabel int, dst_label int, need long, needs int")
    arcs = both_ways(instances)
    events = arcs.select("src", "src_label", "elabel", "dst_label", F.inline(F.array(F.struct(F.col("ins").alias("at"), F.lit(1).alias("step")), F.struct(F.col("del").alias("at"), F.lit(-1).alias("step"))))).where(F.col("at") < FOREVER)
    of = events.join(F.broadcast(needs), ["src_label", "elabel", "dst_label"]).groupBy("qv", "needs", "need", "src", "elabel", "dst_label", "at").agg(F.sum("step").alias("step"))
    around = Window.partitionBy("qv", "src", "elabel", "dst_label").orderBy("at")
    count = of.withColumn("n", F.sum("step").over(around))
    met = count.select("qv", "needs", "src", "at", ((F.col("n") >= F.col("need")).cast("int") - (F.col("n") - F.col("step") >= F.col("need")).cast("int")).alias("step")).where("step <> 0")
    both = met.groupBy("qv", "needs", "src", "at").agg(F.sum("step").alias("step")).where("step <> 0")
    total = both.withColumn("met", F.sum("step").over(Window.partitionBy("qv", "src").orderBy("at")))
    now, before = F.col("met") == F.col("needs"), F.col("met") - F.col("step") == F.col("needs")
    return total.where(now != before).where("at > 0").select(F.col("at").alias("update_id"), "qv", F.col("src").alias("id"), now.alias("gained"))


def counters(spark: SparkSession, updates: DataFrame, results: DataFrame, p: Pattern) -> DataFrame:
    """One row: updates processed, relevant, with matches, matches gained and lost."""
    of = relevant(spark, updates, p).select("update_id", F.lit(1).alias("hit"))
    seen = updates.join(of, "update_id", "left").join(results.select("update_id", "matches"), "update_id", "left")
    sums = {"processed": F.count("*"), "relevant": F.count("hit"), "with_matches": F.count("matches"), "gained": F.sum(F.when(F.col("op") == "+", F.col("matches"))), "lost": F.sum(F.when(F.col("op") == "-", F.col("matches")))}
    return seen.agg(*[F.coalesce(x, F.lit(0)).cast("long").alias(k) for k, x in sums.items()])


