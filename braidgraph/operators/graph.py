"""Graph tables and the operators on them: canonical edges, arcs, views, degrees, neighbour counts, candidates, cores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidgraph.functions.pattern import Pattern
from braidgraph.functions.storage import materialize, prefix_sums
from braidgraph.operators import lookup

#: Of grouped pairs in one row of `GroupedPairs.packets`: sources at most (by hash, so about), and pairs.
PACKET_SOURCES, PACKET_PAIRS = 1 << 12, 1 << 20


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Edges without loops, src < dst, one a pair; of several labels the least stays."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "elabel").groupBy("src", "dst").agg(F.min("elabel").alias("elabel"))


def all_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared vertices, and endpoints nobody declared with the label after the largest one."""
    declared = vertices.groupBy("id").agg(F.min("label").alias("label"))
    spare = (declared.agg(F.max("label").alias("m")).first().m or 0) + 1
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(declared, "id", "full").select("id", F.coalesce("label", F.lit(spare)).cast("int").alias("label"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Arcs: every edge in both orientations, in one pass (extra columns stay)."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "src_label", "dst_label")]
    labelled = "src_label" in edges.columns
    one = F.struct(*[F.col(c) for c in ("src", "dst", *(("src_label", "dst_label") if labelled else ()))])
    other = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *((F.col("dst_label").alias("src_label"), F.col("src_label").alias("dst_label")) if labelled else ()))
    return edges.select(*rest, F.inline(F.array(one, other)))


def with_labels(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """src_label and dst_label looked up."""
    s = vertices.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    d = vertices.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(s, "src", "left").join(d, "dst", "left")


@dataclass
class GraphTables:
    """vertices (id, label) and labelled canonical edges (src, dst, elabel, src_label, dst_label)."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def load(cls, vertices: DataFrame, edges: DataFrame) -> GraphTables:
        plain = canonical_edges(edges)
        known = all_vertices(vertices, plain)
        return cls(known, with_labels(plain, known))

    @property
    def arcs(self) -> DataFrame:
        return both_ways(self.edges)

    def summary(self) -> DataFrame:
        """Vertices, edges, labels, largest degree, largest label frequency."""
        labels = label_frequency(self.vertices).agg(F.sum("n").alias("vertices"), F.count("*").alias("labels"), F.max("n").alias("max_label_frequency"))
        degrees = degree(self.arcs).agg((F.sum("degree") / 2).cast("long").alias("edges"), F.max("degree").alias("max_degree"))
        return labels.join(degrees)  # one row each


def label_frequency(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("label").agg(F.count("*").alias("n"))


def degree(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def degree_offsets(spark: SparkSession, arcs: DataFrame) -> DataFrame:
    """id, degree and the sum of degrees of smaller ids. The sums run inside range partitions; partition totals are added after."""
    summed = prefix_sums(spark, degree(arcs), [], ["id"], "degree", "upto", "degrees")
    return summed.select("id", "degree", (F.col("upto") - F.col("degree")).alias("offset"))


def label_offsets(spark: SparkSession, arcs: DataFrame) -> DataFrame:
    """id, nlabel, n and offset: where the neighbours with a label start in the list of all arcs sorted by vertex and neighbour label."""
    counts = arcs.groupBy(F.col("src").alias("id"), F.col("dst_label").alias("nlabel")).agg(F.count("*").alias("n"))
    summed = prefix_sums(spark, counts, [], ["id", "nlabel"], "n", "upto", "label-counts")
    return summed.select("id", "nlabel", "n", (F.col("upto") - F.col("n")).alias("offset"))


def label_index(spark: SparkSession, vertices: DataFrame) -> DataFrame:
    """label, id and the place (from 0) of the id among the sorted ids of its label."""
    placed = prefix_sums(spark, vertices.select("label", "id", F.lit(1).alias("one")), ["label"], ["id"], "one", "upto", "label-index")
    return placed.select("label", "id", (F.col("upto") - 1).alias("place"))


def neighbour_labels(arcs: DataFrame) -> DataFrame:
    """(id, elabel, nlabel, n): neighbours of each vertex by edge label and label."""
    return arcs.groupBy(F.col("src").alias("id"), F.col("src_label").alias("label"), "elabel", F.col("dst_label").alias("nlabel")).agg(F.count("*").alias("n"))


def neighbour_map(arcs: DataFrame) -> DataFrame:
    """id and a map from neighbour label to count."""
    return arcs.groupBy(F.col("src").alias("id"), "dst_label").agg(F.count("*").alias("n")).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dst_label", "n")))).alias("neighbours"))


def edge_exists(pairs: DataFrame, arcs: DataFrame, negate: bool = False, elabel: int | None = None, src_label: int | None = None, dst_label: int | None = None) -> DataFrame:
    """Pairs (src, dst) with an edge between them, or without one; only edges with the labels that are given count."""
    return pairs.join(_plain(arcs, elabel, src_label, dst_label), ["src", "dst"], "left_anti" if negate else "left_semi")


def _plain(arcs: DataFrame, elabel: int | None, src_label: int | None, dst_label: int | None) -> DataFrame:
    for column, label in (("elabel", elabel), ("src_label", src_label), ("dst_label", dst_label)):
        if label is not None:
            arcs = arcs.where(F.col(column) == label)
    return arcs.select("src", "dst").distinct()


def edge_label_lookup(pairs: DataFrame | GroupedPairs, arcs: DataFrame) -> DataFrame:
    """Pairs with the label of their edge, null without one; of grouped pairs: src, dst, elabel and `pairs`, how many pairs the row stands for."""
    if isinstance(pairs, GroupedPairs):
        return pairs.packets(arcs).mapInArrow(lookup.labelled, "src long, dst long, elabel int, pairs long")
    return pairs.join(arcs.select("src", "dst", "elabel"), ["src", "dst"], "left")


@dataclass
class GroupedPairs:
    """All pairs of a `left` row (group, src) and a `right` row (group, dst) of the same group, without a row for each pair."""

    left: DataFrame
    right: DataFrame

    def with_edges(self, edges: DataFrame) -> DataFrame:
        """Pairs that have an edge: group, src, dst, other columns of edges, and `pairs`, how many pairs the row stands for."""
        left, right = (df.groupBy("group", end).agg(F.count("*").alias(n)) for df, end, n in ((self.left, "src", "__left"), (self.right, "dst", "__right")))
        return edges.join(left, "src").join(right, ["group", "dst"]).withColumn("pairs", F.col("__left") * F.col("__right")).drop("__left", "__right")

    def packets(self, arcs: DataFrame) -> DataFrame:
        """All pairs, dealt out: every row has some sources and some ends of one group (`srcs`, `dsts`; those with copies, and null, once
        more with their number in `src_copies`, `dst_copies`), and the edges from the group's sources that the two may have (edge_src,
        edge_dst, edge_label; null: none). Each pair is in one row; sources are repeated for each PACKET_PAIRS pairs."""
        l, r = (df.groupBy("group").agg(F.count("*").alias(n)) for df, n in ((self.left, "l"), (self.right, "r")))
        blocks, parts = F.ceil(F.col("l") / PACKET_SOURCES).cast("int"), F.ceil(F.col("r") * F.least("l", F.lit(PACKET_SOURCES)) / PACKET_PAIRS).cast("int")
        part_of = lambda end, n: F.pmod(F.xxhash64(end), F.col(n)).cast("int")
        left = self.left.groupBy("group", "src").agg(F.count("*").alias("copies")).join(l.join(r, "group").select("group", blocks.alias("blocks"), parts.alias("parts")), "group")
        left = materialize(self.left.sparkSession, left.withColumn("block", part_of("src", "blocks")), "sources")  # of known size: sent to the tasks if small
        right = self.right.groupBy("group", "dst").agg(F.count("*").alias("copies")).join(left.select("group", "blocks", "parts").distinct(), "group")
        right = right.withColumn("part", part_of("dst", "parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        near = arcs.where("dst is not null").select("src", "dst", "elabel").join(left.select("group", "block", "parts", "src"), "src").withColumn("part", part_of("dst", "parts"))
        longs = lambda c, name: F.collect_list(F.col(c).cast("long")).alias(name)
        more = lambda c, name: F.collect_list(F.when(F.col(c).isNull() | (F.col("copies") > 1), F.struct(F.col(c).cast("long").alias("id"), "copies"))).alias(name)
        srcs = left.groupBy("group", "block").agg(longs("src", "srcs"), more("src", "src_copies"))
        dsts = right.groupBy("group", "block", "part").agg(longs("dst", "dsts"), more("dst", "dst_copies"))
        label = F.coalesce(F.col("elabel").cast("long"), F.lit(lookup.NO_LABEL))
        edges = near.withColumn("label", label).groupBy("group", "block", "part").agg(longs("src", "edge_src"), longs("dst", "edge_dst"), longs("label", "edge_label"))  # in one order
        return dsts.join(edges, ["group", "block", "part"], "left").join(srcs, ["group", "block"]).drop("group", "block", "part")

    def totals(self) -> DataFrame:
        """One row: pairs, and the sum of their src (decimal), of all pairs, from the sizes of the groups."""
        left = self.left.groupBy("group").agg(F.count("*").alias("l"), F.sum(F.col("src").cast("decimal(20,0)")).alias("srcs"))
        both = left.join(self.right.groupBy("group").agg(F.count("*").alias("r")), "group")
        return both.agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("srcs") * F.col("r").cast("decimal(12,0)")), F.lit(0)).cast("decimal(38,0)").alias("srcs"))


def edge_exists_counts(pairs: GroupedPairs, arcs: DataFrame, elabel: int | None = None, src_label: int | None = None, dst_label: int | None = None) -> DataFrame:
    """found, n, srcs: of the pairs with an edge and of those without one, how many there are and the sum of their src (null if it is no long).
    Only pairs with an edge are rows anywhere; the others are what is left of all."""
    product = F.col("src").cast("decimal(20,0)") * F.col("pairs").cast("decimal(12,0)")
    there = pairs.with_edges(_plain(arcs, elabel, src_label, dst_label)).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("with_n"), F.coalesce(F.sum(product), F.lit(0)).cast("decimal(38,0)").alias("with_srcs"))
    both = pairs.totals().join(F.broadcast(there))  # one row each
    of = lambda found, n, srcs: F.struct(F.lit(found).alias("found"), n.alias("n"), srcs.cast("decimal(38,0)").alias("srcs"))
    rows = F.array(of(True, F.col("with_n"), F.col("with_srcs")), of(False, F.col("n") - F.col("with_n"), F.col("srcs") - F.col("with_srcs")))
    return both.select(F.inline(rows)).where("n > 0").select("found", "n", F.expr("try_cast(srcs AS bigint)").alias("srcs"))


def edge_label_counts(pairs: GroupedPairs, arcs: DataFrame) -> DataFrame:
    """elabel, n: all pairs by the labels that `edge_label_lookup` finds, null for those without an edge. Every pair is looked up, one by
    one, and counted in the task where that is done."""
    found = pairs.packets(arcs).mapInArrow(lookup.counted, "elabel int, pairs long")
    return found.groupBy("elabel").agg(F.sum("pairs").alias("n"))


def pattern_rows(spark: SparkSession, p: Pattern) -> tuple[DataFrame, DataFrame]:
    """(qv, label) and (qsrc, qdst, elabel; both ways) of a pattern."""
    v = spark.createDataFrame([(i, k) for i, k in enumerate(p.labels)], "qv int, label int")
    e = spark.createDataFrame([r for a, b, k in p.edges for r in ((a, b, k), (b, a, k))], "qsrc int, qdst int, elabel int")
    return v, e


def candidates(spark: SparkSession, arcs: DataFrame, p: Pattern) -> DataFrame:
    """(qv, id): data vertices whose label and neighbour counts allow query vertex qv.

    The pattern's few requirements meet the neighbour counts by label; a vertex stays where it satisfies all of qv's.
    """
    rows = [(v, p.labels[v], k, label, n, len(p.neighbour_counts(v))) for v in range(p.n) for (k, label), n in p.neighbour_counts(v).items()]
    needs = spark.createDataFrame(rows, "qv int, label int, elabel int, nlabel int, need long, needs int")
    met = neighbour_labels(arcs).join(F.broadcast(needs), ["label", "elabel", "nlabel"]).where("n >= need")  # a row for each vertex of the pattern and kind of neighbour
    return met.groupBy("qv", "id").agg(F.count("*").alias("got"), F.first("needs").alias("needs")).where("got = needs").select("qv", "id")


def triple_view(edges: DataFrame, a: int, elabel: int, b: int, u: str = "src", v: str = "dst") -> DataFrame:
    """The relation of one label triple: columns u (label a) and v (label b), other columns as they are."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "src_label", "dst_label", "elabel")]
    if a == b:
        arcs = both_ways(edges.where((F.col("elabel") == elabel) & (F.col("src_label") == a) & (F.col("dst_label") == a)))
        return arcs.select(F.col("src").alias(u), F.col("dst").alias(v), *rest)
    forth = (F.col("src_label") == a) & (F.col("dst_label") == b)
    back = (F.col("src_label") == b) & (F.col("dst_label") == a)
    one = edges.where((F.col("elabel") == elabel) & (forth | back))
    return one.select(F.when(F.col("src_label") == a, F.col("src")).otherwise(F.col("dst")).alias(u), F.when(F.col("src_label") == a, F.col("dst")).otherwise(F.col("src")).alias(v), *rest)


def views(spark: SparkSession, arcs: DataFrame, p: Pattern) -> DataFrame:
    """Arcs of the pattern's label triples with the triple's number."""
    triples = spark.createDataFrame([(i, *t) for i, t in enumerate(sorted(p.triples()))], "view int, src_label int, elabel int, dst_label int")
    return arcs.join(F.broadcast(triples), ["src_label", "elabel", "dst_label"])  # at most 2 rows an edge of the pattern


def candidate_views(spark: SparkSession, arcs: DataFrame, p: Pattern) -> DataFrame:
    """Arcs of each directed pattern edge whose ends are both candidates: qsrc, qdst, src, dst."""
    found = candidates(spark, arcs, p)
    _, edges = pattern_rows(spark, p)
    labels = spark.createDataFrame(list(enumerate(p.labels)), "qv int, label int")
    q = edges.join(labels.toDF("qsrc", "src_label"), "qsrc").join(labels.toDF("qdst", "dst_label"), "qdst")
    named = arcs.join(F.broadcast(q), ["src_label", "elabel", "dst_label"])
    return named.join(found.toDF("qsrc", "src"), ["qsrc", "src"], "left_semi").join(found.toDF("qdst", "dst"), ["qdst", "dst"], "left_semi").select("qsrc", "qdst", "src", "dst")


def reduce_candidates(edges: DataFrame, p: Pattern) -> dict[int, DataFrame]:
    """Fully reduced candidates of a tree pattern: semi-joins from the leaves to the root and back."""
    if len(p.edges) != p.n - 1:
        raise ValueError("a full reduction by semi-joins needs a tree pattern")
    order = [0]
    parent: dict[int, int] = {}
    for v in order:
        for w in sorted(p.adjacent[v]):
            if w not in parent and w != 0:
                parent[w] = v
                order.append(w)
    rel = {w: triple_view(edges, p.labels[v], p.adjacent[v][w], p.labels[w], "up", "down") for w, v in parent.items()}
    for w in reversed(order[1:]):  # up: what is below must exist
        for x in (x for x in rel if parent[x] == w):
            rel[w] = rel[w].join(rel[x].select(F.col("up").alias("down")).distinct(), "down", "left_semi")
    at_root = reduce(lambda a, b: a.join(b, "id", "left_semi"), [rel[w].select(F.col("up").alias("id")).distinct() for w in rel if parent[w] == 0])
    found = {0: at_root}
    for w in order[1:]:  # down: what is above must exist
        found[w] = rel[w].join(found[parent[w]].withColumnRenamed("id", "up"), "up", "left_semi").select(F.col("down").alias("id")).distinct()
    return found


def prune_candidates(spark: SparkSession, edges: DataFrame, p: Pattern, rounds: int | None = None) -> DataFrame:
    """(qv, id): candidates of any connected pattern, cycles included, after `rounds` rounds of semi-joins (None: until nothing changes).

    In a round a data vertex stays a candidate of qv if for each of qv's edges it has a neighbour that was a candidate of the other end.
    No match is lost; for trees, rounds until nothing changes leave just the vertices of matches. All edges of the pattern are joined at
    once, every round is written, and only a count comes back.
    """
    _, directed = pattern_rows(spark, p)
    labels = spark.createDataFrame(list(enumerate(p.labels)), "qv int, label int")
    q = directed.join(labels.toDF("qsrc", "src_label"), "qsrc").join(labels.toDF("qdst", "dst_label"), "qdst")
    needs = spark.createDataFrame([(v, p.degree(v)) for v in range(p.n)], "qsrc int, needs int")
    views = both_ways(edges).select("src", "dst", "elabel", "src_label", "dst_label").join(F.broadcast(q), ["src_label", "elabel", "dst_label"]).select("qsrc", "qdst", "src", "dst")  # 2 rows a pattern edge
    views = materialize(spark, views, "views-0")
    n = 0
    while True:
        met = views.select("qsrc", "qdst", "src").distinct().groupBy("qsrc", "src").agg(F.count("*").alias("met"))
        found = materialize(spark, met.join(F.broadcast(needs), "qsrc").where("met = needs").select(F.col("qsrc").alias("qv"), F.col("src").alias("id")), f"candidates-{n}")
        n += 1
        if n == rounds:
            return found
        kept = views.join(found.toDF("qsrc", "src"), ["qsrc", "src"], "left_semi").join(found.toDF("qdst", "dst"), ["qdst", "dst"], "left_semi")
        before, views = views, materialize(spark, kept, f"views-{n}")
        if views.count() == before.count():
            return found


def common_neighbours(arcs: DataFrame) -> DataFrame:
    """(a, b, n) for vertices a < b of one label: neighbours that both have. `arcs`: from the side to be paired to the other."""
    left, right = arcs.select(F.col("src").alias("a"), F.col("dst").alias("w")), arcs.select(F.col("src").alias("b"), F.col("dst").alias("w"))
    return left.join(right, "w").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def intersect_adjacency(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sorted array of common neighbours: joined row by row, so that no vertex's whole list is ever held."""
    found = common_of_pairs(pairs, arcs).groupBy("a", "b").agg(F.sort_array(F.collect_list("w")).alias("common"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.array().cast("array<long>")).alias("common"))


def common_of_pairs(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """(a, b, w): the common neighbours of each pair, a row each. Of the three orders to join in, the one that makes fewest rows on the way."""
    pairs, plain = pairs.select("a", "b").distinct(), arcs.select("src", "dst").distinct()
    of_a, of_b = (plain.toDF(x, "w").join(pairs.select(x).distinct(), x, "left_semi") for x in "ab")
    order = min(sizes := _rows_on_the_way(pairs, of_a, of_b), key=sizes.get)
    if order == "w":
        found = of_a.join(of_b, "w").join(pairs, ["a", "b"])
    elif order == "a":
        found = pairs.join(of_a, "a").join(of_b, ["b", "w"])
    else:
        found = pairs.join(of_b, "b").join(of_a, ["a", "w"])
    return found.select("a", "b", "w")


def _rows_on_the_way(pairs: DataFrame, of_a: DataFrame, of_b: DataFrame) -> dict[str, int]:
    """Rows of joining the neighbours of a, or of b, to the pairs first, or both to each other by neighbour."""
    count = lambda df, by, n: df.groupBy(by).agg(F.count("*").cast("double").alias(n))
    total = lambda df: df.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0)).alias("rows")).first().rows
    return {
        "a": total(count(of_a, "a", "n").join(count(pairs, "a", "m"), "a")),
        "b": total(count(of_b, "b", "n").join(count(pairs, "b", "m"), "b")),
        "w": total(count(of_a, "w", "n").join(count(of_b, "w", "m"), "w")),
    }


def peel(arcs: DataFrame, k: int, rounds: int) -> DataFrame:
    """Arcs left after `rounds` rounds of removing vertices with fewer than k arcs."""
    for _ in range(rounds):
        strong = arcs.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("src")
        arcs = arcs.join(strong, "src", "left_semi").join(strong.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return arcs


def core_numbers(spark: SparkSession, arcs: DataFrame) -> DataFrame:
    """(id, core) of every vertex with an edge: h-index iteration. A vertex's number falls to the h-index of its neighbours' numbers
    until none changes; it starts from the degree and ends at the core number. Every round is written to the
    shared folder, and neighbours' numbers are counted, not collected."""
    arcs = materialize(spark, arcs.select("src", "dst"), "arcs")
    now = materialize(spark, degree(arcs).select("id", F.col("degree").alias("core")), "cores-0")
    for n in count(1):
        seen = arcs.join(now.withColumnRenamed("id", "dst"), "dst").join(now.select(F.col("id").alias("src"), F.col("core").alias("own")), "src")
        counts = seen.groupBy("src", "own", F.least("core", "own").alias("c")).agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("c")))
        after = counts.withColumn("h", F.least(F.col("c"), above)).groupBy(F.col("src").alias("id")).agg(F.max("h").alias("core"), F.first("own").alias("own"))
        after = materialize(spark, after, f"cores-{n}")
        now = after.select("id", "core")
        if after.where("core <> own").isEmpty():
            return now
