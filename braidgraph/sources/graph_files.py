"""Graph and update-stream files: text with or without a header, binary CSR folders, edge lists, Parquet.

Text formats: `v <id> <label> [degree]`, `e <u> <v> [edge label]`, an optional `t <vertices> <edges>` header; update streams
add `-e <u> <v> <label>` for deletions and `#` comments. Readers split lines in Spark; only the binary format needs Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidgraph.functions.storage import number_rows
from braidgraph.operators.graph import all_vertices, with_labels

#: File names of a binary CSR folder (fixed values).
CSR_FILES = ("b_degree.bin", "b_adj.bin", "b_vertex_label.bin", "b_edge_label.bin")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    line = F.trim(F.col("value"))
    return spark.read.text(path).select(F.split(line, r"\s+").alias("w"), line.alias("line")).where("line <> ''")


def _long(i: int) -> F.Column:
    return F.get("w", F.lit(i)).cast("long")


def has_header(spark: SparkSession, path: str) -> bool:
    """Whether a text graph starts with `t <vertices> <edges>`."""
    return not spark.read.text(path).where(F.col("value").rlike(r"^\s*t\s+\d+\s+\d+")).isEmpty()


def has_edge_labels(spark: SparkSession, path: str) -> bool:
    """Whether its edge lines carry a label."""
    edges = _lines(spark, path).where("w[0] = 'e'")
    return not edges.isEmpty() and edges.where(F.size("w") < 4).isEmpty()


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) as written in a text graph; edges without a label get 0. Degrees are not trusted but counted."""
    lines = _lines(spark, path)
    vertices = lines.where("w[0] = 'v'").select(_long(1).alias("id"), _long(2).cast("int").alias("label"))
    edges = lines.where("w[0] = 'e'").select(_long(1).alias("src"), _long(2).alias("dst"), F.coalesce(_long(3), F.lit(0)).cast("int").alias("elabel"))
    return vertices, edges


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A text graph without header, vertices first within each file part."""
    v = vertices.select(F.concat_ws(" ", F.lit("v"), "id", "label").alias("value"))
    e = edges.select(F.concat_ws(" ", F.lit("e"), "src", "dst", "elabel").alias("value"))
    v.union(e).write.text(path)


#: Where a line of a stream stands.
LINE = ["file", "block", "at"]


def _stream(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(updates, vertices) of a stream file, each with its line."""
    raw = spark.read.text(path, wholetext=False).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    words = raw.withColumn("w", F.split(F.trim("value"), r"\s+"))
    edges = words.where("w[0] in ('e', '-e')").select(*LINE, F.when(F.col("w")[0] == "e", "+").otherwise("-").alias("op"), _long(1).alias("src"), _long(2).alias("dst"), F.coalesce(_long(3), F.lit(0)).cast("int").alias("elabel"))
    updates = number_rows(spark, edges, [F.col("file"), F.col("block"), F.col("at")], "update_id", "stream")
    return updates, words.where("w[0] = 'v'").select(*LINE, _long(1).alias("id"), _long(2).cast("int").alias("label"))


def read_updates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(updates, vertices) of a stream file. updates: update_id (place among the updates, in file order), op, src, dst,
    elabel; vertices: ids and labels that the stream declares."""
    updates, vertices = _stream(spark, path)
    return updates.select("update_id", "op", "src", "dst", "elabel"), vertices.select("id", "label")


def read_labelled_updates(spark: SparkSession, path: str, vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updates with src_label and dst_label, vertices with the labels at the start). A `v` line of the stream labels its vertex for all updates
    behind it; until the first one, a vertex has its label of the graph, or else the least one that the stream gives it, or else
    the label after the largest one. Edges keep the labels with which they came."""
    updates, declared = _stream(spark, path)
    new = declared.select("id", "label").join(vertices.select("id"), "id", "left_anti")
    known = all_vertices(vertices.select("id", "label").union(new), edges.select("src", "dst").union(updates.select("src", "dst")))
    ends = [updates.select(*LINE, F.col(end).alias("id"), "update_id", F.lit(end).alias("end"), F.lit(None).cast("int").alias("label")) for end in ("src", "dst")]
    touched = ends[0].union(ends[1]).join(declared.select("id").distinct(), "id", "left_semi").select(*LINE, "id", "update_id", "end", "label")
    lines = touched.union(declared.select(*LINE, "id", F.lit(None).cast("long"), F.lit(None).cast("string"), "label"))
    so_far = F.last("label", ignorenulls=True).over(Window.partitionBy("id").orderBy(*LINE).rowsBetween(Window.unboundedPreceding, 0))  # only of vertices that the stream labels
    found = lines.withColumn("label", so_far).where("update_id is not null and label is not null").select("update_id", "end", "label")
    plain = with_labels(updates.select("update_id", "op", "src", "dst", "elabel"), known)
    for end in ("src", "dst"):
        plain = plain.join(found.where(F.col("end") == end).select("update_id", F.col("label").alias("now")), "update_id", "left").withColumn(f"{end}_label", F.coalesce("now", f"{end}_label")).drop("now")
    return plain.select("update_id", "op", "src", "dst", "elabel", "src_label", "dst_label"), known


def _csr_paths(folder: str) -> list[str]:
    return [f"{folder.rstrip('/')}/{name}" for name in CSR_FILES]


def read_csr(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a binary CSR folder. The format is one sequence a file, so one task reads it; for large graphs,
    write Parquet once and read that."""
    degree, adjacent, vlabel, elabel = _csr_paths(folder)
    bytes_of = lambda p, name: spark.read.format("binaryFile").load(p).select(F.col("content").alias(name))
    files = bytes_of(degree, "d").join(bytes_of(adjacent, "a")).join(bytes_of(vlabel, "l")).join(bytes_of(elabel, "k"))

    def vertices(frames):
        for f in frames:
            for blob in f["l"]:
                label = np.frombuffer(blob, "<u4")
                yield pd.DataFrame({"id": np.arange(len(label), dtype=np.int64), "label": label.astype(np.int32)})

    def edges(frames):
        for f in frames:
            for d, a, k in zip(f["d"], f["a"], f["k"], strict=True):
                size, n, _m = np.frombuffer(d, "<u4", 3)
                if size != 4:
                    raise ValueError("only 4-byte integers are read")
                src = np.repeat(np.arange(n, dtype=np.int64), np.frombuffer(d, "<u4", n, 12))
                dst = np.frombuffer(a, "<u4").astype(np.int64)
                keep = src < dst
                yield pd.DataFrame({"src": src[keep], "dst": dst[keep], "elabel": np.frombuffer(k, "<u4").astype(np.int32)[keep]})

    return files.select("l").mapInPandas(vertices, "id long, label int"), files.select("d", "a", "k").mapInPandas(edges, "src long, dst long, elabel int")


def csr_bytes(vertices: pd.DataFrame, edges: pd.DataFrame) -> dict[str, bytes]:
    """Contents of the four files for a graph with ids 0 .. n-1 that fits one machine (the format's own limit)."""
    n = len(vertices)
    both = pd.concat([edges, edges.rename(columns={"src": "dst", "dst": "src"})]).sort_values(["src", "dst"])
    degree = np.bincount(both["src"], minlength=n)
    columns = [np.r_[4, n, len(edges), degree], both["dst"], vertices.sort_values("id")["label"], both["elabel"]]
    return {name: np.asarray(c, "<u4").tobytes() for name, c in zip(CSR_FILES, columns, strict=True)}


def write_csr(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    """Binary CSR folder through Spark's file system (any store)."""
    spark = vertices.sparkSession
    jvm = spark.sparkContext._jvm
    for name, blob in csr_bytes(vertices.toPandas(), edges.toPandas()).items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(blob))
        out.close()


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """`u v` a line -> edges with label 0."""
    return _lines(spark, path).where(F.col("line").rlike(r"^\d+\s+\d+")).select(_long(0).alias("src"), _long(1).alias("dst"), F.lit(0).alias("elabel"))


def write_parquet(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    vertices.write.parquet(f"{folder}/vertices")
    edges.write.parquet(f"{folder}/edges")


def read_parquet(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/vertices"), spark.read.parquet(f"{folder}/edges")
