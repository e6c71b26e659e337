"""Command line: match a pattern over a graph and a stream of updates, all in the text formats.

    python -m braidgraph.cli -d graph.txt -q pattern.txt -u updates.txt [-mode plain] [-num MAX] [-time_limit 3600] [-out folder]

Prints updates processed, relevant and with matches, and the matches gained and lost; -out writes (update_id, op, matches) as
Parquet. Past the time limit all jobs are cancelled and no partial result is given.
"""

from __future__ import annotations

import argparse
import sys
import threading

from pyspark.sql import SparkSession

from braidgraph.functions.pattern import Pattern
from braidgraph.operators.graph import GraphTables, with_labels
from braidgraph.operators.stream import attach_updates, counters
from braidgraph.plans.compiler import MODES, explain
from braidgraph.plans.match import continuous_match
from braidgraph.sources import graph_files


def load_pattern(spark: SparkSession, path: str) -> Pattern:
    """A pattern from a text graph; its vertex ids are renumbered in order."""
    g = GraphTables.load(*graph_files.read_graph(spark, path))
    v = sorted((r.id, r.label) for r in g.vertices.collect())
    at = {x: i for i, (x, _) in enumerate(v)}
    return Pattern(tuple(k for _, k in v), tuple(sorted((at[r.src], at[r.dst], r.elabel) for r in g.edges.collect())), path)


def run(spark: SparkSession, graph: str, pattern: Pattern, updates: str, mode: str = "plain", limit: int | None = None):
    """(results, counters) of a run over files. Labels of updates come from the graph, and from the stream's own vertex lines before them."""
    vertices, edges = graph_files.read_graph(spark, graph)
    labelled, known = graph_files.read_labelled_updates(spark, updates, vertices, edges)
    start = with_labels(GraphTables.load(vertices, edges).edges.select("src", "dst", "elabel"), known)
    results = continuous_match(attach_updates(start, labelled), pattern, mode, limit)
    return results, counters(spark, labelled, results, pattern)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="braidgraph", description=__doc__.partition("\n")[0])
    p.add_argument("-d", required=True, help="data graph")
    p.add_argument("-q", required=True, help="pattern")
    p.add_argument("-u", required=True, help="update stream")
    p.add_argument("-mode", default="plain", choices=MODES)
    p.add_argument("-num", default="MAX", help="cap on matches of an update")
    p.add_argument("-time_limit", type=float, default=3600, help="seconds")
    p.add_argument("-out", help="folder for the results")
    p.add_argument("-explain", action="store_true", help="print the plan's units")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("braidgraph").getOrCreate()
    timer = threading.Timer(a.time_limit, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        pattern = load_pattern(spark, a.q)
        if a.explain:
            print(explain(pattern, a.mode))
        results, counts = run(spark, a.d, pattern, a.u, a.mode, None if a.num == "MAX" else int(a.num))
        if a.out:
            results.write.mode("overwrite").parquet(a.out)
        print(", ".join(f"{k} {v}" for k, v in counts.first().asDict().items()))
    finally:
        timer.cancel()
    return 0


if __name__ == "__main__":
    sys.exit(main())
