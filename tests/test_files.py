from braidgraph import cli
from braidgraph.functions.pattern import Pattern
from braidgraph.operators.graph import GraphTables
from braidgraph.sources import graph_files as files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_graph(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("t 3 3\nv 0 5 2\nv 1 6 1\n\ne 1 0 9\ne 0 1 3\ne 2 2 1\ne 0 7 4\n")
    assert files.has_header(spark, str(path)) and files.has_edge_labels(spark, str(path))
    g = GraphTables.load(*files.read_graph(spark, str(path)))
    assert rows(g.vertices) == [(0, 5), (1, 6), (7, 7)]  # an undeclared vertex gets the label after the largest
    assert rows(g.edges.select("src", "dst", "elabel", "src_label", "dst_label")) == [(0, 1, 3, 5, 6), (0, 7, 4, 5, 7)]
    assert tuple(g.summary().first()) == (3, 3, 1, 2, 2)
    files.write_graph(g.vertices, g.edges, str(tmp_path / "out"))
    again = GraphTables.load(*files.read_graph(spark, str(tmp_path / "out")))
    assert rows(again.vertices) == rows(g.vertices) and rows(again.edges) == rows(g.edges)


def test_edges_without_labels(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("v 0 1\nv 1 1\ne 0 1\n")
    assert not files.has_header(spark, str(path)) and not files.has_edge_labels(spark, str(path))
    assert rows(files.read_graph(spark, str(path))[1]) == [(0, 1, 0)]
    (tmp_path / "pairs").write_text("0 1\n2 3\n")
    assert rows(files.read_edge_list(spark, str(tmp_path / "pairs"))) == [(0, 1, 0), (2, 3, 0)]


def test_update_stream(spark, tmp_path):
    path = tmp_path / "u.txt"
    path.write_text("# comment\nv 9 4\ne 1 2 0\n-e 1 2 0\n\nx y z\ne 9 1 3\n")
    updates, vertices = files.read_updates(spark, str(path))
    assert rows(updates) == [(1, "+", 1, 2, 0), (2, "-", 1, 2, 0), (3, "+", 9, 1, 3)]
    assert rows(vertices) == [(9, 4)]


def test_labels_change_in_a_stream(spark, tmp_path):
    """A vertex line holds for what follows it; before it, the graph's label counts, or for new vertices the stream's."""
    (tmp_path / "g").write_text("v 0 0\nv 1 1\nv 2 0\nv 3 5\ne 0 1 0\n")
    (tmp_path / "u").write_text("e 1 2 0\nv 2 5\n-e 1 2 0\ne 1 2 0\ne 3 1 0\nv 3 0\ne 1 4 0\nv 4 0\n-e 3 1 0\ne 3 1 0\nv 2 0\n-e 1 2 0\ne 1 2 0\n")
    updates, known = files.read_labelled_updates(spark, str(tmp_path / "u"), *files.read_graph(spark, str(tmp_path / "g")))
    assert [(r.update_id, r.src_label, r.dst_label) for r in updates.orderBy("update_id").collect()] == [(1, 1, 0), (2, 1, 5), (3, 1, 5), (4, 5, 1), (5, 1, 0), (6, 0, 1), (7, 0, 1), (8, 1, 0), (9, 1, 0)]
    assert rows(known) == [(0, 0), (1, 1), (2, 0), (3, 5), (4, 0)]
    wedge = Pattern((0, 1, 0), ((0, 1, 0), (1, 2, 0)))
    for mode in ("plain", "anchored"):
        results, _ = cli.run(spark, str(tmp_path / "g"), wedge, str(tmp_path / "u"), mode)
        assert rows(results) == [(1, "+", 2), (2, "-", 2), (5, "+", 2), (7, "+", 4), (9, "+", 6)]


def test_binary_and_parquet(spark, tmp_path):
    v = spark.createDataFrame([(0, 1), (1, 2), (2, 2)], "id long, label int")
    e = spark.createDataFrame([(0, 1, 7), (1, 2, 8), (0, 2, 9)], "src long, dst long, elabel int")
    files.write_csr(v, e, str(tmp_path / "csr"))
    v2, e2 = files.read_csr(spark, str(tmp_path / "csr"))
    assert rows(v2) == rows(v) and rows(e2) == rows(e)
    files.write_parquet(v, e, str(tmp_path / "pq"))
    v3, e3 = files.read_parquet(spark, str(tmp_path / "pq"))
    assert rows(v3) == rows(v) and rows(e3) == rows(e)
