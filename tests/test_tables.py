"""Changes of tables, ingest and snapshots on small rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skipweave.operators import crossref, graph, ledger, significance
from skipweave.sources import corpus


def test_ingest_reads_books_in_order(spark, tmp_path):
    (tmp_path / "Books.json").write_text(json.dumps(["Genesis", "Song of Solomon", "Ruth"]))
    book = {"chapters": [{"chapter": "1", "verses": [{"verse": "1", "text": "a"}, {"verse": "2", "text": "b"}]}]}
    for name in ("Genesis", "SongofSolomon"):
        (tmp_path / f"{name}.json").write_text(json.dumps(book))
    books, verses, missing = corpus.ingest_books(spark, f"file://{tmp_path}")
    assert missing == ["Ruth"]
    assert [(r.book_abbrev, r.verse_count) for r in books.orderBy("book_order").collect()] == [("GEN", 2), ("SOS", 2)]
    assert {r.id for r in verses.collect()} == {"GEN.1.1", "GEN.1.2", "SOS.1.1", "SOS.1.2"}


def test_upsert_and_ignore(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {tuple(r) for r in corpus.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in corpus.insert_ignore(old, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_snapshots_are_pruned(spark, tmp_path):
    one = spark.range(3)
    for stamp in ("2024-01-01", "2024-01-02", "2024-01-03"):
        left = corpus.snapshot(spark, f"file://{tmp_path}/s", stamp, keep=2, nodes=one)
    assert left == ["2024-01-03", "2024-01-02"] == corpus.list_snapshots(spark, f"file://{tmp_path}/s")
    corpus.export_json(f"file://{tmp_path}/e", nodes=one)
    assert spark.read.json(f"file://{tmp_path}/e/nodes").count() == 3
    assert corpus.emptied(nodes=one)["nodes"].count() == 0
    assert corpus.query_one(spark, "SELECT id FROM range(5) WHERE id > ?", 3).id == 4


def test_sessions_change(spark):
    s = spark.createDataFrame([("a", "x", "", 1.0, 1.0)], "session_id string, name string, notes string, created_at double, updated_at double")
    s = ledger.create_session(s, "b", "y", now=2.0)
    s = ledger.update_session(s, "a", {"name": "z"}, now=3.0)
    assert {(r.session_id, r.name, r.updated_at) for r in s.collect()} == {("a", "z", 3.0), ("b", "y", 2.0)}


def test_graph_changes(spark):
    types = spark.createDataFrame([("memo", True)], "type_name string, is_base_type boolean")
    nodes = spark.createDataFrame([(1, "memo", 0.4)], "id int, type string, importance double")
    new = spark.createDataFrame([(2, "memo", 0.0), (3, "none", 0.9)], "id int, type string, importance double")
    nodes = graph.create_nodes(nodes, new, types)
    assert {(r.id, r.importance) for r in nodes.collect()} == {(1, 0.4), (2, 0.5)}
    edges = spark.createDataFrame([(1, 2, "r")], "source_id int, target_id int, relationship string")
    assert graph.create_edges(edges, spark.createDataFrame([(2, 9, "r"), (2, 1, "r")], edges.schema), nodes).count() == 2
    pending = spark.createDataFrame([("old", "pending")], "type_name string, status string")
    pending = graph.propose_types(pending, spark.createDataFrame([("old",), ("memo",), ("fresh",)], "type_name string"), types)
    assert {r.type_name for r in pending.collect()} == {"old", "fresh"}
    types, pending = graph.settle_proposal(types, pending, "fresh", True)
    assert {r.type_name for r in types.collect()} == {"memo", "fresh"}
    assert {(r.type_name, r.status) for r in pending.collect()} == {("old", "pending"), ("fresh", "approved")}


def test_cluster_top_is_the_greedy_choice(spark):
    rows = [("s", i, 10 * i, 10 * i + (i * 7) % 9, 2 + (i * 5) % 3, 4, (i * 7) % 9, "x") for i in range(40)]
    got = crossref.cluster_top(spark.createDataFrame(rows, "stream_id string, hit_id long, region_start long, region_end long, distinct_terms int, total_hits int, spread long, terms string"), 100, 3).collect()
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[6], r[2], r[1])):
        if len(kept) < 3 and all(abs((r[2] + r[3]) / 2 - (k[2] + k[3]) / 2) >= 50 for k in kept):
            kept.append(r)
    assert sorted(g.region_start for g in got) == sorted(k[2] for k in kept)


def test_poisson_tail_edges(spark):
    rows = spark.createDataFrame([(0.0, 0), (0.0, 3), (2.0, 0), (2.0, 1)], "rate double, observed int")
    p = [r.p for r in rows.select(significance.poisson_tail(F.col("rate"), F.col("observed")).alias("p")).collect()]
    assert p[:3] == [1.0, 0.0, 1.0] and abs(p[3] - 0.8646647) < 1e-6
    assert significance.places(100, 4, 1, 3) == (100 - 3) + (100 - 6) + (100 - 9)


def test_saved_rows_keep_their_zeros(spark):
    clusters = spark.createDataFrame([], "cluster_id string, session_id string, type string, terms string, region_start long, discovered_at double")
    got = ledger.save_cluster(clusters, "c", "s", {"terms": "A,B", "region_start": 0}, 1.0).collect()
    assert [tuple(r) for r in got] == [("c", "s", "mega_cluster", "A,B", 0, 1.0)]
    stats = spark.createDataFrame([], "stat_id string, search_id long, observed long, p double, computed_at double")
    assert [tuple(r) for r in ledger.save_statistics(stats, "t", 4, {"observed": 0, "p": 0.0}, 2.0).collect()] == [("t", 4, 0, 0.0, 2.0)]
    s = spark.createDataFrame([], "session_id string, name string, notes string, created_at double, updated_at double")
    s = ledger.ensure_default_session(s, "d", 1.0)
    assert [r.session_id for r in ledger.ensure_default_session(s, "e", 2.0).collect()] == ["d"]


def test_an_approval_leaves_a_snapshot_and_a_row(spark, tmp_path):
    types = spark.createDataFrame([("memo", True)], "type_name string, is_base_type boolean")
    pending = spark.createDataFrame([("fresh", "pending"), ("old", "rejected")], "type_name string, status string")
    migrations = spark.createDataFrame([], "type_name string, action string, snapshot_path string, created_at double")
    folder = f"file://{tmp_path}/snap"
    types, pending, migrations = graph.approve_proposal(spark, folder, "one", types, pending, migrations, "fresh", 3.0)
    assert {r.type_name for r in types.collect()} == {"memo", "fresh"} and corpus.list_snapshots(spark, folder) == ["one"]
    assert [tuple(r) for r in migrations.collect()] == [("fresh", "created", f"{folder}/one", 3.0)]
    assert {r.type_name for r in spark.read.parquet(f"{folder}/one/types").collect()} == {"memo"}
    edges = spark.createDataFrame([(1, 2, "r"), (1, 2, "q"), (2, 1, "r")], "source_id int, target_id int, relationship string")
    assert graph.delete_edge(edges, 1, 2, "r").count() == 2 and graph.delete_edge(edges, 1, 2).count() == 1


def test_node_text_has_its_metadata(spark):
    from skipweave.operators import passages

    one = spark.createDataFrame([(1, "memo", "a", "", None, ["x"], {"k": "v", "b": "c"})], "id int, type string, summary string, detail string, context string, tags array<string>, metadata map<string,string>")
    assert passages.node_text(one).first().node_text == "[memo] | a | Tags: x | b: c | k: v"


def test_nearest_values_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [("s" if k % 3 else "t", "ABCD"[int(rng.integers(4))], int(rng.integers(400))) for k in range(120)]
    hits = spark.createDataFrame(rows, "stream_id string, term string, v long")
    for far, block in ((3, 16), (50, 16), (7, 1 << 16)):
        want = {}
        for s, x, a in rows:
            for r, y, b in rows:
                if s == r and x < y and abs(a - b) <= far:
                    want[s, x, y] = min(want.get((s, x, y), (10**9,)), (abs(a - b), a, b))
        got = {(r.stream_id, r.term_a, r.term_b): (r.distance, r.a, r.b) for r in crossref.nearest_between_terms(hits, F.col("v"), far, block).collect()}
        assert got == want


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from unittest import mock

    from skipweave import session

    remote = mock.Mock()
    remote.conf.get.return_value, remote.sparkContext.master, remote._skipweave_dir = None, "spark://host:7077", None
    with pytest.raises(ValueError):
        session.shared_dir(remote)
