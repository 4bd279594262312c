"""The trigram index against scans, and the inverted file against all vectors."""

import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skipweave.functions.text import contains_ascii
from skipweave.operators import vectors, wordindex
from skipweave.plans import registry
from skipweave.session import scratch_path
from skipweave.sources import corpus

TEXTS = ["The quick fox", "", None, "ab", "A", "quiet aquarium", "Étude ÉTUDE", "x" * 5000 + "end", "AbAbAb", "%_*", "字漢字", "İstanbul K"]


@pytest.fixture(scope="module")
def indexed(spark):
    rows = spark.createDataFrame([(i, f"k{i % 3}", t, TEXTS[-i - 1]) for i, t in enumerate(TEXTS)], "id int, side string, a string, b string").repartition(3)
    return rows, wordindex.build_index(rows, ["id", "side"], ["a", "b"], scratch_path(spark, "words"))


@pytest.mark.parametrize("query", ["the quick", "QUI", "b", "ab", "étude", "Étude", "end", "zzz", "abab", "%_", "_*", "字漢", "漢字字", "x" * 40, "k", "quick fo", "", "i"])
def test_index_finds_what_a_scan_finds(indexed, query):
    rows, folder = indexed
    want = {r.id for r in rows.filter(contains_ascii(F.col("a"), query) | contains_ascii(F.col("b"), query)).collect()}
    assert {r.id for r in wordindex.keyword_search(rows, folder, query, ["id", "side"], ["a", "b"]).collect()} == want


def test_index_reads_few_candidates(spark):
    """Of 3000 texts with common trigrams two hold the query, and hardly more are compared."""
    rng = np.random.default_rng(3)
    syllables = ["the", "ing", "and", "ion", "ent", "her", "for", "tha", "nth", "int"]
    texts = ["".join(rng.choice(syllables, 60)) for _ in range(3000)]
    texts[7] += " zebrafish"
    texts[1999] += " ZEBRAFISH tank"
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    folder = wordindex.build_index(rows, ["id"], ["text"], scratch_path(spark, "words"))
    assert {r.id for r in wordindex.keyword_search(rows, folder, "zebrafish", ["id"], ["text"]).collect()} == {7, 1999}
    assert wordindex.candidates(spark, folder, "zebrafish", ["id"]).count() == 2
    assert wordindex.asked_grams(spark, folder, "the qqq") == [] and wordindex.candidates(spark, folder, "the qqq", ["id"]).count() == 0
    plan = wordindex.candidates(spark, folder, "zebrafish", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and "text" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.one_of(st.none(), st.text("abAB c", max_size=12)), min_size=1, max_size=12), query=st.text("abAB c", max_size=5))
def test_index_on_any_texts(spark, texts, query):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    folder = wordindex.build_index(rows, ["id"], ["text"], scratch_path(spark, "words"))
    lower = query.lower()
    assert {r.id for r in wordindex.keyword_search(rows, folder, query, ["id"], ["text"]).collect()} == {i for i, t in enumerate(texts) if t is not None and lower in t.lower()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_of_lists(spark):
    """At least 0.9 of the ten most similar vectors are found, over all queries, and every one found has its exact similarity."""
    d = "/root/testdata/sf0.01"
    rank = lambda name: {(r.query_id, r.node_id): r.similarity for r in registry.queries()[name](spark, d).collect()}
    every, found = rank("vector_search_all"), rank("vector_search_lists")
    both = every.keys() & found.keys()
    assert len(found) == len(every) and len(both) >= 0.9 * len(every)
    assert all(abs(every[k] - found[k]) < 1e-6 for k in both)


def test_every_vector_is_in_a_list_once(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=4)] if i % 3 else [1.0, 2.0, 0.0, 0.0]) for i in range(300)] + [(300, [0.0] * 4)]
    frame = spark.createDataFrame(data, "node_id long, vector array<double>")
    folder = scratch_path(spark, "lists")
    centroids, read = vectors.build_index(frame, folder, lists=9)
    assert 1 <= read <= len(centroids)
    held = spark.read.parquet(f"{folder}/lists").collect()
    assert sorted(r.node_id for r in held) == list(range(301)) and {r.list for r in held} <= set(range(len(centroids)))
    one = frame.filter("node_id in (1, 3)").select(F.col("node_id").alias("query_id"), F.col("vector").alias("query"))
    whole = vectors.search(one, folder, centroids, len(centroids), 5).collect()  # all lists: the exact rows
    want = vectors.search_all(one, frame, 5, parts=3).select(*whole[0].__fields__).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, want))
    assert [r.node_id for r in sorted(whole, key=lambda r: r.nth) if r.query_id == 3] == [0, 3, 6, 9, 12]  # equal ones by id
    empty = vectors.build_index(frame.limit(0), scratch_path(spark, "lists"))
    assert len(empty[0]) == empty[1] == 0


def test_groups_need_few_lists(spark):
    """Vectors in 20 clear groups: a query reads a fraction of the lists and finds over 0.9."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(20, 16))
    data = [(i, [float(v) for v in middle[i % 20] + 0.2 * rng.normal(size=16)]) for i in range(2000)]
    frame = spark.createDataFrame(data, "node_id long, vector array<double>").repartition(3)
    folder = scratch_path(spark, "lists")
    centroids, read = vectors.build_index(frame, folder)
    assert read <= len(centroids) / 4
    asked = frame.filter("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), F.col("vector").alias("query"))
    pairs = lambda t: {(r.query_id, r.node_id) for r in t.collect()}
    want = pairs(vectors.search_all(asked, frame))
    assert len(want & pairs(vectors.search(asked, folder, centroids, read))) >= 0.9 * len(want)


def test_rows_change_or_raise(spark):
    rows = spark.createDataFrame([(1, "a", {"x": "1"}, 0.5, 1.0), (2, "b", None, 0.5, 1.0)], "id int, summary string, metadata map<string,string>, importance double, updated_at double")
    got = {r.id: r for r in corpus.update_rows(rows, "id", 2, {"summary": "c", "metadata": {"y": "2"}, "importance": None}, now=9.0).collect()}
    assert (got[2].summary, got[2].metadata, got[2].importance, got[2].updated_at) == ("c", {"y": "2"}, 0.5, 9.0) and got[1].metadata == {"x": "1"} and got[1].updated_at == 1.0
    assert corpus.update_rows(rows, "id", 1, {"metadata": {"x": "3", "z": "4"}}).filter("id = 1").first().metadata == {"x": "3", "z": "4"}
    for changes in ({}, {"summary": None}, {"nothing": 1}, {"id": 5}):
        with pytest.raises(ValueError):
            corpus.update_rows(rows, "id", 1, changes)
    with pytest.raises(ValueError, match="not found"):
        corpus.update_rows(rows, "id", 7, {"summary": "x"})


def test_changes_take_columns_of_any_name(spark):
    schema = "of int, row string, given string, k0 string, side string, last string, __new int, __rn int"
    old = spark.createDataFrame([(1, *"abcde", 1, 1), (2, *"abcde", 2, 2)], schema)
    new = spark.createDataFrame([(2, *"vwxyz", 3, 3), (2, *"uwxyz", 3, 3)], schema)
    assert {tuple(r) for r in corpus.upsert(old, new, ["of"]).collect()} == {(1, *"abcde", 1, 1), (2, *"vwxyz", 3, 3)}
    base = spark.createDataFrame([(1, {"a": "1"}, "r", "g", "b")], "of int, metadata map<string,string>, row string, given string, __given string")
    assert [tuple(r) for r in corpus.merge_metadata(base, base.select("of", F.create_map(F.lit("a"), F.lit("2")).alias("metadata")), "of").collect()] == [(1, {"a": "2"}, "r", "g", "b")]


def test_blocks_of_vectors_rank_as_single_cosines_do(spark, monkeypatch):
    """Odd vectors and copies over many blocks and turns give the rows of the plain cosine, pair by pair; no row is made for a pair."""
    from skipweave.functions.text import cosine

    monkeypatch.setattr(vectors, "ASKING", 7)
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60)] + [(60 + i, [0.1, 0.2, 0.3]) for i in range(25)]
    data += [(90, None), (91, [0.0] * 3), (92, [1.0, None, 2.0]), (93, [1.0, 2.0]), (94, [1e200, 1.0, 2.0]), (95, [1e-200, 0.0, 1e-200]), (96, [-0.1, -0.2, -0.3])]
    frame = spark.createDataFrame(data, "node_id long, vector array<double>")
    asked = frame.filter("node_id % 5 = 0 OR node_id > 89").select(F.col("node_id").alias("query_id"), F.col("vector").alias("query"))
    want = vectors.ranked(frame.crossJoin(asked).select("query_id", "node_id", cosine(F.col("vector"), F.col("query")).alias("similarity")), "query_id", "node_id", 6)
    got = vectors.search_all(asked, frame, 6, parts=3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = lambda t: sorted((r.query_id, r.nth, r.node_id, repr(r.similarity)) for r in t.collect())  # noqa: E731  NaN for one whose square overflows
    assert rows(got) == rows(want)


def test_postings_are_the_distinct_trigrams(spark):
    """Texts of one and two characters are one gram, and none goes over a text's end; the texts are cut up in tasks and not by expressions of the plan."""
    rows = spark.createDataFrame([(1, "ABCab", "x"), (2, "abcabc", None), (3, "", "é字"), (4, None, None)], "id int, a string, b string")
    folder = wordindex.build_index(rows, ["id"], ["a", "b"], scratch_path(spark, "words"))
    got = sorted((r.id, r.gram) for r in spark.read.parquet(f"{folder}/postings").collect())
    assert got == sorted([(1, "abc"), (1, "bca"), (1, "cab"), (1, "x"), (2, "abc"), (2, "bca"), (2, "cab"), (3, "é字")])
    list(wordindex._post(["id"], ["a", "b"])([rows.toPandas()]))
