"""Resampling, clusters and byte-level BPE on small tables with every odd case, against plain loops, the SQL and the library."""

import base64
import collections
import hashlib
import math
import os
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from skipweave.llm import byte_bpe, elkan, resample
from skipweave.llm.tokens import tokenizer_path
from skipweave.session import scratch_path
from tests.llm.test_operators import SCHEMA, rows

SMALL = "/root/testdata/sf0.001"


def table(spark, data, schema, parts=3):
    path = scratch_path(spark, "table")
    spark.createDataFrame(data, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [], SCHEMA)


def key(r):
    return tuple((x is not None, x) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


# resampling ----------------------------------------------------------------------------------------------------------


def resampled(docs, target, least=20, percent=25, buckets=10_000, seed=7):
    """Loops over words; docs and target: (id, text)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    sides = [collections.Counter(bucket(f) for _, t in side for f in features(t)[1]) for side in (docs, target)]
    s, t = (sum(c.values()) for c in sides)
    gain = [math.floor(1000 * math.log((sides[1][b] + 1) * (s + buckets) / ((sides[0][b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = None if i is None else int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for r in out:
        r[4] = None
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return out


@pytest.mark.parametrize("percent", [25, 60, 100])
def test_resampling(spark, docs, none, percent):
    target = table(spark, [(1, PROSE_TARGET), (2, None), (3, "")], "item_id long, text string", 2)
    got = resample.resample(spark, docs, target, percent=percent).collect()
    same(got, resampled([(r[0], r[1]) for r in rows()], [(1, PROSE_TARGET), (2, None)], percent=percent))
    assert not resample.resample(spark, none, target).collect()
    same(resample.resample(spark, docs, none).collect(), resampled([(r[0], r[1]) for r in rows()], []))


PROSE_TARGET = "the river where the quick fox drinks and the lazy dog sleeps " * 3


def test_resampling_of_long_and_split_texts(spark):
    """A text beyond a slice, NUL and separators, and slices of a few bytes give the same counts."""
    long = "Ab cd\x00ef, É字 " * 60_000
    data = [(i, t) for i, t in enumerate([long, "x", "a b", long[:5000], None])]
    docs = table(spark, data, "doc_id long, text string", 1)
    counts = [sorted(map(tuple, resample.merged(resample.count_buckets(spark, docs, size=size)).collect())) for size in (1, 1 << 20)]
    assert counts[0] == counts[1]
    same(resample.resample(spark, docs, docs).collect(), resampled(data, data))


def test_ranks_of_equal_scores(spark):
    """A third of all rows share a score and an id; ranks are 1 .. n, by falling score and rising id."""
    data = [(5, 100)] * 400 + [(i, i % 7) for i in range(800)]
    got = resample.ranked(spark, table(spark, data, "doc_id long, score long")).collect()
    got.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(data) + 1))
    assert [(r.doc_id, r.score) for r in got] == sorted(data, key=lambda r: (-r[1], r[0]))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_resampling_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({resample.ORACLE})").fetchall()
    got = resample.op11_importance_resampling(spark, SMALL).select("doc_id", "n_features", "weight", "score", "rank").collect()
    same(got, want)
    assert sum(r["rank"] is not None for r in got) > 10


# clusters ------------------------------------------------------------------------------------------------------------
def brute_force(vectors, k, rounds, seed=2):
    """Plain loops without bounds: the cluster of each vector and the final centroids."""
    order = sorted(range(len(vectors)), key=lambda i: (hashlib.sha256(f"{seed}:{vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    centroids = [list(vectors[i][1]) for i in order[:k]]
    for n in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda j: (sum((p - q) ** 2 for p, q in zip(v, centroids[j], strict=True)), j)) for _, v in vectors]
        if n < rounds:
            for j in range(len(centroids)):
                group = [v for (_, v), c in zip(vectors, own, strict=True) if c == j]
                centroids[j] = [sum(c) // len(group) for c in zip(*group, strict=True)] if group else centroids[j]
    return own, centroids


def clustered(spark, data, k, rounds, dims, parts=3):
    found, centroids = elkan.cluster(spark, table(spark, data, "vec_id long, embedding array<float>, cluster string, upper int", parts), k=k, rounds=rounds, dims=dims)
    return sorted(map(tuple, found.collect()), key=key), centroids.tolist()


def by_hand(data, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in data if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    own, centroids = brute_force(kept, k, rounds)
    return sorted(((i, c, sum((p - q) ** 2 for p, q in zip(v, centroids[c], strict=True))) for (i, v), c in zip(kept, own, strict=True)), key=key), centroids


@pytest.mark.parametrize(("grid", "k", "rounds"), [(2, 5, 5), (3, 12, 4), (1000, 7, 5), (2, 1, 3)])
def test_clusters_equal_loops(spark, grid, k, rounds):
    """Coarse grids make ties and empty clusters; a third of the rows are one vector."""
    rng = np.random.default_rng(grid * 31 + k)
    vectors = [rng.integers(-grid, grid + 1, 4).astype(float) / grid for _ in range(240)] + [np.ones(4)] * 120
    odd = [None, [], [1.0, 2.0], [1.0, None, 0.0, 0.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0]]
    data = [(i, [float(x) for x in v], "c", 1) for i, v in enumerate(vectors)] + [(900 + i, v, None, None) for i, v in enumerate(odd)]
    data.append(data[3])
    assert clustered(spark, data, k, rounds, 4) == by_hand(data, k, rounds, 4)


def test_few_and_no_vectors(spark):
    data = [(1, [0.5, -0.5], "c", 1), (2, [0.25, 0.0], "c", 1)]
    assert clustered(spark, data, 40, 5, 2) == by_hand(data, 40, 5, 2)
    assert clustered(spark, [], 40, 5, 2) == ([], [])


def test_a_component_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        clustered(spark, [(1, [1e30, 0.0], "c", 1)], 2, 1, 2)


def test_bounds_hold_and_skip_distances():
    """Over rounds of moving centroids the bounds never cross the distances, assignments are those of all distances, and most distances aren't worked out."""
    rng = np.random.default_rng(4)
    middle = rng.integers(-200, 200, (16, 8))
    x = middle[rng.integers(0, 16, 3000)] + rng.integers(-9, 10, (3000, 8))
    centroids = x[:16].copy()
    a, upper, lower, full = elkan.first_round(x, centroids)
    for _ in range(6):
        new = np.array([x[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else centroids[j] for j in range(16)])
        moved = np.nextafter(np.sqrt(elkan.squared(new, centroids).astype(float)), np.inf)
        centroids = new
        a, upper, lower, n = elkan.next_round(x, a, upper, lower, centroids, moved, elkan.between(centroids))
        d = np.stack([elkan.squared(x, c) for c in centroids], axis=1)
        assert (a == d.argmin(axis=1)).all()
        assert (upper.astype(float) ** 2 >= d.min(axis=1) * (1 - 1e-12)).all() and (lower.astype(float) ** 2 <= d * (1 + 1e-12)).all()
    assert n < full / 2


# byte-level BPE ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path(byte_bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


def checked(spark, docs, want, **options):
    coded = byte_bpe.encode(spark, docs, **options)
    same([(r.doc_id, tuple(r.ids)) for r in coded.collect()], want)
    decoded = byte_bpe.decode(spark, coded).collect()
    same([(r.doc_id, struct.unpack(f"<{len(r.ids_le) // 4}I", r.ids_le)) for r in decoded], want)
    return [(r.doc_id, bytes(r.decoded)) for r in decoded]


@pytest.mark.parametrize("size", [1, 64, 1 << 24])
def test_byte_bpe(spark, docs, none, library, size):
    data = [(r[0], r[1] or "") for r in rows()]
    got = checked(spark, docs, [(i, tuple(library.encode_ordinary(t))) for i, t in data], size=size)
    same(got, [(i, t.encode()) for i, t in data])
    assert not byte_bpe.encode(spark, none).collect() and not byte_bpe.decode(spark, byte_bpe.encode(spark, none)).collect()


def test_byte_bpe_of_long_and_odd_texts(spark, library, monkeypatch):
    """Texts are split in steps of 100 bytes and give the ids of whole ones; white space of all kinds; one word without an end."""
    monkeypatch.setattr(byte_bpe, "STEP", 100)
    monkeypatch.setattr(byte_bpe, "ROWS", 2)
    spaces = "".join(chr(c) for c in (9, 10, 11, 12, 13, 28, 32, 0x85, 0xA0, 0x2003, 0x3000))
    texts = [" don't  we'll\n\n 12 ab" * 200, "".join(f"{a}x{b}字 {b}" for a in spaces for b in spaces), "z" * 3000, "\n" * 500, " " * 301 + "é", "<|endoftext|>" * 30, "😀" * 90]
    assert [p for t in texts for p in ["".join(byte_bpe._parts(np.frombuffer(t.encode(), np.uint8)))]] == texts
    docs = table(spark, list(enumerate(texts)), "doc_id long, text string", 2)
    got = checked(spark, docs, [(i, tuple(library.encode_ordinary(t))) for i, t in enumerate(texts)])
    same(got, [(i, t.encode()) for i, t in enumerate(texts)])


def test_ids_are_decoded_where_they_are(spark, monkeypatch):
    """No row is made for an id; texts go on over the limits of a step and a batch; no ids, null or empty, give empty bytes."""
    monkeypatch.setattr(byte_bpe, "STEP", 3)
    monkeypatch.setattr(byte_bpe, "BYTES", 5)
    tokens = spark.createDataFrame([(4, bytearray(b"")), (0, bytearray(b"ab")), (9, bytearray(b"\x00")), (2, bytearray(b"xyz"))], "token int, bytes binary")
    word = {4: b"", 0: b"ab", 9: b"\x00", 2: b"xyz"}
    rng = np.random.default_rng(2)
    lists = [[], None, [4], *([int(x) for x in rng.choice([0, 2, 4, 9], n)] for n in rng.integers(0, 20, 40))]
    coded = spark.createDataFrame([(k, None if k == 5 else 7, x) for k, x in enumerate(lists)], "row long, doc_id long, ids array<int>").repartition(3)
    decoded = byte_bpe.decode(spark, coded, tokens)
    same([(r.row, r.doc_id, bytes(r.ids_le), bytes(r.decoded)) for r in decoded.collect()], [(k, None if k == 5 else 7, struct.pack(f"<{len(x or [])}I", *(x or [])), b"".join(word[i] for i in x or [])) for k, x in enumerate(lists)])
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_unknown_ids_are_an_error(spark):
    coded = spark.createDataFrame([(1, 1, [5, 60_000])], "row long, doc_id long, ids array<int>")
    with pytest.raises(Exception, match="doesn't have"):
        byte_bpe.decode(spark, coded).collect()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_byte_bpe_query(spark, library):
    """The query's digests are those of the library's ids and of the texts, for every document."""
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    same(byte_bpe.op13_byte_bpe(spark, SMALL).collect(), want)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_clusters_query(spark):
    """The query's rows are those of plain loops over every vector of the table."""
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found, centroids = by_hand(data, 40, 5, 64)
    inertia = collections.Counter()
    for _, c, d in found:
        inertia[c] += d
    want = [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]
    same(elkan.op12_centroid_clustering(spark, SMALL).collect(), want)
    assert elkan.op12_centroid_clustering(spark, SMALL).filter(F.col("distance") < 0).count() == 0
