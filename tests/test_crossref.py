"""Windows, greedy choices, shared places and triples against loops."""

import itertools

import numpy as np
import pytest

from skipweave.operators import crossref, letters

HITS = "stream_id string, term string, start long, skip int, direction string, hit_id long, positions array<long>"


def made(seed, n, terms="ABCDEF", span=900, length=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        start, skip, sign = int(rng.integers(span)) + 100, int(rng.integers(1, 20)), int(rng.choice([-1, 1]))
        out.append(("st"[i % 3 == 0], "TERM" + terms[int(rng.integers(len(terms)))], start, skip, "forward" if sign > 0 else "reverse", i, [start + sign * k * skip for k in range(length)]))
    return out


@pytest.mark.parametrize(("window", "side"), [(30, 1), (30, 64), (200, 1 << 16), (1, 1)])
def test_candidates_equal_loops(spark, monkeypatch, window, side):
    """Blocks of one window's length and of all; a place with many hits, and hits of one place."""
    monkeypatch.setattr(crossref, "SIDE", side)
    rows = made(1, 150) + [("s", "TERMA", 250, 1 + i % 5, "forward", 1000 + i, [250] * 4) for i in range(60)]
    got = crossref.cluster_candidates(spark.createDataFrame(rows, HITS), window, 2).collect()
    want = []
    for stream in "st":
        mine = sorted((r for r in rows if r[0] == stream), key=lambda r: (r[2], r[1], r[3], r[4], r[5]))
        for i, r in enumerate(mine):
            seen = [x for x in mine[: i + 1] if x[2] >= r[2] - window]
            terms = sorted({x[1] for x in seen})
            if len(terms) >= 2:
                want.append((stream, r[5], seen[0][2], r[2], len(terms), len(seen), r[2] - seen[0][2], ",".join(terms)))
    assert sorted(map(tuple, got)) == sorted(want)
    assert not crossref.cluster_candidates(spark.createDataFrame([], HITS), window).collect()


@pytest.mark.parametrize(("window", "side"), [(40, 1), (300, 1 << 16)])
def test_mega_cluster_equals_loops(spark, monkeypatch, window, side):
    monkeypatch.setattr(crossref, "SIDE", side)
    rows = made(2, 200)
    got = crossref.mega_cluster(spark.createDataFrame(rows, HITS), window, 4).collect()
    want = []
    for stream in "st":
        middles = [(r[6][2], r[1]) for r in rows if r[0] == stream]
        every = {(-len({t for m, t in middles if s <= m <= s + window}), -sum(s <= m <= s + window for m, _ in middles), s) for s, _ in middles}
        want += [(stream, s, -a, -b) for a, b, s in sorted(every)[:4]]
    assert sorted(map(tuple, got)) == sorted(want)


CANDIDATES = "stream_id string, hit_id long, region_start long, region_end long, distinct_terms int, total_hits int, spread long, terms string"


def greedy(rows, window, n):
    out = []
    for stream in sorted({r[0] for r in rows}):
        kept = []
        for r in sorted((r for r in rows if r[0] == stream), key=lambda r: (-r[4], r[6], r[2], r[1])):
            if len(kept) < n and all(abs((r[2] + r[3]) - (k[2] + k[3])) >= window for k in kept):
                kept.append(r)
        out += [(stream, i + 1, *r[2:]) for i, r in enumerate(kept)]
    return out


@pytest.mark.parametrize("beside", [1, 2, 256])
def test_regions_are_the_greedy_choice(spark, monkeypatch, beside):
    """Random regions, and a chain of ever better neighbours over many stretches."""
    monkeypatch.setattr(crossref, "BESIDE", beside)
    rng = np.random.default_rng(beside)
    rows = [("st"[i % 2], i, int(a), int(a + rng.integers(0, 40)), int(rng.integers(2, 6)), 4, int(rng.integers(0, 9)), "x") for i, a in enumerate(rng.integers(0, 4000, 300))]
    rows += [("chain", 1000 + i, 30 * i, 30 * i, 2 + i, 4, 0, "x") for i in range(30)]
    frame = spark.createDataFrame(rows, CANDIDATES)
    for n in (1, 3, 500):
        tried = []
        got = crossref.cluster_top(frame, 100, n, tried=tried).collect()
        assert sorted(map(tuple, got)) == sorted(greedy(rows, 100, n))
        assert len(tried) <= (30 if beside < 256 else 3) and tried[-1] == 0  # the chain, and not n, makes rounds
    assert not crossref.cluster_top(spark.createDataFrame([], CANDIDATES), 100).collect()


@pytest.mark.parametrize("size", [16, 1 << 16])
def test_shared_counts_equal_loops(spark, size):
    rows = made(3, 120, span=300) + [("s", t, 200, 1, "forward", 900 + i, [200, 200, 201, 202]) for i, t in enumerate(["TERMA", "TERMB"] * 40)]
    got = {tuple(r) for r in crossref.shared_counts(spark.createDataFrame(rows, HITS), size).collect()}
    want = set()
    for stream in "st":
        of = {}
        for r in rows:
            if r[0] == stream:
                of.setdefault(r[1], []).extend(r[6])
        for a, b in itertools.combinations(sorted(of), 2):
            n = sum(p in set(of[a]) for p in of[b])
            if n:
                want.add((stream, a, b, n))
    assert got == want


def test_sweep_counts_hits_and_names_verses(spark):
    rows = made(4, 40)
    verses = [(1, "GEN", 1, v, "abcdefghij" * 10) for v in range(1, 15)]
    bounded = letters.verse_boundaries(spark.createDataFrame(verses, "book_order int, book_abbrev string, chapter int, verse int, text string"))
    got = crossref.sweep_report(crossref.sweep(spark.createDataFrame(rows, HITS), 50), bounded).collect()
    size = {(s, t): sum(r[0] == s and r[1] == t for r in rows) for s in "st" for t in {r[1] for r in rows}}
    for r in got:
        assert (r.hits_a, r.hits_b) == (size[r.stream_id, r.term_a], size[r.stream_id, r.term_b])
        assert r.closest_verse_a == (None if r.a is None else f"GEN 1:{r.a // 100 + 1}") and r.closest_verse_b == (None if r.b is None else f"GEN 1:{r.b // 100 + 1}")
    assert len(got) > 5


def test_triples_equal_loops(spark):
    for seed, close in ((1, 40), (2, 7), (3, 500), (4, 0)):
        rows = made(seed, 70, "ABC")
        got = crossref.triple_cluster(spark.createDataFrame(rows, HITS), ("TERMB", "TERMA", "TERMC"), max(close, 20), max(close, 1)).collect()
        of = [sorted({r[6][2] for r in rows if r[1] == t}) for t in ("TERMB", "TERMA", "TERMC")]
        every = [(max(m) - min(m), *m) for m in itertools.product(*of) if max(m) - min(m) <= max(close, 1)]
        assert [(r.spread, r.m1, r.m2, r.m3) for r in got] == sorted(every)[:1]
    with pytest.raises(ValueError):
        crossref.triple_cluster(spark.createDataFrame(rows, HITS), ("A", "B", "C"), 5, 10)


def test_triples_of_ten_thousand_midpoints(spark):
    """10,000 midpoints a term within one distance: 10^12 triples, found by search in sorted ones."""
    rng = np.random.default_rng(9)
    values = [np.sort(rng.integers(0, 14_000_000, 10_000)) for _ in range(3)]
    rows = [("s", f"T{t}", int(m), 1, "forward", 0, [int(m)]) for t, v in enumerate(values) for m in v]
    got = crossref.triple_cluster(spark.createDataFrame(rows, HITS), ("T0", "T1", "T2"), 15_000_000, 15_000_000).first()
    merged = sorted((m, t) for t, v in enumerate(values) for m in v)
    last, best = [None] * 3, None
    for m, t in merged:  # the latest of each term before each value
        last[t] = m
        if None not in last and (best is None or m - min(last) < best):
            best = m - min(last)
    assert got.spread == best == max(got.m1, got.m2, got.m3) - min(got.m1, got.m2, got.m3)


def test_sweeps_of_queries_take_frequent_terms(spark, monkeypatch):
    """Terms with more hits than NOISE are swept too where the query's SQL has no such limit."""
    from skipweave.plans import fixtures, registry

    rows = made(6, 60)
    monkeypatch.setattr(crossref.sweep, "__defaults__", (500, 4, 3))
    monkeypatch.setattr(fixtures, "hits", lambda spark, d: spark.createDataFrame(rows, HITS))
    assert crossref.sweep(spark.createDataFrame(rows, HITS), 50).count() < registry.queries()["sweep_pairs"](spark, "").count()
    assert registry.queries()["sweep_top"](spark, "").count() > 0


def paired(a, b, width):
    """All pairs of hits with their closest letters, by loops."""
    out = []
    for x in a:
        for y in b:
            d, _, _, pa, pb = min((abs(p - q), i, j, p, q) for i, p in enumerate(x[6]) for j, q in enumerate(y[6]))
            if d <= width:
                out.append((d, tuple(x[2:6]), tuple(y[2:6]), pa, pb))
    return sorted(out)


def flat(rows):
    return [(r.distance, tuple(r.a), tuple(r.b), r.pos_a, r.pos_b) for r in rows]


@pytest.mark.parametrize(("strip", "span"), [(64, 300), (1 << 13, 20_000)])
def test_pairs_equal_loops(spark, monkeypatch, strip, span):
    """Crowded and scattered hits, and copies of one place; no operator has its pairs shuffled."""
    monkeypatch.setattr(crossref, "STRIP", strip)
    rows = made(11, 120, "AB", span) + [("s", t, 150, 2, "forward", 900 + i, [150, 152, 154, 156]) for i, t in enumerate(["TERMA", "TERMB"] * 15)]
    a, b = ([r for r in rows if r[1] == t] for t in ("TERMA", "TERMB"))
    one, two = (spark.createDataFrame(x, HITS) for x in (a, b))
    for width in (12,):
        every = paired(a, b, width)
        near = crossref.pairs_within(one, two, width)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("hashpartitioning") == 1
        assert sorted(flat(near.collect())) == every
        for n in (1, 400):
            assert flat(crossref.closest_within(one, two, n, width).collect()) == every[:n]
        best = {}
        for d, x, y, _, _ in every:
            key = (x[1], y[1], x[2], y[2])
            best[key] = min(best.get(key, (d, x[0], y[0])), (d, x[0], y[0]))
        assert {tuple(r) for r in crossref.pairs_once_per_skip(one, two, width).collect()} == {(*k, *v) for k, v in best.items()}
    assert flat(crossref.closest_pairs(one, two, 25, first=1).collect()) == paired(a, b, 1 << 30)[:25]
    assert not crossref.closest_pairs(one, two.limit(0)).collect() and not crossref.pairs_within(one, two.limit(0), 5).collect() and not crossref.pairs_once_per_skip(one.limit(0), two, 5).collect()


def test_pairs_with_verses_name_their_letters(spark):
    rows = made(12, 60, "AB", 300)
    a, b = (spark.createDataFrame([r for r in rows if r[1] == t], HITS) for t in ("TERMA", "TERMB"))
    verses = [(1, "GEN", 1, v, "abcdefghij" * 10) for v in range(1, 4)]  # letters beyond the last verse have none
    bounded = letters.verse_boundaries(spark.createDataFrame(verses, "book_order int, book_abbrev string, chapter int, verse int, text string"))
    got = crossref.pairs_with_verses(a, b, 20, bounded).collect()
    assert sorted(flat(got)) == sorted(flat(crossref.pairs_within(a, b, 20).collect())) and {r.verse_a for r in got} >= {None, "GEN 1:2"}
    named = lambda p: f"GEN 1:{p // 100 + 1}" if 0 <= p < 300 else None
    assert all((r.verse_a, r.verse_b) == (named(r.pos_a), named(r.pos_b)) for r in got)
