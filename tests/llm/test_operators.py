"""The operators on small tables with every odd case, against brute force."""

import collections
import math
import os
import re
import string
import time
import zlib
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skipweave.llm import components, exact_dedup, language, license_scan, lm_score, packing, pieces, quality_rules, simhash, token_output, url_filter
from skipweave.llm.common import marked
from skipweave.llm.tokens import ChunkEncoder, tokenizer_path
from skipweave.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, part int, word string"
PROSE = "the quick brown fox jumps over the lazy dog and runs to the river where it drinks " * 5
WORDS = r"[^\x20\x09-\x0D]+"
MEDIUM = "/root/testdata/sf0.01"


def rows():
    texts = [
        (1, PROSE), (2, PROSE), (3, PROSE.replace(" ", "  ") + "\n"), (4, None), (5, ""), (6, " \t\n"), (7, "a b a b a b a b\nx\n\nx\n x"), (8, "Ünïcödé ß İ K 字 漢字 😀 Kelvin"),
        (9, "Released under the MIT License. mit  LICENSE, GNU General-Public license cc-by cc by"), (10, "x" * 5000 + " " + "tion " * 3000), (11, PROSE + " end"), (2, PROSE), (12, "###$$ %% 12 |"),
        (None, "no id here"), (13, "<|endoftext|> <s>   \x1c ~"),
    ]
    return [(i, t, "en" if k % 2 else None, "s", 1, True, "d", 3, "w") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    path = scratch_path(spark, "docs")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    path = scratch_path(spark, "none")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_exact_dedup(spark, docs, none):
    got = exact_dedup.exact_dedup(spark, docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r[0])
    assert len(got) == len(rows())
    want = {i: (min(g), len(g)) for g in groups.values() if None not in g for i in g}
    for r in got:
        if r.doc_id is not None:
            assert (r.keep_id, r.group_size) == want[r.doc_id]
    assert sum(r.kept for r in got) == len(groups)  # of repeated rows one stays
    assert exact_dedup.exact_dedup(spark, docs, capacity=1).filter("kept").count() == len(groups)
    assert exact_dedup.exact_dedup(spark, none).count() == 0
    left = exact_dedup.drop_copies(spark, docs)
    assert left.columns == docs.columns and left.count() == len(groups)


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, simhash.drop_near_copies])
def test_rows_keep_their_numbers_when_files_are_split_anew(spark, drop):
    """As when an executor is lost between the jobs of a stage: the same files are dealt to fewer partitions."""
    path = scratch_path(spark, "split")
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)) for _ in range(30)]
    spark.createDataFrame([(k, texts[k // 2], "en") for k in range(60)], "doc_id long, text string, lang string").repartition(12, "doc_id").write.parquet(path)
    part = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(part, "12")
        left = drop(spark, spark.read.parquet(path))
        spark.conf.set(part, "1")
        assert sorted(r.doc_id for r in left.collect()) == list(range(0, 60, 2))
    finally:
        spark.conf.unset(part)


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, simhash.drop_near_copies])
def test_dropping_copies_neither_writes_nor_shuffles_the_texts(spark, drop, monkeypatch):
    """Not even where the dropped rows are more than Spark broadcasts of itself; rows without a place of their own are written with their numbers."""
    path, wide = scratch_path(spark, "apart"), []
    spark.createDataFrame([(k, f"text {k // 2} " + " ".join(f"w{k // 2}x{j}" for j in range(60)), "en") for k in range(40)], "doc_id long, text string, lang string").repartition(3).write.parquet(path)
    docs, limit = spark.read.parquet(path), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(type(docs.write), "parquet", lambda self, *a, f=type(docs.write).parquet, **b: (wide.extend({"text"} & set(self._df.columns)), f(self, *a, **b))[1])
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        left = drop(spark, docs)
        assert sorted(r.doc_id for r in left.collect()) == list(range(0, 40, 2)) and not wide
        plan = left._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=broadcast)" in plan and "strategy=broadcast" in plan
        twice = drop(spark, docs.withColumn("lang", F.explode(F.array(F.lit("a"), F.lit("b")))))
        assert sorted(r.doc_id for r in twice.collect()) == list(range(0, 40, 2)) and wide
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_marked_rows(spark):
    df = spark.range(0, 1000, 1, 4).select((F.col("id") * 7 - 9).alias("n"), F.lit("x").alias("__word"))
    some = spark.createDataFrame([(v,) for v in (-9, -2, 5, 446, 6984)], "k long")
    assert sorted(r.n for r in marked(df, "n", some).collect()) == [-9, -2, 5, 446, 6984]
    left = marked(df, "n", some, keep=False)
    assert left.columns == df.columns and left.count() == 995 and left.filter("n IN (-9, -2, 5, 446, 6984)").count() == 0
    assert marked(df, "n", some.limit(0)).count() == 0 and marked(df, "n", some.limit(0), keep=False).count() == 1000


def test_rare_pairs_are_few_where_texts_share_much_but_not_enough(spark):
    """Texts with three fifths in common and little else that another hasn't: every true pair is found, and of the others most don't meet."""
    rng = np.random.default_rng(8)
    common, pool, texts = [f"c{k}" for k in range(90)], rng.integers(0, 60, (80, 60)), []
    for k in range(80):
        own = [f"p{j}x{x // 12}" for j, x in enumerate(pool[k // 2] if k < 20 else pool[k])]
        if k < 20 and k % 2:
            own[3] = "changed"
        texts.append(" ".join(common + [w for x in zip(own, own, own, strict=True) for w in x][:90]))
    path = scratch_path(spark, "rare")
    spark.createDataFrame(list(enumerate(texts)), f"{simhash.ROW} long, text string").write.parquet(path)
    asked = spark.createDataFrame([(k, k) for k in range(80)], "node long, root long")
    got = {(r.a, r.b) for r in simhash.rare_pairs(spark, spark.read.parquet(path), asked).collect()}
    _, links = near_groups(texts)
    assert len(links) >= 10 and set(links) <= got and len(got) < 5 * len(links)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_are_encoded_together(name):
    """The ids are those of each chunk on its own, odd ones too, and there are far fewer texts in the calls than chunks."""
    own, calls = ChunkEncoder(tokenizer_path(name)), []
    letters = ["a", "B", "e\u0301", "ß", "字", "7", "'s", "#", "-", "\x00", "\x1c", "\u00a0", "😀"]
    rng = np.random.default_rng(4)
    chunks = [" \x00", "\x00", " a\x00", "\n", " \n ", "###", "don't", "\u0301x", *(" \n\t\r"[k % 4] * (1 + k % 3) + "".join(rng.choice(letters, 1 + k % 7, p=[0.3, 0.2, *[0.5 / 11] * 11])) for k in range(3000))]
    want = [own.tokenizer.encode(c, add_special_tokens=False).ids for c in chunks]
    whole = own.tokenizer
    own.tokenizer = mock.Mock(encode_batch_fast=lambda texts, **b: calls.append(len(texts)) or whole.encode_batch_fast(texts, **b))
    flat, count = own._ids(chunks)
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == want and sum(calls) < 0.8 * len(chunks)
    own.mark = own.mark[:-1] + [want[-1][-1]]  # a mark that chunks have too: each is encoded on its own
    flat, count = own._ids(chunks)
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == want


@pytest.mark.parametrize("vocabulary", [65534, 65535])
def test_windows_are_cut_anew_in_each_round(spark, monkeypatch, vocabulary):
    """All windows train, as they are, and none is written; with ids next to the largest of two bytes."""
    rng, wide = np.random.default_rng(9), lm_score.id_bytes(vocabulary)
    texts = [rng.integers(vocabulary - 40, vocabulary, n) for n in (1, 32, 33, 200, 500)]
    path = scratch_path(spark, "ids")
    spark.createDataFrame([(k, False, bytearray(x.astype(f"<u{wide}").tobytes())) for k, x in enumerate(texts)], f"{lm_score.ROW} long, held_out boolean, ids binary").write.parquet(path)
    monkeypatch.setattr(lm_score, "scratch_table", None)
    got = lm_score.fit_model(spark, spark.read.parquet(path), vocabulary).flat()
    begin = np.cumsum([0, *map(len, texts)])
    ids = np.concatenate(texts).astype(np.int32)
    want = lm_score.AttentionModel(np.bincount(ids, minlength=vocabulary))
    tables = lm_score._class_pairs(want.klass)(ids, begin).reshape(2, lm_score.CLASSES + 1, lm_score.CLASSES)
    want.with_pairs(*tables)
    row, nth = lm_score.window_numbers(begin)
    x, part = lm_score.windows_of(ids, begin, row, nth), lm_score._mix(row, nth) % np.uint64(lm_score.ROUNDS)
    for r in range(lm_score.ROUNDS):
        want.__dict__.pop("ratio", None)
        want.train(x[part == r], seed=1000 * r)
    assert len(x) == 1 + 1 + 2 + 7 + 16 and np.allclose(got, want.flat(), atol=1e-4)


def small_model(texts, vocabulary):
    ids, begin = np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)])
    model = lm_score.AttentionModel(np.bincount(ids, minlength=vocabulary))
    return model.with_pairs(*lm_score._class_pairs(model.klass)(ids, begin).reshape(2, lm_score.CLASSES + 1, lm_score.CLASSES)), ids, begin


def test_neither_windows_nor_ids_are_shuffled_to_train(spark, monkeypatch):
    """A shuffle of windows took more disk than the input."""
    path, kind = scratch_path(spark, "ids"), type(spark.range(1))
    spark.createDataFrame([(k, False, bytearray(np.arange(k, k + 90, dtype="<u2").tobytes())) for k in range(20)], f"{lm_score.ROW} long, held_out boolean, ids binary").write.parquet(path)
    seen, real = [], kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *cols: (seen.extend([set(self.columns)] if cols else []), real(self, *cols))[1])
    lm_score.fit_model(spark, spark.read.parquet(path), 2000)
    assert len(seen) == 2 + lm_score.ROUNDS and not any(columns & {"window", "ids"} for columns in seen)


def test_shards_of_a_task_train_on_all_its_windows(monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 8)
    rng, vocabulary = np.random.default_rng(3), 2000
    texts = [rng.integers(0, vocabulary, n) for n in (700, 1, 40, 333, 900, 64)]
    model, ids, begin = small_model(texts, vocabulary)
    table = pa.table({lm_score.ROW: list(range(6)), "ids": pa.array([x.astype("<u2").tobytes() for x in texts], pa.binary())})
    row, nth = lm_score.window_numbers(begin)
    x, part = lm_score.windows_of(ids, begin, row, nth), lm_score._mix(row, nth) % np.uint64(lm_score.ROUNDS)
    trained = 0
    for r in range(lm_score.ROUNDS):
        (got,) = lm_score._local(mock.Mock(value=model.arrays()), r, 1, 2)(table.to_batches(max_chunksize=2))
        own, want, shard = x[part == r], 0, 0
        weight = len(own)
        while len(own):
            size = 8 if len(own) >= 12 else len(own)
            want, own, shard = want + size * lm_score.AttentionModel.of(model.arrays()).train(own[:size], 1000 * r + shard).flat().astype(float), own[size:], shard + 1
        total = np.frombuffer(b"".join(got.column(1).to_pylist()))
        assert shard > 2 and set(got.column(2).to_pylist()) == {weight} and np.allclose(total[: len(want)], want, atol=1e-3) and not total[len(want) :].any()
        trained += weight
    assert trained == len(x) == sum(-(-len(t) // lm_score.STRIDE) for t in texts)


def test_gradients_are_those_of_the_loss():
    """By differences, on places with counts of their own left in."""
    rng = np.random.default_rng(5)
    model, ids, begin = small_model([rng.integers(0, 60, n) for n in (300, 20, 150)], 2000)
    x = lm_score.windows_of(ids, begin, *lm_score.window_numbers(begin))
    model._counted = lambda x, y, apart: lm_score.AttentionModel._counted(model, x, y, False)
    real = (x[:, lm_score.CONTEXT - lm_score.STRIDE + 1 :] >= 0).sum()
    model.p["k"] = (rng.standard_normal(model.p["k"].shape) * 0.2).astype(np.float32)

    def loss():
        model.__dict__.pop("projected", None)
        return -model.log_probs(x).sum(dtype=float) / real

    for name, grad in model.gradients(x).items():
        k = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = model.p[name][k]
        model.p[name][k] = kept + 0.02
        more = loss()
        model.p[name][k] = kept - 0.02
        less = loss()
        model.p[name][k] = kept
        assert math.isclose((more - less) / 0.04, grad[k], rel_tol=0.05, abs_tol=2e-5), name


def test_known_words_are_found():
    for known in ([], [7], [0, 1, 2, (1 << 46) - 1, 1 << 46, (1 << 64) - 2, (1 << 64) - 1], list(range(5, 4000, 3))):
        known = np.array(known, np.uint64)
        words = np.concatenate([known, known + np.uint64(1), np.array([0, 9, (1 << 64) - 1], np.uint64)])
        begins = np.searchsorted(known, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        place, found = lm_score._places(known, begins, words)
        assert found.tolist() == np.isin(words, known).tolist() and (known[place[found]] == words[found]).all()


def test_misra_gries_keeps_what_is_frequent():
    counts = collections.Counter()
    stream = [k % 3 for k in range(300)] + list(range(100, 300))
    for i in range(0, len(stream), 50):
        counts.update(stream[i : i + 50])
        counts = exact_dedup.misra_gries(counts, 6)
    assert {0, 1, 2} <= set(counts) and len(counts) <= 6


def test_quality_rules(spark, docs, none):
    trusted = spark.createDataFrame([(1,), (11,)], "id long")
    got = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(spark, docs, trusted).collect()}
    for i, t, *_ in rows():
        t = t or ""
        w = re.findall(WORDS, t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = collections.Counter(tri)
        covered = {k + j for k, x in enumerate(tri) if twice[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORDS, x)]
        r = got[i, len(w)]
        want = (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(spark, none, trusted).count() == 0
    assert quality_rules.quality_rules(spark, docs, trusted.limit(0)).filter("llr <> 0").count() == 0


def test_trusted_ids_are_bounded(spark):
    labels = spark.createDataFrame([(i, 1, 0 if i % 2 else None) for i in range(50)] + [(None, 1, 0), (60, 0, 0), (61, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_rules.trusted_ids(labels).count() == 50 and quality_rules.trusted_ids(labels, 7).count() == 7


def test_license_scan(spark, docs, none):
    got = license_scan.license_scan(spark, docs).collect()
    assert len(got) == len(rows())
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    want = []
    for i, t, *_ in rows():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        at = [(k, label) for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    same([r[:6] for r in got], want)
    assert license_scan.license_scan(spark, none).count() == 0


def labels_and_score(words):
    """By plain loops: whole phrases, and notices whose k-grams stand on neighbouring diagonals."""
    labels, score = set(), 0.0
    for text, label in license_scan.PHRASES:
        p = text.split()
        if any(words[k : k + len(p)] == p for k in range(len(words))):
            labels.add(label)
            score = 1.0
    k = license_scan.NOTICE_K
    for text, label in license_scan.NOTICES:
        p = text.split()
        places = collections.defaultdict(set)
        for i in range(len(words) - k + 1):
            for j in range(len(p) - k + 1):
                if words[i : i + k] == p[j : j + k]:
                    places[i - j].add(j)
        held, last = set(), None
        for d in sorted(places):
            held = places[d] | (held if last is not None and d - last <= license_scan.SLACK else set())
            last, share = d, len(held) / (len(p) - k + 1)
            if share >= license_scan.COVERED:
                labels.add(label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_license_labels_and_score_equal_loops(spark):
    rng, texts = np.random.default_rng(4), [PROSE, "", "cc by", "licensed under the"]
    for text, _ in license_scan.NOTICES:
        for cut in range(4):
            words = text.split()
            for _ in range(cut * 2):
                at = int(rng.integers(len(words)))
                words = [words[:at] + ["so"] + words[at:], words[:at] + words[at + 1 :]][int(rng.integers(2))]
            texts += [" ".join(words), "x y " + " ".join(words[: len(words) // 2]).upper() + " ... " + " ".join(words)]
    path = scratch_path(spark, "notices")
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2).write.parquet(path)
    for r in license_scan.license_scan(spark, spark.read.parquet(path)).collect():
        labels, score = labels_and_score(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].lower()))
        assert r.labels == labels and math.isclose(r.score, score, abs_tol=1e-9), texts[r.doc_id]


def test_license_places_are_verified_word_by_word(spark):
    """A template with a hash that it hasn't: no vote."""
    right = license_scan.template_grams(spark)
    wrong = right.withColumn("words", F.transform("words", lambda w: F.concat(w, F.lit("x"))))
    path = scratch_path(spark, "forged")
    spark.createDataFrame([(1, "the mit license")], "doc_id int, text string").write.parquet(path)
    with mock.patch.object(license_scan, "template_grams", lambda *_: wrong):
        r = license_scan.license_scan(spark, spark.read.parquet(path)).first()
    assert (r.n_words, r.n_base, r.labels, r.score) == (3, 0, "", 0.0)


def test_license_scan_is_linear_in_a_texts_length(spark):
    """Texts of 50,000 and 200,000 words: the longer one takes a few times as long, where a square would take sixteen times."""
    took = []
    for n in (50_000, 200_000):
        words = ["cc", "by", "so", "licensed", "under"] * (n // 5)
        path = scratch_path(spark, "long")
        spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string").write.parquet(path)
        began = time.monotonic()
        r = license_scan.license_scan(spark, spark.read.parquet(path)).first()
        took.append(time.monotonic() - began)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n // 5, 0, n - 5, "cc-by")
    assert took[1] < 30 and took[1] < 8 * took[0] + 2


def test_components(spark):
    """A chain, a star, a ring, two nodes that only meet themselves, links both ways and given twice; and too few rounds."""
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 300)] + [(i, 400 + (i - 399) % 9) for i in range(400, 409)] + [(5, 5), (6, 6), (301, 300), (300, 301), (300, 301)]
    group = {}
    for a, b in links:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    frame = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r.node: r.root for r in components.components(spark, frame).collect()}
    assert got == {x: min(g) for x, g in group.items() if len(g) > 1}  # a node alone has no link and isn't listed
    assert components.components(spark, frame.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        components.components(spark, frame, rounds=1)


def test_license_notices_bear_an_inserted_word(spark):
    text = license_scan.NOTICES[0][0].split()
    text.insert(len(text) // 2, "however")
    one = spark.createDataFrame([(1, "so: " + " ".join(text).upper())], "doc_id int, text string").repartition(1)
    path = scratch_path(spark, "notice")
    one.write.parquet(path)
    r = license_scan.license_scan(spark, spark.read.parquet(path)).first()
    assert r.labels == "mit-text" and 0.6 <= r.score < 1


def test_packing(spark, docs, none):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = packing.pack(spark, docs).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = []
    for i, t, *_ in rows():
        ids, start = tok.encode(t or "", add_special_tokens=False).ids + [2], 0
        for k, n in enumerate(packing.cut_lengths(len(ids))):
            want.append((i, k, start, n, crc(ids[start : start + n])))
            start += n
    same([r[:5] for r in got], want)
    seats = collections.defaultdict(list)
    for r in got:
        seats[r.sequence_id].append((r.offset, r.length))
    for seat in seats.values():
        end = 0
        for offset, length in sorted(seat):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert packing.pack(spark, none).count() == 0


@pytest.mark.parametrize("shape", ["uniform", "small", "large", "third"])
def test_packing_plan_is_tight(shape):
    rng = np.random.default_rng(1)
    lengths = {"uniform": rng.integers(1, 1025, 20000), "small": rng.integers(1, 200, 20000), "large": rng.integers(500, 1025, 5000), "third": np.where(rng.random(9000) < 0.34, 341, rng.integers(1, 1025, 9000))}[shape]
    sizes, counts = np.unique(lengths, return_counts=True)
    slots, n, placed = packing.plan(dict(zip(sizes.tolist(), counts.tolist(), strict=True)))
    assert sum(s[2] for s in slots) == len(lengths)
    assert placed >= 0.6 * ((lengths > packing.LARGE * packing.CAPACITY) & (lengths < packing.CAPACITY)).sum()
    floor = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
    assert n <= 1.02 * floor + 2


def test_packing_of_few_large_pieces():
    slots, n, placed = packing.plan({600: 3, 424: 3, 5: 2})
    assert n == 4 and placed == 6 and sum(s[2] for s in slots) == 8


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="no test tables")
def test_configurations_place_most_documents(spark):
    """Best fit alone gives 964 sequences here."""
    lengths = packing.op1_best_fit_packing(spark, MEDIUM).groupBy("length").count().collect()
    _, n, placed = packing.plan({r.length: r["count"] for r in lengths})
    assert n <= 964 and placed > 0.8 * sum(r["count"] for r in lengths if 128 < r.length < 1024)


@pytest.mark.parametrize("kind,block", [("byte", 65536), ("bit", 64)])
def test_token_output_round_trip(spark, docs, none, kind, block):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    path = scratch_path(spark, "ids")
    token_output.write_ids(spark, docs, path, block=block, planes=kind)
    got = sorted(token_output.read_ids(spark, path).collect(), key=lambda r: r.start)
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in rows()]
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids])
    assert [r.doc_id for r in got] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    total = sum(r.n_tokens for r in got)
    every = [x for r in token_output.read_span(spark, path, 0, total).orderBy("start").collect() for x in r.ids]
    assert len(every) == total and all(zlib.crc32(np.array(every[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32 for r in got)
    for first, count in ((0, 1), (100, 7), (total - 3, 50), (total, 5), (63, 130)):
        span = [x for r in token_output.read_span(spark, path, first, count).orderBy("start").collect() for x in r.ids]
        assert span == every[first : first + count]
    path = scratch_path(spark, "ids")
    token_output.write_ids(spark, none, path)
    assert token_output.read_ids(spark, path).count() == 0


def test_pieces_equal_the_library(spark, docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    encoded = pieces.encode_pieces(spark, docs)
    same([(r.doc_id, tuple(r.ids)) for r in encoded.collect()], [(i, tuple(library.encode(t or ""))) for i, t, *_ in rows()])
    same(pieces.decode_pieces(spark, encoded).collect(), [(i, t or "") for i, t, *_ in rows()])
    assert all(r.decoded for r in pieces.piece_digests(spark, docs).collect())
    assert pieces.piece_digests(spark, none).count() == 0


@pytest.mark.parametrize("alphabet,size", [("ABCDEFGHabcdefgh0123456789+/", 200_000), ("x", 30_000), ("etaoinshr漢字é😀<", 5000)])
def test_long_words_equal_the_library(alphabet, size):
    import pyarrow as pa
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    text = "".join(np.random.default_rng(0).choice(list(alphabet), size))
    ids, _ = pieces.PieceEncoder(path).encode_texts(pa.array([text]))
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)


def test_viterbi_finds_the_best_score():
    import pyarrow as pa

    e = pieces.PieceEncoder(tokenizer_path("piece_bpe_32k.model"), "viterbi")
    known = dict(zip(e.piece_keys.tolist(), e.piece_ids.tolist(), strict=True))
    for word in ("nations", "thereafter", "xqz", "aaaaaaa"):
        text = "▁" + word
        best = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - e.longest), end):
                piece = known.get(int(e._key(np.array([[ord(c) for c in text[begin:end]]]))[0]))
                score = e.scores[piece] if piece is not None else (e.worst if end - begin == 1 else -math.inf)
                best[end] = max(best[end], best[begin] + score)
        ids, _ = e.encode_texts(pa.array([word]))
        assert math.isclose(e.scores[ids].sum(), best[-1])


def test_url_filter(spark):
    urls = ["http://Example.ORG/es/x?q", "https://a.b.example.org/en/12#t", "x.org/no", None, "http://org/", "http://org", "ftp://notexample.org/es/", "http://www.com/de/", "http://www.com/fr/a", "//", "http://a.net/de/", "http:///x", "http://sub.example.org/en/1"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host string, path string")
    path = scratch_path(spark, "pages")
    pages.write.parquet(path)
    got = {r.page_id: r for r in url_filter.url_filter(spark, spark.read.parquet(path)).collect()}
    for i, u in enumerate(urls + urls[:2]):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        place = re.split("[?#]", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and place.startswith(p)]
        want = max(fit, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, place, want[1], want[2])
    assert url_filter.url_filter(spark, spark.read.parquet(path).limit(0)).count() == 0


@pytest.mark.parametrize("sample", [1, 200])
def test_url_filter_with_nested_rules(spark, monkeypatch, sample):
    """Rules within rules, ties of length and of verdicts, text ids, repeated rows, and one host with most pages, cut into many ranges."""
    monkeypatch.setattr(url_filter, "SAMPLE", sample)
    rng = np.random.default_rng(sample)
    hosts = ["a", "b.a", "c.b.a", "bb.a", "d", "a.d", "b"]
    rules = {(str(rng.choice(["allow", "block"])), str(rng.choice(hosts)), str(rng.choice(["/", "/x", "/x/", "/x/y", "", "/z"]))) for _ in range(25)}
    rules |= {("block", "b.a", "/x"), ("allow", "b.a", "/x"), ("allow", "bb.a", "/x"), ("block", "a", "/x/yy")}
    urls = [f"http://{rng.choice(hosts + ['e.c.b.a', 'A', 'xa'])}{rng.choice(['', '/', '/x', '/x/y', '/x/yy?q', '/zz', '/X'])}" for _ in range(120)] + ["http://b.a/x/y"] * 80 + [None, ""]
    path = scratch_path(spark, "pages")
    spark.createDataFrame([(f"p{i}", u, i) for i, u in enumerate(urls)] + [("p0", urls[0], 7)], "page_id string, url string, part int").repartition(3).write.parquet(path)
    frame = spark.createDataFrame(sorted(rules), "verdict string, host string, path string")
    got = url_filter.url_filter(spark, spark.read.parquet(path), frame, default="none").collect()
    assert len(got) == len(urls) + 1
    for r in got:
        fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fit, default=(0, 0, False, None, "none"))
        assert (r.rule, r.verdict) == best[3:], (r, fit)
    assert {r.verdict for r in url_filter.url_filter(spark, spark.read.parquet(path), frame.limit(0), default="none").collect()} == {"none"}


def test_quality_verdicts_equal_loops(spark):
    """llr and kept of every text by plain counts of hashed words and pairs."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'good' if k % 3 else 'bad'}{int(x)}" for x in rng.integers(0, 30, int(rng.integers(40, 90)))) for k in range(40)] + ["", None, "one"]
    path = scratch_path(spark, "judged")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    trusted = [i for i in range(40) if i % 3][:12]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark, spark.read.parquet(path), spark.createDataFrame([(i,) for i in trusted], "id long"), buckets=64).collect()}

    def grams(text):
        w = [x.encode() for x in re.findall(WORDS, text or "")]
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        return [signed(h) % 64 for h in one] + [signed(xxhash.xxh64_intdigest(b, h)) % 64 for h, b in zip(one, w[1:], strict=False)]

    raw, good = ([1 + n for n in np.bincount([g for i in ids for g in grams(texts[i])], minlength=64).tolist()] for ids in (range(len(texts)), trusted))
    weight = [round(math.log(g / sum(good)) - math.log(r / sum(raw)), 6) for g, r in zip(good, raw, strict=True)]
    verdicts = set()
    for i, t in enumerate(texts):
        found = grams(t)
        llr = sum(weight[g] for g in found) / max(len(found), 1)
        assert math.isclose(got[i].llr, llr, abs_tol=1e-5)
        if abs(llr - quality_rules.THRESHOLD) > 1e-4:
            assert got[i].kept == (not got[i].base_failed and llr >= quality_rules.THRESHOLD)
        verdicts.add((got[i].base_failed, got[i].kept))
    assert verdicts == {(True, False), (False, True), (False, False)}


def test_simhash(spark, docs, none):
    got = simhash.simhash_groups(spark, docs).collect()
    prints = []
    for i, t, *_ in rows():
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    component = list(range(len(prints)))
    for _ in prints:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 3:
                    component[a] = component[b] = min(component[a], component[b])
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[component[k]] = min(least.get(component[k], i), i)
    same([(r.doc_id, r.fingerprint, r.component_id) for r in got], [(i, f"{x:016x}", least.get(component[k])) for k, (i, x) in enumerate(prints)])
    assert sum(r.stays for r in got) == len(set(component))
    assert simhash.simhash_groups(spark, none).count() == 0


def near_groups(texts):
    """Numbers of the first text that each reaches over links of 0.8 or more, and the links."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets[:a]) if x == y or 5 * len(x & y) >= 4 * len(x | y)]
    group = list(range(len(sets)))
    for _ in sets:
        before = list(group)
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    return group, links


def test_near_copies(spark, docs, none, monkeypatch):
    """Nulls, texts without words and repeated rows; then groups of near copies, one of them large, with texts that lie between two groups."""
    got = simhash.near_copies(spark, docs).collect()
    group, _ = near_groups([t for _, t, *_ in rows()])
    least = {}
    for k, (i, *_) in enumerate(rows()):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    same([(r.doc_id, r.component_id) for r in got], [(i, least.get(group[k])) for k, (i, *_) in enumerate(rows())])
    assert sum(r.stays for r in got) == len(set(group))
    assert simhash.near_copies(spark, none).count() == 0

    monkeypatch.setattr(simhash, "PER_COPY", 3)
    rng = np.random.default_rng(5)
    texts = []
    for k in range(40):
        base = rng.integers(0, 50_000, 250)
        for _ in range(1 if k % 2 else 60 if k == 0 else 4):
            words = base.copy()
            words[rng.choice(250, rng.integers(0, 8), replace=False)] = rng.integers(0, 50_000)
            texts.append(" ".join(f"W{x}" for x in words))
    group, links = near_groups(texts)
    path = scratch_path(spark, "nearly")
    spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(4).write.parquet(path)
    root = {r.doc_id: r.component_id for r in simhash.near_copies(spark, spark.read.parquet(path), "id", "body").collect()}
    assert all(group[k] == group[r] for k, r in root.items())  # nothing is joined that isn't linked
    assert len(links) > 500 and np.mean([root[a] == root[b] for a, b in links]) > 0.99


def test_keys_of_near_copies_meet(spark):
    """Pairs at a similarity of 0.8 to 0.9: over 0.9 of them share a key, and almost none differ in too many of the further bits."""
    rng = np.random.default_rng(6)
    a, b = [], []
    for _ in range(200):
        shared, own = rng.integers(0, 1 << 62, 1000).astype(np.uint64), rng.integers(0, 1 << 62, 220).astype(np.uint64)
        n = int(rng.integers(50, 110))  # similarity 1000 / (1000 + 2 n)
        a.append(simhash.votes(np.append(shared, own[:n])))
        b.append(simhash.votes(np.append(shared, own[n : 2 * n])))
    a, b = np.array(a), np.array(b)
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(simhash.near_keys(a), simhash.near_keys(b), strict=True)]
    apart = ((a[:, 192:] > 0) != (b[:, 192:] > 0)).sum(axis=1)
    assert np.mean(met) > 0.95 and np.mean(apart <= simhash.CHECK_BITS) > 0.99


def test_golay_keys_miss_no_pair_within_three_bits():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    w = v.copy()
    for k in range(len(w)):
        for bit in rng.choice(64, k % 4, replace=False):
            w[k] ^= np.uint64(1) << np.uint64(bit)
    stored, searched = simhash.golay_keys(v)[0], simhash.golay_keys(w)[1]
    assert all(set(a.tolist()) & set(b.tolist()) for a, b in zip(stored, searched, strict=True))


def test_language(spark, docs, none):
    model = language.fit(docs)
    assert model[0] == ["en"]
    got = language.predict_languages(spark, docs, model).collect()
    assert len(got) == len(rows())
    letters = {i: any(c.isalpha() for c in t or "") for i, t, *_ in rows()}
    for r in got:
        assert (r.lang_pred == "en") == letters[r.doc_id] and 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert language.predict_languages(spark, none, language.fit(none)).count() == 0


def test_language_predictions_equal_loops(spark):
    """Each row's language and score by loops over windows, places and filters: null, without letters, short, and longer than a window."""
    net, langs = language.ByteConvNet(3, seed=9), ["de", "en", "fr"]
    rng = np.random.default_rng(1)
    texts = [None, "", "12 !", "a", "ab", "字", "Die Straße", PROSE[:300], "".join(rng.choice(list("abcdé ñ字"), language.WINDOW * 2 + 3)), "x" * language.WINDOW]
    path = scratch_path(spark, "languages")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    p, deep = {k: v.astype(np.float64) for k, v in net.p.items()}, max(language.WIDTHS)
    for r in language.predict_languages(spark, spark.read.parquet(path), (langs, net)).collect():
        text = texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == (language.UNKNOWN, 0.0)
            continue
        raw, total = text.encode(), np.zeros(3)
        starts = range(0, len(raw), language.WINDOW)
        for begin in starts:
            values = [raw[k] if k < len(raw) else 256 for k in range(begin, begin + language.WINDOW + deep - 1)]
            pooled = []
            for w in net.widths:
                places = [k for k in range(language.WINDOW) if values[k] != 256]
                y = np.array([np.concatenate([p["e"][v] for v in values[k : k + w]]) @ p[f"k{w}"] for k in places])
                pooled.append(np.maximum(y.max(axis=0) + p[f"b{w}"], 0))
            z = np.exp(np.concatenate(pooled) @ p["v"] + p["c"])
            total += z / z.sum()
        total /= len(starts)
        assert r.lang_pred == langs[int(total.argmax())] and math.isclose(r.score, total.max(), rel_tol=1e-4), r


def test_language_rows_are_bounded_whatever_the_ids(spark):
    """One text id on many rows, null languages, and names that the operator uses itself."""
    rows = [("one", f"text number {k} " * 40, "en" if k % 3 else "xx", "a", "b") for k in range(60)] + [("one", "text number 1 " * 40, "en", "a", "b")] * 30 + [(None, "x", None, "a", "b")]
    path = scratch_path(spark, "ids")
    spark.createDataFrame(rows, "name string, body string, tongue string, __text string, __found string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    names = dict(id_col="name", text_col="body")
    assert len({r.key for r in language.training_rows(docs, 7, lang_col="tongue", **names).collect()}) == 7
    model = language.fit(docs, 7, lang_col="tongue", **names)
    got = language.predict_languages(spark, docs, model, keep=("__text", "__found"), **names).collect()
    assert len(got) == len(rows) and {(r["__text"], r["__found"]) for r in got} == {("a", "b")} and {r.doc_id for r in got} == {"one", None}


def test_language_learns_from_every_window(spark):
    path = scratch_path(spark, "long")
    spark.createDataFrame([(1, "a long text " * 5000, "en")], "doc_id long, text string, lang string").write.parquet(path)
    rows = language.training_rows(spark.read.parquet(path)).mapInArrow(language._samples, "key string, k long, raw binary, lang string")
    assert rows.count() == -(-60000 // language.WINDOW)


def test_language_tells_alphabets_apart():
    rng = np.random.default_rng(0)
    draw = lambda letters: np.frombuffer("".join(rng.choice(list(letters), language.WINDOW + 3)).encode(), np.uint8)[: language.WINDOW + 3]
    data = np.array([draw("abcde ") if k % 2 else draw("vwxyz ") for k in range(400)], np.int64)
    net = language.ByteConvNet(2).train(data[:300], np.arange(300) % 2)
    assert (net.forward(data[300:])[0].argmax(axis=1) == np.arange(100) % 2).mean() > 0.97


def test_lm_base(spark, docs, none):
    got = lm_score.lm_scores(spark, docs, frequent=5).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in rows()]
    counts = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n = sum(counts.values())
    space = n + 0.1 * (len(counts) + 1)
    want = [(i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / space) for w in ws), 4)) for i, ws in tokens]
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], want)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert lm_score.lm_scores(spark, none).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_lm_without_training_rows_and_with_text_ids(spark, kind):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    path = scratch_path(spark, "held")
    spark.createDataFrame([(i, "some words here" if i else None) for i in held], "doc_id long, text string").selectExpr(f"cast(doc_id AS {kind}) AS doc_id", "text").write.parquet(path)
    got = lm_score.lm_scores(spark, spark.read.parquet(path)).collect()
    assert len(got) == 5 and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)


def test_lm_windows_score_each_id_once():
    begin = np.array([0, 5, 5, 105])
    row, nth = lm_score.window_numbers(begin)
    x = lm_score.windows_of(np.arange(105), begin, row, nth)
    scored = x[:, lm_score.CONTEXT - lm_score.STRIDE + 1 :]
    assert sorted(scored[scored >= 0].tolist()) == list(range(105))


def test_lm_targets_see_at_least_seventeen_ids():
    begin = np.array([0, 200])
    x = lm_score.windows_of(np.arange(200), begin, *lm_score.window_numbers(begin))
    first = lm_score.CONTEXT - lm_score.STRIDE + 1
    seen = {int(w[j]): int((w[:j] >= 0).sum()) for w in x for j in range(first, len(w)) if w[j] >= 0}
    assert all(n >= min(i, 17) for i, n in seen.items())


def test_language_model_trains_on_every_window(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the old house by the river " * 40) for i in range(30)], "doc_id long, text string")
    real, seen = lm_score.scratch_table, {}
    monkeypatch.setattr(lm_score, "scratch_table", lambda s, df, tag: seen.setdefault(tag, real(s, df, tag)))
    lm_score.lm_scores(spark, docs)
    learnt = [len(r.ids) // lm_score.id_bytes(50257) for r in seen["subwords"].filter("NOT held_out").collect()]
    assert seen["windows"].count() == sum(-(-n // lm_score.STRIDE) for n in learnt) > 0
