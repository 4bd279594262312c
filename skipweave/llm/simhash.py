"""SimHash near-duplicates: fingerprints joined on Golay codewords of their segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skipweave.llm.common import ROW, discard, marked, numbered, placed, scratch_table, stored
from skipweave.llm.components import components
from skipweave.llm.tokens import slices

#: Words of a shingle.
SHINGLE = 3
#: The most bits in which linked fingerprints differ.
BITS = 3
SEED = 42
#: Words of a shingle in near_copies, segments of its prints, and the most of 64 further bits in which compared texts differ (at a similarity
#: of 0.8 some 10 differ, with a deviation of 3; of unrelated texts 32, with one of 4).
STAGE_SHINGLE = 5
SEGMENTS = 7
CHECK_BITS = 20
#: Pairs of a text for each copy of its shingles.
PER_COPY = 4096
# Fixed value: the generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011


def _remainder(v: int) -> int:
    for k in range(22, 10, -1):
        if v >> k & 1:
            v ^= GOLAY << (k - 11)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(remainders of the upper 12 bits; for each syndrome its error patterns, padded with -1).

    The code is perfect: each syndrome has one pattern of up to 3 bits, which leads to the nearest codeword. If that has 3 bits, five
    patterns of 4 bits share the syndrome and lead to the codewords at distance 4.
    """
    high = np.array([_remainder(k << 11) for k in range(4096)], np.int64)
    one = np.array([_remainder(1 << k) for k in range(23)], np.int64)
    patterns = np.full((2048, 6), -1, np.int64)
    patterns[0, 0] = 0
    held = np.zeros(2048, np.int64)
    held[0] = 1
    words = [(0, 0, -1)]
    for weight in range(1, 5):
        words = [(e | 1 << k, s ^ int(one[k]), k) for e, s, last in words for k in range(last + 1, 23)]
        for e, s, _ in words:
            if weight < 4 or bin(int(patterns[s, 0])).count("1") == 3:
                patterns[s, held[s]] = e
                held[s] += 1
    return high, patterns


def codewords(segment: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For 23-bit values the indices of their nearest codeword and of those at distance 4; -1 pads six columns."""
    high, patterns = tables
    error = patterns[high[segment >> 11] ^ (segment & 0x7FF)]
    return np.where(error >= 0, (segment[:, None] ^ error) >> 11, -1)


def golay_keys(prints: np.ndarray, tables=None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(stored keys, searched keys) of 64-bit fingerprints: any two within 3 bits share a stored key of the one and a searched key of the other.

    A fingerprint has segments of 23, 23 and 18 bits. If two differ in a single bit of a segment, the codeword nearest to the one
    is within distance 4 of the other. Three differing bits leave two cases: at most one in each segment, and all three indices meet; or
    one segment with two or more, while of the other two one is equal and one differs in a bit at most, and an equal segment with an index meets.
    """
    tables = tables or golay_tables()
    v = prints.astype(np.uint64)
    segments = [(v >> np.uint64(41)).astype(np.int64), (v >> np.uint64(18)).astype(np.int64) & 0x7FFFFF, v.astype(np.int64) & 0x3FFFF]
    codes = [codewords(s, tables) for s in segments]
    pairs = [(x, y) for x in range(3) for y in range(3) if x != y]

    def exact(tag: int, x: int, code: np.ndarray) -> np.ndarray:
        return np.int64(tag) << 40 | segments[x] << 12 | code

    a, b, c = codes
    stored = np.stack([np.int64(7) << 40 | a[:, 0] << 24 | b[:, 0] << 12 | c[:, 0], *(exact(t, x, codes[y][:, 0]) for t, (x, y) in enumerate(pairs))], axis=1)
    triple = np.int64(7) << 40 | a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]
    real = (a >= 0)[:, :, None, None] & (b >= 0)[:, None, :, None] & (c >= 0)[:, None, None, :]
    searched = [triple.reshape(len(v), -1)]
    mask = [real.reshape(len(v), -1)]
    for t, (x, y) in enumerate(pairs):
        searched.append(exact(t, x, 0)[:, None] | np.maximum(codes[y], 0))
        mask.append(codes[y] >= 0)
    searched, mask = np.concatenate(searched, axis=1), np.concatenate(mask, axis=1)
    return stored, [row[m] for row, m in zip(searched, mask, strict=True)]


def fingerprint(text: str | None, size: int = SHINGLE) -> bytes:
    """Eight bytes, the highest bit first: a bit is set if it is in over half the hashes of the text's shingles, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes, so ASCII alone is lower-cased and split at
    if not words:
        return bytes(8)
    joined, n, digest = b" ".join(words), len(words) - size + 1, xxhash.xxh64_digest
    if n <= 1:
        hashes, n = digest(joined, SEED), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts, ends[size - 1 :].tolist(), strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > n).tobytes()


def _fingerprints(batches):
    for batch in slices(batches, 2):
        prints = b"".join([fingerprint(t) for t in batch.column(2).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], ["doc_id", ROW, "print"])


def _keys(batches):
    tables = golay_tables()
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            stored, searched = golay_keys(part.column(0).to_numpy().view(np.uint64), tables)
            sizes = np.cumsum([0, *map(len, searched)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, stored.size + 1, stored.shape[1], dtype=np.int32)), pa.array(stored.reshape(-1))),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(searched) if searched else np.zeros(0, np.int64))),
                ],
                ["print", "stored", "searched"],
            )


def near_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in `bits` bits at most; each pair may come from several keys."""
    if bits > BITS:
        raise ValueError("the keys find pairs within 3 bits")
    keys = prints.mapInArrow(_keys, "print long, stored array<long>, searched array<long>")
    stored = keys.select(F.col("print").alias("a"), F.explode("stored").alias("key"))
    searched = keys.select(F.col("print").alias("b"), F.explode("searched").alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    # the optimizer takes exploded rows for as few as their parents; neither side may be broadcast on that account
    return stored.hint("merge").join(searched.hint("merge"), [stored["key"] == searched["key"], F.col("a") < F.col("b"), near]).select("a", "b")


def simhash_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, row_col: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, fingerprint, component_id, and the row's number and whether it is the one that stays.

    A-Z lower-cased, words without ASCII white space, 3-word shingles with repeats; fewer words give one shingle, none (null too) the
    fingerprint zero. Fingerprints link at `bits` differing bits or fewer; component_id is the smallest id reachable. Null ids
    come last; repeated rows share a component, of which the first row stays. row_col is a stored number of the rows; without it
    they are numbered here. An empty table gives no rows; other columns play no part.

    All search is on distinct fingerprints, so copies cost nothing; pairs are compared within the join and leave it only when they
    link, and a key's bucket is split among tasks where it is skewed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    narrow = (docs.select(*columns, F.col(row_col).alias(ROW)) if row_col else numbered(docs.select(*columns))).select("doc_id", ROW, "text")
    stored = scratch_table(spark, narrow.mapInArrow(_fingerprints, f"doc_id {kind}, {ROW} long, print long"), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    distinct = scratch_table(spark, stored.groupBy("print").agg(F.min(first).alias("first")), "distinct")
    roots = components(spark, near_links(distinct.select("print"), bits))
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    of = scratch_table(spark, rooted.join(least, "root").select("print", "least"), "components")
    return stored.join(of, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("least.id").alias("component_id"),
        (F.col("least.row") == F.col(ROW)).alias("stays"),
        ROW,
    )


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """256 bits from each 64-bit hash: four draws of the splitmix generator that it seeds."""
    out = np.empty((len(hashes), 4), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(4):
            z = hashes + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            out[:, k] = z ^ z >> np.uint64(31)
    return out


def shingle_set(words: list[bytes], size: int = STAGE_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles; fewer words give one shingle, none an empty set."""
    if not words:
        return np.zeros(0, np.uint64)
    n, digest = max(1, len(words) - size + 1), xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + size]), SEED) for k in range(n)), np.uint64, n))


def votes(hashes: np.ndarray) -> np.ndarray:
    """For 256 bits, how many more of the hashes set the bit than leave it."""
    total = np.zeros(256, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = _mixed(hashes[k : k + (1 << 16)])
        total += 2 * np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) - len(part)
    return total


def near_keys(sums: np.ndarray) -> np.ndarray:
    """Keys of rows of votes. Each of seven segments of 23 bits is decoded to the two codewords that agree best with its votes; a key is
    two segments with a codeword of each. Two texts share a key if two of their segments share a codeword, so five may err."""
    code = np.array([k << 11 ^ _remainder(k << 11) for k in range(4096)], np.int64)
    signs = (2 * (code[:, None] >> np.arange(22, -1, -1) & 1) - 1).astype(np.float32).T
    found = np.empty((len(sums), SEGMENTS, 2), np.int32)
    for i in range(0, len(sums), 1024):
        part = sums[i : i + 1024].astype(np.float32)
        for s in range(SEGMENTS):
            fit = part[:, 23 * s : 23 * s + 23] @ signs
            for rank in range(2):
                found[i : i + 1024, s, rank] = best = fit.argmax(axis=1)
                fit[np.arange(len(fit)), best] = -np.inf
    chosen = [(x, y) for x in range(SEGMENTS) for y in range(x)]
    return np.stack([t << 24 | found[:, x, p] << 12 | found[:, y, q] for t, (x, y) in enumerate(chosen) for p in range(2) for q in range(2)], axis=1)


def _sketches(batches):
    for batch in slices(batches, 2, 8 << 20):
        n = batch.num_rows
        sums, some, digests = np.zeros((n, 256), np.int64), np.zeros(n, bool), []
        for k in range(n):  # the words of one text at a time
            words = (batch.column(2)[k].as_py() or "").encode().lower().split()
            sums[k], some[k] = votes(shingle_set(words)), bool(words)
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
        keys = near_keys(sums)
        ends = np.cumsum([0, *(some * keys.shape[1])]).astype(np.int32)
        check = np.packbits(sums[:, 192:] > 0, axis=1).reshape(-1).view(">i8").astype(np.int64)
        columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(check), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", ROW, "digest", "check", "keys"])


def _sets(batches):
    for batch in slices(batches, 1):
        for k in range(batch.num_rows):
            found = shingle_set((batch.column(1)[k].as_py() or "").encode().lower().split()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], ["node", "shingles"])


def similar_links(spark: SparkSession, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows of texts (ROW, text) whose sets of shingles have a similarity of 0.8 or more, by comparing the sets.

    Only texts that are in a pair are cut into shingles. A row b of many pairs is copied, one copy for each PER_COPY of them.
    """
    pairs, pairs_at = stored(spark, pairs, "pairs")
    named = pairs.select("a").union(pairs.select("b"))
    sets = marked(texts, ROW, named).select(ROW, "text").mapInArrow(_sets, "node long, shingles array<long>")
    sets, sets_at = stored(spark, sets, "sets")
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_COPY).alias("copies"))
    right = sets.join(copies, sets["node"] == copies["b"]).select("b", F.col("shingles").alias("right"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    spread = pairs.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), "copies").alias("copy"))
    both = spread.join(right, ["b", "copy"]).join(sets, F.col("a") == F.col("node"))
    common, total = F.size(F.array_intersect("shingles", "right")), F.size("shingles") + F.size("right")
    similar = scratch_table(spark, both.filter(9 * common >= 4 * total).select("a", "b"), "similar")  # common / (total - common) >= 0.8
    for path in (pairs_at, sets_at):
        discard(spark, path)
    return similar


def rare_pairs(spark: SparkSession, texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs a > b of asked nodes (node, root) of different roots that share one of the rarest fifth of the shingles of each: all that can have a similarity of 0.8.

    Of n shingles at most n - ceil(0.8 n) may be missing from a similar text, so it has one of any n - ceil(0.8 n) + 1 of them; in one order for all texts,
    the first so many of both have one in common. Rare ones come first, and those that no other asked text has take their places without being shuffled
    again, so a shingle that many texts share makes pairs only for texts that have little else. Where the first that two texts have in common is the i-th of m and the j-th of n, they share
    min(m - i, n - j) + 1 at most, which has to be 4/9 of m + n: only where that can be do they meet.
    """
    sets = marked(texts, ROW, asked.select("node")).select(ROW, "text").mapInArrow(_sets, "node long, shingles array<long>")
    sets, sets_at = stored(spark, sets, "rare_sets")
    posted = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = posted.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    posted = posted.join(often.hint("merge"), "shingle")
    of = Window.partitionBy("node")
    nth = F.row_number().over(of.orderBy("often", "shingle")) + F.col("n") - F.count("*").over(of)
    first = posted.withColumn("nth", nth).filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1).select("shingle", "node", "n", "nth")
    first, first_at = stored(spark, first.join(asked, "node"), "rare")
    discard(spark, sets_at)
    x, y = first.hint("merge").alias("x"), first.hint("merge").alias("y")
    size = (5 * F.col("x.n") >= 4 * F.col("y.n")) & (5 * F.col("y.n") >= 4 * F.col("x.n"))
    enough = 9 * (F.least(F.col("x.n") - F.col("x.nth"), F.col("y.n") - F.col("y.nth")) + 1) >= 4 * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & size & enough)
    pairs = scratch_table(spark, met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "rare_pairs")
    discard(spark, first_at)
    return pairs


def near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, component_id (the smallest id reachable), whether it is the row that stays, and the row's number.

    Texts link if their sets of five-word shingles (A-Z lower-cased, words without ASCII white space; fewer words: one shingle) have a
    similarity of 0.8 or more. Texts of the same words are one, and so are those without words, null among them. Null ids come last; of repeated
    rows the first stays. row_col is a number of the rows that every scan gives again (see placed); without it they are numbered here.
    An empty table gives no rows; other columns play no part.

    A text has 84 keys (see near_keys) and 64 further bits that rule chance meetings out. First each text is compared with the first text of each of its keys, at most 84,
    which joins large groups. The texts that then share a key, and most further bits, with one of another group are paired by their rarest shingles alone (see rare_pairs), which
    loses no link: texts that look alike by a common passage, and differ in what is their own, are never paired.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    narrow = docs.select(*columns, F.col(row_col).alias(ROW)) if row_col else placed(spark, docs.select(*columns))[0]
    narrow = narrow.select("doc_id", ROW, "text")
    sketches = narrow.mapInArrow(_sketches, f"doc_id {kind}, {ROW} long, digest binary, check long, keys array<int>")
    sketches = scratch_table(spark, sketches, "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    texts = scratch_table(spark, sketches.groupBy("digest").agg(F.min(first).alias("first")), "texts")
    nodes = sketches.join(texts.select(F.col("first.row").alias(ROW)), ROW, "left_semi").select(F.col(ROW).alias("node"), "check", "keys")
    nodes = scratch_table(spark, nodes, "nodes")

    keyed = nodes.select(F.explode("keys").alias("key"), "node", "check")
    met = keyed.groupBy("key").agg(F.min(F.struct("node", "check")).alias("lead"), F.count("*").alias("n")).filter("n > 1").select("key", "lead")
    shared, shared_at = stored(spark, keyed.hint("merge").join(met.hint("merge"), "key"), "shared")
    likely = shared.filter(F.bit_count(F.col("check").bitwiseXOR(F.col("lead.check"))) <= CHECK_BITS).filter("node <> lead.node")
    few = likely.select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct()
    links = similar_links(spark, narrow, few)

    roots = components(spark, links)
    grouped, grouped_at = stored(spark, shared.join(roots, "node", "left").select("key", "node", "check", F.coalesce("root", "node").alias("root")), "placed")
    discard(spark, shared_at)
    groups = grouped.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other").select("key")
    open_, open_at = stored(spark, grouped.join(groups, "key"), "open")
    discard(spark, grouped_at)
    x, y = open_.hint("merge").alias("x"), open_.hint("merge").alias("y")
    near = F.bit_count(F.col("x.check").bitwiseXOR(F.col("y.check"))) <= CHECK_BITS
    apart = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & near, "left_semi").select("node", "root").distinct()
    apart = scratch_table(spark, apart, "apart")
    discard(spark, open_at)
    roots = components(spark, links.unionByName(similar_links(spark, narrow, rare_pairs(spark, narrow, apart))))

    rooted = texts.join(roots, texts["first.row"] == roots["node"], "left").select("digest", "first", F.coalesce("root", "first.row").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    of = scratch_table(spark, rooted.join(least, "root").select("digest", "least"), "near")
    return sketches.join(of, "digest").select("doc_id", F.col("least.id").alias("component_id"), (F.col("least.row") == F.col(ROW)).alias("stays"), ROW)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """docs with one row of each group of near_copies, with the columns of docs, whatever their names; docs are neither written nor shuffled: bits for the dropped rows meet them where they are read."""
    docs, row = placed(spark, docs)
    dropped = near_copies(spark, docs, row_col=row).filter("NOT stays").select(ROW)
    return marked(docs, row, dropped, keep=False).drop(row)
