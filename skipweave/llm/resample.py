"""Importance resampling towards a target distribution: hashed n-gram counts by DuckDB in each task, merged and scored by Spark."""

from __future__ import annotations

import functools
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skipweave.llm.common import documents, scratch_table, stored
from skipweave.llm.tokens import slices

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text that DuckDB counts at a time, and what it may hold before it spills.
SLICE = 4 << 20
MEMORY = "300MB"
#: Words of up to so many bytes have tables of their own for joining CRCs.
SHORT = 64

#: Runs of one and two words of each text of `slice`, by bucket. zlib's CRC is asked for distinct words alone, once as they are and once before a space;
#: that of two words comes from the CRCs of both and the length of the second.
_COUNT = r"""
WITH split AS (
  SELECT line, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM slice
), words AS MATERIALIZED (
  SELECT line, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split
), hashed AS (
  SELECT word, crc32_of(word) AS crc, crc32_of(word || ' ') AS before, strlen(word) AS size FROM (SELECT DISTINCT word FROM words)
), runs AS (
  SELECT line, crc, before, lead(crc) OVER following AS next_crc, lead(size) OVER following AS next_size FROM words JOIN hashed USING (word) WINDOW following AS (PARTITION BY line ORDER BY i)
), grams AS (
  SELECT line, crc FROM runs UNION ALL SELECT line, crc32_joined(before, next_crc, next_size) FROM runs WHERE next_crc IS NOT NULL
)
SELECT line, CAST(crc % $buckets AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS n FROM grams GROUP BY ALL
"""


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def crc32_of(words) -> pa.Array:
    words = _whole(words).cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    raw = memoryview(words.buffers()[2] or b"")
    return pa.array(np.fromiter(map(zlib.crc32, map(raw.__getitem__, map(slice, ends, ends[1:]))), np.int64, len(words)))


def _after(n: int, crc: int) -> int:
    """What a CRC becomes by n more bytes, apart from those bytes' own CRC."""
    return zlib.crc32(bytes(n), crc) ^ zlib.crc32(bytes(n))


@functools.cache
def _shifts() -> np.ndarray:
    """_after for each length up to SHORT and each byte of a CRC; it is linear, so the bytes' shares are put together by xor."""
    return np.array([[[_after(n, b << 8 * k) for b in range(256)] for k in range(4)] for n in range(SHORT + 1)], np.int64)


def crc32_joined(first, second, size) -> pa.Array:
    """The CRC of two strings one after the other, from theirs and the size of the second."""
    first, second, size = (_whole(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (first, second, size))
    table, short = _shifts(), np.minimum(size, SHORT)
    out = table[short, 0, first & 255] ^ table[short, 1, first >> 8 & 255] ^ table[short, 2, first >> 16 & 255] ^ table[short, 3, first >> 24]
    for k in np.flatnonzero(size > SHORT):
        out[k] = _after(int(size[k]), int(first[k]))
    return pa.array(out ^ second)


def _lists(lines: np.ndarray, n_lines: int, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(lines, np.arange(n_lines + 1)), pa.int32()), pa.array(values, pa.int32()))


def _counted(buckets: int, size: int, memory: str):
    def run(batches):
        import duckdb

        with tempfile.TemporaryDirectory() as spill:
            con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill})
            con.create_function("crc32_of", crc32_of, ["VARCHAR"], "BIGINT", type="arrow")
            con.create_function("crc32_joined", crc32_joined, ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow")
            for batch in slices(batches, 1, size):
                n = batch.num_rows
                con.register("slice", pa.table({"line": pa.array(np.arange(n, dtype=np.int32)), "text": batch.column(1)}))
                found = con.sql(_COUNT.replace("$buckets", str(buckets))).to_arrow_table()
                con.unregister("slice")
                line, bucket, count = (found.column(c).to_numpy() for c in ("line", "bucket", "n"))
                order = np.argsort(line.astype(np.int64) * buckets + bucket)
                line, bucket, count = line[order], bucket[order], count[order]
                own, ids = pa.array(np.zeros(n, bool)), batch.column(0)
                features = np.bincount(line, weights=count, minlength=n).astype(np.int64)  # of n words there are 2 n - 1
                yield pa.RecordBatch.from_arrays([own, ids, pa.array((features + 1) // 2), _lists(line, n, bucket), _lists(line, n, count)], ["total", "doc_id", "n_words", "buckets", "counts"])
                sums = np.bincount(bucket.astype(np.int64), weights=count.astype(np.float64), minlength=buckets).astype(np.int64)
                some = np.flatnonzero(sums)
                one = [pa.array([True]), pa.nulls(1, ids.type), pa.array([0], pa.int64()), pa.array([some], pa.list_(pa.int32())), pa.array([sums[some]], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(one, ["total", "doc_id", "n_words", "buckets", "counts"])
            con.close()

    return run


def count_buckets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, size: int = SLICE, memory: str = MEMORY) -> DataFrame:
    """total, doc_id, n_words, buckets, counts: each text's n-gram counts by bucket, and, marked as total, those of each slice of texts; stored as Parquet.

    DuckDB splits words, makes the runs of one and two of them by a window and counts, for some megabytes of text at a time; zlib's CRC is
    a function that it calls for each distinct word of a slice. What DuckDB spills is a task's own and goes with it; results leave by Spark's writer alone. Null texts have none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = narrow.mapInArrow(_counted(buckets, size, memory), f"total boolean, doc_id {kind}, n_words long, buckets array<int>, counts array<int>")
    return stored(spark, counts, "buckets")[0]


def merged(counts: DataFrame) -> DataFrame:
    """bucket, n over all texts: the sums of slices are summed, so a task sends `buckets` rows at most."""
    flat = counts.filter("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).select(F.col("x.buckets").alias("bucket"), F.col("x.counts").cast("long").alias("n"))
    return flat.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """For each bucket floor(1000 * ln of target's share over raw's), each with one added. A row for each bucket reaches the driver, however large the corpus."""
    spark = raw.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = ((F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    rows = both.join(F.broadcast(sums), F.lit(True)).select("bucket", F.floor(1000 * F.ln(share)).alias("gain")).collect()
    return [g for _, g in sorted(rows)]


def _weighed(of_bucket: list[int]):
    gain = np.array(of_bucket, np.int64)

    def run(batches):
        for batch in batches:
            buckets, counts = batch.column(2), batch.column(3)
            ends = np.concatenate([[0], np.cumsum(buckets.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            n = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(gain[buckets.flatten().to_numpy(zero_copy_only=False)] * n)])
            features = np.concatenate([[0], np.cumsum(n)])
            features, total = np.diff(features[ends]), np.diff(total[ends])
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(seed: int = SEED):
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of sha256("seed:doc_id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """scored with rank: 1, 2, 3 ... by falling score, then rising id, rows of the same id in any order.

    Rows are sorted by ranges, which a row's own number cuts even where all else is equal, and written with their place in their range; the
    sizes of ranges, a row each, say where each begins. No task holds more than a range.
    """
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.desc("score"), F.asc("doc_id"), F.asc("__own")]
    ordered = scored.withColumn("__own", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__own")
    placed = scratch_table(spark, ordered.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = sorted((r, n) for r, n in placed.groupBy("__range").count().collect())
    begin = dict(zip((r for r, _ in sizes), np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist(), strict=False))
    bases = spark.createDataFrame(list(begin.items()), "__range int, __base long")
    return placed.join(F.broadcast(bases), "__range").withColumn("rank", F.col("__base") + F.col("__at") + 1).select(*scored.columns, "rank")


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", target_id: str | None = None,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, and rank where it is drawn.

    Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters; features are runs of one and two of them. weight is the
    floored mean gain of a text's features (0 without any), score adds Gumbel noise of the id. Of the N rows with least_words the
    floor(percent * N / 100) highest scores are drawn, equal ones by smaller id. Null and empty texts have no words. A row without an id has no score, is never drawn
    and isn't one of the N; repeated rows score alike and are drawn each on its own. An empty table gives no rows, an empty target gains from smoothing alone; other columns play no part.

    Counts of both tables are spilled to Parquet by each task; what is shuffled are sums by bucket and, for the ranks, a few numbers a row.
    """
    own = count_buckets(spark, docs, id_col, text_col, buckets)
    aim = count_buckets(spark, target, target_id or target.columns[0], target_col, buckets)
    weights = own.filter("NOT total").select("doc_id", "n_words", "buckets", "counts")
    kind = docs.schema[id_col].dataType.simpleString()
    weights = weights.mapInArrow(_weighed(gains(merged(own), merged(aim), buckets)), f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = scratch_table(spark, weights.withColumn("score", F.col("weight") + gumbel(seed)), "scores")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = percent * scored.filter(able).count() // 100
    best = ranked(spark, scored.filter(able)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB has no CRC, so it is worked out byte by byte from the table of its polynomial, once for each distinct feature.
ORACLE = r"""
WITH RECURSIVE crc_step(value, bits, c) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) r(i)
  UNION ALL SELECT value, bits + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM crc_step WHERE bits < 8
), crc_table AS (SELECT list(c ORDER BY value) AS of_byte FROM crc_step WHERE bits = 8
), texts AS (
  SELECT 's' AS side, row_number() OVER () AS line, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), split AS MATERIALIZED (
  SELECT side, line, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), words AS (SELECT side, line, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split
), runs AS (SELECT side, line, word, lead(word) OVER (PARTITION BY side, line ORDER BY i) AS following FROM words
), grams AS (SELECT side, line, word AS feature FROM runs UNION ALL SELECT side, line, word || ' ' || following FROM runs WHERE following IS NOT NULL
), counted AS MATERIALIZED (SELECT side, line, feature, count(*) AS n FROM grams GROUP BY ALL
), hashed AS MATERIALIZED (
  SELECT feature, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, octet_length(encode(feature))), lambda k: CAST('0x' || substr(hex(encode(feature)), 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, of_byte[xor(c, b) % 256 + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS BIGINT) AS bucket
  FROM (SELECT DISTINCT feature FROM counted), crc_table
), sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM counted JOIN hashed USING (feature) GROUP BY 1
), totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums
), gains AS (
  SELECT bucket, floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS gain FROM sums, totals
), weights AS (
  SELECT line, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * CAST(gain AS BIGINT)) / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 's' GROUP BY 1
), scored AS (
  SELECT line, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (line) WHERE side = 's'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM ranked
"""
