"""Quality rules: text statistics, and a log-likelihood ratio of hashed n-grams, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skipweave.llm.common import ROW, WS, full_text, where_settled

#: Buckets that words and word pairs are hashed to; bounds what is gathered on the driver.
BUCKETS = 16384
#: The most trusted ids that are broadcast, the smallest by hash.
TRUSTED = 20000
#: Mean log-likelihood ratio an n-gram under which a document is rejected.
THRESHOLD = -0.05
_SPACE = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Runs without ASCII white space, in order."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def _steps(count: Column, least: int) -> Column:
    """0 .. count - least, or nothing."""
    return F.when(count >= least, F.sequence(F.lit(0), count - least)).otherwise(F.array().cast("array<int>"))


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("__text", full_text(docs, text_col)).withColumn("__words", words_of(F.col("__text"))).withColumn("__n", F.size("__words"))


def _bucket(*words: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def ngram_counts(worded: DataFrame, trusted: DataFrame, id_col: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n_raw, n_trusted over every word and word pair of every document.

    trusted has at most TRUSTED ids (trusted_ids sees to that), so it is broadcast. The counts are summed in each task
    before they are shuffled: at most `buckets` rows leave a task.
    """
    word = F.transform("__words", lambda w: _bucket(w, buckets=buckets))
    pair = F.transform(_steps(F.col("__n"), 2), lambda i: _bucket(F.get("__words", i), F.get("__words", i + 1), buckets=buckets))
    marked = worded.join(F.broadcast(trusted.select(F.col("id").alias(id_col), F.lit(1).alias("__trusted"))), id_col, "left")
    return (
        marked.select(F.coalesce("__trusted", F.lit(0)).alias("trusted"), F.explode(F.concat(word, pair)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n_raw"), F.sum("trusted").alias("n_trusted"))
    )


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids of trusted documents (quality 1, not toxic): at most `most`, the smallest by hash."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    return good.orderBy(F.xxhash64("id"), "id").limit(most)


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """For each bucket log p(trusted) - log p(raw), each with one added; zeros where nothing is trusted. Gathers `buckets` rows at most."""
    raw, good = [1] * buckets, [1] * buckets
    for bucket, n_raw, n_trusted in counts.collect():
        raw[bucket] += n_raw
        good[bucket] += n_trusted
    if sum(good) == buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(good))
    return [round(math.log(g) - math.log(r) + shift, 6) for g, r in zip(good, raw, strict=True)]


def _repeat_words(worded: DataFrame) -> DataFrame:
    """Adds __repeat: words in 3-word windows found twice or more in the text.

    Windows are 64-bit hashes. Each is packed with its place into one long, as many hash bits as fit, so that a sort of
    plain longs brings equal windows together; the whole hashes of neighbours decide.
    """
    get = F.get
    out = worded.withColumn("__tri", F.transform(_steps(F.col("__n"), 3), lambda i: F.xxhash64(get("__words", i), get("__words", i + 1), get("__words", i + 2))))
    out = out.withColumn("__bits", F.when(F.size(F.array_distinct("__tri")) < F.size("__tri"), F.length(F.bin("__n")).cast("int")))
    packed = F.transform("__tri", lambda h, i: F.call_function("shiftleft", h, F.col("__bits")).bitwiseOR(i.cast("long")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1
    out = out.withColumn("__place", F.when(F.col("__bits").isNotNull(), F.transform(F.sort_array(packed), lambda x: x.bitwiseAND(mask).cast("int"))))
    out = out.withColumn("__hash", F.transform("__place", lambda i: get("__tri", i)))
    twice = F.filter("__place", lambda i, j: get("__hash", j).eqNullSafe(get("__hash", j - 1)) | get("__hash", j).eqNullSafe(get("__hash", j + 1)))
    out = out.withColumn("__twice", F.sort_array(twice))
    covered = F.transform("__twice", lambda p, j: F.least(F.lit(3), F.coalesce(get("__twice", j + 1) - p, F.lit(3))))
    return out.withColumn("__repeat", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))


def quality_rules(
    spark: SparkSession,
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept, and the columns in keep.

    Null and empty texts have no words: all counts 0, llr 0, base_failed. Repeated rows are judged alike, each on its own.
    An empty table gives no rows. Without trusted ids llr is 0 and the base rules decide. Columns of docs that aren't named play no part.
    """
    narrow = docs.select(id_col, text_col)
    weights = log_ratios(ngram_counts(with_words(narrow, text_col), trusted, id_col, buckets), buckets)
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")  # folded to one constant array

    text, words, n = F.col("__text"), F.col("__words"), F.col("__n")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    worded = with_words(docs.select(F.struct(*(docs[c] for c in dict.fromkeys((id_col, *keep)))).alias("__in"), docs[text_col].alias("__raw")), "__raw").drop("__raw")
    worded = worded.withColumn("__lines", lines)
    worded = worded.select(
        "__in", "__words", "__n",
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(words, F.lit(0.0), lambda a, w: a + F.get(table, _bucket(w, buckets=buckets))).alias("__one"),
        F.aggregate(_steps(n, 2), F.lit(0.0), lambda a, i: a + F.get(table, _bucket(F.get(words, i), F.get(words, i + 1), buckets=buckets))).alias("__two"),
    )
    done = _repeat_words(worded)
    grams = F.greatest(2 * n - 1, F.lit(1))
    failed = (n < 50) | (100 * F.col("__repeat") > 50 * n)
    llr = (F.col("__one") + F.col("__two")) / grams
    return done.select(
        F.col(f"__in.{id_col}").alias("doc_id"),
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("__repeat").alias("n_repeat_words"),
        llr.alias("llr"),
        failed.alias("base_failed"),
        (~failed & (llr >= threshold)).alias("kept"),
        *(F.col(f"__in.{c}") for c in keep if c != id_col),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(spark, docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    trusted = trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_rules(spark, docs.withColumn(ROW, F.struct(*docs.columns)), trusted, keep=(ROW,))
    return where_settled(judged, "kept").select(*(F.col(f"{ROW}.{c}").alias(c) for c in docs.columns))
