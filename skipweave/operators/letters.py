"""Letter streams: verses become one run of letters with boundaries, and positions lead back to verses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skipweave.functions.text import letters_of
from skipweave.session import scratch_table

#: Letters of a bucket that positions and verses meet in.
BUCKET = 4096
#: Chapters that are summed together.
PART = 1024
#: Letters of a block of a concatenated stream.
BLOCK = 1 << 16
# Named scopes and their books.
SCOPES = {"genesis": "book_order = 1", "torah": "book_order <= 5", "ot": "book_order <= 39", "nt": "book_order > 39", "full": "true"}


def scope_filter(scope: str, abbrevs: set[str] | None = None) -> str:
    """The filter of a named scope, or of a book by its abbreviation."""
    if scope in SCOPES:
        return SCOPES[scope]
    if not scope.isalnum() or (abbrevs is not None and scope.upper() not in abbrevs):
        raise ValueError(f"unknown stream: {scope}")
    return f"book_abbrev = '{scope.upper()}'"


def verse_boundaries(verses: DataFrame, scope: str = "full") -> DataFrame:
    """Adds letters, start_pos and end_pos (exclusive) to the verses of a scope; verses without letters are left out.

    Sums run over the verses of a part of PART chapters, which are shuffled once, and over the parts: what one task sums over all is a row for PART chapters.
    """
    lettered = verses.filter(scope_filter(scope)).withColumn("letters", letters_of(F.col("text"))).filter("letters <> ''")
    lettered = lettered.withColumn("n_letters", F.length("letters").cast("long")).withColumn("__part", F.floor(F.col("chapter") / PART))
    earlier = Window.orderBy("book_order", "__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lettered.groupBy("book_order", "__part").agg(F.sum("n_letters").alias("n"))
    parts = parts.select("book_order", "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("book_order", "__part").orderBy("chapter", "verse").rowsBetween(Window.unboundedPreceding, 0)
    out = lettered.withColumn("__upto", F.sum("n_letters").over(within)).join(parts, ["book_order", "__part"])
    end = F.col("__base") + F.col("__upto")
    return out.withColumn("end_pos", end).withColumn("start_pos", end - F.col("n_letters")).drop("__base", "__upto", "__part")


def stored_boundaries(verses: DataFrame, scope: str = "full") -> DataFrame:
    """verse_boundaries written once, for what reads them more than once."""
    return scratch_table(verses.sparkSession, verse_boundaries(verses, scope).select("book_order", "book_abbrev", "chapter", "verse", "letters", "start_pos", "end_pos"), "bounded")


def letter_positions(bounded: DataFrame) -> DataFrame:
    """pos, ch, book_abbrev, chapter, verse: one row a letter; letters carry their verse, so no later join looks it up."""
    exploded = bounded.select("start_pos", "book_abbrev", "chapter", "verse", F.posexplode(F.split("letters", "")).alias("i", "ch"))
    return exploded.select((F.col("start_pos") + F.col("i")).alias("pos"), "ch", "book_abbrev", "chapter", "verse")


def letter_frequency(bounded: DataFrame) -> DataFrame:
    """letter, n, probability; counts are summed in each task before they are shuffled."""
    counts = bounded.select(F.explode(F.split("letters", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("letter", "n", F.round(F.col("n") / F.col("total"), 6).alias("probability"))


def stream_blocks(bounded: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """block, start, letters: runs of `block` letters with up to `halo` letters after them.

    Each verse goes to the blocks that it meets, so a letter moves once, and once more for each block whose halo holds it.
    """
    first = F.floor(F.greatest(F.col("start_pos") - halo - block + 1, F.lit(0)) / block)
    verses = bounded.select("start_pos", "end_pos", "letters", F.explode(F.sequence(first, F.floor((F.col("end_pos") - 1) / block))).alias("block"))
    low, high = F.col("block") * block, F.col("block") * block + block + halo
    begin, end = F.greatest(F.col("start_pos"), low), F.least(F.col("end_pos"), high)
    part = F.substring(F.col("letters"), (begin - F.col("start_pos") + 1).cast("int"), (end - begin).cast("int"))
    pieces = verses.select("block", begin.alias("at"), F.when(end > begin, part).alias("part")).filter("part IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")
    return pieces.groupBy("block").agg(F.min("at").alias("start"), joined.alias("letters"))


def stream_concat(bounded: DataFrame, block: int = BLOCK) -> DataFrame:
    """The letters of a stream in order, in blocks of one size: block, its first position, its length and digest. No group outgrows a block."""
    return stream_blocks(bounded, 0, block).select("block", F.col("start").alias("start_pos"), F.length("letters").cast("long").alias("n_letters"), F.md5("letters").alias("digest"))


def rebuild_streams(verses: DataFrame, folder: str, scopes: list[str] | None = None) -> DataFrame:
    """Boundaries of the named scopes, or of all of them and every book, worked out anew and written over what folder has of them; returns their stream_info."""
    if scopes is None:
        scopes = [*SCOPES, *(r.book_abbrev for r in verses.select("book_abbrev").distinct().orderBy("book_abbrev").collect())]
    for scope in scopes:
        verse_boundaries(verses, scope).write.mode("overwrite").parquet(f"{folder}/stream_id={scope}")
    return stream_info(verses, scopes)


def stream_info(verses: DataFrame, scopes: list[str]) -> DataFrame:
    """stream_id, total_letters, total_verses of named scopes."""
    out = None
    for scope in scopes:
        lettered = verses.filter(scope_filter(scope)).select(F.length(letters_of(F.col("text"))).cast("long").alias("n")).filter("n > 0")
        one = lettered.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_letters"), F.count("*").alias("total_verses")).select(F.lit(scope).alias("stream_id"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def list_streams(built: DataFrame, books: DataFrame) -> DataFrame:
    """All scopes and books, and whether each has been built."""
    spark = built.sparkSession
    named = spark.createDataFrame([(s,) for s in SCOPES], "stream_id string").select("stream_id", F.lit("scope").alias("kind"))
    every = named.unionByName(books.select(F.col("book_abbrev").alias("stream_id"), F.lit("book").alias("kind")))
    marks = built.select("stream_id", "total_letters").withColumn("built", F.lit(True))
    return every.join(marks, "stream_id", "left").select("stream_id", "kind", F.coalesce("built", F.lit(False)).alias("built"), "total_letters")


def positions_to_verses(positions: DataFrame, bounded: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each row of positions (with a column position) with the verse that holds it, or nulls outside of the stream.

    Verses are put in the buckets they meet, so the range join is an equi-join on buckets of which a verse has few. Columns of positions keep their values: book_abbrev, chapter
    and verse of their own are kept as they are, and beside a letter of their own the one found is letter_at.
    """
    reach = F.explode(F.sequence(F.floor(F.col("start_pos") / bucket), F.floor((F.col("end_pos") - 1) / bucket)))
    ranges = bounded.select(F.struct("start_pos", "end_pos", "letters", "book_abbrev", "chapter", "verse").alias("__in"), reach.alias("__at"))
    asked = positions.select(F.struct(*positions.columns).alias("__row"), F.col("position").alias("__position"), F.floor(F.col("position") / bucket).alias("__of"))
    inside = (F.col("__of") == F.col("__at")) & (F.col("__position") >= F.col("__in.start_pos")) & (F.col("__position") < F.col("__in.end_pos"))
    joined = asked.join(ranges, inside, "left")
    at = (F.col("__position") - F.col("__in.start_pos")).cast("int")
    return joined.select(
        *(F.col(f"__row.`{c}`").alias(c) for c in positions.columns),
        *(F.col(f"__in.{c}").alias(c) for c in ("book_abbrev", "chapter", "verse") if c not in positions.columns),
        at.alias("char_in_verse"),
        F.when(at.isNotNull(), F.substring(F.col("__in.letters"), at + 1, F.lit(1))).alias("letter_at" if "letter" in positions.columns else "letter"),
        F.concat(F.col("__in.book_abbrev"), F.lit(" "), F.col("__in.chapter"), F.lit(":"), F.col("__in.verse")).alias("reference"),
    )
