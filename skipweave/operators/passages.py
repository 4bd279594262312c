"""Passages: keyword and vector search, windows of verses, and the notes that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skipweave.functions.text import contains_ascii, cosine, parse_reference


def scripture_keyword(verses: DataFrame, query: str, book: str | None = None, limit: int = 20) -> DataFrame:
    """Verses that hold the query, in canonical order."""
    out = verses.filter(contains_ascii(F.col("text"), query))
    if book:
        out = out.filter(F.col("book_abbrev") == book)
    return out.orderBy("book_order", "chapter", "verse").limit(limit)


def passage_windows(verses: DataFrame, size: int = 3, overlap: int = 1) -> DataFrame:
    """Windows of `size` verses within each chapter, `overlap` of them shared; short tails stay."""
    chapter = Window.partitionBy("book_abbrev", "chapter").orderBy("verse")
    ahead = chapter.rowsBetween(0, size - 1)
    rows = verses.withColumn("rn", F.row_number().over(chapter)).withColumn("last", F.max("verse").over(ahead)).withColumn("texts", F.collect_list("text").over(ahead))
    rows = rows.filter((F.col("rn") - 1) % (size - overlap) == 0)
    name = F.concat("book_abbrev", F.lit("."), "chapter", F.lit("."), "verse", F.lit("-"), "last")
    return rows.select(name.alias("passage_id"), "book_abbrev", "chapter", F.col("verse").alias("verse_start"), F.col("last").alias("verse_end"), F.concat_ws(" ", "texts").alias("passage_text"))


def similarities(vectors: DataFrame, query: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vectors with similarity to the single row of query (a column `query`), in the JVM; the query is one row, so it is broadcast."""
    return vectors.join(F.broadcast(query.limit(1)), F.lit(True)).withColumn("similarity", cosine(F.col(vector_col), F.col("query"))).drop("query")


def semantic_topk(scored: DataFrame, id_col: str, k: int = 10, floor: float | None = None) -> DataFrame:
    """The k most similar rows, at or above the floor where there is one."""
    out = scored if floor is None else scored.filter(F.col("similarity") >= floor)
    return out.orderBy(F.desc("similarity"), id_col).limit(k)


def node_text(nodes: DataFrame, most: int = 2000) -> DataFrame:
    """What is embedded of a node: its type, summary, detail, context, tags and, where it has a map of them, metadata as `key: value`, cut at `most` characters."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", ")))
    extra = [F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))] if "metadata" in nodes.columns else []
    text = F.concat_ws(" | ", F.concat(F.lit("["), F.col("type"), F.lit("]")), some("summary"), some("detail"), some("context"), tags, *extra)
    return nodes.select("id", F.substring(text, 1, most).alias("node_text"))


def context_window(verses: DataFrame, book: str, chapter: int, first: int, last: int, around: int = 3) -> DataFrame:
    """Verses before, in and after a passage of one chapter."""
    rows = verses.filter((F.col("book_abbrev") == book) & (F.col("chapter") == chapter) & F.col("verse").between(first - around, last + around))
    part = F.when(F.col("verse") < first, "before").when(F.col("verse") > last, "after").otherwise("passage")
    return rows.withColumn("part", part).orderBy("verse")


def passage_notes(nodes: DataFrame, reference: str, types: list[str]) -> DataFrame:
    """Nodes of the types that mention the reference; GEN.1.1 is found in GEN.1.12 too."""
    found = contains_ascii(F.col("summary"), reference) | contains_ascii(F.col("detail"), reference) | contains_ascii(F.col("context"), reference)
    return nodes.filter(F.col("type").isin(types) & found).orderBy(F.desc("created_at"), "id")


def study_passage(verses: DataFrame, nodes: DataFrame, book: str, chapter: int, first: int, last: int, types: list[str], around: int = 3) -> tuple[DataFrame, DataFrame]:
    """(passage with context, notes)."""
    return context_window(verses, book, chapter, first, last, around), passage_notes(nodes, f"{book}.{chapter}.{first}", types)


def study_history(nodes: DataFrame, types: list[str], limit: int = 50) -> DataFrame:
    return nodes.filter(F.col("type").isin(types)).orderBy(F.desc("created_at"), "id").limit(limit)


def scripture_stats(verses: DataFrame) -> DataFrame:
    counts = [F.count("*").alias("verses"), F.count_distinct("chapter").alias("chapters")]
    return verses.groupBy("book_abbrev").agg(*counts, *([F.count_distinct("translation").alias("translations")] if "translation" in verses.columns else []))


def corpus_totals(verses: DataFrame) -> DataFrame:
    return verses.agg(F.count("*").alias("verses"), F.count_distinct("book_abbrev").alias("books"), F.count_distinct("book_abbrev", "chapter").alias("chapters"))


def read_scripture(verses: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, label, book_abbrev, chapter, verse, text of every verse that a reference names: a range, a single verse, or a chapter.

    refs has a column ref; those that name nothing give no rows. refs is a question and not a table, so it is broadcast.
    """
    asked = refs.select("ref", *(c.alias(f"__{k}") for k, c in parse_reference(F.col("ref")).items()))
    same = (F.col("__book_abbrev") == F.col("book_abbrev")) & (F.col("__chapter") == F.col("chapter"))
    named = F.col("__verse_start").isNull() | F.col("verse").between(F.col("__verse_start"), F.col("__verse_end"))
    span = F.when(F.col("__verse_end") != F.col("__verse_start"), F.concat(F.lit("-"), F.col("__verse_end"))).otherwise("")
    tail = F.when(F.col("__verse_start").isNotNull(), F.concat(F.lit(":"), F.col("__verse_start"), span)).otherwise("")
    label = F.concat(F.col("book"), F.lit(" "), F.col("chapter"), tail)
    return verses.join(F.broadcast(asked), same & named).select("ref", label.alias("label"), "book_abbrev", "chapter", "verse", "text")


def search_scripture(passages: DataFrame, verses: DataFrame, query: DataFrame, words: str, book: str | None = None, books: list[str] | None = None, limit: int = 10, floor: float | None = None) -> DataFrame:
    """reference, text, similarity, mode of the passages closest to the query's vector, within a book or some books where they are given.

    passages has book_abbrev, chapter, verse_start, verse_end and vector. The text of a hit is its verses, each with its number. Without
    any passage the words are looked for instead, which gives no similarity. Only the hits meet the verses.
    """
    if not passages.take(1):
        found = scripture_keyword(verses, words, book, limit)
        name = F.concat("book", F.lit(" "), "chapter", F.lit(":"), "verse")
        return found.select(name.alias("reference"), "text", F.lit(None).cast("double").alias("similarity"), F.lit("keyword").alias("mode"))
    near = similarities(passages, query, "verse_start", "vector").drop("vector")
    near = near if floor is None else near.filter(F.col("similarity") >= floor)
    near = near.filter(F.col("book_abbrev") == book.upper()) if book else near
    near = near.filter(F.col("book_abbrev").isin(books)) if books else near
    place = ["book_abbrev", "chapter", "verse_start", "verse_end"]
    top = near.orderBy(F.desc("similarity"), *place).limit(limit)
    inside = verses.join(F.broadcast(top), ["book_abbrev", "chapter"]).filter(F.col("verse").between(F.col("verse_start"), F.col("verse_end")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("verse", "text"))), lambda v: F.concat(v["verse"], F.lit(". "), v["text"]))
    hit = inside.groupBy(*place, "similarity").agg(F.first("book").alias("book"), F.concat_ws(" ", lines).alias("text"))
    span = F.when(F.col("verse_end") != F.col("verse_start"), F.concat(F.lit("-"), F.col("verse_end"))).otherwise("")
    name = F.concat("book", F.lit(" "), "chapter", F.lit(":"), "verse_start", span)
    return hit.select(name.alias("reference"), "text", F.round("similarity", 3).alias("similarity"), F.lit("semantic").alias("mode"))
