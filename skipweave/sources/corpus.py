"""Corpus tables: reading, ingest, and changes as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_books(spark: SparkSession, folder: str, order_file: str = "Books.json", translation: str = "KJV") -> tuple[DataFrame, DataFrame, list[str]]:
    """(books, verses, missing names) of a folder with a list of names in order and one JSON file of chapters for each.

    Names lose their spaces in file names. A book without a file is reported and left out. Where the order is kept in a folder of its own (order_file
    is a path), the books are folders book=Name of JSON lines, so a book is read by many tasks.
    """
    from skipweave.functions.text import BOOKS

    order_path = order_file if "/" in order_file else f"{folder}/{order_file}"
    names = [r[0] for r in spark.read.text(order_path, wholetext=True).select(F.explode(F.from_json("value", "array<string>"))).collect()]
    order = spark.createDataFrame(
        [(i, n, BOOKS.get(n, n[:3].upper()), "OT" if i <= 39 else "NT", n.replace(" ", "")) for i, n in enumerate(names, 1)],
        "book_order int, book string, book_abbrev string, testament string, file string",
    )
    shape = "chapters array<struct<chapter: string, verses: array<struct<verse: string, text: string>>>>"
    if order_path == order_file:
        files = spark.read.schema(f"{shape}, book string").json(folder).select(F.replace("book", F.lit(" "), F.lit("")).alias("file"), "chapters")
    else:
        files = spark.read.json(f"{folder}/*.json", multiLine=True, schema=shape)
        files = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("file"), "chapters")
    files = files.filter("chapters IS NOT NULL")
    rows = files.select(F.url_decode("file").alias("file"), F.explode("chapters").alias("c")).select("file", F.col("c.chapter").cast("int").alias("chapter"), F.explode("c.verses").alias("v"))
    verses = rows.join(F.broadcast(order), "file").select(
        F.concat_ws(".", "book_abbrev", "chapter", F.col("v.verse")).alias("id"), "book", "book_abbrev", "book_order", "chapter",
        F.col("v.verse").cast("int").alias("verse"), F.col("v.text").alias("text"), F.lit(translation).alias("translation"),
    )
    sizes = verses.groupBy("book_order").agg(F.count_distinct("chapter").alias("chapter_count"), F.count("*").alias("verse_count"))
    books = order.join(F.broadcast(sizes), "book_order").drop("file").withColumn("translation", F.lit(translation))
    there = {r.book for r in books.select("book").collect()}
    return books, verses, [n for n in names if n not in there]


def query_all(spark: SparkSession, sql: str, *args) -> DataFrame:
    """SQL with positional parameters (?)."""
    return spark.sql(sql, args=list(args))


def query_one(spark: SparkSession, sql: str, *args):
    return query_all(spark, sql, *args).limit(1).first()


def read_verse(verses: DataFrame, book: str, chapter: int, verse: int) -> DataFrame:
    return verses.filter((F.col("book_abbrev") == book) & (F.col("chapter") == chapter) & (F.col("verse") == verse))


def read_chapter(verses: DataFrame, book: str, chapter: int) -> DataFrame:
    return verses.filter((F.col("book_abbrev") == book) & (F.col("chapter") == chapter)).orderBy("verse")


def read_range(verses: DataFrame, book: str, chapter: int, first: int, last: int) -> DataFrame:
    """Verses first to last, both among them."""
    return verses.filter((F.col("book_abbrev") == book) & (F.col("chapter") == chapter) & F.col("verse").between(first, last)).orderBy("verse")


def list_books(books: DataFrame, testament: str | None = None, translation: str | None = None) -> DataFrame:
    for name, value in (("testament", testament), ("translation", translation)):
        if value:
            books = books.filter(F.col(name) == value)
    return books.orderBy("book_order")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new take the place of rows of old with their keys; of several new ones the last by all columns."""
    named = lambda t, i: t.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keys)), F.struct(F.lit(i).alias("side"), F.struct(*(F.col(f"`{c}`") for c in old.columns)).alias("row")).alias("last"))
    both = named(old, 0).unionByName(named(new, 1))
    return both.groupBy(*(f"k{n}" for n in range(len(keys)))).agg(F.max("last").alias("last")).select("last.row.*")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new come in where no row has their keys."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def merge_metadata(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with metadata merged: given keys take the new values, others stay. changes has the key and a metadata map."""
    base, given = F.col("row.metadata"), F.col("given")
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(given), k))
    merged = F.when(given.isNull(), base).when(base.isNull(), given).otherwise(F.map_concat(kept, given))
    both = rows.select(F.col(key).alias("of"), F.struct(*rows.columns).alias("row")).join(changes.select(F.col(key).alias("of"), F.col("metadata").alias("given")), "of", "left")
    return both.select(*(merged.alias(c) if c == "metadata" else F.col(f"row.`{c}`").alias(c) for c in rows.columns))


def update_rows(rows: DataFrame, key: str, value, changes: dict, now: float | None = None) -> DataFrame:
    """rows with the one of this key changed: plain fields are set, metadata is merged, updated_at is now where rows have it.

    An error where no field is given, a field isn't one of rows, or there is no such row.
    """
    given = {c: v for c, v in changes.items() if v is not None}
    if not given or key in given:
        raise ValueError("no fields to update")
    if unknown := set(given) - set(rows.columns):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    if not rows.filter(F.col(key) == value).take(1):
        raise ValueError(f"not found: {value}")
    metadata = given.pop("metadata", None)
    if now is not None and "updated_at" in rows.columns:
        given["updated_at"] = now
    mine = F.col(key) == value
    out = rows.withColumns({c: F.when(mine, F.lit(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in given.items()})
    if metadata is None:
        return out
    entries = F.create_map(*(F.lit(x) for pair in metadata.items() for x in pair)).cast(rows.schema["metadata"].dataType)
    change = rows.sparkSession.range(1).select(F.lit(value).cast(rows.schema[key].dataType).alias(key), entries.alias("metadata"))
    return merge_metadata(out, change, key)


def to_json_lines(rows: DataFrame) -> DataFrame:
    """One column, json, with an object a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def export_json(path: str, **tables: DataFrame) -> None:
    """A folder of JSON lines for each table."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def snapshot(spark: SparkSession, folder: str, stamp: str, keep: int = 20, **tables: DataFrame) -> list[str]:
    """Write all tables under folder/stamp; return the snapshots that stay, the newest first, once older ones are gone."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{stamp}/{name}")
    return prune_snapshots(spark, folder, keep)


def list_snapshots(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()), reverse=True) if fs.exists(path) else []


def prune_snapshots(spark: SparkSession, folder: str, keep: int = 20) -> list[str]:
    names = list_snapshots(spark, folder)
    jvm = spark.sparkContext._jvm
    for name in names[keep:]:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return names[:keep]


def emptied(**tables: DataFrame) -> dict[str, DataFrame]:
    """The same tables without rows, for a copy that goes out with the corpus alone."""
    return {name: table.limit(0) for name, table in tables.items()}
