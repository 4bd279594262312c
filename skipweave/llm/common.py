"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skipweave.session import scratch_path, scratch_table

__all__ = ["ROW", "WS", "documents", "full_text", "where_settled", "numbered", "stored_numbered", "placed", "marked", "stored", "bucketed", "discard", "scratch_table"]

#: ASCII white space, as in the text contracts.
WS = r"[\x20\x09-\x0D]+"
ROW = "__row"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def full_text(df: DataFrame, column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(df[column], F.lit(""))


def free_name(df: DataFrame, name: str = ROW) -> str:
    """name, with as many underscores after it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str = ROW) -> DataFrame:
    """df with a number for each row, so that repeated rows and ids stay apart.

    The number is partition and place, so df has to be a plain scan of stored files: then a task that is run again gives each
    row the same number. A second scan need not: files are split by the cores there are. Numbers that two jobs
    compare have to be stored: see stored_numbered.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def stored_numbered(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """numbered(df), written once with its numbers, for jobs that find rows again by them; and the name of that column, which is none of df's."""
    name = free_name(df)
    return scratch_table(spark, numbered(df, name), "numbered"), name


def placed(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number for each row that every scan gives it again, whatever files are split into: its file, in order of their names, and its place there; and the name of that column.

    Nothing but the names of the files is written. For rows of Parquet files, with or without filters and projections; where rows have no such place, or one place stands
    for several, they are written with their numbers as in stored_numbered.
    """
    name = free_name(df)
    try:
        at = df.metadataColumn("_metadata")
        places = df.select(at["file_path"].alias("file"), at["row_index"].alias("place"))
    except AnalysisException:
        return stored_numbered(spark, df)
    files = places.groupBy("file").agg(F.count("*").alias("rows"), F.count_distinct("place").alias("places"))
    files = scratch_table(spark, files.withColumn("number", F.row_number().over(Window.orderBy("file")).cast("long")), "files")  # a row for each file
    if files.filter("rows <> places").count():
        return stored_numbered(spark, df)
    file, number = free_name(df, "__file"), free_name(df, "__number")
    known = files.select(F.col("file").alias(file), F.col("number").alias(number))
    out = df.withColumns({name: at["row_index"], file: at["file_path"]}).join(F.broadcast(known), file)
    return out.withColumn(name, F.shiftleft(number, 40).bitwiseOR(F.col(name))).drop(file, number), name


def marked(df: DataFrame, row: str, numbers: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of df whose number `row` is in the one column of numbers or, without keep, is not: df stays where it is.

    The numbers are broadcast as bits, a row of 16 bytes for each 64 rows of df at most.
    """
    word, bits = free_name(df, "__word"), free_name(df, "__bits")
    (n,) = numbers.columns
    one = F.shiftright(n, 6).alias(word), F.expr(f"shiftleft(1L, CAST(`{n}` & 63 AS INT))").alias(bits)
    masks = numbers.select(*one).groupBy(word).agg(F.bit_or(bits).alias(bits))
    found = df.join(F.broadcast(masks), F.shiftright(row, 6) == masks[word], "left")
    hit = F.expr(f"coalesce(shiftright(`{bits}`, CAST(`{row}` & 63 AS INT)) & 1, 0) = {int(keep)}")
    return found.filter(hit).drop(word, bits)


def where_settled(df: DataFrame, condition: str) -> DataFrame:
    """df.filter(condition) on columns as computed: the number beside them keeps the optimizer from moving the filter below
    the projections, where it would hold a second copy of every expression."""
    return df.withColumn("__settled", F.monotonically_increasing_id()).filter(f"({condition}) AND __settled >= 0").drop("__settled")


def stored(spark: SparkSession, df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written once to the shared folder, tightly, and read back; and its path, for discard."""
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(spark: SparkSession, df: DataFrame, tag: str, column: str, buckets: int) -> tuple[DataFrame, str]:
    """stored, in buckets of a column, so that a later grouping by that column moves none of it; each task's rows stay in files of their own."""
    path = scratch_path(spark, tag)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(buckets, column).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table of which nothing is read any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
