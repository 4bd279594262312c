"""The engine's tables as views of the given test tables, for Spark and, as text, for the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BOOKS = [(0, 1, "Genesis", "GEN", "OT"), (1, 2, "Exodus", "EXO", "OT"), (2, 3, "Leviticus", "LEV", "OT"), (3, 40, "Matthew", "MAT", "NT"), (4, 41, "Mark", "MRK", "NT"), (5, 42, "Luke", "LUK", "NT")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_BOOKS, "k long, book_order int, book string, book_abbrev string, testament string")


def verses(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as verses: six books in turn, a conversation a chapter."""
    rows = table(spark, d, "conversations").withColumn("k", F.col("conv_id") % 6).join(F.broadcast(books(spark)), "k")
    chapter = (F.floor(F.col("conv_id") / 6) + 1).cast("int")
    return rows.select("book_order", "book", "book_abbrev", "testament", chapter.alias("chapter"), (F.col("turn") + 1).cast("int").alias("verse"), "text")


VERSES = """books(k, book_order, book, book_abbrev, testament) AS (
  VALUES (0, 1, 'Genesis', 'GEN', 'OT'), (1, 2, 'Exodus', 'EXO', 'OT'), (2, 3, 'Leviticus', 'LEV', 'OT'),
         (3, 40, 'Matthew', 'MAT', 'NT'), (4, 41, 'Mark', 'MRK', 'NT'), (5, 42, 'Luke', 'LUK', 'NT')
), verses AS (
  SELECT book_order, book, book_abbrev, testament, CAST(conv_id // 6 + 1 AS INT) AS chapter, CAST(turn + 1 AS INT) AS verse, text
  FROM conversations JOIN books ON conv_id % 6 = k
)"""
BOUNDED = VERSES + """, lettered AS (
  SELECT *, regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z]', '', 'g') AS letters FROM verses
), bounded AS MATERIALIZED (
  SELECT *, CAST(sum(length(letters)) OVER o AS BIGINT) - length(letters) AS start_pos, CAST(sum(length(letters)) OVER o AS BIGINT) AS end_pos
  FROM lettered WHERE letters <> '' WINDOW o AS (ORDER BY book_order, chapter, verse)
)"""
LETTERS = BOUNDED + """, letters AS MATERIALIZED (
  SELECT start_pos + i - 1 AS pos, letters[i] AS ch, book_abbrev, chapter, verse FROM bounded, LATERAL (SELECT unnest(generate_series(1, length(letters))) AS i)
)"""


def search_sql(terms: dict[str, tuple[int, int, str]]) -> str:
    """hits(term, direction, skip, start) by joins of letters on places worked out before; terms: (least skip, most skip, direction)."""
    starts, parts = [], []
    for term, (low, high, direction) in terms.items():
        for way, sign in (("forward", 1), ("reverse", -1)):
            if direction in (way, "both"):
                name, others = f"{term}_{way}".lower(), list(enumerate(term))[1:]
                at = ", ".join(f"pos + {sign * k} * skip AS p{k}" for k, _ in others)
                starts.append(
                    f"{name} AS MATERIALIZED (SELECT pos AS start, skip, {at} FROM letters, (SELECT unnest(generate_series({low}, least({high}, (SELECT max(end_pos) FROM bounded) // {len(term)}))) AS skip) "
                    f"WHERE ch = '{term[0]}')"
                )
                joins = " ".join(f"SEMI JOIN (SELECT pos FROM letters WHERE ch = '{c}') l{k} ON l{k}.pos = p{k}" for k, c in others)
                parts.append(f"SELECT '{term}' AS term, '{way}' AS direction, CAST(skip AS INT) AS skip, CAST(start AS BIGINT) AS start FROM {name} {joins}")
    return f"{LETTERS}, " + ",\n".join(starts) + ", hits AS MATERIALIZED (\n" + "\nUNION ALL\n".join(parts) + "\n)"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 500 == 7, "__default__").otherwise(F.col("c_name"))
    return c.select(F.col("c_custkey").alias("session_id"), name.alias("name"), F.col("c_mktsegment").alias("notes"), F.col("c_custkey").cast("double").alias("created_at"), F.col("c_acctbal").alias("updated_at"))


def searches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    term = F.concat(F.regexp_replace(F.upper("o_orderpriority"), "[^A-Z]", ""), F.chr(65 + F.col("o_custkey") % 7))
    return o.select(F.col("o_orderkey").alias("search_id"), F.col("o_custkey").alias("session_id"), term.alias("term"), F.col("o_orderstatus").alias("stream_id"), F.floor(F.col("o_totalprice") % 100).cast("long").alias("hit_count"), F.col("o_orderdate").alias("searched_at"))


LEDGER = """sessions AS (
  SELECT c_custkey AS session_id, CASE WHEN c_custkey % 500 = 7 THEN '__default__' ELSE c_name END AS name, c_mktsegment AS notes,
         CAST(c_custkey AS DOUBLE) AS created_at, c_acctbal AS updated_at FROM customer
), searches AS (
  SELECT o_orderkey AS search_id, o_custkey AS session_id, regexp_replace(upper(o_orderpriority), '[^A-Z]', '', 'g') || chr(CAST(65 + o_custkey % 7 AS INT)) AS term,
         o_orderstatus AS stream_id, CAST(floor(o_totalprice % 100) AS BIGINT) AS hit_count, o_orderdate AS searched_at FROM orders
)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Line items as stored hits of five-letter terms."""
    li = table(spark, d, "lineitem")
    start = (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729 + F.col("l_suppkey") * 31) % 2_000_000
    skip = (1 + (F.col("l_quantity").cast("long") * 13 + F.col("l_linenumber")) % 200).cast("int")
    rows = li.select(
        F.col("l_orderkey").alias("search_id"), F.concat(F.lit("TERM"), F.chr(65 + F.col("l_suppkey") % 25)).alias("term"), F.col("l_returnflag").alias("stream_id"),
        start.alias("start"), skip.alias("skip"), F.when(F.col("l_linestatus") == "O", "forward").otherwise("reverse").alias("direction"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("hit_id"),
    )
    sign = F.when(F.col("direction") == "forward", 1).otherwise(-1)
    return rows.withColumn("positions", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("start") + sign * k * F.col("skip")))


HITS = """hits AS (
  SELECT l_orderkey AS search_id, 'TERM' || chr(CAST(65 + l_suppkey % 25 AS INT)) AS term, l_returnflag AS stream_id,
         (l_partkey * 7919 + l_orderkey * 104729 + l_suppkey * 31) % 2000000 AS start, CAST(1 + (CAST(trunc(l_quantity) AS BIGINT) * 13 + l_linenumber) % 200 AS INT) AS skip,
         CASE WHEN l_linestatus = 'O' THEN 'forward' ELSE 'reverse' END AS direction, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS hit_id
  FROM lineitem
), marks AS MATERIALIZED (
  SELECT h.*, k, start + (CASE WHEN direction = 'forward' THEN 1 ELSE -1 END) * k * skip AS pos FROM hits h, (SELECT unnest(generate_series(0, 4)) AS k)
)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select(
        F.col("doc_id").alias("id"), F.col("source").alias("type"), F.substring("text", 1, 60).alias("summary"), F.col("text").alias("detail"), F.col("lang").alias("context"),
        F.array(F.concat(F.lit("tag"), (F.col("doc_id") % 5).cast("string")), F.col("lang")).alias("tags"), (F.col("n_chars") % 10 / 10).alias("importance"), (F.col("doc_id") * 37 % 1009).alias("created_at"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    return lab.select(F.col("doc_id").alias("source_id"), F.floor(F.col("doc_id") / 2).alias("target_id"), F.when(F.col("toxic") == 1, "contradicts").otherwise("supports").alias("relationship"), F.col("doc_id").alias("created_at"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))


def types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("type_name"), F.col("n_name").alias("display_name"), (F.col("n_regionkey") < 3).alias("is_base_type"))


def pending(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.lower("r_name").alias("type_name"), F.col("r_name").alias("display_name"), F.when(F.col("r_regionkey") % 2 == 0, "pending").otherwise("approved").alias("status"))


GRAPH = """nodes AS (
  SELECT doc_id AS id, source AS type, substr(text, 1, 60) AS summary, text AS detail, lang AS context, ['tag' || CAST(doc_id % 5 AS VARCHAR), lang] AS tags,
         n_chars % 10 / 10 AS importance, doc_id * 37 % 1009 AS created_at FROM documents
), edges AS (
  SELECT doc_id AS source_id, doc_id // 2 AS target_id, CASE WHEN toxic = 1 THEN 'contradicts' ELSE 'supports' END AS relationship, doc_id AS created_at FROM labels
), vectors AS (
  SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings
), types AS (
  SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS type_name, n_name AS display_name, n_regionkey < 3 AS is_base_type FROM nation
), pending AS (
  SELECT lower(r_name) AS type_name, r_name AS display_name, CASE WHEN r_regionkey % 2 = 0 THEN 'pending' ELSE 'approved' END AS status FROM region
), scored AS (
  SELECT node_id, CASE WHEN list_dot_product(vector, vector) * list_dot_product(q, q) > 0
    THEN list_dot_product(vector, q) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(q, q))) ELSE 0 END AS similarity
  FROM vectors, (SELECT vector AS q FROM vectors WHERE node_id = 0) one
)"""
