"""Token ids as compressed byte or bit planes, with a chunk index.

The format is a folder of two tables. `chunks` has a row for each block of ids: shard, chunk, first_id (within the shard),
n_ids, planes (each compressed with zstandard), and the documents that begin in the block (doc_ids, doc_starts) together with the one that
is still open at its beginning (open_doc, open_start). `index` has the sizes alone: shard, chunk, first_id, n_ids, n_docs, n_bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skipweave.llm.common import numbered, ROW, scratch_table
from skipweave.llm.tokens import encoder, slices, tokenizer_path
from skipweave.session import scratch_path

END_ID = 1
#: Ids of a block.
BLOCK = 65536


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """The k-th plane holds the k-th byte (or bit) of every id, the lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [raw[:, k].tobytes() for k in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(p) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(open_.decompress(p), np.uint8) for p in planes]
    if len(rows) == 4:
        return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").reshape(-1)[:n]
    bits = np.stack([np.unpackbits(r, bitorder="little")[:n] for r in rows], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def _chunks(path: str, end_id: int, block: int, kind: str, id_type: pa.DataType):
    def rows(shard, chunk, first, ids, docs, starts, opened):
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "first_id": pa.array([first], pa.int64()), "n_ids": pa.array([len(ids)], pa.int32()),
                "planes": pa.array([to_planes(ids, kind)], pa.list_(pa.binary())), "doc_ids": pa.array([docs], pa.list_(id_type)), "doc_starts": pa.array([starts], pa.list_(pa.int64())),
                "open_doc": pa.array([opened[0]], id_type), "open_start": pa.array([opened[1]], pa.int64()),
            }
        )

    def run(batches):
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        held, docs, starts, opened = np.zeros(0, np.uint32), [], [], (None, None)  # first: place of held[0] in the shard
        for batch in slices(batches, 1):
            ids, begin = encoder(path).encode(batch.column(1), end_id)
            names, begin = batch.column(0).to_pylist(), begin + first + len(held)
            held = np.concatenate([held, ids])
            docs, starts = docs + names, starts + begin[:-1].tolist()
            while len(held) > block:  # the last block stays until it is known to be full
                k = int(np.searchsorted(starts, first + block))
                yield rows(shard, chunk, first, held[:block], docs[:k], starts[:k], opened)
                last = (docs[k - 1], starts[k - 1]) if k else opened
                chunk, first, held, docs, starts = chunk + 1, first + block, held[block:], docs[k:], starts[k:]
                opened = (None, None) if starts and starts[0] == first else last
        if len(held):
            yield rows(shard, chunk, first, held, docs, starts, opened)

    return run


def write_ids(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, block: int = BLOCK, planes: str = "byte") -> None:
    """Write the ids of every text, end_id after each, in ascending order of the document ids (null first; equal ids in input order).

    One range shuffle puts the texts in order; each range becomes a shard, tokenised and written where it is. Ranges are cut by id and
    row number, so repeated ids can't pile up in one. Spark's writer commits the shards: a task that is run again leaves no trace.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    field = docs.schema[id_col].dataType
    kind = field.simpleString()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = numbered(docs.select(id_col, text_col)).repartitionByRange(parts, id_col, ROW).sortWithinPartitions(id_col, ROW)
    schema = f"shard int, chunk long, first_id long, n_ids int, planes array<binary>, doc_ids array<{kind}>, doc_starts array<long>, open_doc {kind}, open_start long"
    chunks = ordered.select(id_col, text_col).mapInArrow(_chunks(tokenizer, end_id, block, planes, to_arrow_type(field)), schema)
    chunks.write.option("compression", "none").parquet(f"{path}/chunks")
    size = F.aggregate("planes", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p))
    index = spark.read.schema(schema).parquet(f"{path}/chunks").select("shard", "chunk", "first_id", "n_ids", F.size("doc_ids").alias("n_docs"), size.alias("n_bytes"))
    index.write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files alone.

    Blocks are decoded where they are read. Only documents that cross a block's edge are put together by a shuffle; where a shard's
    ids begin comes from the index: one row a shard.
    """
    chunks = spark.read.parquet(f"{path}/chunks")
    kind = dict(chunks.dtypes)["open_doc"]

    def decode(frames):
        for pdf in frames:
            out = []
            for c in pdf.itertuples(index=False):
                ids = from_planes(list(c.planes), c.n_ids)
                raw = memoryview(ids.astype("<u4").tobytes())
                names, starts = list(c.doc_ids), [int(s) for s in c.doc_starts]
                if not pd.isna(c.open_start):
                    names, starts = [c.open_doc, *names], [int(c.open_start), *starts]
                for i, (name, start) in enumerate(zip(names, starts, strict=True)):
                    begin, end = max(start, c.first_id), starts[i + 1] if i + 1 < len(starts) else c.first_id + c.n_ids
                    piece = raw[4 * (begin - c.first_id) : 4 * (end - c.first_id)]
                    whole = start >= c.first_id and i + 1 < len(starts)
                    out.append((c.shard, name, start, c.chunk, end - begin, zlib.crc32(piece), None if whole else bytes(piece)))
            frame = pd.DataFrame(out, columns=["shard", "doc_id", "at", "chunk", "n_tokens", "ids_crc32", "piece"])
            frame["doc_id"] = frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None)
            yield frame

    pieces = chunks.mapInPandas(decode, f"shard int, doc_id {kind}, at long, chunk long, n_tokens long, ids_crc32 long, piece binary")
    pieces = scratch_table(spark, pieces, "pieces")  # read twice, decoded once

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        crc = 0
        for piece in pdf.sort_values("chunk")["piece"]:
            crc = zlib.crc32(piece, crc)
        return pdf.iloc[:1].assign(n_tokens=int(pdf["n_tokens"].sum()), ids_crc32=crc)[["shard", "doc_id", "at", "n_tokens", "ids_crc32"]]

    cut = pieces.filter("piece IS NOT NULL").groupBy("shard", "at").applyInPandas(join, f"shard int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    whole = pieces.filter("piece IS NULL").select("shard", "doc_id", "at", "n_tokens", "ids_crc32")
    totals = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return whole.unionByName(cut).join(bases, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_span(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """start, ids of the ids first .. first + count - 1 of the whole output, in one row for each block that holds some of them.

    The index, read alone, says which blocks these are; no other block is decoded, and Parquet skips the row groups without one. An
    empty span, or one beyond the last id, gives no rows.
    """
    index = spark.read.parquet(f"{path}/index")
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    start = F.col("base") + F.col("first_id")
    held = index.join(bases, "shard").filter((start < first + count) & (start + F.col("n_ids") > first)).select("shard", "chunk", start.alias("start"))
    shards = [r.shard for r in held.select("shard").distinct().collect()]  # at most as many as there are shards
    chunks = spark.read.parquet(f"{path}/chunks").filter(F.col("shard").isin(shards)).join(held, ["shard", "chunk"]).select("start", "n_ids", "planes")

    def decode(frames):
        for pdf in frames:
            out = []
            for c in pdf.itertuples(index=False):
                ids, skip = from_planes(list(c.planes), c.n_ids), max(first - c.start, 0)
                out.append((c.start + skip, ids[skip : first + count - c.start].astype(np.int64).tolist()))
            yield pd.DataFrame(out, columns=["start", "ids"])

    return chunks.mapInPandas(decode, "start long, ids array<long>")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty and have the end id alone; an empty table gives empty files and no rows."""
    path = scratch_path(spark, "ids")
    write_ids(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path)
