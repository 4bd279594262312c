"""Byte-level BPE: each distinct pre-token of all texts is encoded once, and its ids are joined back by a shuffle of distinct words."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skipweave.llm.common import bucketed
from skipweave.llm.tokens import cuts, slices, text_buffer, tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text whose pre-tokens share a dictionary; a longer text has one of its own.
SLICE = 8 << 20
#: Bytes of one text that are split at a time.
STEP = 1 << 18
#: Pre-tokens of some texts that are stored together; a longer text stands alone.
CHUNK = 1 << 17
#: A row's number is its task, its slice and its line there; the latter two have so many bits each.
PLACE_BITS = 20
#: The most rows of an output batch of decoded texts, and the most bytes but for one text.
ROWS, BYTES = 4096, 4 << 20


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_bytes(spark: SparkSession, ranks: str | None = None) -> DataFrame:
    """token int, bytes binary: the vocabulary file as a table. Its size is the vocabulary's, whatever the texts."""
    lines = open(ranks or tokenizer_path(RANKS), "rb").read().split(b"\n")
    rows = [(int(rank), bytearray(base64.b64decode(token))) for token, rank in (line.split() for line in lines if line)]
    return spark.createDataFrame(rows, "token int, bytes binary")


def _parts(text: np.ndarray):
    """A text's bytes in steps, cut before white space that follows a character: pre-tokens begin there whatever comes before."""
    begin = 0
    while len(text) - begin > STEP:
        end, width = None, STEP
        while end is None and begin + width < len(text):  # a text without white space is taken whole
            found = np.flatnonzero(cuts(text[begin : begin + width]))
            end = begin + int(found[-1]) if len(found) and found[-1] else None
            width *= 2
        if end is None:
            break
        yield text[begin:end].tobytes().decode()
        begin = end
    if begin < len(text):
        yield text[begin:].tobytes().decode()


def _packed(numbers: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Small numbers as planes of their bytes, compressed."""
    width = 1 + max(int(numbers.max(initial=0)).bit_length() - 1, 0) // 8
    return press.compress(bytes([width]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes())


def _unpacked(data: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = np.frombuffer(press.decompress(data), np.uint8)
    planes = raw[1:].reshape(int(raw[0]), -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u4").reshape(-1).astype(np.int64)


def _packed_words(words: list[str], press: zstandard.ZstdCompressor) -> tuple[bytes, bytes]:
    """The sizes of words in bytes, and the words in a row, both compressed."""
    raw = [w.encode() for w in words]
    return _packed(np.fromiter(map(len, raw), np.int64, len(raw)), press), press.compress(b"".join(raw))


def _unpacked_words(sizes: bytes, text: bytes, press: zstandard.ZstdDecompressor) -> list[bytes]:
    ends, raw = np.cumsum(_unpacked(sizes, press)).tolist(), press.decompress(text)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _pretokens(split: str, size: int, shares: int, kind: pa.DataType):
    schema = pa.schema([("slice", pa.int64()), ("line", pa.int32()), ("doc_ids", pa.list_(kind)), ("counts", pa.list_(pa.int32())), ("share", pa.int32()), ("at", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())])

    def run(batches):
        import regex

        find, press, task, number = regex.compile(split).findall, zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        place, line, held = defaultdict(count().__next__), 0, 0
        rows = lambda found: pa.RecordBatch.from_pylist([{"slice": task << PLACE_BITS | number} | r for r in found], schema)

        def dictionary():
            """The distinct words of a slice with their places, in rows by the words' share."""
            words = list(place)
            share = np.fromiter((zlib.crc32(w.encode()) % shares for w in words), np.int64, len(words))
            order = np.argsort(share, kind="stable")
            values, begin = np.unique(share[order], return_index=True)
            for some in np.array_split(np.arange(len(values)), 1 + len(values) // ROWS):
                out = []
                for k in some.tolist():
                    mine = order[begin[k] : begin[k + 1] if k + 1 < len(values) else None]
                    sizes, text = _packed_words([words[i] for i in mine.tolist()], press)
                    out.append({"share": int(values[k]), "at": _packed(mine, press), "sizes": sizes, "words": text})
                yield rows(out)

        for batch in slices(batches, 1, size):
            n = batch.num_rows
            if max(line + n, number) >> PLACE_BITS or held >= size:
                yield from dictionary()
                place, line, held, number = defaultdict(count().__next__), 0, 0, number + 1
                if max(n, number) >> PLACE_BITS:
                    raise ValueError("too many rows in an Arrow batch, or slices in a task")
            raw, offsets = text_buffer(batch.column(1))
            ids, parts, counts, total, first = batch.column(0).to_pylist(), [], [], 0, 0
            for i in range(n):
                found = [np.fromiter(map(place.__getitem__, find(part)), np.int64) for part in _parts(raw[offsets[i] : offsets[i + 1]])]
                parts += found
                counts.append(sum(map(len, found)))
                total += counts[-1]
                if i + 1 == n or total >= CHUNK:
                    yield rows([{"line": line + first, "doc_ids": ids[first : i + 1], "counts": counts, "at": _packed(np.concatenate(parts) if parts else np.zeros(0, np.int64), press)}])
                    parts, counts, total, first = [], [], 0, i + 1
            line, held = line + n, held + int(offsets[-1])
        if place:
            yield from dictionary()

    return run


def _encode_words(ranks: str, split: str):
    def run(batches):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        one = tiktoken.Encoding("words", pat_str=split, mergeable_ranks=table, special_tokens={})._encode_single_piece
        press, open_ = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        known, of = {}, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["share"] != of:
                    known, of = {}, r["share"]
                words = _unpacked_words(r["sizes"], r["words"], open_)
                for w in words:
                    if w not in known:
                        known[w] = one(w)
                found = [known[w] for w in words]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
                out.append({"slice": r["slice"], "at": r["at"], "sizes": _packed(sizes, press), "ids": _packed(ids, press)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("slice", pa.int64()), ("at", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())]))

    return run


def _reassemble(kind: pa.DataType):
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        """The ids of a slice's texts: each place of a pre-token is replaced by the ids of its word."""
        press = zstandard.ZstdDecompressor()
        at, size, flat = (np.concatenate([_unpacked(x, press) for x in words.column(c).to_pylist()] or [np.zeros(0, np.int64)]) for c in ("at", "sizes", "ids"))
        sizes, begin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        begin[at], sizes[at] = np.cumsum(size) - size, size
        rows, names, lengths, out = [], [], [], []
        for r in texts.to_pylist():
            places = _unpacked(r["at"], press)
            n = sizes[places]
            ends = np.concatenate([[0], np.cumsum(n)])
            out.append(flat[np.repeat(begin[places] - ends[:-1], n) + np.arange(ends[-1])].astype(np.int32))
            lengths.append(np.diff(ends[np.concatenate([[0], np.cumsum(r["counts"])])]))
            names += r["doc_ids"]
            rows.append((r["slice"] << PLACE_BITS) + r["line"] + np.arange(len(r["counts"])))
        join = lambda parts: np.concatenate(parts or [np.zeros(0, np.int64)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(join(lengths))]), pa.int32()), pa.array(join(out), pa.int32()))
        return pa.table({"row": pa.array(join(rows), pa.int64()), "doc_id": pa.array(names, kind), "ids": lists})

    return run


def encode(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, split: str | None = None, size: int = SLICE) -> DataFrame:
    """row, doc_id, ids of every row of docs: byte-level BPE of each match of the pattern on its own, no special tokens.

    Null and empty texts have no ids; repeated rows are encoded each on its own and have rows of their own; null ids are kept; an empty table
    gives no rows; other columns play no part.

    Texts are split once into pre-tokens. A slice of some megabytes of texts keeps the places of its pre-tokens and its distinct words, which are stored.
    The words of all slices, with their places, are shuffled by hash, so that all rows of a word come to one task, which encodes it once; the ids go back to the
    slices and meet their texts there, which are stored in buckets of slices and stay where they are. A frequent word is in one row a slice, so no key is
    hot; a task holds one slice or one text.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ranks, split = ranks or tokenizer_path(RANKS), split or pattern()
    field = docs.schema[id_col].dataType
    kind, arrow = field.simpleString(), to_arrow_type(field)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"slice long, line int, doc_ids array<{kind}>, counts array<int>, share int, at binary, sizes binary, words binary"
    cut, path = bucketed(spark, narrow.mapInArrow(_pretokens(split, size, 4 * parts, arrow), schema), "pretokens", "slice", parts)
    words = spark.read.schema(cut.schema).parquet(path).filter("share IS NOT NULL").select("slice", "share", "at", "sizes", "words")
    coded = words.repartition(parts, "share").sortWithinPartitions("share").mapInArrow(_encode_words(ranks, split), "slice long, at binary, sizes binary, ids binary")
    texts = cut.filter("share IS NULL").select("slice", "line", "doc_ids", "counts", "at")
    return texts.groupBy("slice").cogroup(coded.groupBy("slice")).applyInArrow(_reassemble(arrow), f"row long, doc_id {kind}, ids array<int>")


def _decoded(shared):
    """Rows of (row, doc_id, ids) become (row, doc_id, ids_le, decoded)."""

    def run(batches):
        starts, sizes, flat = shared.value
        for batch in batches:
            lists = batch.column(2)
            ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            ids = lists.flatten().fill_null(-1).to_numpy()
            if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or sizes[ids].min() < 0):
                raise ValueError("an id that the table of tokens doesn't have")
            total = np.concatenate([[0], np.cumsum(sizes[ids], dtype=np.int64)])
            i = 0
            while i < batch.num_rows:  # some texts, or one
                before = int(ends[i - 1]) if i else 0
                j = max(i + 1, min(i + ROWS, int(np.searchsorted(total[ends], total[before] + BYTES, "right"))))
                rows, own = batch.slice(i, j - i), ids[before : ends[j - 1]]
                parts = []
                for k in range(0, len(own), STEP):
                    some = own[k : k + STEP]
                    n = sizes[some]
                    last = np.cumsum(n, dtype=np.int64)
                    parts.append(flat[np.repeat(starts[some] - (last - n), n) + np.arange(last[-1])])
                cut = np.concatenate([[before], ends[i:j]])
                binary = lambda at, data, m=j - i: pa.LargeBinaryArray.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data)]).cast(pa.binary())
                text = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), binary(4 * (cut - before), own.astype("<u4")), binary(total[cut] - total[before], text)], ["row", "doc_id", "ids_le", "decoded"])
                i = j

    return run


def decode(spark: SparkSession, coded: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """row, doc_id, ids_le, decoded of coded (row, doc_id, ids): the ids as little-endian 32-bit numbers, and the bytes of all ids in order. No ids give empty bytes.

    The table of tokens, which has the vocabulary's size whatever the texts, is broadcast as one run of bytes and the places of tokens in it. Texts are decoded where
    they are, without a shuffle; an id without a token is an error.
    """
    table = (token_bytes(spark) if tokens is None else tokens).select("token", "bytes").toArrow().sort_by("token")
    token, data = table.column(0).to_numpy(), table.column(1).to_pylist()
    starts, sizes = np.zeros(int(token.max(initial=-1)) + 1, np.int64), np.full(int(token.max(initial=-1)) + 1, -1, np.int64)
    sizes[token] = np.fromiter(map(len, data), np.int64, len(data))
    starts[token] = np.cumsum(sizes[token]) - sizes[token]
    shared = spark.sparkContext.broadcast((starts, sizes, np.frombuffer(b"".join(data), np.uint8)))
    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("row", "doc_id", "ids").mapInArrow(_decoded(shared), f"row long, doc_id {kind}, ids_le binary, decoded binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(spark, encode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")))
    count = (F.octet_length("ids_le") / 4).cast("long")
    return decoded.select("doc_id", count.alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
