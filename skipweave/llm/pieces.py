"""SentencePiece encoding and decoding in batched numpy."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from skipweave.llm.tokens import ChunkEncoder, slices, text_buffer, tokenizer_path

SPACE = "▁"
#: Words that are encoded at a time.
STEP = 4096
#: Bytes of text that are held in memory at a time.
HELD = 2 << 20
#: Longer words are merged with a heap, whose cost is nearly linear.
LONG = 256
#: A character without a piece costs this much more than the worst piece.
PENALTY = 10.0
_MULTIPLIER, _SEED, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x51ED270B), np.uint64(42)


class PieceEncoder(ChunkEncoder):
    """Encodes with the pieces of a SentencePiece model, either as its merges do (`bpe`) or by the best total score (`viterbi`).

    Words, each with the spaces before it, are encoded apart: a piece has spaces at its beginning alone. Words of equal length advance
    together; hashes of all their substrings probe the sorted keys of the pieces.
    """

    def __init__(self, path: str, method: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.method = method
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._clear()
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        bad = [pieces[i] for i in plain if SPACE in pieces[i].lstrip(SPACE)]
        if bad:
            raise ValueError(f"pieces with a space inside: {bad[:5]}")
        self.scores = np.array([model.get_score(i) for i in range(n)] + [-np.inf], np.float64)
        self.byte_ids = np.array([model.piece_to_id(f"<0x{k:02X}>") for k in range(256)])
        self.longest = max(len(pieces[i]) for i in plain)
        keys = np.array([self._key(np.array([[ord(c) for c in pieces[i]]]))[0] for i in plain], np.uint64)
        order = np.argsort(keys)
        self.piece_keys, self.piece_ids = keys[order], np.array(plain)[order]
        self.likely = np.zeros(1 << 22, bool)
        self.likely[keys >> _SHIFT] = True
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one key")
        self.worst = self.scores[plain].min() - PENALTY
        texts = [pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        for k, i in enumerate(self.byte_ids):
            texts[i] = bytes([k])
        for i in range(n):
            if model.is_control(i):
                texts[i] = b""
        self.text_size = np.array([len(t) for t in texts])
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.text_pool = np.frombuffer(b"".join(texts), np.uint8)

    @staticmethod
    def _fold(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Keys of substrings that are one character longer."""
        with np.errstate(over="ignore"):
            h = (h ^ codes) * _MULTIPLIER
            return h ^ (h >> np.uint64(32))

    def _key(self, codes: np.ndarray) -> np.ndarray:
        """A 64-bit key of each row of code points."""
        h = np.full(len(codes), _SEED, np.uint64)
        for j in range(codes.shape[1]):
            h = self._fold(h, codes[:, j].astype(np.uint64))
        return h

    def _cuts(self, b: np.ndarray) -> np.ndarray:
        space = b == 32
        own = np.zeros(len(b), bool)  # the end of the sign that stands for a space, which may lie in a text too
        own[2:] = (b[:-2] == 0xE2) & (b[1:-1] == 0x96) & (b[2:] == 0x81)
        return space & ~np.concatenate([[True], (space | own)[:-1]])

    def _substrings(self, codes: np.ndarray) -> np.ndarray:
        """(words, begin, size - 1): the id of the piece that a substring is, else -1."""
        n, length = codes.shape
        most = min(length, self.longest)
        out = np.full((n, length, most), -1, np.int32)
        codes = codes.astype(np.uint64)
        keys = np.full((n, length), _SEED, np.uint64)
        for size in range(1, most + 1):
            keys = self._fold(keys[:, : length - size + 1], codes[:, size - 1 :])
            word, begin = np.nonzero(self.likely[keys >> _SHIFT])  # a table of marks spares most of the probes
            probe = keys[word, begin]
            at = np.minimum(np.searchsorted(self.piece_keys, probe), len(self.piece_keys) - 1)
            out[word, begin, size - 1] = np.where(self.piece_keys[at] == probe, self.piece_ids[at], -1)
        return out

    def _viterbi(self, found: np.ndarray) -> np.ndarray:
        """Sizes of the last piece at each end, by the best total score; of equal ones the longest piece."""
        n, length, most = found.shape
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((n, length + 1), np.int64)
        for end in range(1, length + 1):
            sizes = np.arange(min(end, most), 0, -1)
            ids = found[:, end - sizes, sizes - 1]
            score = np.where(ids >= 0, self.scores[ids], np.where(sizes == 1, self.worst, -np.inf)) + best[:, end - sizes]
            pick = score.argmax(axis=1)
            best[:, end], back[:, end] = score[np.arange(n), pick], sizes[pick]
        cut = np.zeros((n, length + 1), bool)
        at, rows = np.full(n, length), np.arange(n)
        while len(rows):
            cut[rows, at[rows]] = True
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return cut

    def _merges(self, found: np.ndarray) -> np.ndarray:
        """Ends of pieces after merges: each time the neighbours that form the piece of the best score, the leftmost of equal ones."""
        n, length, most = found.shape
        cut = np.ones((n, length + 1), bool)
        after = np.tile(np.arange(1, length + 1), (n, 1))  # where the symbol that begins here ends
        rows = np.arange(n)
        begins = np.arange(length)[None]
        while len(rows):
            end = after[rows]
            live = cut[rows, :-1] | (begins == 0)
            live[:, 1:] &= cut[rows][:, 1:-1]
            beyond = np.where(end < length, np.take_along_axis(end, np.minimum(end, length - 1), axis=1), length + most)
            size = beyond - begins
            fits = live & (end < length) & (size <= most)
            ids = found[rows[:, None], begins, np.clip(size - 1, 0, most - 1)]
            score = np.where(fits & (ids >= 0), self.scores[ids], -np.inf)
            pick = score.argmax(axis=1)
            some = np.isfinite(score[np.arange(len(rows)), pick])
            rows, pick, end, beyond = rows[some], pick[some], end[some], beyond[some]
            k = np.arange(len(rows))
            cut[rows, end[k, pick]] = False
            after[rows, pick] = beyond[k, pick]
        return cut

    def _merges_of_long(self, found: np.ndarray) -> np.ndarray:
        """_merges of a single word: neighbours wait in a heap by score and place, and those that are no longer there are passed over."""
        _, length, most = found.shape
        ids, after, before = found[0], list(range(1, length + 1)), list(range(-1, length - 1))  # of the symbol that begins here

        def offer(begin: int) -> None:
            middle = after[begin]
            if middle < length and after[middle] - begin <= most:
                piece = ids[begin, after[middle] - begin - 1]
                if piece >= 0:
                    heapq.heappush(heap, (-scores[piece], begin, middle, after[middle]))

        heap, scores = [], self.scores.tolist()
        alive = np.ones(length + 1, bool)
        for begin in range(length - 1):
            offer(begin)
        while heap:
            _, begin, middle, end = heapq.heappop(heap)
            if not alive[begin] or after[begin] != middle or middle == length or after[middle] != end:
                continue
            alive[middle] = False
            after[begin] = end
            if end < length:
                before[end] = begin
            offer(begin)
            if before[begin] >= 0:
                offer(before[begin])
        return alive[None]

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        ranked = sizes[order]
        owners, pieces, unknown, i = [], [], [], 0
        while i < len(order):
            length = int(ranked[i])
            j = min(int(np.searchsorted(ranked, length, "right")), i + max(1, STEP * 8 // max(length, 1)))
            text = "".join([chunks[k] for k in order[i:j].tolist()]).replace(" ", SPACE)
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(j - i, length)
            found = self._substrings(codes)
            cut = self._viterbi(found) if self.method == "viterbi" else self._merges(found) if length <= LONG else np.concatenate([self._merges_of_long(f[None]) for f in found])
            cut[:, length], cut[:, 0] = True, False
            word, end = np.nonzero(cut)
            begin = np.where(np.append(-1, word[:-1]) == word, np.append(0, end[:-1]), 0)
            owners.append(order[i + word])
            pieces.append(found[word, begin, np.minimum(end - begin, found.shape[2]) - 1])
            unknown.append(codes[word, begin])
            i = j
        if not owners:
            return np.zeros(0, np.uint32), np.zeros(len(chunks), np.int64)
        owner, piece, unknown = np.concatenate(owners), np.concatenate(pieces).astype(np.int64), np.concatenate(unknown)
        back = np.argsort(owner, kind="stable")
        owner, piece, unknown = owner[back], piece[back], unknown[back]
        spelled = {k: self.byte_ids[list(chr(unknown[k]).encode())] for k in np.flatnonzero(piece < 0).tolist()}  # a character without a piece becomes its bytes
        many = np.ones(len(piece), np.int64)
        many[list(spelled)] = [len(v) for v in spelled.values()]
        at = np.cumsum(many) - many
        flat = np.repeat(piece, many)
        for k, ids in spelled.items():
            flat[at[k] : at[k] + len(ids)] = ids
        return flat.astype(np.uint32), np.bincount(owner, weights=many, minlength=len(chunks)).astype(np.int64)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and where each text's begin; a text gets one space before it, an empty one has no ids."""
        texts = texts.fill_null("").cast(pa.large_string())
        space, none = (pa.scalar(t, pa.large_string()) for t in (" ", ""))
        b, offsets = text_buffer(pc.if_else(pc.equal(texts, none), texts, pc.binary_join_element_wise(space, texts, none)))
        parts, starts, done, i = [], [np.zeros(1, np.int64)], 0, 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1)
            ids, begin = self._step(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append(ids)
            starts.append(done + begin[1:])
            done, i = int(starts[-1][-1]), j
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate(starts)

    def decode_texts(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text, without the space before it."""
        size = self.text_size[ids]
        ends = np.cumsum(size)
        data = self.text_pool[np.repeat(self.text_at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        edges = np.concatenate([[0], ends])[begin].tolist()
        return [data[a + (data[a : a + 1] == b" ") : z] for a, z in zip(edges[:-1], edges[1:], strict=True)]


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def piece_encoder(path: str, method: str) -> PieceEncoder:
    if (path, method) not in _ENCODERS:
        _ENCODERS[path, method] = PieceEncoder(path, method)
    return _ENCODERS[path, method]


def encode_pieces(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, method: str = "bpe") -> DataFrame:
    """Per row of docs: doc_id, ids. Null and empty texts have none; repeated rows are encoded each on its own; other columns play no part."""
    path, kind = model or tokenizer_path("piece_bpe_32k.model"), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 1, HELD):
            ids, begin = piece_encoder(path, method).encode_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_pieces(spark: SparkSession, rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Per row: doc_id, text. Null and empty lists give the empty text; bytes that aren't UTF-8 are replaced."""
    path, kind = model or tokenizer_path("piece_bpe_32k.model"), rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(1).fill_null([])
            begin = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = piece_encoder(path, "bpe").decode_texts(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), begin)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(errors="replace") for t in texts], pa.string())], ["doc_id", "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def piece_digests(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_pieces, ids_crc32, viterbi_pieces, viterbi_crc32, decoded.

    The first two are of the model's own merges, the next two of the best total score; decoded says that both decode to the text. Null and
    empty texts have no pieces; repeated rows are encoded each on its own; an empty table gives no rows; other columns play no part.
    """
    path, kind = model or tokenizer_path("piece_bpe_32k.model"), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 1, HELD):
            raw, columns, same = [t.encode() for t in batch.column(1).fill_null("").to_pylist()], [], np.ones(batch.num_rows, bool)
            for method in ("bpe", "viterbi"):
                encoder = piece_encoder(path, method)
                ids, begin = encoder.encode_texts(batch.column(1))
                data = memoryview(ids.astype("<u4").tobytes())
                edges = (begin * 4).tolist()
                columns += [pa.array(np.diff(begin)), pa.array([zlib.crc32(data[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)], pa.int64())]
                same &= np.array([a == b for a, b in zip(encoder.decode_texts(ids.astype(np.int64), begin), raw, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "viterbi_pieces", "viterbi_crc32", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, viterbi_pieces long, viterbi_crc32 long, decoded boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
