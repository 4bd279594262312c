"""Token ids of whole texts, batch by batch, each distinct piece of text encoded once per batch series."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Distinct chunks that a worker remembers; beyond that it starts anew.
REMEMBERED = 1_500_000
#: Bytes of text that are taken at a time.
STEP = 2 << 20
#: Longer chunks get their hash from xxhash instead of the rolling sum.
LONG = 64
#: Stands between chunks that are encoded in one call, and how many these are.
MARK, TOGETHER = " \x00", 256
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more at the end); null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: int, size: int = 32 << 20):
    """The rows of all batches in slices of about `size` bytes of text in a column, one row at least: what a worker holds follows that and not the batch."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
            yield batch.slice(i, j - i)
            i = j


def cuts(b: np.ndarray) -> np.ndarray:
    """True where white space follows a character that is surely none: token pieces never cross such a place.

    A place after a character of 2 to 4 bytes counts only where no Unicode white space can end.
    """
    space = (b == 32) | (b == 10) | (b == 9) | (b == 13)
    p = [np.concatenate([np.zeros(k, np.uint8), b[: len(b) - k]]) if len(b) > k else np.zeros(len(b), np.uint8) for k in (1, 2, 3, 4)]
    sure = (p[0] > 32) & (p[0] < 127)
    tail = (p[0] >= 0x80) & (p[0] < 0xC0)
    sure |= tail & (p[1] >= 0xC3) & (p[1] <= 0xDF)
    tail &= (p[1] >= 0x80) & (p[1] < 0xC0)
    sure |= tail & (p[2] >= 0xE4) & (p[2] <= 0xEF)
    sure |= tail & (p[2] >= 0x80) & (p[2] < 0xC0) & (p[3] >= 0xF0)
    return space & sure


class ChunkEncoder:
    """Encodes texts with a tokenizers file. Texts are cut before white space, where pieces end anyway; equal chunks, found
    by 64-bit hash, are encoded once. The ids are those of the whole text, as both kinds of file split at white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.mark = self._one_by_one([MARK])[0].tolist()
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _cuts(self, b: np.ndarray) -> np.ndarray:
        return cuts(b)

    def _one_by_one(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for one in ids for x in one), np.uint32, int(count.sum())), count

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for chunks that begin with white space, end with none and have no zero byte; None if their marks can't be told from their ids."""
        whole = [MARK.join(chunks[i : i + TOGETHER]) + MARK for i in range(0, len(chunks), TOGETHER)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)])
        ends, wide = np.flatnonzero(flat == self.mark[-1]), len(self.mark)
        count = np.diff(ends, prepend=-1) - wide
        if len(ends) != len(chunks) or (count < 0).any() or any((flat[ends - k] != self.mark[-1 - k]).any() for k in range(wide)):
            return None
        keep = np.ones(len(flat), bool)
        for k in range(wide):
            keep[ends - k] = False
        return flat[keep], count

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each chunk has. A call takes longer than a chunk, so most are encoded together, with marks of a zero byte between them."""
        plain = np.fromiter((c[0] in " \n\t\r" and "!" <= c[-1] <= "~" and "\0" not in c for c in chunks), bool, len(chunks))
        some = [c for c, p in zip(chunks, plain.tolist(), strict=True) if p]
        found = self._joined(some) if some and self.mark else None
        if found is None:
            return self._one_by_one(chunks)
        rest = self._one_by_one([c for c, p in zip(chunks, plain.tolist(), strict=True) if not p])
        count = np.zeros(len(chunks), np.int64)
        count[plain], count[~plain] = found[1], rest[1]
        of = np.repeat(plain, count)
        flat = np.zeros(len(of), np.uint32)
        flat[of], flat[~of] = found[0], rest[0]
        return flat, count

    def _power(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _P, np.uint64))])
                back = np.uint64(pow(int(_P), -1, 1 << 64))
                self.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, back, np.uint64))])

    def _hashes(self, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        self._power(len(b))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.powers[: len(b)])])
            h = (total[starts + sizes] - total[starts]) * self.inverse[starts]
            h = (h ^ (h >> np.uint64(31))) * _MIX + sizes.astype(np.uint64)
            h ^= h >> np.uint64(29)
        for k in np.flatnonzero(sizes > LONG):
            h[k] = xxhash.xxh64_intdigest(b[starts[k] : starts[k] + sizes[k]].tobytes(), 7)
        return h

    def _step(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(b) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = self._cuts(b)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(b)))
        keys, first, inverse = np.unique(self._hashes(b, starts, sizes), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > REMEMBERED and len(self.keys):
                self._clear()
                return self._step(b, offsets)
            data = b.tobytes()
            s, n = starts[first[new]].tolist(), sizes[first[new]].tolist()
            flat, count = self._ids([data[i : i + k].decode() for i, k in zip(s, n, strict=True)])
            at = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate([self.pool, flat])
            self.keys, self.at, self.size = np.insert(self.keys, place[new], keys[new]), np.insert(self.at, place[new], at), np.insert(self.size, place[new], count)
            place = np.searchsorted(self.keys, keys)
        at, count = self.at[place][inverse], self.size[place][inverse]
        ends = np.cumsum(count)
        out = self.pool[np.repeat(at - (ends - count), count) + np.arange(ends[-1])]
        return out, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, end_id after each text, and where each text's ids begin (one more at the end)."""
        b, offsets = text_buffer(texts)
        parts, starts, done, i = [], [np.zeros(1, np.int64)], 0, 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, "right")) - 1)
            ids, begin = self._step(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append(np.insert(ids, begin[1:], np.uint32(end_id)))
            starts.append(done + begin[1:] + np.arange(1, j - i + 1))
            done, i = int(starts[-1][-1]), j
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate(starts)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
