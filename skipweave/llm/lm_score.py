"""Language-model scores: a causal self-attention model on subword ids, and a smoothed word unigram as the base."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skipweave.llm.common import ROW, numbered, scratch_table
from skipweave.llm.tokens import ChunkEncoder, encoder, text_buffer, tokenizer_path

#: Inputs of a window; each window scores its last STRIDE targets, so windows overlap by CONTEXT - STRIDE inputs.
CONTEXT, STRIDE = 48, 32
WIDTH, HIDDEN = 16, 32
#: Classes: the SINGLE most frequent ids have one each, the others share bands of about equal frequency.
CLASSES, SINGLE = 1280, 1024
#: Counts that the unigram of classes adds to each row of pairs.
SMOOTH = 5.0
#: Input rows: the most frequent half of them stand for one id each, the other ids share the rest.
INPUTS = 2048
#: One window in so many trains the attention weights: every one, unless a caller asks for fewer; all counts cover every training document.
RATE = 1
#: Windows of a training shard, and rounds after which the shards' weights are averaged.
SHARD, ROUNDS, BATCH, LEARNING = 1 << 15, 2, 64, 0.012
#: Weights in a row of a task's sums.
BLOCK = 256
END = 50256
#: Frequent words that are broadcast with their counts (16 bytes each); the others are joined.
FREQUENT = 1 << 17
#: Counts of words that a task holds before it adds them up.
COUNTED = 1 << 21
#: Windows that are scored at a time.
STEP = 64
_END_WORD = np.uint64(0x5EED0FE4D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def words_in(b: np.ndarray, offsets: np.ndarray, hasher: ChunkEncoder) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of all words: runs without ASCII white space."""
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[b]
    before = np.concatenate([[True], space[:-1]])
    before[offsets[:-1][offsets[:-1] < len(b)]] = True
    after = np.concatenate([space[1:], [True]])
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return hasher._hashes(b, starts, ends - starts), np.searchsorted(offsets, starts, "right") - 1


def _steps(texts: pa.Array, size: int = 2 << 20):
    """Lower-cased texts, some megabytes at a time: (first text, bytes, offsets)."""
    b, offsets = text_buffer(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, _LOWER[b[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        i = j


class _Hasher(ChunkEncoder):
    """The rolling hash alone."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)


def _count_words(batches):
    hasher, parts = _Hasher(), []
    for batch in itertools.chain(batches, [None]):
        for _, b, offsets in _steps(batch.column(0)) if batch is not None else ():
            words, many = np.unique(words_in(b, offsets, hasher)[0], return_counts=True)
            parts.append((np.append(words, _END_WORD), np.append(many, len(offsets) - 1)))
            if sum(len(words) for words, _ in parts) >= COUNTED:
                yield _summed(parts)
                parts = []
    if parts:
        yield _summed(parts)


def _summed(parts: list) -> pa.RecordBatch:
    words, many = map(np.concatenate, zip(*parts, strict=True))
    words, of = np.unique(words, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(of, weights=many, minlength=len(words)).astype(np.int64))], ["word", "n"])


def _places(known: np.ndarray, begins: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted known words, whether it is there) of each word. Those with the same bits in front are few and lie together."""
    place, found = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    if not len(known):
        return place, found
    at, left = np.take(begins, (words >> np.uint64(46)).astype(np.int64)), np.arange(len(words))
    while len(left):
        here = np.take(known, np.minimum(at, len(known) - 1))
        same = here == words[left]
        place[left[same]], found[left[same]] = at[same], True
        on = ~same & (here < words[left]) & (at + 1 < len(known))
        left, at = left[on], at[on] + 1
    return place, found


def _prepare(shared, tokenizer: str, end_id: int, wide: int):
    """Subword ids, and the base of words that are in the broadcast table; the other words are listed."""

    def run(batches):
        hasher = _Hasher()
        known, count, space = shared.value
        begins = np.searchsorted(known, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)  # of the words with the same 18 bits in front
        for batch in batches:
            for i, b, offsets in _steps(batch.column(3)):
                texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(b))
                ids, begin = encoder(tokenizer).encode(texts, end_id)
                words, doc = words_in(b, offsets, hasher)
                n = len(offsets) - 1
                words, doc = np.append(words, np.full(n, _END_WORD)), np.append(doc, np.arange(n))
                place, found = _places(known, begins, words)
                value = np.log10((count[place[found]] + 0.1) / space) if len(known) else np.zeros(0)
                tail, tail_doc = words[~found], doc[~found]
                order = np.lexsort((tail, tail_doc))
                tail, tail_doc = tail[order], tail_doc[order]
                new = np.ones(len(tail), bool)
                new[1:] = (tail[1:] != tail[:-1]) | (tail_doc[1:] != tail_doc[:-1])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(tail)))
                bounds = np.searchsorted(tail_doc[first], np.arange(n + 1)).astype(np.int32)
                part = batch.slice(i, n)
                packed = ids.astype(f"<u{wide}")
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(begin * packed.itemsize), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2), raw.cast(pa.binary()), pa.array(np.bincount(doc, minlength=n)),
                        pa.array(np.bincount(doc[found], minlength=n)), pa.array(np.bincount(doc[found], weights=value, minlength=n).astype(np.float64)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(tail[first].view(np.int64))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(many)),
                    ],
                    ["doc_id", ROW, "held_out", "ids", "n_tokens", "known", "base", "tail", "tail_n"],
                )

    return run


def slices(batches, rows: int = 500):
    """Some rows at a time, as ids in numpy take many times the room of their texts."""
    return (batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))


def id_bytes(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def unpack(binary: pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, where each row begins)."""
    binary = binary.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(binary) and binary.buffers()[2] else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data).view(f"<u{wide}").astype(np.int32), (offsets - offsets[0]) // wide


def window_numbers(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number within the row) of every window."""
    count = -(-np.diff(begin) // STRIDE)
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def windows_of(ids: np.ndarray, begin: np.ndarray, row: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The asked windows: CONTEXT inputs and one more id; -1 stands before a text, -2 after it.

    Window k scores ids k * STRIDE .. k * STRIDE + STRIDE - 1, each once, with the inputs before it that the window holds.
    """
    at = (nth * STRIDE)[:, None] + np.arange(CONTEXT + 1) - (CONTEXT - STRIDE + 1)
    size = np.diff(begin)[row][:, None]
    inside = (at >= 0) & (at < size)
    x = np.full(at.shape, -1, np.int32)
    x[inside] = ids[(begin[:-1][row][:, None] + at)[inside]]
    x[at >= size] = -2
    return x


class AttentionModel:
    """Causal self-attention that weighs four predictions of the next id, one of them its own.

    p(id | before) is a mixture: the unigram, the bigram of classes, the skip bigram of classes (from the id before the last one), each
    times p(id | class), and a copy: the attention weights of those places whose id is the one asked for, where places
    before the text stand for the unigram. The weights of the mixture come from the attended state of each place. Keys see an id and the one
    before it, so a place can be found by what precedes it. Counts are of all training ids; `attend` off leaves the three counts, weighed by the last id.
    """

    NAMES = ("e", "f", "pos", "q", "k", "w", "v", "o", "w1", "w2", "u", "b")

    def __init__(self, counts: np.ndarray, seed: int = 0, attend: bool = True):
        self.attend = attend
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        mass = np.cumsum(counts[order] + 0.1)
        rest = mass - mass[SINGLE - 1]
        band = SINGLE + np.minimum((rest / rest[-1] * (CLASSES - SINGLE)).astype(np.int64), CLASSES - SINGLE - 1)
        klass = np.where(rank < SINGLE, rank, band[rank])
        total = np.bincount(klass, weights=counts + 0.1, minlength=CLASSES)
        self.within = ((counts + 0.1) / total[klass]).astype(np.float32)
        self.unigram = ((counts + 0.1) / total.sum()).astype(np.float32)
        half = INPUTS // 2
        self.input = np.append(np.where(rank < half, rank, half + rank % half), [INPUTS, INPUTS]).astype(np.int32)  # [-1] and [-2] come before and after
        self.klass = np.append(klass, [CLASSES, CLASSES]).astype(np.int32)
        self.pairs = self.skips = np.zeros((CLASSES + 1, CLASSES), np.float32)
        rng = np.random.default_rng(seed)
        draw = lambda a, b, s: (rng.standard_normal((a, b)) * s).astype(np.float32)
        d, same = WIDTH, np.eye(WIDTH, dtype=np.float32)
        e = draw(INPUTS + 1, d, 0.5)
        # at the start a place looks for an earlier one that was preceded by its own id
        self.p = {
            "e": e, "f": e.copy(), "pos": draw(CONTEXT, d, 0.1), "q": same.copy(), "k": 0 * same, "w": same.copy(), "v": draw(d, d, d**-0.5), "o": draw(d, d, d**-0.5),
            "w1": draw(d, HIDDEN, d**-0.5), "w2": draw(HIDDEN, d, HIDDEN**-0.5), "u": draw(d, 4, 0.1), "b": np.array([[0, 2, 0, 0]], np.float32),
        }

    def with_pairs(self, pairs: np.ndarray, skips: np.ndarray) -> AttentionModel:
        """Counts of (class or start, next class) and of (class or start, class after the next)."""
        self.pairs, self.skips = pairs.astype(np.float32), skips.astype(np.float32)
        return self

    def arrays(self) -> dict:
        """All of the model as plain arrays, which any worker can load."""
        return {"attend": self.attend, "within": self.within, "unigram": self.unigram, "input": self.input, "klass": self.klass, "pairs": self.pairs, "skips": self.skips, "p": self.p}

    @classmethod
    def of(cls, arrays: dict) -> AttentionModel:
        one = cls.__new__(cls)
        one.__dict__.update(arrays, p=dict(arrays["p"]))
        return one

    def _ready(self) -> None:
        """The tables that scoring and training read, once a process."""
        if "ratio" not in self.__dict__:
            places = np.arange(CONTEXT)
            self.mask = (places[None] <= places[CONTEXT - STRIDE :, None]).astype(np.float32)
            self.one = self.pairs.sum(axis=0, dtype=np.float64) + 0.1
            self.one = (SMOOTH * self.one / self.one.sum()).astype(np.float32)
            self.sums = [t.sum(axis=1, dtype=np.float64).astype(np.float32) + np.float32(SMOOTH) for t in (self.pairs, self.skips)]
            self.plain = [(t + self.one).reshape(-1) for t in (self.pairs, self.skips)]
            self.ratio = [t.reshape(self.pairs.shape) / n[:, None] for t, n in zip(self.plain, self.sums, strict=True)]

    def _counted(self, x: np.ndarray, y: np.ndarray, apart: bool) -> list[np.ndarray]:
        """Unigram, bigram and skip bigram of the targets; `apart` leaves out the count that the target itself made."""
        target, c = np.maximum(y, 0), CONTEXT - STRIDE
        now, within, out, seen = np.take(self.klass, target), np.take(self.within, target), [np.take(self.unigram, target)], np.take(self.klass, x[:, c - 1 :])
        for i, before in enumerate((seen[:, 1:], seen[:, :-1])):
            cell = before * np.int32(CLASSES) + now
            if apart:
                own = (y >= 0).astype(np.float32)
                out.append((np.take(self.plain[i], cell) - own) / (np.take(self.sums[i], before) - own) * within)
            else:
                out.append(np.take(self.ratio[i].reshape(-1), cell) * within)
        return out

    def _projected(self) -> dict[str, np.ndarray]:
        """What each input row and each place adds to keys, queries and values, for weights that stay as they are."""
        if "projected" not in self.__dict__:
            p, c, q, v = self.p, CONTEXT - STRIDE, self.p["q"] * np.float32(WIDTH**-0.5), self.p["v"] @ self.p["o"]
            self.projected = {"key": p["e"] @ p["k"], "before": p["f"] @ p["w"], "query": p["e"] @ q, "value": p["e"] @ v, "key_at": p["pos"] @ p["k"], "query_at": p["pos"][c:] @ q, "value_at": p["pos"] @ v}
            self.projected["key_at"][0] += self.projected["before"][INPUTS]
        return self.projected

    def _weights(self, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Attention weights of the places that a target sees, not yet divided by their sum."""
        s = q @ k.transpose(0, 2, 1)
        if s.max() > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= self.mask
        return s

    @staticmethod
    def _matches(x: np.ndarray, y: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """1 where an input is the target, the target's unigram at places before the text, else 0."""
        match = (x[:, None, :] == y[:, :, None]).astype(np.float32)
        outside = np.flatnonzero(x[:, 0] < 0)
        if len(outside):
            match[outside] = np.where((x[outside] < 0)[:, None, :], unigram[outside][:, :, None], match[outside])
        return match

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        """Natural log probability of each of the STRIDE targets, 0 after the text. Keys, queries and values are looked up, as the weights stay as they are."""
        self._ready()
        p, c, x, y = self.p, CONTEXT - STRIDE, windows[:, :-1], windows[:, CONTEXT - STRIDE + 1 :]
        row, counted, copied = np.take(self.input, x), self._counted(x, y, False), np.float32(0)
        h = np.take(p["e"], row[:, c:], axis=0) + p["pos"][c:]
        if self.attend:
            t = self._projected()
            k = np.take(t["key"], row, axis=0)
            k[:, 1:] += np.take(t["before"], row[:, :-1], axis=0)
            k += t["key_at"]
            s = self._weights(np.take(t["query"], row[:, c:], axis=0) + t["query_at"], k)
            whole = np.einsum("nts->nt", s)
            h += (s @ (np.take(t["value"], row, axis=0) + t["value_at"])) / whole[:, :, None]
            copied = np.einsum("nts,nts->nt", s, self._matches(x, y, counted[0])) / whole
        h = h.reshape(-1, WIDTH)
        h = h + np.maximum(h @ p["w1"], 0) @ p["w2"]
        g = np.ascontiguousarray((h @ p["u"] + p["b"]).T).reshape(4, *y.shape)
        if not self.attend:
            g[3] = -1e9
        g -= g.max(axis=0)
        np.exp(g, out=g)
        total = sum(w * each for w, each in zip(g, (*counted, copied), strict=True)) / g.sum(axis=0)
        return np.where(y >= 0, np.log(np.maximum(total, 1e-30)), 0)

    def gradients(self, windows: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability, where no target counts as its own evidence.

        Places are rows of one matrix wherever weights meet them; only attention itself is a product for each window. Its weights stay undivided:
        what they are multiplied with is divided by their sum instead. Values are never made: attended inputs meet the product of `v` and `o`.
        """
        self._ready()
        p, c, d, n = self.p, CONTEXT - STRIDE, WIDTH, len(windows)
        x, y = windows[:, :-1], windows[:, c + 1 :]
        row = np.take(self.input, x)
        both = np.empty((n, CONTEXT, 2 * d), np.float32)  # of each place its own input, then the one before it
        np.add(np.take(p["e"], row, axis=0), p["pos"], out=both[..., :d])
        both[:, 0, d:], both[:, 1:, d:] = p["f"][INPUTS], np.take(p["f"], row[:, :-1], axis=0)
        flat, e, late = both.reshape(-1, 2 * d), both[..., :d], both[:, c:, :d].reshape(-1, d)
        counted, copied, h = self._counted(x, y, True), np.zeros(y.shape, np.float32), late
        if self.attend:
            scaled, keys, values = p["q"] * np.float32(d**-0.5), np.concatenate([p["k"], p["w"]]), p["v"] @ p["o"]
            q, k = (late @ scaled).reshape(n, STRIDE, d), (flat @ keys).reshape(n, CONTEXT, d)
            s = self._weights(q, k)
            part = 1 / np.einsum("nts->nt", s)
            attended = ((s @ e) * part[..., None]).reshape(-1, d)
            h = late + attended @ values
            match = self._matches(x, y, counted[0])
            match *= s
            copied = np.einsum("nts->nt", match) * part
        r = np.maximum(h @ p["w1"], 0)
        m = h + r @ p["w2"]
        g = np.ascontiguousarray((m @ p["u"] + p["b"]).T)
        if not self.attend:
            g[3] = -1e9
        g -= g.max(axis=0)
        np.exp(g, out=g)
        g /= g.sum(axis=0)
        each = np.stack([*counted, copied]).reshape(4, -1)
        each *= g
        total, known = np.maximum(each.sum(axis=0), 1e-30), (y >= 0).reshape(-1)
        real = known / np.float32(max(1, np.count_nonzero(known)))
        dz = (g - each / total) * real
        out = {"u": m.T @ dz.T, "b": dz.sum(axis=1)[None]}
        dm = dz.T @ p["u"].T
        dr = dm @ p["w2"].T
        dr *= r > 0
        out["w2"], out["w1"] = r.T @ dm, h.T @ dr
        dh = dm + dr @ p["w1"].T
        if self.attend:
            da, by = dh @ values.T, attended.T @ dh
            out["v"], out["o"] = by @ p["o"].T, p["v"].T @ by
            mean = np.einsum("nd,nd->n", da, attended) - each[3] / total * real
            ds = da.reshape(n, STRIDE, d) @ e.transpose(0, 2, 1)
            ds -= mean.reshape(n, STRIDE, 1)
            ds *= s
            match *= (g[3] / total * real).reshape(n, STRIDE, 1)
            ds -= match
            dq = ((ds @ k) * part[..., None]).reshape(-1, d)
            dk = (ds.transpose(0, 2, 1) @ (q * part[..., None])).reshape(-1, d)
            out["q"], by = late.T @ dq * np.float32(d**-0.5), flat.T @ dk
            out["k"], out["w"] = by[:d], by[d:]
            de = (dk @ keys.T).reshape(both.shape)
            de[..., :d] += s.transpose(0, 2, 1) @ (da.reshape(n, STRIDE, d) * part[..., None])
            dh += dq @ scaled.T
        else:
            de = np.zeros_like(both)
        de[:, c:, :d] += dh.reshape(n, STRIDE, d)
        out["pos"] = de.reshape(n, -1).sum(axis=0).reshape(CONTEXT, -1)[:, :d]
        first = de[:, 0, d:].sum(axis=0)
        de[:, :-1, d:] = de[:, 1:, d:]  # to the place whose input it is
        de[:, -1, d:] = 0
        by = _scatter(row, de.reshape(-1, 2 * d))
        by[INPUTS, d:] += first
        out["e"], out["f"] = by[:, :d], by[:, d:]
        return out

    def train(self, windows: np.ndarray, seed: int) -> AttentionModel:
        """One pass of Adam over shuffled batches."""
        order = np.random.default_rng(seed).permutation(len(windows))
        self.load(now := self.flat())
        m, v = np.zeros_like(now), np.zeros_like(now)
        for step, i in enumerate(range(0, len(order), BATCH), 1):
            found = self.gradients(windows[order[i : i + BATCH]])
            g = np.concatenate([found[k].reshape(-1) if k in found else np.zeros(self.p[k].size, np.float32) for k in self.NAMES])
            level = (1 - 0.999**step) ** 0.5
            rate = np.float32(LEARNING * level / (1 - 0.9**step))
            m *= np.float32(0.9)
            m += g * np.float32(0.1)
            v *= np.float32(0.999)
            g *= g
            g *= np.float32(0.001)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-8 * level)
            np.divide(m, g, out=g)
            g *= rate
            now -= g
        return self.load(now)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in self.NAMES])

    def load(self, values: np.ndarray) -> AttentionModel:
        at = 0
        for k in self.NAMES:
            size = self.p[k].size
            self.p[k] = values[at : at + size].reshape(self.p[k].shape).astype(np.float32, copy=False)
            at += size
        self.__dict__.pop("projected", None)
        return self


def _scatter(row: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """Sums of the gradients of each input row."""
    order = np.argsort(row.reshape(-1).astype(np.uint16), kind="stable")
    rows = row.reshape(-1)[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    grad = np.take(grad.view(np.complex64), order, axis=0)  # two numbers are added at a time
    out = np.zeros((INPUTS + 1, grad.shape[1]), np.complex64)
    out[rows[first]] = np.add.reduceat(grad, first, axis=0)
    return out.view(np.float32)


def _mix(row: np.ndarray, nth: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _bincounts(of, wide: int):
    """(slot, n) sums of what `of` makes of the training rows of a task."""

    def run(batches):
        total = None
        for batch in slices(batches, 2000):
            got = of(*unpack(batch.column(0), wide))
            if total is None:
                total = got
            else:
                total += got
        if total is not None:
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])

    return run


def _gather(rows: DataFrame, size: int, wide: int, of) -> np.ndarray:
    """The sums on the driver: at most `size` numbers."""
    out = np.zeros(size, np.int64)
    got = rows.mapInArrow(_bincounts(of, wide), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def _local(shared, r: int, rate: int, wide: int):
    """Passes over the windows of round r that the rows of a task have, each from the shared weights: their sum, weighted by windows, in blocks."""

    def run(batches):
        total, weight, shard, parts, many = 0.0, 0, 0, [], 0
        for batch in itertools.chain(slices(batches), [None]):
            if batch is not None:
                ids, begin = unpack(batch.column(1), wide)
                row, nth = window_numbers(begin)
                number = batch.column(0).to_numpy()[row]
                h = _mix(number, nth)
                pick = (h % np.uint64(rate) == 0) & (h // np.uint64(rate) % np.uint64(ROUNDS) == r)
                parts.append((number[pick], nth[pick], windows_of(ids, begin, row[pick], nth[pick])))
                many += len(parts[-1][0])
            while many >= SHARD + SHARD // 2 or batch is None and many:
                number, nth, windows = map(np.concatenate, zip(*parts, strict=True))
                size = SHARD if many >= SHARD + SHARD // 2 else many
                order = np.lexsort((nth[:size], number[:size]))
                total += AttentionModel.of(shared.value).train(windows[:size][order], seed=1000 * r + shard).flat().astype(np.float64) * size
                parts, many, weight, shard = [(number[size:], nth[size:], windows[size:])], many - size, weight + size, shard + 1
        if weight:
            total = np.append(total, np.zeros(-len(total) % BLOCK))
            blocks = np.arange(len(total) // BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([x.tobytes() for x in total.reshape(-1, BLOCK)], pa.binary()), pa.array(np.full(len(blocks), weight))], ["block", "total", "weight"])

    return run


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of the mean of all tasks' weights."""
    total = np.frombuffer(b"".join(pdf["total"])).reshape(len(pdf), BLOCK).sum(axis=0) / pdf["weight"].sum()
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "mean": [total.tobytes()]})


def _class_pairs(klass: np.ndarray):
    """Counts of (class before, class), then of (class before that, class); the start stands before a text."""
    start, cells = CLASSES, (CLASSES + 1) * CLASSES

    def of(ids, begin):
        now = klass[ids].astype(np.int64)
        before, first = np.concatenate([np.full(2, start), now]), begin[:-1]
        out = np.zeros(2 * cells, np.int64)
        for far in (1, 2):
            last = before[2 - far : len(before) - far].copy()
            for k in range(far):
                at = first + k
                last[at[at < begin[1:]]] = start
            out[(far - 1) * cells : far * cells] = np.bincount(last * CLASSES + now, minlength=cells)
        return out

    return of


def fit_model(spark: SparkSession, stored: DataFrame, vocabulary: int, rate: int = RATE, attend: bool = True) -> AttentionModel:
    """Counts of ids and class pairs over every training row, then attention weights by averaged local descent.

    One window in `rate`, chosen by hash over whole texts, trains, in one of ROUNDS rounds: the training set grows with the corpus. Shards of about
    SHARD windows, of rows that lie together, train side by side from the same weights; their mean, weighted by windows, starts the next round. The driver holds
    the model alone, which is of one size. Where no window is chosen the weights stay as drawn; where no row may be learnt from all counts are zero.
    """
    rows = stored.filter("NOT held_out").select("ids")
    wide = id_bytes(vocabulary)
    model = AttentionModel(_gather(rows, vocabulary, wide, lambda ids, begin: np.bincount(ids, minlength=vocabulary)), attend=attend)
    model.with_pairs(*_gather(rows, 2 * (CLASSES + 1) * CLASSES, wide, _class_pairs(model.klass)).reshape(2, CLASSES + 1, CLASSES))
    total = rows.agg(F.sum(F.octet_length("ids"))).first()[0]
    shards = max(1, round((total or 0) / wide / STRIDE / rate / ROUNDS / SHARD))

    rows = stored.filter("NOT held_out").select(ROW, "ids").coalesce(shards)
    for r in range(ROUNDS):
        local = _local(spark.sparkContext.broadcast(model.arrays()), r, rate, wide)
        sums = rows.mapInArrow(local, "block long, total binary, weight long")  # where the ids lie: neither they nor windows are shuffled
        got = sums.groupBy("block").applyInPandas(_mean, "block long, mean binary").toArrow().sort_by("block")
        if got.num_rows:
            model.load(np.frombuffer(b"".join(got.column("mean").to_pylist())))
    return model


def lm_scores(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END, frequent: int = FREQUENT, rate: int = RATE, attend: bool = True
) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A-Z is lower-cased. Tokens are the words and one end. Null and empty texts have the end alone. Rows whose crc32(id) mod 10 is 0 are held
    out; null ids are not. Repeated rows are scored, and learnt from, each on its own; an empty table gives no rows; other columns play
    no part. Words are known by 64-bit hashes. Where every row is held out, counts are zero and all scores are those of smoothing alone. tokenizer may be any
    tokenizers file, with an end_id of its own.

    The counts of all words are a table. Its `frequent` largest are broadcast, which settles most words where they are read; only
    the others are shuffled to their counts and back to their rows as sums.
    """
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    wide, kind = id_bytes(vocabulary), docs.schema[id_col].dataType.simpleString()
    narrow = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", ROW, held_out(F.col("doc_id")).alias("held_out"), "text")
    counts = narrow.filter("NOT held_out").select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch_table(spark, counts.filter("n > 0"), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    space = n + 0.1 * (v + 1)
    # words by their count on a scale of some thousand steps: the least step from which on at most `frequent` words lie
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(64 * (F.log2("n") - 10))).cast("int")
    least, room = 1 << 30, frequent
    for s, many in sorted(counts.groupBy(step.alias("s")).agg(F.count("*")).collect(), reverse=True):
        if many > room:
            break
        least, room = s, room - many
    top = counts.filter(step >= least).toArrow().to_pandas()
    order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((top["word"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.int64)[order], space))

    schema = f"doc_id {kind}, {ROW} long, held_out boolean, ids binary, n_tokens long, known long, base double, tail array<long>, tail_n array<long>"
    stored = scratch_table(spark, narrow.mapInArrow(_prepare(shared, tokenizer, end_id, wide), schema), "subwords")
    tail = stored.select(ROW, F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select(ROW, F.col("t.tail").alias("word"), F.col("t.tail_n").alias("many"))
    # words that share the broadcast table's counts are settled; what is left has no word of more than about 1 / frequent of all
    tail = tail.hint("merge").join(counts.hint("merge"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tail = tail.groupBy(ROW).agg(
        F.sum(F.col("many") * F.log10((F.col("n") + 0.1) / F.lit(space))).alias("tail_base"),
        F.sum(F.when(F.col("n") > 0, F.col("many")).otherwise(0)).alias("tail_known"),
    )

    shared_model = spark.sparkContext.broadcast(fit_model(spark, stored, vocabulary, rate, attend).arrays())

    def score(batches):
        model = AttentionModel.of(shared_model.value)
        for batch in slices(batches):
            ids, begin = unpack(batch.column(6), wide)
            total = np.zeros(batch.num_rows)
            step = 0
            while step < batch.num_rows:  # whole rows, about a million ids at a time
                stop = max(step + 1, int(np.searchsorted(begin, begin[step] + (1 << 20), "right")) - 1)
                own = begin[step : stop + 1] - begin[step]
                row, nth = window_numbers(own)
                for k in range(0, len(row), STEP):
                    x = windows_of(ids[begin[step] : begin[stop]], own, row[k : k + STEP], nth[k : k + STEP])
                    np.add.at(total, step + row[k : k + STEP], model.log_probs(x).sum(axis=1, dtype=np.float64))
                step = stop
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(total / np.log(10))], [*batch.schema.names[:6], "score"])

    columns = ["doc_id", ROW, "held_out", "n_tokens", "known", "base"]
    scored = stored.select(*columns, "ids").mapInArrow(score, f"doc_id {kind}, {ROW} long, held_out boolean, n_tokens long, known long, base double, score double")
    return scored.join(tail, ROW, "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
