"""Best-fit packing of tokenised documents into sequences, with linear grouping of large lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skipweave.llm.common import scratch_table
from skipweave.llm.tokens import encoder, slices, tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Lengths over this share of the capacity are large: they are grouped, the others fill what is left.
LARGE = 1 / 8
#: Groups of equal cardinality that large lengths are rounded up within.
GROUPS = 48
#: A configuration ends where actual lengths would fill this share of a sequence less than the rounded ones: best fit takes what is left of its pieces.
WASTE = 1 / 128
#: The last two places of a configuration are full enough where they leave no more than this share of a sequence.
SPARE = 1 / 512


def best_patterns(sizes: list[int], demand: list[float], capacity: int, rounds: int = 400) -> list[tuple[list[int], float]]:
    """Few-size configurations and how often to use each, by column generation on the fractional problem.

    A configuration says how many of each size share a bin. The basis starts with one size a bin; prices of
    the basis go to an unbounded knapsack, whose best configuration enters until none is worth more than a bin.
    """
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    use = np.array(demand, float) / np.diag(basis)
    weight = np.array(sizes)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(weight.min()), capacity + 1):
            fits = np.flatnonzero(weight <= c)
            value = best[c - weight[fits]] + price[fits]
            j = int(np.argmax(value))
            best[c] = best[c - 1]
            if value[j] > best[c] + 1e-12:
                best[c], take[c] = value[j], fits[j]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                column[take[c]] += 1
                c -= sizes[take[c]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = ratio[out]
        use = np.maximum(use - amount * step, 0)
        use[out] = amount
        basis[:, out] = column
    return [(basis[:, j].astype(int).tolist(), float(use[j])) for j in range(k)]


class _Bins:
    """Bins in runs: `count` bins from `first` on, all filled to the same level. Slots say what lies in them."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.slots = capacity, 0, []
        self.given: dict[int, int] = {}
        self.room: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, bins: int, per: int, first: int, at: int) -> None:
        rank = self.given.get(length, 0)
        self.slots.append((length, rank, bins * per, per, first, at))
        self.given[length] = rank + bins * per

    def open(self, bins: int) -> int:
        self.next += bins
        return self.next - bins

    def leave(self, first: int, bins: int, level: int) -> None:
        room = self.capacity - level
        if bins and room:
            if room not in self.runs:
                insort(self.room, room)
            self.runs.setdefault(room, []).append((first, bins))

    def fit(self, length: int, count: int) -> None:
        """Best fit of `count` pieces of one length: always the least room that holds one more."""
        while count:
            i = bisect_left(self.room, length)
            if i == len(self.room):
                bins = -(-count // (self.capacity // length))
                first, room = self.open(bins), self.capacity
            else:
                room = self.room[i]
                first, bins = self.runs[room].pop()
                if not self.runs[room]:
                    del self.runs[room]
                    self.room.pop(i)
            level, per = self.capacity - room, room // length
            full = min(bins, count // per)
            if full:
                self.put(length, full, per, first, level)
                self.leave(first, full, level + per * length)
            count -= full * per
            first, bins = first + full, bins - full
            if bins and count:
                self.put(length, 1, count, first, level)
                self.leave(first, 1, level + count * length)
                first, bins, count = first + 1, bins - 1, 0
            self.leave(first, bins, level)


def _substitute(wanted: list[int], big: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """Actual lengths for the places of a configuration, and how often each: for each place the largest that fits it and what is left over so far, but
    for the last two together those that fill them best. big is sorted and has the lengths that are left. Fewer than wanted where a place finds none."""
    taken: dict[int, int] = {}
    level = room = 0

    def largest(most: int, beside: int = 0) -> int:
        i = bisect_right(big, most) - 1
        while i >= 0 and left[big[i]] <= taken.get(big[i], 0) + (big[i] == beside):
            i -= 1
        return big[i] if i >= 0 else 0

    def take(n: int) -> None:
        taken[n] = taken.get(n, 0) + 1

    for s in wanted[:-2]:
        room += s
        n = largest(room)
        if not n:
            return taken
        take(n)
        room, level = room - n, level + n
    rest, spare = capacity - level, SPARE * capacity
    if len(wanted) == 1:
        n = largest(rest)
        if n:
            take(n)
        return taken
    best, n, least = (0, 0), largest(wanted[-2] + room), rest
    while n and least > spare:
        other = largest(rest - n, n)
        if other and rest - n - other < least:
            best, least = (n, other), rest - n - other
        n = largest(n - 1)
    for n in best:
        if n:
            take(n)
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS, waste: float = WASTE) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Where the pieces of each length go, the number of sequences, and the number of large pieces that configurations placed.

    A place is (length, rank, count, per, sequence, offset): the pieces `rank` .. `rank + count - 1` of a length go to the sequences from `sequence`
    on, `per` of them in each, from `offset` on. All work is on runs of equal lengths, so its cost depends on the capacity and not on the number
    of pieces. Large lengths are grouped whatever their number: with fewer than `groups` each is a group of its own.

    Actual pieces take a configuration's places from the largest down, so that what rounding wasted evens out. What a sequence then has left is for best fit, with the small pieces and those large ones that no configuration takes: a configuration
    ends where actual pieces would fill its sequences less than the rounded ones by more than the share `waste`, as happens once few lengths are left.
    """
    left = {n: c for n, c in histogram.items() if c}
    bins = _Bins(capacity)
    if capacity in left:
        count = left.pop(capacity)
        bins.put(capacity, count, 1, bins.open(count), 0)
    big = sorted(n for n in left if n > large * capacity)
    total, placed = sum(left[n] for n in big), 0
    if big:
        # linear grouping: groups of equal cardinality from the largest down, each as tall as its tallest; groups of one height count as one size
        each, demand, seen = -(-total // groups), {}, 0
        for n in reversed(big):
            count = left[n]
            while count:
                if seen % each == 0:
                    tall = n
                take = min(count, each - seen % each)
                demand[tall] = demand.get(tall, 0) + take
                seen, count = seen + take, count - take
        sizes = sorted(demand, reverse=True)
        for column, use in sorted(best_patterns(sizes, [demand[s] for s in sizes], capacity), key=lambda p: -p[1]):
            wanted, times = [s for s, c in zip(sizes, column, strict=True) for _ in range(c)], int(use + 1e-9)
            while times:
                taken = _substitute(wanted, big, left, capacity)
                level = sum(n * per for n, per in taken.items())
                if sum(taken.values()) < len(wanted) or sum(wanted) - level > waste * capacity:
                    break
                stretch = min(times, *(left[n] // per for n, per in taken.items()))
                first, at = bins.open(stretch), 0
                for n, per in taken.items():
                    bins.put(n, stretch, per, first, at)
                    at, placed = at + n * per, placed + stretch * per
                    left[n] -= stretch * per
                    if not left[n]:
                        big.remove(n)
                bins.leave(first, stretch, level)
                times -= stretch
    for n in sorted(left, reverse=True):
        bins.fit(n, left[n])
    return bins.slots, bins.next, placed


def cut_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: all of the capacity, but for a shorter first one."""
    first = total % capacity
    return ([first] if first else []) + [capacity] * (total // capacity)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, 1):
            ids, starts = encoder(path).encode(batch.column(1), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            total = np.diff(starts)
            first = total % capacity
            count = total // capacity + (first > 0)
            doc = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            short = np.where(first == 0, capacity, first)[doc]
            start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
            length = np.where(piece == 0, short, capacity)
            at = (starts[:-1][doc] + start) * 4
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sizes, begin, many = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(begin, many) + np.repeat(seen[sizes], many)
            seen[sizes] += many
            ids_of = batch.column(0).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [ids_of, *map(pa.array, (piece.astype(np.int32), start, length)), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
            )

    return run


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids end with end_id, so null and empty texts give one piece of one id. Texts over the capacity are cut into pieces of the
    capacity, of which the first may be shorter. Repeated rows are packed each on its own; an empty table gives no rows; other
    columns play no part.

    Only the counts of the lengths 1 .. capacity reach the driver, which plans in runs of equal lengths; each piece then finds its
    place by its rank among those of its length. Ranks are the place within a task plus the counts of earlier tasks, so a length
    that most pieces share is never gathered.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long"
    pieces = scratch_table(spark, docs.select(id_col, text_col).mapInArrow(_pieces(path, end_id, capacity), schema), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = scratch_table(spark, counts, "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _, _ = plan(histogram, capacity)
    table = np.array(sorted(slots), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacity: some thousand rows

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))

    def seat(batches):
        rows = shared.value
        key = rows[:, 0] * (1 << 44) + rows[:, 1]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            slot = rows[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1] if len(pdf) else np.zeros((0, 6), np.int64)
            nth = rank - slot[:, 1]
            per = np.maximum(slot[:, 3], 1)
            yield pdf.drop(columns="rank").assign(sequence_id=slot[:, 4] + nth // per, offset=slot[:, 5] + nth % per * length)

    return ranked.mapInPandas(seat, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
