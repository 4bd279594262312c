"""Significance: expected hits, Poisson tails and shuffled streams."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skipweave.functions.text import normalize_term
from skipweave.operators.letters import letter_frequency
from skipweave.operators.search import count_in, effective_max_skip, stream_length
from skipweave.session import scratch_table, shuffles_dropped

#: Letters of a block of a shuffled stream, of what a task lays out at a time, and of the shuffled streams that are laid out before their blocks are counted and dropped.
BLOCK = 1 << 20
PIECE = 1 << 22
ROUND = 1 << 28


def places(total: int, length: int, min_skip: int, max_skip: int) -> int:
    """The sum over skips of the places where a term can begin, in closed form."""
    cap = effective_max_skip(total, length, max_skip)
    if cap < min_skip:
        return 0
    n = cap - min_skip + 1
    return n * total - (length - 1) * (cap * (cap + 1) - min_skip * (min_skip - 1)) // 2


def letter_probs(frequency: DataFrame, terms: list[str]) -> DataFrame:
    """term, i, letter, probability in the order of the term's letters; 0 for letters that the stream lacks."""
    rows = [(w, i, c) for w in map(normalize_term, terms) for i, c in enumerate(w)]
    asked = frequency.sparkSession.createDataFrame(rows, "term string, i int, letter string")
    return asked.join(F.broadcast(frequency.select("letter", "p")), "letter", "left").select("term", "i", "letter", F.coalesce("p", F.lit(0.0)).alias("p"))


def exact_frequency(frequency: DataFrame) -> DataFrame:
    """letter and its unrounded probability."""
    total = frequency.agg(F.sum("n").alias("total"))
    return frequency.join(F.broadcast(total), F.lit(True)).select("letter", (F.col("n") / F.col("total")).alias("p"))


def expected_frequency(frequency: DataFrame, terms: list[str], total: int, min_skip: int, max_skip: int, direction: str = "both") -> DataFrame:
    """term, expected: the product of the letters' probabilities times the places, twice for both directions; 0 with an absent letter."""
    ways = 2 if direction == "both" else 1
    rows = [(w, float(places(total, len(w), min_skip, max_skip) * ways)) for w in dict.fromkeys(map(normalize_term, terms))]
    asked = frequency.sparkSession.createDataFrame(rows, "term string, places double")
    logs = letter_probs(exact_frequency(frequency), terms).groupBy("term").agg(F.min("p").alias("least"), F.sum(F.when(F.col("p") > 0, F.ln("p"))).alias("log_p"))
    return asked.join(logs, "term").select("term", F.when(F.col("least") > 0, F.exp("log_p") * F.col("places")).otherwise(0.0).alias("expected"))


def poisson_log(rate: Column, observed: Column) -> Column:
    """The logarithm of P(X = observed) for a Poisson rate over 0, without a sum of logarithms: Stirling's series stands for the factorial beyond 20."""
    off = (observed - rate) / rate
    apart = rate * ((1 + off) * F.log1p(off) - off)  # observed * ln(observed / rate) - (observed - rate), which is exact where both are large and near
    series = 1 / (12 * observed) - 1 / (360 * F.pow(observed, 3.0)) + 1 / (1260 * F.pow(observed, 5.0))
    few = observed * F.ln(rate) - rate - F.ln(F.factorial(F.least(observed, F.lit(20)).cast("int")))
    return F.when(observed <= 20, few).otherwise(-apart - series - F.ln(2 * math.pi * observed) / 2)


def poisson_tail(rate: Column, observed: Column) -> Column:
    """P(X >= observed) for a Poisson rate.

    Beyond the rate the tail itself is summed, so that a small one isn't the difference of two numbers near 1; up to it what lies below is, downwards. Terms fall from observed on, either
    way, and those further than ten deviations and 60 places away are below what a double holds: the sums grow with the root of the rate, and not with observed.
    """
    at = F.exp(poisson_log(rate, observed))
    steps = F.sequence(F.lit(1), (10 * F.sqrt(rate) + 60).cast("int"))
    summed = lambda ratio: F.aggregate(steps, F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")), lambda a, k: F.struct((a["sum"] + a["term"] * ratio(k)).alias("sum"), (a["term"] * ratio(k)).alias("term")), lambda a: a["sum"])
    above, below = summed(lambda k: rate / (observed + k)), summed(lambda k: (observed - k) / rate)  # no term lies below 0
    tail = F.when(observed > rate, at * above).otherwise(F.greatest(F.lit(0.0), 1.0 - at * observed / rate * below))
    return F.when(observed <= 0, F.lit(1.0)).when(rate <= 0, F.lit(0.0)).otherwise(tail)


#: Levels under which a p-value is called so.
LEVELS = [(0.001, "EXTREMELY SIGNIFICANT (p < 0.001)"), (0.01, "HIGHLY SIGNIFICANT (p < 0.01)"), (0.05, "SIGNIFICANT (p < 0.05)")]
NOT_SIGNIFICANT = "NOT SIGNIFICANT (p >= 0.05)"


def significance_label(p: Column) -> Column:
    out = F.lit(NOT_SIGNIFICANT)
    for level, name in reversed(LEVELS):
        out = F.when(p < level, name).otherwise(out)
    return out


def reported_p(p: Column) -> Column:
    """Six places, and under 0.0001 five digits wherever they begin."""
    return F.when(p < 0.0001, F.format_string("%.4e", p).cast("double")).otherwise(F.round(p, 6))


def poisson_analysis(counts: DataFrame) -> DataFrame:
    """counts (term, expected, observed) with ratio, p and label; p is of the unrounded rate."""
    out = counts.withColumn("p", poisson_tail(F.col("expected"), F.col("observed")))
    ratio = F.when(F.col("expected") > 0, F.round(F.col("observed") / F.col("expected"), 4)).alias("ratio")
    return out.select("term", F.round("expected", 4).alias("expected"), "observed", ratio, reported_p(F.col("p")).alias("p"), significance_label(F.col("p")).alias("label"))


#: Half rounds of a shuffle, and the prime that its rounds count by: cubes of numbers under it take two products of under 63 bits.
HALF_ROUNDS = 6
PRIME = (1 << 31) - 1


def shuffle_keys(seed: str, run: int) -> list[int]:
    """A key for each half round: the first 28 bits of the digest of seed, run and number."""
    return [int(hashlib.md5(f"{seed}:{run}:{i}".encode()).hexdigest()[:7], 16) for i in range(HALF_ROUNDS)]


def shuffled_places(places: np.ndarray, total: int, keys: list[int]) -> np.ndarray:
    """Where the letters at `places` of a stream of `total` letters go: a bijection that is worked out for each place alone.

    A place is written as two digits to the bases rows and columns, whose product is little more than total. Rounds in turn add to one digit a cube of the
    other, which can be undone; a place beyond the stream is shuffled again until it falls into it.
    """
    if total >= 1 << 58:
        raise ValueError("too many letters")
    rows = math.isqrt(max(total - 1, 0)) + 1
    columns = -(-total // rows) or 1

    def cubes(n, key, base):
        y = (np.arange(n) + key) % PRIME
        return (y * y % PRIME * y + key) % PRIME % base

    # what a half round adds follows from a digit, so it is worked out once for each digit and not for each place
    added = [cubes(rows, k, columns) if i % 2 else cubes(columns, k, rows) for i, k in enumerate(keys)]
    out, todo = places.astype(np.int64), np.arange(len(places))
    while len(todo):
        high, low = np.divmod(out[todo], columns)
        for i in range(0, HALF_ROUNDS, 2):
            high += added[i][low]
            high -= rows * (high >= rows)
            low += added[i + 1][high]
            low -= columns * (low >= columns)
        out[todo] = high * columns + low
        todo = todo[out[todo] >= total]
    return out


def _stream_parts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of all letters of a batch of verses."""
    codes = np.frombuffer("".join(pdf["letters"]).encode(), np.uint8)
    n = pdf["letters"].str.len().to_numpy(np.int64)
    ends = np.cumsum(n)
    return np.repeat(pdf["start_pos"].to_numpy(np.int64) - (ends - n), n) + np.arange(len(codes)), codes


def shuffled(bounded: DataFrame, runs: int, seed: str, total: int) -> DataFrame:
    """run, pos, ch: the letters of each shuffled stream at their new places."""

    def run(frames):
        for pdf in frames:
            places, codes = _stream_parts(pdf)
            letters = np.array([chr(c) for c in range(256)], object)[codes]
            for r in range(1, runs + 1):
                yield pd.DataFrame({"run": np.int32(r), "pos": shuffled_places(places, total, shuffle_keys(seed, r)), "ch": letters})

    return bounded.select("start_pos", "letters").mapInPandas(run, "run int, pos long, ch string")


def _pieces(frames, letters: np.ndarray):
    """Places and numbers in `letters` of a task's letters that are among them, from some PIECE letters of its verses at a time."""
    number = np.full(256, len(letters), np.int64)
    number[letters] = np.arange(len(letters))
    held, n = [], 0
    for pdf in frames:
        for _, verses in pdf.groupby(pdf["letters"].str.len().cumsum() // PIECE):
            places, codes = _stream_parts(verses)
            n += len(codes)
            among = np.flatnonzero(number[codes] < len(letters))
            held.append((places[among], number[codes[among]]))
            if n >= PIECE:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


#: A step of this many places is written before what a longer one has beyond it.
FULL = (1 << 16) - 1


def packed(rising: np.ndarray) -> bytes:
    """Rising numbers from 0 on by the steps between them, two bytes a step; a longer one has as many full steps before it as it holds."""
    steps = np.diff(rising, prepend=0)
    full = steps // FULL
    out = np.full(len(steps) + int(full.sum()), FULL, "<u2")
    out[np.arange(len(steps)) + np.cumsum(full)] = steps - full * FULL
    return out.tobytes()


def unpacked(steps: bytes) -> np.ndarray:
    step = np.frombuffer(steps, "<u2")
    return np.cumsum(step, dtype=np.int64)[step < FULL]


def monte_carlo(bounded: DataFrame, term: str, total: int | None = None, runs: int = 100, seed: str = "0", min_skip: int = 1, max_skip: int = 1000, direction: str = "both", block: int = BLOCK) -> DataFrame:
    """run, n: hits of the term in each shuffled stream, runs without hits among them.

    A letter's new place follows from its old one, the run and the seed alone, so no run is sorted or ranked. Tasks send the term's letters, and no others, to
    the blocks of the shuffled streams, by the steps between their places; blocks are then searched side by side by ANDs of bits. Runs are laid out a round at a time, ROUND letters or one
    run, and what a round shuffles is dropped when it is counted: neither the number of runs nor the stream's other letters take disk. A task holds a piece of the stream or one block,
    and the driver a count for each run.
    """
    word = normalize_term(term)
    spark = bounded.sparkSession
    total = stream_length(bounded) if total is None else total
    cap = effective_max_skip(total, len(word), max_skip)
    if cap < min_skip:
        return spark.range(1, runs + 1).select(F.col("id").cast("int").alias("run"), F.lit(0).cast("long").alias("n"))
    halo = (len(word) - 1) * cap
    size = max(block, halo)
    words = [np.frombuffer(w.encode(), np.uint8) for w, way in ((word, "forward"), (word[::-1], "reverse")) if direction in (way, "both")]
    spelled = np.unique(np.frombuffer(word.encode(), np.uint8))
    kinds = len(spelled)
    if size + halo >= 1 << 32:
        raise ValueError("a hit spans too many letters")

    def laid(asked):
        def run(frames):
            blocks = np.arange(-(-total // size))
            for places, numbers in _pieces(frames, spelled):
                for r in asked:
                    to = np.sort(shuffled_places(places, total, shuffle_keys(seed, r)) * kinds + numbers)
                    begin, end = np.searchsorted(to, blocks * (size * kinds)), np.searchsorted(to, (blocks * size + size + halo) * kinds)
                    met = np.flatnonzero(begin < end)
                    yield pd.DataFrame({"run": np.int32(r), "block": met, "steps": [packed(to[begin[b] : end[b]] - b * size * kinds) for b in met]})

        return run

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [unpacked(x) for x in pdf["steps"]]
        stream = np.zeros(max(int(x[-1]) for x in found) // kinds + 1, np.uint8)
        for x in found:
            at, number = np.divmod(x, kinds)
            stream[at] = spelled[number]
        return pd.DataFrame({"run": [pdf["run"].iloc[0]], "n": [count_in(stream, words, range(min_skip, cap + 1), size)]})

    each, counts = max(1, ROUND // max(total, 1)), {}
    with shuffles_dropped(spark):
        # verses are dealt out by number, or adaptive execution would put a short stream into one task
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PIECE))
        dealt = scratch_table(spark, bounded.select("start_pos", "letters").repartition(parts, "start_pos"), "dealt")
        for first in range(1, runs + 1, each):
            found = dealt.mapInPandas(laid(range(first, min(first + each, runs + 1))), "run int, block long, steps binary").groupBy("run", "block").applyInPandas(count, "run int, n long")
            counts |= {r.run: r.n for r in found.groupBy("run").agg(F.sum("n").alias("n")).collect()}
    return spark.createDataFrame([(r, counts.get(r, 0)) for r in range(1, runs + 1)], "run int, n long")


def mc_distribution(counts: DataFrame, observed: int) -> DataFrame:
    """Of the runs' counts: mean, population deviation, upper median, extremes, z (0 without deviation) and p."""
    sorted_ = F.array_sort(F.collect_list("n"))
    out = counts.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.element_at(sorted_, (F.floor(F.size(sorted_) / 2) + 1).cast("int")).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg((F.col("n") >= observed).cast("int")).alias("p"))
    z = F.when(F.col("sd") > 0, (observed - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return out.select(F.round("mean", 2).alias("mean"), F.round("sd", 2).alias("sd"), "median", "least", "most", F.round(z, 4).alias("z"), F.round("p", 6).alias("p"))


def full_analysis(bounded: DataFrame, term: str, observed: int, min_skip: int = 1, max_skip: int = 3000, direction: str = "both", runs: int = 100, mc_max_skip: int | None = None, seed: str = "0") -> DataFrame:
    """One row: the Poisson analysis of a term, and, unless runs is 0, how its hits lie in shuffled streams.

    Without mc_max_skip shuffled streams are searched to max_skip, but to 1000 at most; range_mismatch says that this is another range than
    the one that observed was counted over, so that mc_p is too low.
    """
    word = normalize_term(term)
    total = stream_length(bounded)
    expected = expected_frequency(letter_frequency(bounded), [word], total, min_skip, max_skip, direction)
    out = poisson_analysis(expected.withColumn("observed", F.lit(observed).cast("long")))
    if not runs:
        return out
    narrow = min(max_skip, 1000) if mc_max_skip is None else mc_max_skip
    cut = lambda skip: effective_max_skip(total, len(word), skip)
    shuffles = mc_distribution(monte_carlo(bounded, word, total, runs, seed, min_skip, narrow, direction), observed)
    return out.join(F.broadcast(shuffles.withColumnRenamed("p", "mc_p")), F.lit(True)).withColumn("runs", F.lit(runs)).withColumn("range_mismatch", F.lit(cut(narrow) != cut(max_skip)))
