"""Search for terms spelled by letters at equal skips."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skipweave.functions.text import normalize_term
from skipweave.operators.letters import positions_to_verses, stream_blocks
from skipweave.session import scratch_table

#: Letters of a block; each is searched with as many letters after it as a hit can span.
BLOCK = 1 << 18
CAP = 10_000
#: From so many words on (a term and its reverse are two) one pass over a block serves them all.
MANY = 8
#: Skips of the first range of a search that stops.
FIRST = 16


def effective_max_skip(total: int, length: int, max_skip: int) -> int:
    """A skip is at most the stream's letters over the term's, rounded down."""
    return min(max_skip, total // length)


def find_in(stream: np.ndarray, word: np.ndarray, skips, own: int) -> tuple[np.ndarray, np.ndarray]:
    """(first places, skips) at which word lies forward in stream, for first places under own. The rarest letter leads."""
    counts = np.bincount(stream, minlength=256)
    order = np.argsort(counts[word], kind="stable")
    lead = np.flatnonzero(stream == word[order[0]])
    places, steps = [], []
    for s in skips:
        start = lead - order[0] * s
        start = start[(start >= 0) & (start < own) & (start + (len(word) - 1) * s < len(stream))]
        for k in order[1:]:
            if not len(start):
                break
            start = start[stream[start + k * s] == word[k]]
        if len(start):
            places.append(start)
            steps.append(np.full(len(start), s))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(steps)


def count_in(stream: np.ndarray, words: list[np.ndarray], skips, own: int) -> int:
    """How many places find_in gives for all words, without the places: a letter's places are bits, and a word at a skip is the AND of its letters' bits, each moved to the first."""
    n = -(-len(stream) // 64)
    moved = {}  # of each letter its bits moved by 0 .. 63, so that a skip is a slice of whole words
    for c in {int(c) for w in words for c in w}:
        bits = np.zeros(n * 64, np.uint8)
        bits[: len(stream)] = stream == c
        one = np.append(np.packbits(bits, bitorder="little").view("<u8"), np.uint64(0))
        moved[c] = np.stack([one[:-1], *((one[:-1] >> np.uint64(b)) | (one[1:] << np.uint64(64 - b)) for b in range(1, 64))])
    begins = np.zeros(n * 64, np.uint8)
    begins[: min(own, len(stream))] = 1
    first = [moved[int(w[0])][0] & np.packbits(begins, bitorder="little").view("<u8") for w in words]
    total = 0
    for s in skips:
        for w, at in zip(words, first, strict=True):
            size = n - (len(w) - 1) * s // 64
            if size <= 0:
                continue
            found = at[:size]
            for k in range(1, len(w)):
                far, b = divmod(k * s, 64)
                found = found & moved[int(w[k])][b, far : far + size]
            total += int(np.bitwise_count(found).sum(dtype=np.int64))
    return total


def find_many(stream: np.ndarray, words: list[np.ndarray], lows: list[int], highs: list[int], own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of words, first places, skips) at which each word lies forward with a skip in its range, for first places under own.

    All words share the passes over the stream: for each skip the three letters from every place on are read as one number, and a table says whether a
    word begins with it; where one does, a second table asks for four letters. What is left is compared letter by letter, for all words side by side.
    """
    letter = (stream - 65).astype(np.uint16)
    out = [[np.zeros(0, np.int64)] for _ in range(3)]
    sizes, low, high = (np.array(x, np.int64) for x in ([len(w) for w in words], lows, highs))
    spelled = np.zeros((len(words), max(4, int(sizes.max(initial=0)))), np.int64)
    for i, w in enumerate(words):
        spelled[i, : len(w)] = w - 65
    code = spelled[:, :3] @ np.array([676, 26, 1])
    by_code = np.argsort(code, kind="stable")
    starts, first, many = np.unique(code[by_code], return_index=True, return_counts=True)
    begins, ends_there, fourth = np.zeros(26**3, bool), np.zeros(26**3, bool), np.zeros(26**4, bool)
    begins[code], ends_there[code[sizes == 3]], fourth[(code * 26 + spelled[:, 3])[sizes > 3]] = True, True, True
    for s in range(int(low.min(initial=1)), int(high.max(initial=0)) + 1):
        n = min(own, len(stream) - 2 * s)
        if n <= 0:
            break
        number = letter[:n] * np.uint16(26)
        number += letter[s : s + n]
        number *= np.uint16(26)
        number += letter[2 * s : 2 * s + n]
        place = np.flatnonzero(begins[number])
        three = number[place].astype(np.int64)
        there = place + 3 * s < len(stream)
        four = three * 26 + letter[np.where(there, place + 3 * s, 0)]
        ok = ends_there[three] | (there & fourth[four])
        place, group = place[ok], np.searchsorted(starts, three[ok])
        n = many[group]
        ends = np.cumsum(n)
        word = by_code[np.repeat(first[group] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        place = np.repeat(place, n)
        ok = (low[word] <= s) & (s <= high[word]) & (place + (sizes[word] - 1) * s < len(stream))
        word, place = word[ok], place[ok]
        for j in range(3, spelled.shape[1]):
            if not len(word):
                break
            longer = np.flatnonzero(sizes[word] > j)
            ok = np.ones(len(word), bool)
            ok[longer] = letter[place[longer] + j * s] == spelled[word[longer], j]
            word, place = word[ok], place[ok]
        if len(word):
            for o, x in zip(out, (word, place, np.full(len(word), s)), strict=True):
                o.append(x)
    return tuple(np.concatenate(o) for o in out)


def _segments(asked: list[tuple[str, str, int, int]], size: int):
    """Searches blocks for (term, direction, least skip, most skip); the reversed term lies forward where a hit is in reverse."""
    words = [np.frombuffer((t if way == "forward" else t[::-1]).encode(), np.uint8) for t, way, _, _ in asked]
    terms, ways = np.array([t for t, *_ in asked], object), np.array([way for _, way, *_ in asked], object)
    back = np.array([0 if way == "forward" else len(t) - 1 for t, way, *_ in asked], np.int64)
    lows, highs = [low for *_, low, _ in asked], [high for *_, high in asked]

    def run(frames):
        for pdf in frames:
            for number, start, letters in zip(pdf["block"], pdf["start"], pdf["letters"], strict=True):
                stream = np.frombuffer(letters.encode(), np.uint8)
                own = int(number * size + size - start)
                if len(words) >= MANY:
                    found = [find_many(stream, words, lows, highs, own)]
                else:
                    found = [(np.full(len(at), i), at, step) for i, w in enumerate(words) for at, step in [find_in(stream, w, range(lows[i], highs[i] + 1), own)]]
                for word, at, step in found:
                    if len(word):
                        yield pd.DataFrame({"term": terms[word], "direction": ways[word], "skip": step.astype(np.int32), "start": at + start + step * back[word]})

    return run


_HITS = "term string, direction string, skip int, start long"


def stream_length(bounded: DataFrame) -> int:
    return bounded.agg(F.coalesce(F.max("end_pos"), F.lit(0))).first()[0]


def _asked(terms: list[str], total: int, max_skip: int, block: int) -> tuple[dict[str, int], int, int]:
    """The most skip of each distinct term, the halo that the longest hit needs, and the size of blocks."""
    most = {w: effective_max_skip(total, len(w), max_skip) for w in dict.fromkeys(map(normalize_term, terms))}
    halo = max([(len(w) - 1) * m for w, m in most.items()], default=0)
    return most, halo, max(block, halo)


def _ways(direction: str) -> list[str]:
    return [w for w in ("forward", "reverse") if direction in (w, "both")]


def els_search(bounded: DataFrame, terms: list[str], min_skip: int = 1, max_skip: int = 3000, direction: str = "both", total: int | None = None, block: int = BLOCK) -> DataFrame:
    """term, direction, skip, start, positions of all hits, forward and reverse; a palindrome is reported in both.

    Blocks with their halo are searched side by side in numpy, for the reversed term too, so nothing but the letters is shuffled. The halo
    is what the longest hit spans; it is bounded by the skip and not by the stream. Many terms share their passes over a block.
    """
    if min_skip < 1:
        raise ValueError("skips begin at 1")
    most, halo, size = _asked(terms, stream_length(bounded) if total is None else total, max_skip, block)
    asked = [(w, way, min_skip, m) for w, m in most.items() for way in _ways(direction) if m >= min_skip]
    return with_positions(stream_blocks(bounded, halo, size).mapInPandas(_segments(asked, size), _HITS))


def with_positions(hits: DataFrame) -> DataFrame:
    """Adds the positions in the order of the term's letters; a reverse hit has falling ones."""
    sign = F.when(F.col("direction") == "forward", 1).otherwise(-1)
    steps = F.sequence(F.lit(0), F.length("term") - 1)
    return hits.withColumn("positions", F.transform(steps, lambda k: F.col("start") + sign * k * F.col("skip")))


def els_search_join(letters: DataFrame, term: str, total: int, min_skip: int = 1, max_skip: int = 3000, direction: str = "both") -> DataFrame:
    """The same hits by equi-joins of letters on computed places.

    The first two letters meet in blocks as long as the most skip, so skips come from their places, and no row is shuffled for a letter and a skip. What is left is joined with each further letter.
    """
    word, signs = normalize_term(term), [1 if w == "forward" else -1 for w in _ways(direction)]
    cap = effective_max_skip(total, len(word), max_skip)
    block, step = max(1, cap), F.col("at") - F.col("start")
    first = letters.filter(F.col("ch") == word[0]).select(F.col("pos").alias("start"), F.floor(F.col("pos") / block).alias("block"))
    second = letters.filter(F.col("ch") == word[1]).select(F.col("pos").alias("at"), F.explode(F.array(*(F.floor(F.col("pos") / block) + k for k in (-1, 0, 1)))).alias("block"))
    out = first.join(second, (first["block"] == second["block"]) & F.abs(step).between(min_skip, cap) & F.signum(step).isin(signs))
    out = out.select("start", F.abs(step).cast("int").alias("skip"), F.signum(step).cast("int").alias("sign"))
    last = F.col("start") + F.col("sign") * (len(word) - 1) * F.col("skip")
    out = out.filter((last >= 0) & (last < total))
    for k in range(2, len(word)):
        at = letters.filter(F.col("ch") == word[k]).select(F.col("pos").alias("at"))
        out = out.join(at, F.col("start") + F.col("sign") * k * F.col("skip") == F.col("at"), "left_semi")
    return with_positions(out.select(F.lit(word).alias("term"), F.when(F.col("sign") > 0, "forward").otherwise("reverse").alias("direction"), "skip", "start"))


def _cut(hits: DataFrame, cap: int) -> DataFrame:
    later = F.when(F.col("direction") == "forward", 0).otherwise(1)
    sizes = hits.groupBy("term", "direction", "skip").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("term").orderBy(later, "skip")
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.withColumn("capped", F.sum("__n").over(Window.partitionBy("term")) >= cap).filter(F.col("__base") < cap).drop("__n")
    own = F.row_number().over(Window.partitionBy("term", "direction", "skip").orderBy("start"))
    return hits.join(sizes, ["term", "direction", "skip"]).withColumn("__rn", own).filter(F.col("__base") + F.col("__rn") <= cap).select(*hits.columns, "capped")


def capped(hits: DataFrame, cap: int = CAP) -> DataFrame:
    """The first `cap` hits of each term, forward ones first, then by skip and start; capped says that there were as many or more.

    Counts by term, direction and skip say where each skip's hits begin in that order; only hits of skips that begin within the cap are ranked, each skip apart.
    """
    return _cut(scratch_table(hits.sparkSession, hits, "hits"), cap)  # read twice, searched once


def first_hits(
    bounded: DataFrame, terms: list[str], cap: int = CAP, min_skip: int = 1, max_skip: int = 3000, direction: str = "both", total: int | None = None, block: int = BLOCK, first: int = FIRST, tried: list | None = None
) -> DataFrame:
    """The rows of capped(els_search(...), cap), by a search that stops: no skip is tried beyond the range in which a term's cap is filled.

    Skips are tried in the order of the cap, forward ones first, in ranges that at least double; a range is made longer where the hits so far
    say that the cap needs it, and takes all that is left where there were none. Blocks are laid out once and each range's hits are stored; a count for each term reaches the driver.
    tried, if given, gets the ranges: lists of (term, direction, least skip, most skip).
    """
    if min_skip < 1:
        raise ValueError("skips begin at 1")
    spark = bounded.sparkSession
    most, halo, size = _asked(terms, stream_length(bounded) if total is None else total, max_skip, block)
    blocks = scratch_table(spark, stream_blocks(bounded, halo, size), "blocks")
    ways = _ways(direction)
    steps = {w: len(ways) * (m - min_skip + 1) for w, m in most.items() if m >= min_skip}  # all skips of one way, then those of the other
    done, width, held, out = dict.fromkeys(steps, 0), dict.fromkeys(steps, first), dict.fromkeys(steps, 0), []
    while steps:
        asked = []
        for w, n in steps.items():
            low, high, per = done[w], min(done[w] + width[w], n), n // len(ways)
            for k, way in enumerate(ways):
                a, b = max(low, k * per), min(high, (k + 1) * per)
                if a < b:
                    asked.append((w, way, min_skip + a - k * per, min_skip + b - 1 - k * per))
        if tried is not None:
            tried.append(asked)
        out.append(scratch_table(spark, blocks.mapInPandas(_segments(asked, size), _HITS), "hits"))
        counts = {r.term: r.n for r in out[-1].groupBy("term").agg(F.count("*").alias("n")).collect()}
        for w, n in list(steps.items()):
            done[w], held[w] = min(done[w] + width[w], n), held[w] + counts.get(w, 0)
            left = cap - held[w]
            if left <= 0 or done[w] == n:
                del steps[w]
            else:
                width[w] = max(2 * width[w], -(-5 * left * done[w] // (4 * held[w])) if held[w] else n)
    found = reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], _HITS)
    return with_positions(_cut(found, cap)).select("term", "direction", "skip", "start", "positions", "capped")


def search_page(bounded: DataFrame, term: str, max_skip: int = 2000, min_skip: int = 1, direction: str = "both") -> DataFrame:
    """The form for a page: all hits with their positions and verses, by skip, to a skip of 2000 where none is asked for."""
    found = hits_with_verses(els_search(bounded, [term], min_skip or 1, max_skip, direction), bounded)
    return with_positions(found).orderBy("skip", "direction", "start")


def search_report(bounded: DataFrame, term: str, min_skip: int = 1, max_skip: int = 3000, direction: str = "both", n: int = 25, cap: int = CAP) -> DataFrame:
    """The first n hits in the order of the cap with their verses; hit_count of the whole search, capped where that is cap or more, and a warning with a term of three letters. No hits give no rows."""
    word = normalize_term(term)
    found = scratch_table(bounded.sparkSession, els_search(bounded, [word], min_skip, max_skip, direction).drop("positions"), "report")  # all hits, as all are counted
    count = found.agg(F.count("*").alias("hit_count"))
    later = F.when(F.col("direction") == "forward", 0).otherwise(1)
    shown = with_positions(found.orderBy(later, "skip", "start").limit(n))
    placed = hits_with_verses(shown, bounded)
    warning = F.lit(f"{word} has three letters and may have many hits by chance; four or more say more" if len(word) == 3 else None).cast("string").alias("warning")
    return placed.join(F.broadcast(count), F.lit(True)).select(*placed.columns, "hit_count", (F.col("hit_count") >= cap).alias("capped"), warning).orderBy(later, "skip", "start")


def hits_with_verses(hits: DataFrame, bounded: DataFrame) -> DataFrame:
    """Adds start_verse, mid_verse and end_verse ('' where there is none): one range join for all three places."""
    places = hits.select("term", "direction", "skip", "start", F.explode(F.create_map(
        F.lit("start_verse"), F.col("start"),
        F.lit("mid_verse"), F.element_at("positions", (F.floor(F.length("term") / 2) + 1).cast("int")),
        F.lit("end_verse"), F.element_at("positions", -1),
    )).alias("place", "position"))
    found = positions_to_verses(places, bounded)
    names = ["start_verse", "mid_verse", "end_verse"]
    return found.groupBy("term", "direction", "skip", "start").agg(*(F.coalesce(F.max(F.when(F.col("place") == n, F.col("reference"))), F.lit("")).alias(n) for n in names))


def top_hits(hits: DataFrame, n: int = 25) -> DataFrame:
    return hits.orderBy("skip", "direction", "start").limit(n)


def hits_per_skip(hits: DataFrame, n: int = 5) -> DataFrame:
    return hits.groupBy("skip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skip").limit(n)


def hits_by_direction(hits: DataFrame) -> DataFrame:
    return hits.groupBy("term", "direction").agg(F.count("*").alias("n"))


def roll_call(hits: DataFrame, terms: list[str]) -> DataFrame:
    """Hits of each term, zero among them."""
    asked = hits.sparkSession.createDataFrame([(normalize_term(t),) for t in terms], "term string")
    return asked.join(hits.groupBy("term").agg(F.count("*").alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def expand_missing(narrow: DataFrame, wide: DataFrame, terms: list[str], max_skip: int) -> DataFrame:
    """Terms without a hit in `narrow`, and they alone, are searched anew in `wide` with skips up to max_skip; the number of hits of each, zero among them."""
    missing = [r.term for r in roll_call(narrow, terms).filter("n = 0").collect()]  # of the terms that were asked for
    return roll_call(els_search(wide, missing, 1, max_skip), missing)
