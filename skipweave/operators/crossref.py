"""Cross-reference of hits: proximity, clusters, sweeps and the searches around midpoints."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skipweave.operators.letters import positions_to_verses
from skipweave.session import scratch_table

NOISE = 10_000
_SIDES = ("start", "skip", "direction")


def intersections(hits_a: DataFrame, hits_b: DataFrame) -> DataFrame:
    """position and hit of B for each letter of B that lies on a letter of A: a bag over B, a set over A."""
    taken = hits_a.select(F.explode("positions").alias("position")).distinct()
    return hits_b.select("hit_id", F.explode("positions").alias("position")).join(taken, "position", "left_semi")


def with_verses(rows: DataFrame, bounded: DataFrame, places: dict[str, str]) -> DataFrame:
    """rows with the reference of each place: places maps a column of positions to the name of a new one. A null where there is no verse."""
    spots = rows.select(F.explode(F.array(*map(F.col, places))).alias("position")).distinct()
    found = positions_to_verses(spots, bounded).select("position", "reference")
    for column, name in places.items():
        rows = rows.join(found.select(F.col("position").alias(column), F.col("reference").alias(name)), column, "left")
    return rows


def intersections_with_verses(hits_a: DataFrame, hits_b: DataFrame, bounded: DataFrame) -> DataFrame:
    """intersections with the verse and the letter of each place."""
    meets = intersections(hits_a, hits_b)
    found = positions_to_verses(meets.select("position").distinct(), bounded).select("position", F.col("reference").alias("verse"), "letter")
    return meets.join(found, "position", "left").select("hit_id", "position", "verse", "letter")


#: Places of a block in which pairs are looked for, and pairs of letters that are held at a time.
STRIP, CHUNK = 1 << 13, 1 << 19
_KEYS = [*_SIDES, "hit_id"]


def _ranked_hits(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The distinct hits in the order of start, skip, direction and hit_id, and the number of each row's hit."""
    own = pdf.groupby(_KEYS, sort=True, dropna=False).ngroup().to_numpy()
    first = np.unique(own, return_index=True)[1]
    return pdf[_KEYS].iloc[first].reset_index(drop=True), own


def _flat(hits: pd.DataFrame, side: str) -> pd.DataFrame:
    return hits.rename(columns={k: f"{k}_{side}" for k in _KEYS}).reset_index(drop=True)


_FLAT_PAIR = ", ".join(f"start_{s} long, skip_{s} int, direction_{s} string, hit_id_{s} long" for s in "ab") + ", distance long, pos_a long, pos_b long"


def _paired(flat: DataFrame, *more: str) -> DataFrame:
    sides = (F.struct(*(F.col(f"{k}_{s}").alias(k) for k in _KEYS)).alias(s) for s in "ab")
    return flat.select(*sides, "distance", "pos_a", "pos_b", *more)


def _all_pairs(width: int, more: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Hits of A that begin in the block against all of B that reach it, some pairs at a time: each pair is met once, with all its letters."""
        pdf = pd.concat(list(batches), ignore_index=True)
        a, b = (pdf[pdf["side"] == k].sort_values(["low", *_KEYS], kind="stable").reset_index(drop=True) for k in (0, 1))
        a, b = a.drop_duplicates(_KEYS, ignore_index=True), b.drop_duplicates(_KEYS, ignore_index=True)
        if not len(a) or not len(b):
            return
        low_b, high_b = b["low"].to_numpy(), b["high"].to_numpy()
        begin = np.searchsorted(low_b, a["low"].to_numpy() - width - int((high_b - low_b).max()), "left")
        end = np.searchsorted(low_b, a["high"].to_numpy() + width, "right")
        letters, size = {}, {}
        for side, t in (("a", a), ("b", b)):
            size[side] = t["positions"].str.len().to_numpy(np.int64)
            letters[side] = np.zeros((len(t), int(size[side].max())), np.int64)
            letters[side][np.arange(letters[side].shape[1]) < size[side][:, None]] = np.concatenate(list(t["positions"]))
        refs = {s: list(t["refs"]) for s, t in (("a", a), ("b", b))} if more else None
        ends = np.cumsum(end - begin)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")))
            n = (end - begin)[i:j]
            left = np.repeat(np.arange(i, j), n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[i:j], n)
            best, at_a, at_b = np.full(len(left), width + 1), np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
            for x in range(letters["a"].shape[1]):
                for y in range(letters["b"].shape[1]):
                    gap = np.abs(letters["a"][left, x] - letters["b"][right, y])
                    nearer = np.flatnonzero((gap < best) & (size["a"][left] > x) & (size["b"][right] > y))
                    best[nearer], at_a[nearer], at_b[nearer] = gap[nearer], x, y
            near = np.flatnonzero(best <= width)
            left, right, at_a, at_b = left[near], right[near], at_a[near], at_b[near]
            out = pd.concat([_flat(a[_KEYS].iloc[left], "a"), _flat(b[_KEYS].iloc[right], "b")], axis=1)
            out = out.assign(distance=best[near], pos_a=letters["a"][left, at_a], pos_b=letters["b"][right, at_b])
            for name, side, rows, at in zip(more, "ab", (left, right), (at_a, at_b), strict=False):
                out[name] = [refs[side][r][k] for r, k in zip(rows, at, strict=True)]
            if len(out):
                yield out
            i = j

    return run


def _all_pairs_of(hits_a: DataFrame, hits_b: DataFrame, width: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Hits go to blocks by their places and are shuffled once; pairs are made in the block of A's first place, and never shuffled."""
    columns = [*_KEYS, "positions", *(["refs"] if more else []), F.array_min("positions").alias("low"), F.array_max("positions").alias("high")]
    a, b = (h.filter(F.size("positions") > 0).select(F.lit(k).alias("side"), *columns) for k, h in enumerate((hits_a, hits_b)))
    span = a.agg(F.coalesce(F.max(F.col("high") - F.col("low")), F.lit(0))).first()[0]
    block = lambda c: F.floor(c / STRIP)
    a = a.withColumn("block", block(F.col("low")))
    b = b.withColumn("block", F.explode(F.sequence(block(F.col("low") - width - span), block(F.col("high") + width))))
    schema = _FLAT_PAIR + "".join(f", {m} string" for m in more)
    return _paired(a.unionByName(b).groupBy("block").applyInPandas(_all_pairs(width, list(more)), schema), *more)


def pairs_within(hits_a: DataFrame, hits_b: DataFrame, width: int) -> DataFrame:
    """Pairs of hits with letters at most `width` apart: the closest letters, of equal ones the first in letter order."""
    return _all_pairs_of(hits_a, hits_b, max(1, width))


def pairs_with_verses(hits_a: DataFrame, hits_b: DataFrame, width: int, bounded: DataFrame) -> DataFrame:
    """pairs_within with verse_a and verse_b, those of the closest letters. Verses are looked up for the hits' letters, before pairs are made."""
    with_refs = []
    for hits in (hits_a, hits_b):
        each = hits.select(*_KEYS, F.posexplode("positions").alias("k", "position"))
        found = positions_to_verses(each, bounded).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("k", "position", "reference"))).alias("each"))
        with_refs.append(found.select(*_KEYS, F.col("each.position").alias("positions"), F.col("each.reference").alias("refs")))
    return _all_pairs_of(*with_refs, max(1, width), ("verse_a", "verse_b"))


def order_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The n closest pairs, equal ones by the hits' starts, skips and directions."""
    keys = [F.col(f"{s}.{k}") for s in ("a", "b") for k in (*_SIDES, "hit_id")]
    return pairs.orderBy("distance", *keys).limit(n)


def _first_of_each(place: np.ndarray, hit: np.ndarray, n: int) -> np.ndarray:
    """Rows in the order of places and hits, of which the first n of a place are left."""
    order = np.lexsort((hit, place))
    place = place[order]
    nth = np.arange(len(place)) - np.searchsorted(place, place)
    return order[nth < n]


def _expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges begin .. end - 1 the number of the range and each of its members."""
    n = np.maximum(end - begin, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def _closest(n: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The block's n closest pairs of different hits, by letters of A in the block and letters of B in it or near it.

        Of hits with a letter at one place only the first n can be among them. The distance at which there are enough pairs of letters is found by bisection; nearer pairs are
        then fewer than that many, and those at it are taken in the order of A's hits until there are n.
        """
        hits_a, own_a = _ranked_hits(pdf[pdf["side"] == 0])
        hits_b, own_b = _ranked_hits(pdf[pdf["side"] == 1])
        (pa, ka), (pb, kb) = [[pdf.loc[pdf["side"] == k, c].to_numpy() for c in ("pos", "letter")] for k in (0, 1)]
        most = int(np.bincount(own_a).max(initial=1)) * int(np.bincount(own_b).max(initial=1)) if len(own_a) and len(own_b) else 0
        # a hit with several letters at one place takes one seat for each
        i, j = _first_of_each(pa, own_a, n * max(most, 1)), _first_of_each(pb, own_b, n * max(most, 1))
        pa, ka, own_a, pb, kb, own_b = pa[i], ka[i], own_a[i], pb[j], kb[j], own_b[j]
        count = lambda w: int((np.searchsorted(pb, pa + w, "right") - np.searchsorted(pb, pa - w, "left")).sum())
        low, high = 0, width + 1  # the least distance with enough pairs of letters, width + 1 for none
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if count(middle) >= n * most else (middle + 1, high)
        x, y = _expand(np.searchsorted(pb, pa - (low - 1), "left"), np.searchsorted(pb, pa + (low - 1), "right")) if low else (np.zeros(0, np.int64),) * 2
        x, y, more = [x], [y], set(zip(own_a[x], own_b[y], strict=True))
        if low <= width:
            wanted = n - len(more)
            spots = sorted({-low, low})
            ranges = [(np.searchsorted(pb, pa + s, "left"), np.searchsorted(pb, pa + s, "right")) for s in spots]
            some = np.flatnonzero(sum(e - b for b, e in ranges))
            some = some[np.lexsort((ka[some], own_a[some]))]
            for rows in np.split(some, np.flatnonzero(np.diff(own_a[some])) + 1):
                if wanted <= 0:
                    break
                got = [_expand(b[rows], e[rows]) for b, e in ranges]
                left, right = rows[np.concatenate([g[0] for g in got])], np.concatenate([g[1] for g in got])
                new = [v for v in np.unique(own_b[right]) if (own_a[left[0]], v) not in more][:wanted]
                take = np.isin(own_b[right], new)
                x.append(left[take])
                y.append(right[take])
                wanted -= len(new)
        x, y = np.concatenate(x), np.concatenate(y)
        gap = np.abs(pa[x] - pb[y])
        order = np.lexsort((kb[y], ka[x], gap, own_b[y], own_a[x]))
        x, y, gap = x[order], y[order], gap[order]
        first = np.ones(len(x), bool)
        first[1:] = (own_a[x][1:] != own_a[x][:-1]) | (own_b[y][1:] != own_b[y][:-1])
        x, y, gap = x[first], y[first], gap[first]
        best = np.lexsort((own_b[y], own_a[x], gap))[:n]
        x, y, gap = x[best], y[best], gap[best]
        out = pd.concat([_flat(hits_a.iloc[own_a[x]], "a"), _flat(hits_b.iloc[own_b[y]], "b")], axis=1)
        return out.assign(distance=gap, letter_a=ka[x], letter_b=kb[y], pos_a=pa[x], pos_b=pb[y])

    return run


def _marks(hits: DataFrame, side: int, size: int, width: int) -> DataFrame:
    """Letters of hits with their block; those of the second side go to all blocks within width."""
    each = hits.select(F.lit(side).alias("side"), *_KEYS, F.posexplode("positions").alias("letter", "pos"))
    reach = width if side else 0
    return each.withColumn("block", F.explode(F.sequence(F.floor((F.col("pos") - reach) / size), F.floor((F.col("pos") + reach) / size))))


def closest_within(hits_a: DataFrame, hits_b: DataFrame, n: int, width: int) -> DataFrame:
    """The n closest pairs at most `width` apart, in order: the first rows of pairs_within, which is not worked out. Letters are shuffled once, a block yields n pairs at most."""
    size = max(STRIP, width)
    schema = _FLAT_PAIR.replace("distance long,", "distance long, letter_a int, letter_b int,")
    near = _marks(hits_a, 0, size, width).unionByName(_marks(hits_b, 1, size, width)).groupBy("block").applyInPandas(_closest(n, width), schema)
    best = F.min(F.struct("distance", "letter_a", "letter_b", "pos_a", "pos_b")).alias("best")
    each = _paired(near, "letter_a", "letter_b").groupBy("a", "b").agg(best).select("a", "b", "best.distance", "best.pos_a", "best.pos_b")
    return order_pairs(each, n)


def closest_pairs(hits_a: DataFrame, hits_b: DataFrame, n: int = 20, max_distance: int | None = None, first: int = 64) -> DataFrame:
    """The n closest pairs of hits. Without a distance the band widens until it holds n pairs, which are then the closest of all."""
    if max_distance is not None:
        return closest_within(hits_a, hits_b, n, max_distance)
    ends = [h.agg(F.count("*"), F.min(F.array_min("positions")), F.max(F.array_max("positions"))).first() for h in (hits_a, hits_b)]
    if not all(e[0] for e in ends):
        return closest_within(hits_a, hits_b, n, 1)
    wanted, span, width = min(n, ends[0][0] * ends[1][0]), max(e[2] for e in ends) - min(e[1] for e in ends), first
    while True:
        found = scratch_table(hits_a.sparkSession, closest_within(hits_a, hits_b, n, min(width, max(span, 1))), "closest")
        if width >= span or found.count() >= wanted:
            return order_pairs(found, n)
        width *= 8


def closest_region(pairs: DataFrame) -> DataFrame:
    """From, to and span of the closest pair."""
    one = order_pairs(pairs, 1)
    low, high = F.least("pos_a", "pos_b"), F.greatest("pos_a", "pos_b")
    return one.select(low.alias("region_start"), high.alias("region_end"), (high - low).alias("span"))


def proximity_summary(hits_a: DataFrame, hits_b: DataFrame) -> DataFrame:
    """hits_a, hits_b, their product and the number of intersections; an error where a side has no hits."""
    a, b = hits_a.agg(F.count("*").alias("hits_a")), hits_b.agg(F.count("*").alias("hits_b"))
    meets = intersections(hits_a, hits_b).agg(F.count("*").alias("n_intersections"))
    out = a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(meets), F.lit(True))
    checked = F.when(F.least("hits_a", "hits_b") > 0, F.col("hits_a") * F.col("hits_b")).otherwise(F.raise_error(F.lit("a term has no hits")))
    return out.select("hits_a", "hits_b", checked.cast("long").alias("pairs_compared"), "n_intersections")


def without_noise(hits: DataFrame, most: int = NOISE) -> DataFrame:
    """Hits of terms that have at most `most`."""
    quiet = hits.groupBy("stream_id", "term").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    return hits.join(quiet.select("stream_id", "term"), ["stream_id", "term"], "left_semi")


#: Places of a block whose windows are worked out together; never fewer than a window has.
SIDE = 1 << 13


def _in_blocks(column: str, size: int, reach: int, step: int) -> Column:
    """The blocks of a value: its own, and the next one (step 1) or the one before (step -1) where that one's windows of `reach` places go beyond its end."""
    own, within = F.floor(F.col(column) / size), F.pmod(column, F.lit(size))
    near = within >= size - reach if step > 0 else within <= reach
    block = lambda b, mine: F.struct(b.alias("bucket"), F.lit(mine).alias("own"))
    return F.explode(F.when(near, F.array(block(own, True), block(own + step, False))).otherwise(F.array(block(own, True)))).alias("b")


def _latest_spans(pos: np.ndarray, term: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order: for each row the first one of its window, and the last row whose window counts it as the latest of its term.

    Windows end at a row and reach `window` back. A row stands for its term from itself on until the term comes again or the window has left it, so the terms of all
    windows are counted by adding 1 where a row begins to stand and taking it off after it ends: one sort and no pass over any window.
    """
    n = len(pos)
    left = np.searchsorted(pos, pos - window, "left")
    order = np.lexsort((np.arange(n), term))
    again = np.full(n, n)
    same = term[order][1:] == term[order][:-1]
    again[order[:-1][same]] = order[1:][same]
    return left, np.minimum(again, np.searchsorted(pos, pos + window, "right")) - 1


def _sums_of_spans(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the number of spans begin .. end that hold it."""
    return np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end + 1, minlength=n + 1))[:n]


def _windows(window: int, min_terms: int):
    names = ["stream_id", "hit_id", "region_start", "region_end", "distinct_terms", "total_hits", "spread", "terms"]

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of the block before are there only as the beginning of windows."""
        pdf = pdf.sort_values(["position", "term", "skip", "direction", "hit_id"], kind="stable")
        pos, n = pdf["position"].to_numpy(), len(pdf)
        term, spelled = pd.factorize(pdf["term"], sort=True)
        left, last = _latest_spans(pos, term, window)
        distinct = _sums_of_spans(np.arange(n), last, n)
        chosen = np.flatnonzero(pdf["own"].to_numpy() & (distinct >= min_terms))
        # terms of the chosen windows, a bit for each: windows with the same ones share their list
        held = np.zeros((len(chosen), -(-len(spelled) // 8)), np.uint8)
        for t in range(len(spelled)):
            mine = np.flatnonzero(term == t)
            held[:, t // 8] |= (_sums_of_spans(mine, last[mine], n)[chosen] > 0).astype(np.uint8) << (t % 8)
        sets, which = np.unique(held, axis=0, return_inverse=True) if len(chosen) else (held, np.zeros(0, np.int64))
        lists = np.array([",".join(spelled[np.flatnonzero(np.unpackbits(x, bitorder="little")[: len(spelled)])]) for x in sets], object)
        first = pos[left[chosen]]
        columns = [key[0], pdf["hit_id"].to_numpy()[chosen], first, pos[chosen], distinct[chosen], chosen - left[chosen] + 1, pos[chosen] - first, lists[which.reshape(-1)]]
        return pd.DataFrame(dict(zip(names, columns, strict=True)), index=np.arange(len(chosen)))

    return run


def cluster_candidates(hits: DataFrame, window: int = 10_000, min_terms: int = 2) -> DataFrame:
    """For each hit by its start the hits of all terms in the `window` up to it: a candidate if they are of min_terms terms.

    Hits go to the block of their start, and to the next one where its first windows reach back to them, so a task holds a block and a window's length of
    one stream. A hit sees the earlier ones at its own start, not the later.
    """
    both = _in_blocks("start", max(SIDE, window), window, 1)
    rows = hits.select("stream_id", "term", "hit_id", "skip", "direction", F.col("start").alias("position"), both).select("*", "b.*").drop("b")
    schema = "stream_id string, hit_id long, region_start long, region_end long, distinct_terms int, total_hits int, spread long, terms string"
    return rows.groupBy("stream_id", "bucket").applyInPandas(_windows(window, min_terms), schema)


#: Windows that lie side by side in a task when regions are chosen.
BESIDE = 256


def _choose(window: int, length: int):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        """Settles what the regions of a stretch decide among themselves. Open regions beyond its ends hold back those near them that are worse."""
        pdf = pdf.sort_values(["rank", "tight", "from", "hit_id"], kind="stable")
        low = key[1] * length
        middle, kept = pdf["twice"].to_numpy(), pdf["kept"].to_numpy()
        own = (middle >= low) & (middle < low + length)
        order = np.argsort(middle, kind="stable")
        along, place = middle[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first, last = np.searchsorted(along, middle - window, "right"), np.searchsorted(along, middle + window, "left")  # of those strictly nearer than half a window
        state = np.where(kept, 2, 0)[order]  # along the line: 0 open, 1 gone, 2 kept
        for i in np.flatnonzero(kept):
            near = slice(first[i], last[i])
            state[near] = np.where(state[near] == 0, 1, state[near])
        held = np.zeros(len(order), bool)  # near an open region that another stretch decides on, or that is held itself
        for i in range(len(order)):  # from the best on
            near = slice(first[i], last[i])
            if state[place[i]] != 0:
                continue
            if own[i] and not held[place[i]]:
                state[near] = np.where(state[near] == 0, 1, state[near])
                state[place[i]] = 2
            else:
                held[near] = True
        return pdf.drop(columns="stretch").assign(kept=state[place] == 2)[own & (state[place] != 1)]

    return run


def cluster_top(candidates: DataFrame, window: int = 10_000, n: int = 10, tried: list | None = None) -> DataFrame:
    """The n best regions of each stream: most terms, then least spread, none with its middle within half a window of a better one's.

    A region is chosen as soon as it is better than all open ones near it, so regions along the line are chosen side by side: each task settles a stretch of BESIDE windows
    with half a window on either side of it, and only a chain of ever better neighbours that goes over the ends of stretches needs another round. Rounds depend
    on such chains and not on n; of regions with the same middle the best alone can be chosen, so a stretch holds two regions a letter at most. tried, if given, gets the
    number of open regions after each round.
    """
    spark = candidates.sparkSession
    spans = [F.col(c) for c in ("region_start", "region_end", "distinct_terms", "total_hits", "spread", "terms")]
    twice = (F.col("region_start") + F.col("region_end")).cast("long")  # twice the middle: near is nearer than `window` by this
    order = F.struct((-F.col("distinct_terms")).alias("rank"), F.col("spread").alias("tight"), F.col("region_start").alias("from"), "hit_id", F.struct(*spans).alias("region"))
    best = candidates.groupBy("stream_id", twice.alias("twice")).agg(F.min(order).alias("best")).select("stream_id", "twice", "best.*")
    best = scratch_table(spark, best, "best")
    length = 2 * window * BESIDE
    rest = best.drop("region").withColumn("kept", F.lit(False))  # tasks get what decides alone; the regions that are chosen are joined in the end
    schema = rest.schema
    while True:
        own = F.floor(F.col("twice") / length)
        sides = F.array_distinct(F.array(own, F.floor((F.col("twice") - window) / length), F.floor((F.col("twice") + window) / length)))
        spread = rest.withColumn("stretch", F.explode(sides))
        rest = scratch_table(spark, spread.groupBy("stream_id", "stretch").applyInPandas(_choose(window, length), schema), "regions")
        left = rest.filter("NOT kept").count()
        if tried is not None:
            tried.append(left)
        if not left:
            break
    nth = F.row_number().over(Window.partitionBy("stream_id", "part").orderBy("rank", "tight", "from", "hit_id"))
    some = rest.withColumn("part", F.pmod(F.xxhash64("hit_id"), F.lit(64))).withColumn("nth", nth).filter(F.col("nth") <= n)  # n of each part, so that no task ranks a whole stream
    some = some.withColumn("cluster", F.row_number().over(Window.partitionBy("stream_id").orderBy("rank", "tight", "from", "hit_id"))).filter(F.col("cluster") <= n)
    return best.select("stream_id", "twice", "region").join(F.broadcast(some.select("stream_id", "twice", "cluster")), ["stream_id", "twice"]).select("stream_id", "cluster", "region.*")


def cluster_detail(clusters: DataFrame, hits: DataFrame, each: int = 3) -> DataFrame:
    """Up to `each` hits of each term within each region, by start."""
    inside = hits.join(F.broadcast(clusters.select("stream_id", "cluster", "region_start", "region_end")), "stream_id").filter(F.col("start").between(F.col("region_start"), F.col("region_end")))
    rn = F.row_number().over(Window.partitionBy("stream_id", "cluster", "term").orderBy("start", "skip", "direction", "hit_id"))
    return inside.withColumn("rn", rn).filter(F.col("rn") <= each).select("stream_id", "cluster", "term", "start", "skip", "direction", "rn")


def cluster_term_counts(clusters: DataFrame, hits: DataFrame) -> DataFrame:
    inside = hits.join(F.broadcast(clusters.select("stream_id", "cluster", "region_start", "region_end")), "stream_id").filter(F.col("start").between(F.col("region_start"), F.col("region_end")))
    return inside.groupBy("stream_id", "cluster", "term").agg(F.count("*").alias("n"))


def _nearest(far: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each two terms of a block the nearest values, found by binary search among sorted ones."""
        of = {t: np.unique(v.to_numpy()) for t, v in pdf.groupby("term", sort=True)["v"]}
        terms, out = sorted(of), []
        for i, one in enumerate(terms):
            a = of[one]
            for other in terms[i + 1 :]:
                b = of[other]
                at = np.searchsorted(b, a)
                left, right = b[np.maximum(at - 1, 0)], b[np.minimum(at, len(b) - 1)]
                gap = np.minimum(np.abs(a - left), np.abs(a - right))
                k = int(gap.argmin())  # the first of equal ones has the smallest a
                if gap[k] <= far:
                    out.append((one, other, gap[k], a[k], left[k] if abs(a[k] - left[k]) == gap[k] else right[k]))
        return pd.DataFrame(out, columns=["term_a", "term_b", "distance", "a", "b"]).assign(stream_id=pdf["stream_id"].iloc[0])

    return run


def nearest_between_terms(hits: DataFrame, value: Column, far: int, block: int = 1 << 14) -> DataFrame:
    """stream_id, term_a < term_b and the closest values of theirs at most `far` apart; of equal distances the smallest values.

    Values go to their block and, within `far` of its beginning, to the one before, so any such pair meets in a block. A block yields one row for two
    terms, never their pairs; its distinct values are bounded by its length and the number of terms.
    """
    size = max(block, far + 1)
    own = F.floor(F.col("v") / size)
    points = hits.select("stream_id", "term", value.alias("v")).distinct()
    points = points.select("*", F.explode(F.filter(F.array(own, F.when(F.pmod("v", F.lit(size)) <= far, own - 1)), lambda b: b.isNotNull())).alias("block"))
    near = points.groupBy("stream_id", "block").applyInPandas(_nearest(far), "term_a string, term_b string, distance long, a long, b long, stream_id string")
    return near.groupBy("stream_id", "term_a", "term_b").agg(F.min(F.struct("distance", "a", "b")).alias("best")).select("stream_id", "term_a", "term_b", "best.*")


def shared_places(hits: DataFrame, swept: DataFrame, n: int = 5) -> DataFrame:
    """stream_id, term_a, term_b, nth, position: the first n places of term B that term A has too, for each pair of swept, in the order of B's hits by start and of their letters."""
    letters = hits.select("stream_id", "term", "start", "skip", "direction", "hit_id", F.posexplode("positions").alias("k", "position"))
    pairs = scratch_table(hits.sparkSession, swept.filter("shared > 0").select("stream_id", "term_a", "term_b"), "pairs")  # read by both sides
    sides = pairs.select("stream_id", F.col("term_a").alias("term")).distinct()
    a = letters.join(sides, ["stream_id", "term"], "left_semi").select("stream_id", F.col("term").alias("term_a"), "position").distinct()
    b = letters.withColumnRenamed("term", "term_b").join(pairs, ["stream_id", "term_b"])
    first = F.row_number().over(Window.partitionBy("stream_id", "term_a", "term_b").orderBy("start", "skip", "direction", "hit_id", "k"))
    return b.join(a, ["stream_id", "term_a", "position"], "left_semi").withColumn("nth", first).filter(F.col("nth") <= n).select("stream_id", "term_a", "term_b", "nth", "position")


#: Places of a block in which the sets of all terms are compared.
PLACES = 1 << 13


def _shared(size: int):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        """The counts of a term by place, looked up at the places of all terms: a sum for each two terms, and no row for each two letters."""
        term, spelled = pd.factorize(pdf["term"], sort=True)
        at = (pdf["position"] - key[1] * size).to_numpy()
        own = np.unique(term * size + at)  # each term's places as a set
        places, begin = own % size, np.searchsorted(own // size, np.arange(len(spelled)))
        order = np.argsort(term, kind="stable")
        of = np.split(at[order], np.searchsorted(term[order], np.arange(1, len(spelled))))
        out = []
        for j in range(1, len(spelled)):
            sums = np.add.reduceat(np.bincount(of[j], minlength=size)[places], begin)[:j]
            for i in np.flatnonzero(sums):
                out.append((key[0], spelled[i], spelled[j], sums[i]))
        return pd.DataFrame(out, columns=["stream_id", "term_a", "term_b", "shared"])

    return run


def shared_counts(hits: DataFrame, size: int = PLACES) -> DataFrame:
    """stream_id, term_a < term_b, shared: the letters of B on the set of A's places, summed over blocks of places, which yield a row for two terms at most."""
    letters = hits.select("stream_id", "term", F.explode("positions").alias("position")).withColumn("block", F.floor(F.col("position") / size))
    found = letters.groupBy("stream_id", "block").applyInPandas(_shared(size), "stream_id string, term_a string, term_b string, shared long")
    return found.groupBy("stream_id", "term_a", "term_b").agg(F.sum("shared").alias("shared"))


def sweep(hits: DataFrame, max_distance: int = 500, least: int = 4, most: int | None = NOISE) -> DataFrame:
    """All pairs of terms of a stream (of `least` letters and, unless most is None, at most `most` hits) that share letters or come within max_distance by start.

    score is 1000 a shared letter, and what the distance leaves of max_distance. shared counts B's letters on the set of A's; hits_a and hits_b are the terms' hits.
    """
    long = hits.filter(F.length("term") >= least)
    usable = (long if most is None else without_noise(long, most)).select("stream_id", "term", "start", "positions")
    usable = scratch_table(hits.sparkSession, usable, "swept")  # read by all three parts
    both = nearest_between_terms(usable, F.col("start"), max_distance).join(shared_counts(usable), ["stream_id", "term_a", "term_b"], "full")
    counts = usable.groupBy("stream_id", "term").agg(F.count("*").alias("n"))
    for side in ("a", "b"):
        both = both.join(counts.select("stream_id", F.col("term").alias(f"term_{side}"), F.col("n").alias(f"hits_{side}")), ["stream_id", f"term_{side}"])
    distance = F.coalesce("distance", F.lit(max_distance))
    score = F.coalesce("shared", F.lit(0)) * 1000 + (max_distance - distance)
    return both.select("stream_id", "term_a", "term_b", "hits_a", "hits_b", "distance", "a", "b", F.coalesce("shared", F.lit(0)).alias("shared"), score.cast("long").alias("score"))


def sweep_report(swept: DataFrame, bounded: DataFrame, n: int = 30) -> DataFrame:
    """The n best pairs with the verses in which their closest hits begin; a null where none lie within the distance."""
    return with_verses(sweep_top(swept, n), bounded, {"a": "closest_verse_a", "b": "closest_verse_b"})


def sweep_top(swept: DataFrame, n: int = 30) -> DataFrame:
    return swept.orderBy(F.desc("score"), "stream_id", "term_a", "term_b").limit(n)


def midpoint() -> Column:
    return F.element_at("positions", (F.floor(F.size("positions") / 2) + 1).cast("int"))


def closest_midpoints(hits: DataFrame, far: int = 500, n: int | None = None) -> DataFrame:
    """Pairs of terms by their closest midpoints."""
    near = nearest_between_terms(hits, midpoint(), far)
    return near.orderBy("distance", "stream_id", "term_a", "term_b").limit(n) if n else near


def _once_per_skip(width: int):
    names = ["skip", "direction"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Hits with one skip and direction are a class. For each two classes the closest letters, of equal ones those of the smallest starts.

        Pairs of letters are made where they are fewer than A's letters times B's classes; else each class of B is searched for the neighbours of all letters of A.
        """
        sides = []
        for k in (0, 1):
            t = pdf[pdf["side"] == k]
            own = t.groupby(names, sort=True).ngroup().to_numpy()
            classes = t[names].iloc[np.unique(own, return_index=True)[1]].reset_index(drop=True)
            pos, start = t["pos"].to_numpy(), t["start"].to_numpy()
            order = np.lexsort((start, own, pos))
            pos, own, start = pos[order], own[order], start[order]
            first = np.ones(len(pos), bool)  # of a class at a place the smallest start
            first[1:] = (pos[1:] != pos[:-1]) | (own[1:] != own[:-1])
            sides.append((classes, pos[first], own[first], start[first]))
        (classes_a, pa, ca, sa), (classes_b, pb, cb, sb) = sides
        many = len(classes_b)
        found = []  # columns: class of A, class of B, distance, start of A, start of B

        def keep(x, y, of_b):
            gap = np.abs(pa[x] - pb[y])
            near = gap <= width
            x, y, gap = x[near], y[near], gap[near]
            both = ca[x] * many + of_b[y]
            order = np.lexsort((sb[y], sa[x], gap, both))
            order = order[np.unique(both[order], return_index=True)[1]]
            found.append(np.stack([both[order], gap[order], sa[x][order], sb[y][order]]))

        begin, end = np.searchsorted(pb, pa - width, "left"), np.searchsorted(pb, pa + width, "right")
        if (end - begin).sum() <= len(pa) * many:
            ends = np.cumsum(end - begin)
            i = 0
            while i < len(pa):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")))
                x, y = _expand(begin[i:j], end[i:j])
                keep(x + i, y, cb)
                i = j
        else:
            of = np.argsort(ca, kind="stable")
            groups = np.searchsorted(ca[of], np.arange(len(classes_a)))
            sized = np.diff(np.append(groups, len(of)))
            for c in range(many):
                mine = np.flatnonzero(cb == c)
                place, start = pb[mine], sb[mine]
                at = np.searchsorted(place, pa)
                left, right = np.maximum(at - 1, 0), np.minimum(at, len(place) - 1)
                gap_l, gap_r = np.abs(pa - place[left]), np.abs(place[right] - pa)
                gap = np.minimum(gap_l, gap_r)
                least = np.minimum.reduceat(gap[of], groups)
                tied = of[gap[of] == np.repeat(least, sized)]
                s = np.minimum(np.where(gap_l[tied] == gap[tied], start[left[tied]], np.iinfo(np.int64).max), np.where(gap_r[tied] == gap[tied], start[right[tied]], np.iinfo(np.int64).max))
                order = np.lexsort((s, sa[tied], ca[tied]))
                order = order[np.unique(ca[tied][order], return_index=True)[1]]
                order = order[gap[tied[order]] <= width]
                t = tied[order]
                found.append(np.stack([ca[t] * many + c, gap[t], sa[t], s[order]]))
        every = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        order = np.lexsort((every[3], every[2], every[1], every[0]))
        every = every[:, order[np.unique(every[0][order], return_index=True)[1]]]
        a, b = classes_a.iloc[every[0] // max(many, 1)], classes_b.iloc[every[0] % max(many, 1)]
        out = {"skip_a": a["skip"].to_numpy(), "skip_b": b["skip"].to_numpy(), "direction_a": a["direction"].to_numpy(), "direction_b": b["direction"].to_numpy()}
        return pd.DataFrame({**out, "distance": every[1], "start_a": every[2], "start_b": every[3]})

    return run


def pairs_once_per_skip(hits_a: DataFrame, hits_b: DataFrame, width: int) -> DataFrame:
    """Of pairs with the same skips and directions the closest. Letters are shuffled once, and a block yields a row for two classes of hits; pairs of hits are not worked out."""
    size = max(STRIP, width)
    keys = ["skip_a", "skip_b", "direction_a", "direction_b"]
    schema = "skip_a int, skip_b int, direction_a string, direction_b string, distance long, start_a long, start_b long"
    marks = _marks(hits_a, 0, size, width).unionByName(_marks(hits_b, 1, size, width)).select("side", "start", "skip", "direction", "pos", "block")
    near = marks.groupBy("block").applyInPandas(_once_per_skip(width), schema)
    return near.groupBy(*keys).agg(F.min(F.struct("distance", "start_a", "start_b")).alias("best")).select(*keys, "best.*")


def _tightest(terms: tuple[str, str, str], close: int):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        """Each value of the bucket as the smallest of three: the next ones of the other two terms make the tightest three that begin there."""
        values = [np.unique(pdf.loc[pdf["nth"] == i, "m"].to_numpy()) for i in range(3)]
        found = []
        for i, low in enumerate(values):
            low = low[(low >= key[0] * close) & (low < (key[0] + 1) * close)]
            at = [np.searchsorted(v, low) for v in values]
            ok = np.all([k < len(v) for k, v in zip(at, values, strict=True)], axis=0)
            m = np.stack([v[k[ok]] for k, v in zip(at, values, strict=True)], axis=1) if ok.any() else np.zeros((0, 3), np.int64)
            found.append(m[m.max(axis=1, initial=0) - low[ok] <= close] if len(m) else m)
        m = np.concatenate(found)
        spread = m.max(axis=1, initial=0) - m.min(axis=1, initial=1 << 62) if len(m) else np.zeros(0, np.int64)
        best = np.lexsort((m[:, 2], m[:, 1], m[:, 0], spread))[:1]
        return pd.DataFrame({"m1": m[best, 0], "m2": m[best, 1], "m3": m[best, 2], "spread": spread[best]})

    return run


def triple_cluster(hits: DataFrame, terms: tuple[str, str, str], wide: int = 20_000, close: int = 15_000) -> DataFrame:
    """The tightest three midpoints, one of each term, each two at most `close` apart; wide, the first two's distance, can't be less.

    Midpoints go to their bucket of that length and to the one before, so the smallest of any such three meets the others in its bucket, which yields its best
    three alone: by binary search of each midpoint in the other terms' sorted ones, and never by their product.
    """
    if wide < close:
        raise ValueError("the first two midpoints may be as far apart as any two")
    spark = hits.sparkSession
    asked = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, nth int")
    points = hits.join(F.broadcast(asked), "term").select("nth", midpoint().cast("long").alias("m")).distinct()
    own = F.floor(F.col("m") / close)
    rows = points.select("nth", "m", F.explode(F.array(own, own - 1)).alias("bucket"))
    best = rows.groupBy("bucket").applyInPandas(_tightest(terms, close), "m1 long, m2 long, m3 long, spread long")
    return best.orderBy("spread", "m1", "m2", "m3").limit(1)


def _ahead(window: int, n: int):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        """A row stands for its term in the windows that begin after the one before of its term, and reach it."""
        pdf = pdf.sort_values(["term", "middle"], kind="stable")
        m, term = pdf["middle"].to_numpy(), pd.factorize(pdf["term"])[0]
        starts = np.unique(m[pdf["own"].to_numpy()])
        before = np.concatenate([[np.iinfo(np.int64).min // 2], np.where(term[1:] == term[:-1], m[:-1], np.iinfo(np.int64).min // 2)]) if len(m) else m
        begin, end = np.searchsorted(starts, np.maximum(before + 1, m - window)), np.searchsorted(starts, m, "right") - 1
        some = begin <= end
        along = np.sort(m)
        hits = np.searchsorted(along, starts + window, "right") - np.searchsorted(along, starts)
        out = pd.DataFrame({"stream_id": key[0], "window_start": starts, "n_terms": _sums_of_spans(begin[some], end[some], len(starts)), "n_hits": hits}, index=np.arange(len(starts)))
        return out.sort_values(["n_terms", "n_hits", "window_start"], ascending=[False, False, True]).head(n)

    return run


def mega_cluster(hits: DataFrame, window: int = 20_000, n: int = 1) -> DataFrame:
    """The windows from a midpoint on with the most terms, then the most hits, of each stream.

    A midpoint goes to its block, and to the one before where its windows reach into it; each block gives its n best windows at most.
    """
    rows = hits.select("stream_id", "term", midpoint().cast("long").alias("middle")).select("stream_id", "term", "middle", _in_blocks("middle", max(SIDE, window), window, -1)).select("*", "b.*").drop("b")
    rows = rows.groupBy("stream_id", "bucket").applyInPandas(_ahead(window, n), "stream_id string, window_start long, n_terms int, n_hits long")
    best = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("n_terms"), F.desc("n_hits"), "window_start"))
    return rows.withColumn("rn", best).filter(F.col("rn") <= n).drop("rn")
