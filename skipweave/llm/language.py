"""Language identification with a byte convolutional network, trained in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skipweave.llm.common import scratch_table, where_settled
from skipweave.llm.tokens import slices, text_buffer

#: Bytes of a window; every byte of a text lies in exactly one.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: The most labelled documents that training takes, the smallest by hash; it learns from every window of each.
SAMPLE = 4000
#: Windows of a training shard, and passes over them; the shards' weights are averaged after each.
SHARD, EPOCHS = 1 << 14, 4
BATCH = 64
LEARNING = 0.004
UNKNOWN = "und"
#: Windows that are scored at a time.
STEP = 48
#: Windows that are cut at a time.
CUT = 2048
_LETTER = r"\p{L}"


class ByteConvNet:
    """Bytes are embedded; filters of several widths slide over a window; each filter's maximum goes through a softmax.

    Filters see zeros beyond the text's end, and positions past it take no part in the maximum.
    """

    def __init__(self, classes: int, seed: int = 0, widths=WIDTHS, filters: int = FILTERS, embedding: int = EMBEDDING):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(np.prod(s[:-1]))).astype(np.float32)
        self.widths, self.filters = tuple(widths), filters
        self.p = {"e": rng.standard_normal((257, embedding)).astype(np.float32) * 0.5, "v": draw(len(widths) * filters, classes), "c": np.zeros(classes, np.float32)}
        self.p["e"][256] = 0
        for w in widths:
            self.p[f"k{w}"], self.p[f"b{w}"] = draw(w * embedding, filters), np.zeros(filters, np.float32)

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        """(windows, places, w * embedding) views of neighbouring embeddings."""
        n, length, d = x.shape
        return np.lib.stride_tricks.as_strided(x, (n, length - w + 1, w * d), x.strides, writeable=False)

    def forward(self, windows: np.ndarray, train: bool = False):
        """windows: (n, WINDOW + max width - 1) of byte values, 256 where there is no text."""
        x = self.p["e"][windows]
        n, pooled, kept = len(windows), [], []
        dead = windows[:, :WINDOW] == 256
        dead = dead if dead.any() else None
        for w in self.widths:
            cols = self._columns(np.ascontiguousarray(x), w)[:, :WINDOW]
            y = (np.ascontiguousarray(cols).reshape(n * WINDOW, -1) @ self.p[f"k{w}"]).reshape(n, WINDOW, -1)
            if dead is not None:
                y[dead] = -1e9
            best = y.argmax(axis=1) if train else None
            pooled.append(np.maximum(y.max(axis=1) + self.p[f"b{w}"], 0))
            kept.append((cols, best))
        h = np.concatenate(pooled, axis=1)
        z = h @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), h, x, kept

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        prob, h, x, kept = self.forward(windows, train=True)
        n = len(windows)
        dz = prob.copy()
        dz[np.arange(n), target] -= 1
        dz /= n
        g = {"v": h.T @ dz, "c": dz.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = (dz @ self.p["v"].T) * (h > 0)
        d = x.shape[2]
        for i, w in enumerate(self.widths):
            cols, best = kept[i]
            dy = dh[:, i * self.filters : (i + 1) * self.filters]
            picked = cols[np.arange(n)[:, None], best]  # (n, filters, w * d)
            g[f"k{w}"] = np.einsum("nf,nfk->kf", dy, picked)
            g[f"b{w}"] = dy.sum(axis=0)
            back = dy[:, :, None] * self.p[f"k{w}"].T[None]
            for j in range(w):
                at = np.take_along_axis(windows, best + j, axis=1)
                np.add.at(g["e"], at.reshape(-1), back[:, :, j * d : (j + 1) * d].reshape(-1, d))
        g["e"][256] = 0
        return g

    def train(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> ByteConvNet:
        """Adam over shuffled batches."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                pick, step = order[i : i + BATCH], step + 1
                for k, g in self.gradients(windows[pick], target[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= LEARNING * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)])

    def load(self, values: np.ndarray) -> ByteConvNet:
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = values[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size
        return self

    def arrays(self) -> dict:
        """The network as plain arrays, which any worker can load."""
        return {"widths": self.widths, "filters": self.filters, "p": self.p}

    @classmethod
    def of(cls, arrays: dict) -> ByteConvNet:
        one = cls.__new__(cls)
        one.__dict__.update(arrays, p={k: v.copy() for k, v in arrays["p"].items()})
        return one


def windows_of(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts in a row (256 past a text's end), and the text each belongs to; an empty text has none.

    The few bytes after a window are there for its last filters; a filter that begins in the next window counts there.
    """
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][doc] + nth * WINDOW
    places = begin[:, None] + np.arange(WINDOW + max(WIDTHS) - 1)
    inside = places < offsets[1:][doc][:, None]
    return np.where(inside, b[np.minimum(places, len(b) - 1)].astype(np.int16), np.int16(256)) if len(b) else np.zeros((0, places.shape[1]), np.int16), doc


def training_rows(docs: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """key, text, lang of at most `most` different labelled rows with a letter, the smallest by hash, held-out ones never.

    Rows with one id, text and language count once, and an id with many texts takes one place for each, so the bound holds for any ids.
    """
    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = named.filter("lang IS NOT NULL AND id IS NOT NULL AND crc32(id) % 4 <> 2").filter(F.col("text").rlike(_LETTER))
    labelled = labelled.withColumn("key", F.sha2(F.concat_ws("\x00", "id", "lang", "text"), 256)).select("key", "text", "lang")
    chosen = labelled.select("key").distinct().orderBy("key").limit(most)
    return labelled.join(F.broadcast(chosen), "key", "left_semi")  # at most `most` keys of 64 bytes


def _samples(batches):
    """Every window of the chosen rows."""
    wide = WINDOW + max(WIDTHS) - 1
    for batch in slices(batches, 1):
        for key, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            for first in range(0, len(raw), WINDOW * CUT):
                places = range(first, min(first + WINDOW * CUT, len(raw)), WINDOW)
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n), pa.array([k // WINDOW for k in places], pa.int64()), pa.array([raw[k : k + wide] for k in places], pa.binary()), pa.array([lang] * n)], ["key", "k", "raw", "lang"]
                )


def _local(shared, langs: list[str], epoch: int):
    """A shard's pass over its windows, from the shared weights."""
    place = {lang: i for i, lang in enumerate(langs)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "k"])
        data = np.full((len(pdf), WINDOW + max(WIDTHS) - 1), 256, np.int64)
        for i, raw in enumerate(pdf["raw"]):
            data[i, : len(raw)] = np.frombuffer(bytes(raw), np.uint8)
        net = ByteConvNet.of(shared.value).train(data, pdf["lang"].map(place).to_numpy(), epochs=1, seed=1000 * epoch + int(pdf["shard"].iloc[0]))
        values = net.flat().astype(np.float64)
        return pd.DataFrame({"slot": np.arange(len(values)), "value": values * len(pdf), "weight": float(len(pdf))})

    return run


def fit(docs: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], ByteConvNet | None]:
    """(languages, network) from all windows of at most `most` labelled rows; (none, None) without labelled rows.

    Shards of about SHARD windows train side by side, and their mean, weighted by windows, starts the next epoch: the driver holds the
    weights and the names of the languages alone, however long the texts are.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, most, id_col, text_col, lang_col).mapInArrow(_samples, "key string, k long, raw binary, lang string").distinct()
    rows = scratch_table(spark, rows, "language")
    found = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(found)
    if not langs:
        return [], None
    net = ByteConvNet(len(langs))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "k"), F.lit(max(1, round(sum(found.values()) / SHARD)))))
    for epoch in range(EPOCHS):
        local = _local(spark.sparkContext.broadcast(net.arrays()), langs, epoch)
        one = rows.groupBy("shard").applyInPandas(local, "slot long, value double, weight double")
        got = one.groupBy("slot").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow().to_pandas().sort_values("slot")
        net.load(got["value"].to_numpy())
    return langs, net


def predict_languages(
    spark: SparkSession, docs: DataFrame, model: tuple[list[str], ByteConvNet | None], keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, and the columns in keep.

    The mean of the window probabilities decides. Null texts and texts without a letter give `und` with score 0, as does a model without
    languages. Long texts are scored window by window, whole; repeated rows each on their own; an empty table gives no rows.
    held_out is false for a null id. Ids may be of any type; columns of docs that aren't named play no part.
    """
    langs, net = model
    shared = spark.sparkContext.broadcast((langs, net and net.arrays()))  # some kilobytes, whatever the corpus

    @F.pandas_udf("lang string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        names, weights = shared.value
        network = weights and ByteConvNet.of(weights)
        best, value = np.full(len(texts), -1), np.zeros(len(texts))
        if network is not None and len(texts):
            b, offsets = text_buffer(pa.array(texts, pa.string(), from_pandas=True))
            total, i = np.zeros((len(texts), len(names))), 0
            while i < len(texts):  # so many texts at a time that they have about CUT windows
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CUT * WINDOW, "right")) - 1)
                data, doc = windows_of(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(0, len(data), STEP):
                    np.add.at(total, i + doc[k : k + STEP], network.forward(data[k : k + STEP])[0])
                i = j
            count = np.maximum(total.sum(axis=1), 1e-9)
            best, value = total.argmax(axis=1), total.max(axis=1) / count
        return pd.DataFrame({"lang": [names[k] if k >= 0 else None for k in best], "score": np.clip(value, 0, 1)})

    kept = F.struct(F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    out = docs.select(kept.alias("__in"), F.col(text_col).alias("__text"))
    out = out.withColumn("__text", F.when(F.col("__text").rlike(_LETTER) & F.lit(bool(langs)), F.col("__text"))).withColumn("__found", score("__text"))
    held = F.coalesce(F.crc32(F.col("__in.doc_id").cast("string")) % 4 == 2, F.lit(False))
    has = F.col("__text").isNotNull()
    return out.select(
        "__in.doc_id",
        held.alias("held_out"),
        F.when(has, F.col("__found.lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(has, F.col("__found.score")).otherwise(F.lit(0.0)).alias("score"),
        *(F.col(f"__in.k{i}").alias(c) for i, c in enumerate(keep)),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict_languages(spark, docs.select("doc_id", "text"), fit(docs))


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with the probability `least`, with the columns of docs."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    judged = predict_languages(spark, whole, fit(docs), keep=("__row",))
    return where_settled(judged, f"lang_pred <> '{UNKNOWN}' AND score >= {least}").select(*(F.col(f"__row.{c}").alias(c) for c in docs.columns))
