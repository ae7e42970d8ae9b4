"""Language identification with a convolutional network over bytes, trained here in numpy.

A text's UTF-8 bytes are cut into windows of fixed length, the last one filled with zeros. Byte vectors run
through filters of several widths, each filter keeps its largest answer in the window, and a softmax layer
turns these into a probability for each language. A text's probabilities are those of its windows, weighted
by their bytes; all windows of a text count, whatever its length.

Training uses a bounded sample of labelled rows. For prediction the learned filters are turned into tables
over byte pairs, so that a window costs a few table look-ups instead of matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNDETERMINED = "und"
BROADCAST_LABELS = 100_000


@dataclass(frozen=True)
class Conf:
    window: int = 256  # bytes
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16  # of each width
    vector: int = 8  # numbers for each byte
    rows_per_language: int = 500  # bound of the training sample
    sample_rows: int = 20_000  # bound over all labels; each of them has a row at least
    windows_per_row: int = 4  # spread evenly over the row's text
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


class ByteNet:
    """Parameters, training and prediction of the network."""

    def __init__(self, langs: list[str], conf: Conf = Conf()):
        self.langs, self.conf = langs, conf
        r = np.random.default_rng(conf.seed)
        d, f = conf.vector, conf.filters
        self.embed = r.normal(0, 0.5, (256, d)).astype(np.float32)
        self.embed[0] = 0
        self.kernels = [r.normal(0, 1 / np.sqrt(w * d), (w * d, f)).astype(np.float32) for w in conf.widths]
        self.biases = [np.zeros(f, np.float32) for _ in conf.widths]
        self.out = r.normal(0, 0.1, (f * len(conf.widths), len(langs))).astype(np.float32)
        self.shift = np.zeros(len(langs), np.float32)
        self._tables = None

    def fit(self, windows: np.ndarray, labels: np.ndarray) -> ByteNet:
        """windows: uint8 (n, window); labels: numbers of languages. Adam on cross-entropy, classes weighted alike."""
        c, r = self.conf, np.random.default_rng(self.conf.seed + 1)
        params = [self.embed, *self.kernels, *self.biases, self.out, self.shift]
        mean, var, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = (len(labels) / np.maximum(1, np.bincount(labels, minlength=len(self.langs))) / len(self.langs)).astype(np.float32)
        for _ in range(c.epochs):
            order = r.permutation(len(labels))
            for at in range(0, len(order), c.batch):
                some = order[at : at + c.batch]
                x = windows[some]
                if r.random() < 0.5:  # short texts must work as well
                    x = x.copy()
                    x[:, int(r.integers(8, c.window)) :] = 0
                grads = self._gradients(x, labels[some], weight[labels[some]])
                step += 1
                for p, g, m, v in zip(params, grads, mean, var, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= c.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self._tables = None
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the mean weighted cross-entropy, in the order of the parameters in ``fit``."""
        c, n = self.conf, len(x)
        pooled, places = [], []
        for w, k, b in zip(c.widths, self.kernels, self.biases, strict=True):
            last = c.window - w + 1
            parts = [self.embed @ k[i * c.vector : (i + 1) * c.vector] for i in range(w)]  # a filter's answer to each byte
            z = parts[0][x[:, :last]]
            for i, part in enumerate(parts[1:], 1):
                z += part[x[:, i : i + last]]
            at = z.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + b)
        h = np.concatenate(pooled, axis=1)
        act = np.maximum(h, 0)
        p = _softmax(act @ self.out + self.shift)
        p[np.arange(n), y] -= 1
        p *= weight[:, None] / n
        g_out, g_shift = act.T @ p, p.sum(axis=0)
        g_h = (p @ self.out.T) * (h > 0)
        g_k, g_b, bytes_, backs = [], [], [], []
        rows = np.arange(n)[:, None, None]
        for i, (w, k) in enumerate(zip(c.widths, self.kernels, strict=True)):
            g = g_h[:, i * c.filters : (i + 1) * c.filters]  # n, f; only the largest answers pass gradients on
            seen = x[rows, places[i][:, :, None] + np.arange(w)]  # n, f, w
            g_k.append(np.einsum("nf,nfk->kf", g, self.embed[seen].reshape(n, c.filters, -1), optimize=True))
            g_b.append(g.sum(axis=0))
            backs.append((g[:, :, None] * k.T[None]).reshape(-1, c.vector))
            bytes_.append(seen.ravel())
        at, back = np.concatenate(bytes_), np.concatenate(backs)
        g_embed = np.stack([np.bincount(at, back[:, d], minlength=256) for d in range(c.vector)], axis=1).astype(self.embed.dtype)
        g_embed[0] = 0  # filling stays without weight
        return [g_embed, *g_k, *g_b, g_out, g_shift]

    def _compiled(self):
        """Filters as int16 tables over byte pairs (and single bytes for an odd width), with their common scale."""
        if self._tables is None:
            d, pairs = self.conf.vector, np.arange(65536)
            tables = []
            for w, k in zip(self.conf.widths, self.kernels, strict=True):
                one = [self.embed @ k[i * d : (i + 1) * d] for i in range(w)]
                parts = [one[i][pairs >> 8] + one[i + 1][pairs & 255] for i in range(0, w - 1, 2)]
                tables.append(parts + ([one[-1]] if w % 2 else []))
            top = max(float(np.abs(t).max()) for ts in tables for t in ts) * max(len(t) for t in tables)
            scale = 32000 / max(top, 1e-6)
            self._tables = [[np.round(t * scale).astype(np.int16) for t in ts] for ts in tables], scale
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, languages) for uint8 windows; a block of windows at a time, so that it stays in the cache.

        A window's numbers don't depend on those it comes with, down to the last bit: however a table is cut into
        batches, as it is anew when executors are lost, scores agree.
        """
        tables, scale = self._compiled()
        n, size = windows.shape
        z_all, bias = np.empty((n, len(self.langs)), np.float32), np.concatenate(self.biases)
        for at in range(0, n, 64):
            x = np.ascontiguousarray(windows[at : at + 64].T)  # place, window: the largest is taken over the first axis
            pairs = (x[:-1].astype(np.uint16) << 8) | x[1:]
            h = np.empty((x.shape[1], len(tables) * self.conf.filters), np.float32)
            for i, (w, parts) in enumerate(zip(self.conf.widths, tables, strict=True)):
                last = size - w + 1
                z = parts[0][pairs[:last]]
                for j, t in enumerate(parts[1:], 1):
                    z += t[(pairs if 2 * j + 1 < w else x)[2 * j : 2 * j + last]]
                h[:, i * self.conf.filters : (i + 1) * self.conf.filters] = z.max(axis=0)
            h = np.maximum(h / np.float32(scale) + bias, 0)
            # sums filter by filter: a matrix product's rounding may follow its shape
            z_all[at : at + 64] = np.add.reduce(h[:, :, None] * self.out, axis=1) + self.shift
        return _softmax(z_all)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the text of each, and its bytes."""
    counts = np.array([max(1, -(-len(t) // size)) for t in texts], np.int64)
    data = b"".join(t.ljust(int(n) * size, b"\0") for t, n in zip(texts, counts, strict=True))
    owner = np.repeat(np.arange(len(texts)), counts)
    used = np.full(len(owner), size, np.int64)
    used[np.cumsum(counts) - 1] = [max(1, len(t) - (int(n) - 1) * size) for t, n in zip(texts, counts, strict=True)]
    return np.frombuffer(data, np.uint8).reshape(-1, size), owner, used


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: the remainder of crc32 of the id's digits by 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, conf: Conf = Conf()) -> list[tuple[str, list[str]]]:
    """(lang, pieces of text) of rows with text and lang that aren't held out; equal rows count once.

    Every label is there, with as many rows as ``rows_per_language`` and ``sample_rows`` allow, chosen by hash of
    id and text; a row gives ``windows_per_row`` pieces, spread evenly. Rows without an id take part.
    """
    n, size = conf.windows_per_row, conf.window
    room = F.greatest(F.length("text") - size, F.lit(0))
    cuts = F.array(*(F.substring("text", (room * k / max(1, n - 1)).cast("int") + 1, F.lit(size)) for k in range(n)))
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    # a number for each label, as the network itself has a column for each
    known = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()
    if not known:
        return []
    most = max(1, min(conf.rows_per_language, conf.sample_rows // len(known)))
    # the least hashes of each label, first thinned to some times as many, so no task ranks more whatever the input
    limits = docs.sparkSession.createDataFrame([(r.lang, 4.0 * most / max(1, r.n)) for r in known], "lang string, share double")
    limits = F.broadcast(limits) if len(known) <= BROADCAST_LABELS else limits
    thin = rows.join(limits, "lang").where(F.col("key").cast("double") / 2.0**64 + 0.5 < F.col("share"))
    each = thin.select("lang", "key", cuts.alias("cuts")).groupBy("lang", "key").agg(F.min("cuts").alias("cuts"))  # copies of a row: partial aggregates
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("place") <= most)
    return sorted((r.lang, r.cuts) for r in ranked.select("lang", "cuts").collect())


def train(docs: DataFrame, conf: Conf = Conf()) -> ByteNet | None:
    """Learn from a bounded sample of labelled rows, see ``sampled``; it is all that reaches the driver. None if there are none."""
    sample = sampled(docs, conf)
    if not sample:
        return None
    langs = sorted({lang for lang, _ in sample})
    number = {lang: k for k, lang in enumerate(langs)}
    texts = [(x.encode("utf-8", "surrogatepass")[: conf.window], number[lang]) for lang, cuts in sample for x in dict.fromkeys(cuts)]
    windows, _, _ = _windows([t for t, _ in texts], conf.window)
    return ByteNet(langs, conf).fit(windows, np.array([y for _, y in texts]))


def predict(texts: Column, net: ByteNet | None) -> Column:
    """A struct (lang, score) for each text; ``und`` and 0 for null, for no letter, or if nothing was learned."""
    langs = net.langs if net else []

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [("und", 0.0)] * len(batch)
            if net is not None:
                for k, lang, score in _scored(batch):
                    found[k] = (lang, score)
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([float(s) for _, s in found], pa.float64())], names=["lang", "score"])

    def _scored(batch):
        part, held = [], 0
        for k, value in enumerate(batch):  # a few MB of text at a time
            text = value.as_py()
            if has_letter(text):
                part.append((k, text.encode("utf-8", "surrogatepass")))
                held += len(part[-1][1])
            if part and (held >= 2 << 20 or k + 1 == len(batch)):
                yield from _best(part)
                part, held = [], 0

    def _best(part):
        windows, owner, used = _windows([t for _, t in part], net.conf.window)
        p = net.probabilities(windows) * used[:, None]
        ends = np.flatnonzero(np.append(np.diff(owner), 1))
        sums = np.add.reduceat(p, np.concatenate(([0], ends[:-1] + 1)), axis=0)
        sums /= sums.sum(axis=1, keepdims=True)
        best = sums.argmax(axis=1)
        for (k, _), b, row in zip(part, best, sums, strict=True):
            yield k, langs[b], min(1.0, float(row[b]))

    from pyspark.sql.functions import arrow_udf

    return arrow_udf(run, "lang string, score double")(texts)


def identify(docs: DataFrame, net: ByteNet | None = None, conf: Conf = Conf()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; trains on ``docs`` unless a net is given.

    lang, source and doc_id play no part in a prediction. Repeated rows are predicted alike; an empty table
    gives no rows. A null doc_id isn't held out. Null and empty texts, and those without a letter, are ``und``
    with score 0. Of very long texts all windows count.
    """
    net = net or train(docs, conf)
    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), net).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def accepted(docs: DataFrame, least_score: float = 0.5, net: ByteNet | None = None, conf: Conf = Conf()) -> DataFrame:
    """Rows of ``docs`` with a determined language of at least that score; their columns stay as they are.

    Null and empty texts, and those without a letter, go. Repeated rows stay or go together; nothing to learn
    from: all go; an empty table gives no rows.
    """
    net = net or train(docs, conf)
    p = predict(F.col("text"), net)
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), p.alias("p"))
    return kept.where((F.col("p.lang") != UNDETERMINED) & (F.col("p.score") >= least_score)).select(*(F.col(f"row.`{c}`") for c in docs.columns))
