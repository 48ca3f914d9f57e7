"""Histogram gradient-boosted trees over document statistics.

The features say nothing of a document's id, source or language; they are shares and lengths of a whole text. A model
is fitted in numpy on at most `sample_rows` labelled documents, the ones with the least hash of their id, outside the held-out
fold. Values are binned by quantiles, trees grow level by level from gradient and hessian histograms, and the ensemble
is flattened into arrays of a complete binary tree each, which numpy traverses for a whole batch at once.

Defined results: null text is an empty text and gets a score as any other; null ids or labels teach nothing; of
repeated ids the row with the least features teaches, all are scored; without labels of both classes every score is the share of label 1, or 0.5
with none; an empty table gives no rows; further columns are not looked at and stay in `keep_good`. Ids are cast to long.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import map_batches, table, text_column

FEATURES = (
    "log_chars", "log_words", "chars_per_word", "longest_word", "symbols", "upper", "digits", "stops", "exclamations", "bars",
    "beyond_ascii", "spaces", "lines_per_word", "distinct_words", "repeated_neighbours", "commonest_word", "capitalised", "duplicate_lines", "marked_words", "period_words",
)
_SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"])


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    n_b, n_w = max(1, len(raw)), max(1, len(ws))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower = int(counts[0x41:0x5B].sum()), int(counts[0x61:0x7B].sum())
    distinct = {}
    for w in ws:
        distinct[w] = distinct.get(w, 0) + 1
    n_same = sum(map(operator.eq, ws, ws[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    loud = sum(1 for w in ws if w.isupper() and len(w) > 1)
    marked = sum(k for w, k in distinct.items() if w[-1] in b"#*$%&|<>!" )
    ended = sum(k for w, k in distinct.items() if w[-1] in b".,;:?")
    return [
        np.log1p(len(text)), np.log1p(len(ws)), sum(map(len, ws)) / n_w, min(200, max(map(len, ws), default=0)),
        counts[_SYMBOLS].sum() / n_b, upper / max(1, upper + lower), counts[0x30:0x3A].sum() / n_b, counts[ord(".")] / n_w, counts[ord("!")] / n_w, counts[ord("|")] / n_w,
        counts[0x80:].sum() / n_b, (counts[0x20] + counts[0x0A] + counts[0x09]) / n_b, len(lines) / n_w, len(distinct) / n_w, n_same / n_w,
        max(distinct.values(), default=0) / n_w, loud / n_w, 1 - len(set(lines)) / max(1, len(lines)), marked / n_w, ended / n_w,
    ]


class Boosted:
    """Trees of one depth as arrays: node i of a tree has children 2i+1 and 2i+2; values over `cut` go right."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 20):
        self.n_trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.base = 0.0
        self.feature = np.zeros((0, 2**depth - 1), dtype=np.int32)
        self.cut = np.zeros((0, 2**depth - 1))
        self.leaf = np.zeros((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        if not len(y):
            return self
        p = y.mean()
        self.base = float(np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))))
        if p in (0.0, 1.0):
            return self
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
        margin = np.full(n, self.base)
        inner = 2**self.depth - 1
        feats, cuts, leaves = [], [], []
        for _ in range(self.n_trees):
            prob = 1 / (1 + np.exp(-margin))
            g, h = prob - y, prob * (1 - prob)
            node = np.zeros(n, dtype=np.int64)
            feature, cut = np.zeros(inner, dtype=np.int32), np.full(inner, np.inf)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                here = node - first
                best = np.full(width, 1e-6)
                split_f, split_b = np.full(width, -1), np.zeros(width, dtype=np.int64)
                for j in range(m):
                    k = len(edges[j]) + 1
                    if k < 2:
                        continue
                    at = here * k + binned[:, j]
                    gs, hs, cs = (np.bincount(at, weights=v, minlength=width * k).reshape(width, k).cumsum(axis=1) for v in (g, h, np.ones(n)))
                    gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                    gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(cl < self.least) | (ct - cl < self.least)] = -np.inf
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(width), top]
                    better = value > best
                    best[better], split_f[better], split_b[better] = value[better], j, top[better]
                for w in np.flatnonzero(split_f >= 0):
                    feature[first + w], cut[first + w] = split_f[w], edges[split_f[w]][split_b[w]]
                right = x[np.arange(n), feature[node]] > cut[node]
                node = 2 * node + 1 + right
            at = node - inner
            gsum, hsum = np.bincount(at, weights=g, minlength=inner + 1), np.bincount(at, weights=h, minlength=inner + 1)
            leaf = -self.rate * gsum / (hsum + self.l2)
            margin += leaf[at]
            feats.append(feature), cuts.append(cut), leaves.append(leaf)
        self.feature, self.cut, self.leaf = np.array(feats), np.array(cuts), np.array(leaves)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), np.arange(len(self.leaf))[None, :]
        if not n:
            return np.zeros(0)
        node = np.zeros((n, len(self.leaf)), dtype=np.int64)
        rows = np.arange(n)[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        margin = self.base + self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def _fold(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and its features, an array of doubles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([features(t) for t in part.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    source = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return map_batches(source, ["doc_id", "text"], "doc_id long, x array<double>", rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, sample_rows: int = 20_000, **model) -> Boosted:
    """A model of label 1, from at most sample_rows labelled documents outside fold 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    known = known.filter(_fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = {r[0]: r[1] for r in sample.collect()}
    ids = docs.sparkSession.createDataFrame([(k,) for k in sorted(chosen)], "doc_id long")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    found = {r[0]: r[1] for r in document_features(some).groupBy("doc_id").agg(F.min("x")).collect()}
    order = sorted(found)
    x = np.array([found[k] for k in order]).reshape(len(order), len(FEATURES))
    y = np.array([float(chosen[k] == 1) for k in order])
    return Boosted(**model).fit(x, y)


def score(docs: DataFrame, model: Boosted, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([features(t) for t in part.column(1).to_pylist()]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.predict(x))], ["doc_id", "score"])

    source = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = map_batches(source, ["doc_id", "text"], "doc_id long, score double", rows)
    return out.select("doc_id", (_fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Boosted, threshold: float = 0.3) -> DataFrame:
    """The documents with a score of at least the threshold. All columns stay."""
    place = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([features(t or "") for t in part.column(place).to_pylist()]).reshape(-1, len(FEATURES))
                yield part.filter(pa.array(model.predict(x) >= threshold))

    return map_batches(docs, [f"`{c}`" for c in docs.columns], docs.schema, rows)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
