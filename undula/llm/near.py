"""Near copies at a similarity, exactly, among texts that are already grouped by something cheaper.

The nodes are the distinct sequences of words, numbered in the order of their ids. A round looks at pairs of nodes: odd sketches rule out
most, the texts of the others are compared exactly, and of what is linked only the least nodes stay. Stars, every member of a group
against its least, come first: they take large groups of copies out without listing their pairs. Then all pairs of the nodes that
are left and share a shingle of their prefixes are looked at, so no pair that reaches the similarity stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.lineage import cut
from undula.llm.common import map_batches, words
from undula.llm.components import components
from undula.llm.similar import differing, may_be_similar, odd_sketch, prefix, shingle_hashes, similar
from undula.llm.simhash import majority
from undula.numbering import numbered

#: Least hashes of a text by which the first stars are made.
LOW = 8
#: One text in so many is counted to find common shingles; at most COMMON of them, from LEAST occurrences there, come last in the order.
SAMPLE, LEAST, COMMON = 16, 3, 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """docs with h1 and h2, hashes over all columns of a row; rows that are equal in all of them are one row."""
    cols = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.isnull(F.col(f"`{c}`")))]
    made = docs.withColumns({"_h1": F.xxhash64(*cols), "_h2": F.xxhash64(F.lit(1), *cols)})
    twice = cut(made.groupBy("_h1", "_h2").agg(F.count("*").alias("k")).filter("k > 1").select("_h1", "_h2"), "near-repeats")
    if twice.isEmpty():
        return made
    row = F.struct(*[F.col(f"`{c}`") for c in made.columns])
    one = made.join(twice, ["_h1", "_h2"], "left_semi").groupBy("_h1", "_h2").agg(F.first(row).alias("row")).select("row.*")
    return made.join(twice, ["_h1", "_h2"], "left_anti").unionByName(cut(one, "near-one-of-repeats"))


class Nodes:
    """The distinct word sequences of keyed documents: node, h1 and h2 (of the row with the least id), n (shingles), fp, low, sketch."""

    def __init__(self, docs: DataFrame, size: int, seed: int, t: Fraction, id_col: str = "doc_id", text_col: str = "text"):
        self.size, self.seed, self.t = size, seed, t
        self.source = docs.select("_h1", "_h2", F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
        schema = T.StructType.fromDDL("_h1 long, _h2 long, sum binary, n int, fp long, low array<long>, sketch binary")
        schema.add("id", docs.schema[id_col].dataType)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    sums, n, fps, low, sketches = [], [], [], [], []
                    for text in part.column(3).to_pylist():
                        ws = words(text)
                        h = shingle_hashes(ws, size, seed)
                        own = np.unique(h)
                        sums.append(blake2b(b" ".join(ws), digest_size=16).digest())
                        n.append(len(own))
                        fps.append(majority(h))
                        low.append(own[:LOW].view(np.int64))
                        sketches.append(odd_sketch(own))
                    cols = [pa.array(sums, pa.binary()), pa.array(n, pa.int32()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(low, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols, part.column(2)], schema.names)

        read = map_batches(self.source, ["_h1", "_h2", "id", "text"], schema, rows)
        head = F.struct(F.isnull("id").alias("none"), "id", "_h1", "_h2")
        one = read.groupBy("sum").agg(F.min(head).alias("head"), F.first(F.struct("n", "fp", "low", "sketch")).alias("made")).select("head", "made.*")
        placed = numbered(one, [F.col(f"head.{c}") for c in ("none", "id", "_h1", "_h2")], out="node", name="near-texts")
        self.all = cut(placed.select("node", "head._h1", "head._h2", "n", "fp", "low", "sketch"), "near-nodes")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """node, text of the nodes."""
        heads = self.all.select("node", "_h1", "_h2").join(wanted.select("node"), "node", "left_semi")
        return self.source.join(heads, ["_h1", "_h2"]).select("node", "text")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those whose texts are similar. Written to the shared folder."""
        t, size, seed = self.t, self.size, self.seed

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = [may_be_similar(differing(x, y), p, q, t) for x, y, p, q in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = lru_cache(64)(lambda x: np.unique(shingle_hashes(words(x), size, seed)))
            for batch in batches:
                ok = [similar(known(x.as_py()), known(y.as_py()), t) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        own = lambda x: self.all.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
        both = pairs.join(own("a"), "a").join(own("b"), "b")
        close = cut(map_batches(both, ["a", "b", "sa", "sb", "na", "nb"], "a long, b long", possible), "near-close")
        wanted = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = cut(self.texts(wanted), "near-compared")
        said = close.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        return cut(map_batches(said, ["a", "b", "ta", "tb"], "a long, b long", equal), "near-links")

    def linked_away(self, pairs: DataFrame) -> DataFrame:
        """node: those that the pairs link, maybe over others, to a lesser one."""
        return components(self.links(pairs)).filter("node <> root").select("node")

    def common(self, alive: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Common shingles of a sample of the texts, sorted, and their ranks: at most COMMON of them, so a bounded broadcast."""
        size, seed = self.size, self.seed

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    sets = [np.unique(shingle_hashes(words(x), size, seed)) for x in batch.column(1).slice(at, 512).to_pylist()]
                    keys, n = np.unique(np.concatenate(sets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        some = self.texts(alive.filter(F.pmod(F.xxhash64("_h1"), F.lit(SAMPLE)) == 0))
        counted = map_batches(some, ["node", "text"], "key long, n long", rows).groupBy("key").agg(F.sum("n").alias("n"))
        top = counted.filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
        keys = top.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], top.column("n").to_numpy()[order]

    def prefixes(self, alive: DataFrame) -> DataFrame:
        """node, n, pos, key: the shingles of each prefix that another node has in its own, with their places and the set's size."""
        size, seed, t = self.size, self.seed, self.t
        shared = alive.sparkSession.sparkContext.broadcast(self.common(alive))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    sets = [np.unique(shingle_hashes(words(x), size, seed)) for x in part.column(1).to_pylist()]
                    firsts = [prefix(h, *shared.value, t) if len(h) else h for h in sets]
                    often = [len(f) for f in firsts]
                    nodes = part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), often)))
                    n = np.repeat(np.array([len(h) for h in sets], dtype=np.int32), often)
                    pos = np.concatenate([np.arange(k, dtype=np.int32) for k in often])
                    yield pa.RecordBatch.from_arrays([nodes, pa.array(n), pa.array(pos), pa.array(np.concatenate(firsts).view(np.int64))], ["node", "n", "pos", "key"])

        every = map_batches(self.texts(alive), ["node", "text"], "node long, n int, pos int, key long", rows)
        return cut(every.withColumn("k", F.count("*").over(Window.partitionBy("key"))).filter("k > 1").drop("k"), "near-prefixes")


def stars(rows: DataFrame, key: str = "key") -> DataFrame:
    """Pairs (a, b) of the least node of each key and every other node of it. rows: node and the key."""
    least = rows.groupBy(key).agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select(key, "a")
    return rows.join(least, key).filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def _possible(a: str, b: str, t: Fraction) -> Column:
    """Whether sizes and places allow the similarity, if the shingle is the first that the sets share."""
    na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (rest * (t.numerator + t.denominator) >= (na + nb) * t.numerator) & (F.least(na, nb) * t.denominator >= F.greatest(na, nb) * t.numerator)


def meeting(rows: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) of nodes that share a key of their prefixes and may be similar by their sizes and places."""
    met = rows.alias("x").join(rows.alias("y"), "key").filter(F.col("x.node") < F.col("y.node")).filter(_possible("x", "y", t))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def kept_nodes(nodes: Nodes, groups: DataFrame) -> DataFrame:
    """The nodes that stay. groups: fp and root, the groups of fingerprints with more than one member."""
    by_fp = nodes.all.select("node", "fp").join(groups, "fp", "left").select("node", F.coalesce("root", "fp").alias("key"))
    gone = cut(nodes.linked_away(stars(by_fp)), "near-gone")
    alive = nodes.all.join(gone, "node", "left_anti")
    gone = cut(gone.unionByName(nodes.linked_away(stars(alive.select("node", F.explode("low").alias("key"))))), "near-gone")
    alive = nodes.all.join(gone, "node", "left_anti")
    rows = nodes.prefixes(alive)
    more = cut(nodes.linked_away(stars(rows)), "near-gone")
    last = nodes.linked_away(meeting(rows.join(more, "node", "left_anti"), nodes.t))
    return alive.join(more.unionByName(last), "node", "left_anti").select("_h1", "_h2")
