"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has one bit per bit of the shingles' hashes: set where more than half of them have it set. For radius r
every bit position gets a number from 1 to 2^(r+1)-1, read as a vector over GF(2), and table v masks away the
positions whose vector has an odd product with v. At most r positions differ in a linked pair; some v other than 0
is orthogonal to all of their vectors, so the pair agrees on everything that table v keeps: no pair within the radius is missed.

Only distinct fingerprints are hashed. Buckets of a few members are compared inside. The fingerprints of larger
buckets, however large, are linked through their neighbours: with radius 2, two fingerprints are linked exactly if some value
is at distance 1 or less from both. Each fingerprint is dealt to itself and its 64 neighbours; at such a value meet at most 65
fingerprints, any two of them within the radius, so links to the least of them lose nothing and no pairs are listed.

Defined results: null text is empty and has fingerprint zero, linked like any other; a null id takes part, but is
never the smallest id; repeated rows give repeated rows; an empty table gives no rows; further columns aren't looked at.
`near_duplicates` takes ids that can be cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.lineage import cut
from undula.llm.common import map_batches, table, text_column, words
from undula.llm.components import components
from undula.llm.similar import shingle_hashes

BITS = 64


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 4096):
        part = np.ascontiguousarray(h[at : at + 4096], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprint(ws: list[bytes], size: int, seed: int) -> int:
    return majority(shingle_hashes(ws, size, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(words(t), shingle, seed) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    source = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return map_batches(source, ["doc_id", "text"], "doc_id long, fp long", rows)


def covering_masks(radius: int) -> list[int]:
    """For each table the positions that it keeps, as a signed 64-bit integer."""
    n = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, n + 1):
        kept = sum(1 << i for i in range(BITS) if (v & (i % n + 1)).bit_count() % 2 == 0)
        masks.append(kept - (1 << BITS) if kept >> (BITS - 1) else kept)
    return masks


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = 2, compared: int = 32) -> DataFrame:
    """Links a < b between distinct fingerprints (fp) that connect all within the radius. Written to the shared folder. Buckets of up to
    `compared` members are compared inside; what is in a larger one is linked through neighbour values."""
    if radius != 2:
        raise ValueError("neighbour values link exactly at radius 2 only")
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    keyed = fps.select("fp", F.posexplode(masks).alias("tab", "mask")).select("fp", "tab", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    buckets = cut(
        keyed.groupBy("tab", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"),
        "buckets",
    )
    pairs = buckets.filter((F.col("n") == 2) & (_apart(F.col("a"), F.col("b")) <= radius)).select("a", "b")
    some = buckets.filter(F.col("n").between(3, compared)).select("tab", "key")
    held = keyed.join(some, ["tab", "key"]).groupBy("tab", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))  # at most `compared`
    inside = held.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.filter("all", lambda x: (x > F.col("a")) & (_apart(x, F.col("a")) <= radius))).alias("b"))
    crowded = buckets.filter(F.col("n") > compared).select("tab", "key")
    members = keyed.join(crowded, ["tab", "key"], "left_semi").select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
    spread = members.select("fp", F.explode(near).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = spread.groupBy("value").agg(F.sort_array(F.collect_list("fp")).alias("all")).filter(F.size("all") > 1)
    stars = met.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, BITS + 1)).alias("b"))
    return cut(pairs.unionByName(inside).unionByName(stars).distinct(), "links")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of all that links reach)."""
    made = cut(fingerprints(docs, shingle, seed), "fingerprints")
    heads = made.groupBy("fp").agg(F.min("doc_id").alias("head"))
    roots = components(links(heads.select("fp"), radius))
    grouped = heads.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("head").alias("component_id"))
    named = cut(grouped.join(smallest, "root").select("fp", "component_id"), "components")
    return made.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: texts whose sets of shingles have at least the similarity (Jaccard), and chains of such.

    The fingerprints' groups are compared first, each member with its least. Texts at 0.8 differ in about ten of 64 bits, far beyond a
    radius that masks can cover, so what is left is searched exactly by prefixes of the shingle sets (near.py): no two rows that stay
    reach the similarity, and each that goes is linked, maybe over others, to one that stays and comes before it by id.

    Defined results: the row with the smallest id stays, nulls last, then by a hash of all columns; ids may be of any type with an order, be
    null or repeat, and rows that share one are told apart; null text is empty, empty texts are copies of each other; a text of
    up to `shingle` words is one shingle; rows equal in all columns are one; an empty table gives no rows; all columns stay. Columns of maps
    can't be hashed and are an error.
    """
    from undula.llm import near

    rows = near.keyed(docs)
    nodes = near.Nodes(rows, shingle, seed, Fraction(str(similarity)), id_col, text_col)
    groups = components(links(nodes.all.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    return rows.join(near.kept_nodes(nodes, groups), ["_h1", "_h2"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
