"""A content-addressed store of token ids.

A document's ids, with the end id, are cut into chunks where a rolling hash of the last ids has its high bits zero, within
a least and a greatest size. A chunk's name is the BLAKE2b-128 digest of its bytes (little-endian, two bytes an id where
the vocabulary allows, else four). The store is a folder of tables:

    objects/    key, ids: every distinct chunk once, by name; beside them the recipes as they were made; bucketed by key
    recipes/    doc_id, part, first, n_tokens, leaves, root: documents in ascending doc_id; leaves are the names of a document's
                chunks in order, root their Merkle root, first the number of ids in all documents before it
    manifest/   per part of the recipes (level 1), and per 1,024 rows of the level below: documents, ids, Merkle root
    format/     one row: buckets, bytes an id, ids a part

Bytes cross the network once when written. Chunks that a task has already sent are not sent again, so a chunk that a
third of all documents share comes about once from each task. Reading asks for each chunk once per part, joins on
the buckets without moving or sorting the objects, and puts the documents of a part together, checking every root on the way.

Defined results: null text is empty and is its end id alone; null ids come first; repeated rows are documents of their own,
in the order of their roots; an empty table gives an empty store; further columns are not looked at. Ids are cast to long. Names of
special tokens in a text are these tokens, as the library has it, or ordinary text with `special_as_text`.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.lineage import cut, new_path
from undula.llm import tokens
from undula.llm.common import map_batches, ship, table, text_column

_NAME = 16


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=_NAME, person=b"chunk").digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary Merkle tree over names; an odd node moves up as it is; inner nodes are hashed apart from chunks."""
    level = leaves or [name_of(b"")]
    while len(level) > 1:
        level = [hashlib.blake2b(level[i] + level[i + 1], digest_size=_NAME, person=b"node").digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def marks(ids: np.ndarray, bits: int, span: int = 4, block: int = 32_768) -> list[int]:
    """Where chunks may end: behind ids at which the rolling hash of the last `span` of them has its `bits` highest bits zero. Blocks stay
    in the processor's cache."""
    found: list[int] = []
    with np.errstate(over="ignore"):
        factors = [np.uint64(0xD6E8FEB86659FD93) ** np.uint64(k + 1) for k in range(span)]
        for at in range(0, len(ids), block):
            low = max(0, at - span + 1)
            mixed = (ids[low : at + block].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
            h = mixed * factors[0]
            for k in range(1, min(span, len(mixed))):
                h[k:] += mixed[: len(mixed) - k] * factors[k]
            found += (np.flatnonzero((h[at - low :] >> np.uint64(64 - bits)) == 0) + at + 1).tolist()
    return found


def boundaries(at: list[int], start: int, stop: int, least: int, greatest: int) -> list[int]:
    """Ends of the chunks of the ids from start to stop, at the marks; they depend on nearby ids alone, so equal passages get equal chunks."""
    ends, i = [], 0
    i = bisect_left(at, start + least)
    while stop - start > least:
        i = bisect_left(at, start + least, i)
        start = min(at[i] if i < len(at) else stop, start + greatest, stop)
        ends.append(start)
    if start < stop:
        ends.append(stop)
    return ends


def _objects_schema() -> str:
    return "key binary, ids binary, doc_id long, n_tokens long, leaves array<binary>, root binary"


def _let_go(spark: SparkSession) -> None:
    """Asks for a collection, by which Spark's cleaner finds the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_store(docs: DataFrame, path: str, end_id: int = 0, vocabulary: str | None = None, width: int = 2, least: int = 128, bits: int = 9, greatest: int = 4096, part_tokens: int = 2_000_000, bucket_bytes: int = 64_000_000, special_as_text: bool = False) -> str:
    """Writes the store to path. width: bytes an id. There are as many buckets as shuffle partitions, or one for bucket_bytes of text if that
    is more."""
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.default_vocabulary()
    kind = {2: "<u2", 4: "<u4"}[width]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        task, n_docs = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids, sizes in tokens.encode_column(batch.column(1), vocabulary, special_as_text, end_id):
                if width == 2 and ids.max() > 0xFFFF:
                    raise ValueError("an id doesn't fit into two bytes")
                places, data = marks(ids, bits), memoryview(ids.astype(kind).tobytes())
                keys, chunks, recipes, start = [], [], [], 0
                for doc_id, n in zip(doc_ids[at : at + len(sizes)], sizes.tolist(), strict=True):
                    leaves, here = [], start
                    for stop in boundaries(places, start, start + n, least, greatest):
                        chunk = data[here * width : stop * width]
                        leaves.append(name := name_of(chunk))
                        if name not in sent:
                            sent.add(name)
                            keys.append(name)
                            chunks.append(chunk)
                        here = stop
                    start += n
                    n_docs += 1
                    recipes.append((name_of(b"recipe %d %d" % (task, n_docs)), doc_id, n, leaves, merkle(leaves)))
                if len(sent) > 100_000:
                    sent.clear()
                none = len(keys)
                cols = list(zip(*recipes, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*keys, *cols[0]], pa.binary()), pa.array([*chunks, *[None] * len(recipes)], pa.binary()), pa.array([*[None] * none, *cols[1]], pa.int64()),
                        pa.array([*[None] * none, *cols[2]], pa.int64()), pa.array([*[None] * none, *cols[3]], pa.list_(pa.binary())), pa.array([*[None] * none, *cols[4]], pa.binary()),
                    ],
                    ["key", "ids", "doc_id", "n_tokens", "leaves", "root"],
                )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for key in batch.column(0).to_pylist():
                keep.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(keep))

    source = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes), 1)
    objects = map_batches(source, ["doc_id", "text"], _objects_schema(), rows)
    # One shuffle carries chunks and recipes; each task holds all that may equal one another, whose names fit as buckets follow the input.
    dealt = objects.repartition(buckets, "key").mapInArrow(once, _objects_schema())
    name = f"undula_objects_{uuid.uuid4().hex}"
    dealt.write.bucketBy(buckets, "key").option("compression", "snappy").option("path", f"{path}/objects").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    del dealt, objects
    _let_go(spark)
    spark.createDataFrame([(buckets, width, part_tokens)], "buckets int, width int, part_tokens long").coalesce(1).write.parquet(f"{path}/format")

    recipes = spark.read.schema(_objects_schema()).parquet(f"{path}/objects").filter(F.col("leaves").isNotNull()).select("doc_id", "n_tokens", "leaves", "root")
    order = [F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("n_tokens")]
    ranged = cut(recipes.repartitionByRange(*order).withColumn("at", F.spark_partition_id()), "recipe-ranges")
    before, total = [], 0
    for r in sorted(ranged.groupBy("at").agg(F.sum("n_tokens").alias("n")).collect()):  # a row per partition
        before.append((r["at"], total))
        total += r["n"]
    base = F.broadcast(spark.createDataFrame(before, "at int, base long"))
    w = Window.partitionBy("at").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(base, "at").withColumn("first", F.col("base") + F.sum("n_tokens").over(w) - F.col("n_tokens"))
    placed = placed.withColumn("part", F.floor(F.col("first") / part_tokens).cast("long"))
    placed.select("doc_id", "part", "first", "n_tokens", "leaves", "root").repartitionByRange("first").sortWithinPartitions("first").write.option("compression", "zstd").parquet(f"{path}/recipes")

    level = spark.read.parquet(f"{path}/recipes").select(F.lit(0).alias("level"), "part", F.col("first").alias("at"), "root", F.lit(1).cast("long").alias("n_docs"), "n_tokens")
    written = None
    for k in range(1, 12):
        level = cut(_roots(level, k), "manifest")
        written = level if written is None else written.unionByName(level)
        if level.count() <= 1:
            break
        level = level.withColumn("at", F.col("part")).withColumn("part", F.floor(F.col("part") / 1024).cast("long"))
    written.write.parquet(f"{path}/manifest")
    return path


def _roots(level: DataFrame, k: int) -> DataFrame:
    """One row per part: the Merkle root over its rows in order, and their sums."""

    def root(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        found = merkle(t.column("root").to_pylist())
        n = [pc.sum(t.column(c)).as_py() for c in ("n_docs", "n_tokens")]
        return pa.table({"level": pa.array([k], pa.int32()), "part": t.column("part").slice(0, 1), "root": pa.array([found], pa.binary()), "n_docs": pa.array([n[0]], pa.int64()), "n_tokens": pa.array([n[1]], pa.int64())})

    ship(level.sparkSession)
    return level.groupBy("part").applyInArrow(root, "level int, part long, root binary, n_docs long, n_tokens long")


def _objects(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The object table with its buckets, whichever session wrote it."""
    name = f"undula_read_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (key BINARY, ids BINARY, doc_id BIGINT, n_tokens BIGINT, leaves ARRAY<BINARY>, root BINARY) USING parquet CLUSTERED BY (key) INTO {buckets} BUCKETS LOCATION '{path}/objects'")
    made = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the plan has what it needs, and the files stay
    return made


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, first, n_tokens, ids (little-endian uint32), read from the files; a wrong chunk, recipe or root is an error."""
    said = spark.read.parquet(f"{path}/format").first()
    kind = {2: "<u2", 4: "<u4"}[said["width"]]
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = _objects(spark, path, said["buckets"]).filter(F.col("ids").isNotNull()).select("key", "ids")
    asked = spark.read.parquet(f"{path}/recipes").select("part", F.explode("leaves").alias("key")).distinct()
    sent = chunks.join(asked.hint("shuffle_hash"), "key").select("part", "key", "ids")
    roots = spark.read.parquet(f"{path}/manifest").filter("level = 1").select("part", F.col("root").alias("part_root"))

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {}
        for key, ids in zip(right.column("key").to_pylist(), right.column("ids").to_pylist(), strict=True):
            if name_of(ids) != key:
                raise ValueError("a chunk differs from its name")
            found[key] = ids
        left = left.sort_by("first")
        if left.num_rows and merkle(left.column("root").to_pylist()) != left.column("part_root")[0].as_py():
            raise ValueError("a part differs from the manifest")
        texts = []
        for leaves, root in zip(left.column("leaves").to_pylist(), left.column("root").to_pylist(), strict=True):
            if merkle(leaves) != root:
                raise ValueError("a recipe differs from its root")
            texts.append(np.frombuffer(b"".join([found[x] for x in leaves]), dtype=kind).astype("<u4").tobytes())
        sizes = pa.array([len(x) // 4 for x in texts], pa.int64())
        return pa.table({"doc_id": left.column("doc_id"), "first": left.column("first"), "n_tokens": sizes, "ids": pa.array(texts, pa.binary())})

    ship(spark)
    left = recipes.join(roots, "part").groupBy("part")
    return left.cogroup(sent.groupBy("part")).applyInArrow(together, "doc_id long, first long, n_tokens long, ids binary")


def digests(read: DataFrame) -> DataFrame:
    return read.select("doc_id", F.col("first").alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_store(spark, sf_dir: str) -> DataFrame:
    path = write_store(table(spark, sf_dir, "documents"), new_path(spark, "store"))
    return digests(read_store(spark, path))
