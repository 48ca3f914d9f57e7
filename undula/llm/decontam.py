"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Words are lower-cased runs of letters, digits and everything beyond ASCII. An item's windows are its runs of `n`
consecutive words; an item with fewer words is one window, one without words is none. Documents are scanned window by window and each
hit of a window's hash is verified word by word. Only benchmark texts of at most `block_chars` characters are broadcast at a
time, of which a worker makes about 16 bytes a word, once; a larger benchmark is dealt into blocks by a hash, each of which is held
against all documents: the hits of the blocks before go along with each row, so rows need no id, and passages are cut once
all blocks have been seen.

Defined results: null text has no words; null benchmark texts give no window; repeated items count as items of
their own, with the same id once; an empty benchmark leaves every document clean; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.lineage import cut
from undula.llm.common import map_batches, table, text_column

#: Bytes that separate words, after lower-casing A-Z.
_BREAKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: The same words in the text itself, for their places.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_words long, hits array<struct<first:long,last:long>>, items array<string>"


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BREAKS).split()


class WindowSet:
    """The windows of some items, in columns: words have small numbers, and for each length of window there are sorted hashes, where a
    window begins among the items' words, and whose it is. A window of an item is kept once: about 16 bytes each."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.numbers: dict[bytes, int] = {}
        self.names = [item_id for item_id, _ in items]
        words, ends = array("I"), []
        for _, text in items:
            words.extend([self.numbers.setdefault(w, len(self.numbers) + 1) for w in item_words(text)])
            ends.append(len(words))
        self.words = np.array(words, dtype=np.uint64)
        stops = np.array(ends, dtype=np.int64)
        starts = np.concatenate(([0], stops[:-1])).astype(np.int64)
        sizes = np.minimum(stops - starts, n)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            often = (stops - starts)[own] - size + 1
            item = np.repeat(own, often)
            at = np.arange(len(item)) + np.repeat(starts[own] - (np.cumsum(often) - often), often)
            h = self._hashes(self.words, size)[at]
            order = np.lexsort((at, item, h))
            h, at, item = h[order], at[order], item[order]
            same = (h[1:] == h[:-1]) & (item[1:] == item[:-1])
            for k in range(size):
                same &= self.words[at[1:] + k] == self.words[at[:-1] + k]
            keep = np.concatenate(([True], ~same))
            self.by_size[size] = h[keep], at[keep], item[keep]

    @staticmethod
    def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
        """Of each run of `size` numbers, by Horner's rule modulo 2^64."""
        out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = out * _FACTOR + ids[k : k + len(out)]
        return out ^ (out >> np.uint64(29))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans (end exclusive, merged) inside windows that occur, and the items these are of."""
        get = self.numbers.get
        ids = np.array([get(w, 0) for w in words], dtype=np.uint64)
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        spans: list[tuple[int, int]] = []
        owners: set[int] = set()
        for size, (keys, at, item) in self.by_size.items():
            if len(ids) < size:
                continue
            full = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(full):
                continue
            h = self._hashes(ids, size)[full]
            low, high = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            seen: set[tuple[int, ...]] = set()
            for i, a, b in zip(full[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                here = ids[i : i + size]
                if (window := tuple(here.tolist())) in seen:
                    spans.append((i, i + size))
                    continue
                found = [k for k in range(a, b) if np.array_equal(self.words[at[k] : at[k] + size], here)]
                if found:
                    seen.add(window)
                    spans.append((i, i + size))
                    owners.update(item[found].tolist())
        return merge_spans(spans), {self.names[k] for k in owners}


#: The windows that this process has built last, by the name of their block.
_built: list[tuple[str, WindowSet]] = []


def _windows(name: str, shared, n: int) -> WindowSet:
    if not _built or _built[0][0] != name:
        _built[:] = [(name, WindowSet(shared.value, n))]
    return _built[0][1]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def benchmark_blocks(benchmark: DataFrame, block_chars: int, n: int) -> list[DataFrame]:
    """The benchmark's words in blocks of about block_chars characters at most; one block if it has no more in all. A text over an eighth of
    that is dealt in pieces which overlap by n - 1 words, so that each of its windows is in one."""
    piece = max(block_chars // 8, 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = [w.decode("utf-8", "replace") for w in item_words(text)]
                step = len(ws)
                if len(text) > piece:
                    step = max(n, piece * len(ws) // len(text))
                for at in range(0, max(1, len(ws) - n + 1 if step < len(ws) else 1), max(1, step)):
                    ids.append(item_id)
                    texts.append(" ".join(ws[at : at + step + n - 1] if step < len(ws) else ws))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["item_id", "text"])

    source = text_column(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"))
    items = map_batches(source, ["item_id", "text"], "item_id string, text string", rows).filter(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= block_chars:
        return [items] if total else []
    k = -(-total // block_chars) * 2
    items = cut(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(k))), "benchmark-words")
    return [items.filter(F.col("block") == i).drop("block") for i in range(k)]


def _shared(block: DataFrame) -> tuple[str, object]:
    """A name for the block's windows, and its words, broadcast; their size is bounded by block_chars."""
    return uuid.uuid4().hex, block.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in block.collect()])


_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scan_blocks(rows_in: DataFrame, blocks: list[DataFrame], n: int) -> DataFrame:
    """Active rows (text, hits, items, active; further columns stay) with what the blocks hit added."""
    out = rows_in
    for block in blocks:
        name, shared = _shared(block)

        def rows(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            windows = _windows(name, shared, n)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    names = part.schema.names
                    text, hits, items, active = (part.column(names.index(c)).to_pylist() for c in ("text", "hits", "items", "active"))
                    for i, live in enumerate(active):
                        if live:
                            spans, owners = windows.scan(item_words(text[i]))
                            merged = merge_spans([*((h["first"], h["last"]) for h in hits[i]), *spans])
                            hits[i], items[i] = [{"first": a, "last": b} for a, b in merged], sorted(owners.union(items[i]))
                    cols = part.columns
                    cols[names.index("hits")], cols[names.index("items")] = pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        out = map_batches(out, out.columns, out.schema, rows)
        if len(blocks) > 1:  # one set of windows in a worker at a time
            out = cut(out, "decontam-hits")
    return out


def _unseen(docs: DataFrame, *columns) -> DataFrame:
    empty = F.from_json(F.lit("[]"), "array<struct<first:long,last:long>>")
    return docs.select(*columns, empty.alias("hits"), F.array().cast("array<string>").alias("items"), F.lit(True).alias("active"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_chars: int = 8_000_000) -> DataFrame:
    """Per document: its number of words, the word spans that are hit (end exclusive), and the items found, sorted."""
    docs = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = _scan_blocks(_unseen(docs, "doc_id", "text"), benchmark_blocks(benchmark, block_chars, n), n)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes = pa.array([len(item_words(t)) for t in part.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, part.column(2), part.column(3)], ["doc_id", "n_words", "hits", "items"])

    return map_batches(found, ["doc_id", "text", "hits", "items"], SCHEMA, rows)


def digest(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["last"] - h["first"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def clean_text(text: str, windows: WindowSet) -> tuple[str, int]:
    """The text without hit spans, and how many words went. Words that come together are looked at again, until nothing is hit."""
    gone = 0
    while True:
        spans, _ = windows.scan(item_words(text))
        if not spans:
            return text, gone
        gone += sum(b - a for a, b in spans)
        text = cut_spans(text, spans)


def _remove_by_blocks(docs: DataFrame, blocks: list[DataFrame], n: int, drop_share: float) -> DataFrame:
    """As clean_text does it, with each look at the text over all blocks, until no text is hit."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            whole, text, hits, items, _, gone, size = part.columns
            text, gone, size, live = text.to_pylist(), gone.to_pylist(), size.to_pylist(), []
            for i, found in enumerate(hits.to_pylist()):
                live.append(bool(found))
                if found:
                    size[i] = len(item_words(text[i])) if size[i] is None else size[i]
                    spans = [(h["first"], h["last"]) for h in found]
                    gone[i] += sum(b - a for a, b in spans)
                    text[i] = cut_spans(text[i], spans)
            cols = [whole, pa.array(text, pa.string()), pa.array([[]] * len(text), _HITS), items, pa.array(live, pa.bool_()), pa.array(gone, pa.int64()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    rest = [c for c in docs.columns if c != "text"]
    whole = F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_"))
    state = _unseen(docs, whole.alias("whole"), "text").select("*", F.lit(0).cast("long").alias("gone"), F.lit(None).cast("long").alias("size"))
    while True:
        found = _scan_blocks(state, blocks, n)
        state = cut(map_batches(found, found.columns, found.schema, rows), "decontam-texts")
        if state.filter("active").isEmpty():
            break
    kept = state.filter((F.col("gone") == 0) | (F.col("gone") <= drop_share * F.col("size")))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"whole.`{c}`") for c in docs.columns])


def remove_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, block_chars: int = 8_000_000) -> DataFrame:
    """Documents without their hit spans; those of which over drop_share of the words are hit go. All columns stay."""
    blocks = benchmark_blocks(benchmark, block_chars, n)
    if len(blocks) > 1:
        return _remove_by_blocks(docs, blocks, n, drop_share)
    out = docs
    for block in blocks:
        name, shared = _shared(block)
        place, schema = out.columns.index("text"), out.schema

        def rows(batches: Iterator[pa.RecordBatch], name=name, shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            windows = _windows(name, shared, n)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    keep, texts = [], []
                    for text in part.column(place).to_pylist():
                        clean, gone = clean_text(text or "", windows)
                        keep.append(not gone or gone <= drop_share * len(item_words(text)))
                        texts.append(clean if gone else text)
                    cols = part.columns
                    cols[place] = pa.array(texts, pa.string())
                    yield pa.RecordBatch.from_arrays(cols, names=part.schema.names).filter(pa.array(keep))

        out = map_batches(out, [f"`{c}`" for c in out.columns], schema, rows)
    return out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return digest(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))
), h AS (
  SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id
), o AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)
"""
