"""Subword lattice likelihood: the marginal probability of a text over all its segmentations.

The pieces of an existing unigram vocabulary are weighted by its own scores, the logs of their probabilities. A vocabulary without such
scores, as one of byte-pair merges, whose scores are ranks, is a departure: its pieces are weighted by how often its own segmentation
of the training words uses them, smoothed. The public vocabularies have no unigram one, so op5 takes that way. A word, with the vocabulary's space mark before it, is a lattice of all pieces that match at each place and, for each
character, its byte pieces; the forward recursion adds up all paths in log space. Words don't share pieces, so a
document's log10 probability is the sum over its words and one end piece.

Every distinct word of the corpus is counted once over all documents and scored once. Frequent words, at most `head_words`
of them, are looked up in a broadcast table when documents are scored; the others, none of which is frequent, are joined by a shuffle.

Beside it stands a word unigram with additive smoothing, from the same counts.

Defined results: null text has no words and is its end alone; a row without an id is never held out, so it trains; repeated rows
count and return as often, with equal scores; a word longer than the longest piece is a path over several; an empty table gives no
rows; further columns are not looked at. Ids are cast to long.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.lineage import cut
from undula.llm.common import map_batches, table, text_column, words

MARK = "▁"
_loaded: dict[str, tuple] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _vocabulary(path: str) -> tuple:
    """The processor, the id of each piece, the ids of the byte pieces, the end piece's id, and the longest piece."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        own = set(special)
        ids = {sp.id_to_piece(i): i for i in range(n) if i not in own}
        _loaded[path] = sp, ids, byte_ids, sp.eos_id(), max(map(len, ids))
    return _loaded[path]


def is_held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _source(docs: DataFrame, folds: int) -> DataFrame:
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return text_column(ids.withColumn("held_out", is_held_out(F.col("doc_id"), folds)))


def word_counts(docs: DataFrame, folds: int = 10, keep: int = 400_000) -> DataFrame:
    """word, c_train, c_all over all documents; a null word stands for the end of a document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        held: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for counts, share in ((train, 1), (held, 0)):
                n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                yield pa.RecordBatch.from_arrays([pa.array([None if w is None else w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(n * share), pa.array(n)], ["word", "c_train", "c_all"])
                counts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for out, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts = held if out else train
                    counts.update(words(text))
                    counts[None] += 1
                if len(train) + len(held) > keep:
                    yield from flush()
        yield from flush()

    by_task = map_batches(_source(docs, folds), ["held_out", "text"], "word string, c_train long, c_all long", rows)
    return by_task.groupBy("word").agg(F.sum("c_train").alias("c_train"), F.sum("c_all").alias("c_all"))


def piece_counts(counts: DataFrame, path: str) -> DataFrame:
    """piece (id), n: how often the vocabulary's own segmentation of the training words uses each piece."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _, _, end, _ = _vocabulary(path)
        total = np.zeros(sp.get_piece_size(), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ws, n = part.column(0).to_pylist(), part.column(1).to_numpy()
                pieces = sp.encode(["" if w is None else w for w in ws], num_threads=1)
                sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(ws))
                ids = np.fromiter((i for p in pieces for i in p), dtype=np.int64, count=int(sizes.sum()))
                total += np.bincount(ids, weights=np.repeat(n, sizes), minlength=len(total)).astype(np.int64)
                total[end] += sum(k for w, k in zip(ws, n.tolist(), strict=True) if w is None)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    return map_batches(counts.filter("c_train > 0"), ["word", "c_train"], "piece long, n long", rows).groupBy("piece").agg(F.sum("n").alias("n"))


def own_weights(path: str) -> np.ndarray | None:
    """The vocabulary's own scores, if they are logs of probabilities that add up to about 1. Byte pieces and the end, which have none, share
    what an unknown piece would have: a hundredth of the least."""
    sp, ids, byte_ids, end, _ = _vocabulary(path)
    scores = np.array([sp.get_score(i) for i in range(sp.get_piece_size())])
    known = np.array(sorted(ids.values()))
    if not 0.9 < np.exp(scores[known]).sum() < 1.1:
        return None
    weights = np.full(len(scores), scores[known].min() + np.log(0.01))
    weights[known] = scores[known]
    return weights


def piece_weights(counts: DataFrame, path: str, alpha: float = 0.1) -> np.ndarray:
    """The natural log of each piece's probability; as many numbers as the vocabulary has pieces."""
    if (own := own_weights(path)) is not None:
        return own
    size = _vocabulary(path)[0].get_piece_size()
    n = np.zeros(size)
    for r in piece_counts(counts, path).collect():
        n[r[0]] = r[1]
    return np.log((n + alpha) / (n.sum() + alpha * size))


def forward(word: str, weight: dict[str, float], by_byte: list[float], longest: int) -> float:
    """The natural log of the sum over all segmentations of the word, its mark before it, of their probabilities."""
    s = MARK + word
    n = len(s)
    log, exp, get = math.log, math.exp, weight.get
    at = [-math.inf] * (n + 1)
    at[0] = 0.0
    arriving: list[list[float]] = [[] for _ in range(n + 1)]
    for i in range(n):
        if i:
            paths = arriving[i]
            top = max(paths)
            at[i] = top if len(paths) == 1 else top + log(sum([exp(p - top) for p in paths]))
            arriving[i] = []
        here = at[i]
        spelled = here
        for b in s[i].encode("utf-8", "surrogatepass"):
            spelled += by_byte[b]
        arriving[i + 1].append(spelled)
        for j in range(i + 1, min(n, i + longest) + 1):
            w = get(s[i:j])
            if w is not None:
                arriving[j].append(here + w)
    paths = arriving[n]
    top = max(paths)
    return top + log(sum([exp(p - top) for p in paths]))


def word_scores(counts: DataFrame, path: str, weights: np.ndarray) -> DataFrame:
    """The counts with lattice: log10 of each word's marginal probability; of the end piece's where word is null."""
    shared = counts.sparkSession.sparkContext.broadcast(weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids, byte_ids, end, longest = _vocabulary(path)
        log_p = shared.value.tolist()
        weight = {p: log_p[i] for p, i in ids.items()}
        by_byte = [log_p[i] for i in byte_ids]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = [(log_p[end] if w is None else forward(w, weight, by_byte, longest)) / math.log(10) for w in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], ["word", "c_train", "c_all", "lattice"])

    return map_batches(counts, ["word", "c_train", "c_all"], "word string, c_train long, c_all long, lattice double", rows)


def score(docs: DataFrame, vocabulary: str | None = None, folds: int = 10, alpha: float = 0.1, head_words: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    counts = cut(word_counts(docs, folds), "word-counts")
    total = counts.agg(F.sum("c_train"), F.sum((F.col("c_train") > 0).cast("long"))).first()
    n, v = total[0] or 0, total[1] or 0
    weights = piece_weights(counts, path)
    scored = cut(word_scores(counts, path, weights), "word-scores")
    below = math.log10(n + alpha * (v + 1))
    base = F.log10(F.col("c_train") + F.lit(alpha)) - F.lit(below)
    scored = scored.withColumn("base", base).withColumn("known", (F.col("c_train") > 0).cast("long"))
    # The head: words at least as frequent as the least power of two that leaves no more than head_words of them.
    sizes = {r[0]: r[1] for r in scored.filter("word is not null").groupBy(F.floor(F.log2("c_all")).cast("int").alias("k")).count().collect()}
    k, many = 64, 0
    while k > 0 and many + sizes.get(k - 1, 0) <= head_words:
        k -= 1
        many += sizes.get(k, 0)
    in_head = F.col("c_all") >= F.lit(2**k if k < 63 else 2**63 - 1)
    head = {r[0].encode(): (r[1], r[2], r[3]) for r in scored.filter(in_head & F.col("word").isNotNull()).select("word", "base", "lattice", "known").collect()}
    end = scored.filter("word is null").select("base", "lattice", "known").first()
    shared = spark.sparkContext.broadcast((head, tuple(end) if end else (0.0, 0.0, 0)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = shared.value
        get = known.get
        task = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[] for _ in range(8)]
                for doc_id, out, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    tf = Counter(words(text))
                    b, s, k = last
                    n_tokens, tail = 1, []
                    for w, c in tf.items():
                        n_tokens += c
                        got = get(w)
                        if got is None:
                            tail.append((w.decode("utf-8", "replace"), c))
                        else:
                            b += c * got[0]
                            s += c * got[1]
                            k += c * got[2]
                    for r in ((None, n_tokens, b, s, k), *((w, c, 0.0, 0.0, 0) for w, c in tail)):
                        for col, x in zip(cols, (task, doc_id, out, *r), strict=True):
                            col.append(x)
                    task += 1
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row", "doc_id", "held_out", "word", "n", "b", "s", "k"])

    schema = "row long, doc_id long, held_out boolean, word string, n long, b double, s double, k long"
    parts = map_batches(_source(docs, folds), ["doc_id", "held_out", "text"], schema, rows)
    parts = cut(parts.withColumn("task", F.spark_partition_id()), "document-words")  # a row is told from its repeats by task and place
    key = ["task", "row", "doc_id", "held_out"]
    tail = parts.filter("word is not null").select(*key, "word", "n").join(scored.filter(~in_head & F.col("word").isNotNull()).select("word", "base", "lattice", "known"), "word")
    tail = tail.groupBy(*key).agg(F.lit(0).cast("long").alias("n_tokens"), F.sum(F.col("n") * F.col("base")).alias("b"), F.sum(F.col("n") * F.col("lattice")).alias("s"), F.sum(F.col("n") * F.col("known")).alias("k"))
    heads = parts.filter("word is null").select(*key, F.col("n").alias("n_tokens"), "b", "s", "k")
    added = heads.unionByName(tail).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n_tokens", "b", "s", "k")])
    return added.select(
        "doc_id", "held_out", "n_tokens", F.col("k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("b").alias("base_score"), F.col("s").alias("score")
    )


def op5_lattice(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
