"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Whole-text statistics become ratios; KLL sketches of each ratio are built per language and source, merged to one per
language and one of all, and give quantiles. The threshold of a group is a fence `fence` interquartile ranges beyond its
quartiles; where these are equal, as for ratios that are 0 in most documents, it is the 0.99 quantile (or 0.01). A tiny slack is
left beyond it for groups without any spread. A group with fewer than `min_rows` documents takes its language's, and a
language with fewer takes the corpus's. The thresholds, three small tables with a row per group, are joined back and each document
is held against its own.

Defined results: null text has no words and fails the base rule; a null language or source is a group of its own; repeated
rows count and return as often; an empty table gives no rows; further columns of the input are not looked at. Ids are cast
to long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.lineage import cut
from undula.llm.common import map_batches, table, text_column

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each ratio with the sides on which a document may lie too far out, and the slack beyond its fence.
RATIOS = {"mean_word": ("both", 0.01), "symbols": ("high", 0.001), "dup_lines": ("high", 0.001), "repeats": ("high", 0.001)}
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_SPACES = b" \t\n\x0b\x0c\r"


def repeat_words(ws: list[bytes], size: int = 8) -> int:
    """Words inside windows of `size` words that occur twice or more in the list."""
    n = len(ws) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), dtype=np.int64, count=len(ws))
    mixed = np.random.default_rng(7).integers(1, 2**63, size=len(number), dtype=np.uint64)[ids]
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    grid = np.lib.stride_tricks.sliding_window_view(ids, size)
    at = np.flatnonzero(same)
    if (grid[order[at]] == grid[order[at + 1]]).all():
        twice = np.zeros(n, dtype=bool)
        twice[order[at]] = twice[order[at + 1]] = True
    else:  # unequal windows share a hash
        _, which, often = np.unique(grid, axis=0, return_inverse=True, return_counts=True)
        twice = often[which.ravel()] > 1
    edge = np.zeros(len(ws) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((edge.cumsum() > 0).sum())


def counts_of(text: str) -> tuple[int, int, int, int, int, int]:
    """The COUNTS, and the number of lines that aren't blank."""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    return len(ws), chars, len(text) - len(text.translate(_SYMBOLS)), len(lines) - len(set(lines)), repeat_words(ws), len(lines)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of the whole text, and n_lines."""
    names = [*COUNTS, "n_lines"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = np.array([counts_of(t) for t in part.column(3).to_pylist()], dtype=np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(found[:, i]) for i in range(len(names)))], ["doc_id", "lang", "source", *names])

    source = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text"))
    return map_batches(source, ["doc_id", "lang", "source", "text"], "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in names), rows)


def with_ratios(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "mean_word": F.col("word_chars") / n,
            "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
            "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "repeats": F.col("n_repeat_words") / n,
        }
    )


def sketches(ratios: DataFrame) -> DataFrame:
    """Per language and source: rows and a KLL sketch of each ratio."""
    return ratios.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(c)).alias(c) for c in RATIOS])


def _fences(groups: DataFrame, fence: float, prefix: str) -> list:
    out = []
    for c, (side, slack) in RATIOS.items():
        low, q1, q3, high = (F.kll_sketch_get_quantile_double(F.col(c), F.lit(x)) for x in (0.01, 0.25, 0.75, 0.99))
        reach = F.lit(fence) * (q3 - q1)
        out.append((F.when(q3 > q1, q3 + reach).otherwise(high) + slack).alias(f"{prefix}{c}_high"))
        if side == "both":
            out.append((F.when(q3 > q1, q1 - reach).otherwise(low) - slack).alias(f"{prefix}{c}_low"))
    return out


def thresholds(groups: DataFrame, fence: float = 3.0, min_rows: int = 50) -> DataFrame:
    """lang, source and a fence for each ratio; small groups have the language's or the corpus's."""
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(F.col(c)).alias(c) for c in RATIOS]]
    names = [f"{c}_{s}" for c, (side, _) in RATIOS.items() for s in (("high", "low") if side == "both" else ("high",))]
    own = groups.select("lang", "source", "n", *_fences(groups, fence, ""))
    by_lang = groups.groupBy("lang").agg(*merged)
    lang = by_lang.select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), *_fences(by_lang, fence, "l_"))
    everything = groups.agg(*merged)
    corpus = everything.filter("n > 0").select(*_fences(everything, fence, "")).first()  # one row
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")))
    pick = lambda c: F.when(F.col("n") >= min_rows, F.col(c)).when(F.col("l_n") >= min_rows, F.col(f"l_{c}")).otherwise(F.lit(corpus[c] if corpus else None).cast("double"))
    return joined.select("lang", "source", *[pick(c).alias(c) for c in names])


def judge(docs: DataFrame, fence: float = 3.0, min_rows: int = 50, min_words: int = 20, max_repeats: int = 30) -> DataFrame:
    """The counts of each document, whether the base rule fails it, and whether it is kept."""
    ratios = with_ratios(cut(statistics(docs), "rule-counts"))
    limits = thresholds(cut(sketches(ratios), "rule-sketches"), fence, min_rows)
    limits = limits.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    joined = ratios.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeats * F.col("n_words"))
    inside = F.lit(True)
    for c, (side, _) in RATIOS.items():
        inside = inside & (F.col(c) <= F.col(f"{c}_high"))
        if side == "both":
            inside = inside & (F.col(c) >= F.col(f"{c}_low"))
    return joined.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
