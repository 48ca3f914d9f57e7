"""Information-theoretic sanitisation of personal data and secrets.

Protected entities are the base spans, found by four patterns, and secrets: long runs of ASCII letters mixed with digits. Around each,
the terms (runs of three or more letters, lower-cased, outside of entities) next to it, `reach` on either side, co-occur with an entity
of that kind. From counts over the whole corpus, a term's disclosure of a kind is PMI(kind; term) / IC(kind): the pointwise mutual
information in bits over what knowing the kind itself would tell, 1 if the term stands nowhere but beside such entities. Terms are scored
against single entity values in the same way; the higher disclosure holds. Those with a disclosure of at least `disclosure`, beside
entities in at least `min_texts` distinct texts, so that copies of one text can't make a term, are protected too, in every
document. Entities are generalised to their kind, terms to what they reveal ([SECRET TERM]) or, with `remove_terms`, to nothing.

Only terms with the support are counted over the corpus; they, and later the protected terms, are broadcast in blocks of about
`block_terms` at most, each of which is held against all documents.

Defined results: null text is empty and has no spans (sanitised, it stays null); null ids stay null, ids are cast to long; repeated rows
are handled one by one and count as often; an empty table gives no rows; further columns pass through `sanitise`.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.lineage import cut
from undula.llm.common import map_batches, table, text_column

#: The kinds of base spans, in the order of the output, and their patterns. Fixed values.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: All kinds of entities, and what makes a run of letters and digits a secret: its length, and so many of each.
PROTECTED = (*KINDS, "secret")
SECRET_CHARS, SECRET_EACH = 24, 4
_SECRET = re.compile(r"[A-Za-z0-9]{%d,}" % SECRET_CHARS)
_TERM = re.compile(r"[^\W\d_]{3,}")
#: Runs of digits joined by dots; four of them are an address.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_HAS_DOTTED = re.compile(r"[0-9]\.[0-9]")
_ANY = re.compile("[0-9@]")

SPAN = "array<struct<kind:string,start:long,end:long,of:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("of", pa.string())]))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(filter("0123456789".__contains__, s))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four runs of digits at a time, from the left, of each chain that dots join; each run is read once, however long it is."""
    for m in _DOTTED.finditer(text):
        if "." not in m[0]:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place in KINDS, start, end), by start and kind."""
    if not _ANY.search(text):
        return []
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        # The part before the sign can't hold one, so the leftmost match starts at its run of characters, found backwards.
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(free, at + 1))
    if _HAS_DOTTED.search(text):
        out += [(1, a, b) for a, b in _addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    out.sort(key=lambda s: (s[1], s[0]))
    return out


def entities(text: str) -> list[tuple[int, int, int]]:
    """(place in PROTECTED, start, end), by start and kind: base spans, and secrets that don't overlap with one."""
    found = base_spans(text)
    if _ANY.search(text) and any(len(w) >= SECRET_CHARS for w in text.split()):
        for m in _SECRET.finditer(text):
            n = len(_digits(m[0]))
            if SECRET_EACH <= n <= len(m[0]) - SECRET_EACH and not any(a < m.end() and m.start() < b for _, a, b in found):
                found.append((len(KINDS), m.start(), m.end()))
        found.sort(key=lambda s: (s[1], s[0]))
    return found


def terms_outside(text: str, spans: list[tuple[int, int, int]]) -> list[re.Match]:
    """The terms that overlap with no span. Spans are in order of their starts."""
    out, i, reach = [], 0, 0  # reach: the furthest end of the spans that start before the term ends
    for m in _TERM.finditer(text):
        while i < len(spans) and spans[i][1] < m.end():
            reach = max(reach, spans[i][2])
            i += 1
        if reach <= m.start():
            out.append(m)
    return out


def _per_text(docs: DataFrame, schema: str, rows) -> DataFrame:
    return map_batches(text_column(docs.select("text")), ["text"], schema, rows)


def _blocks(names: DataFrame, block_terms: int) -> list[DataFrame]:
    """names (with a column term) in blocks of about block_terms at most."""
    n = names.count()
    if n <= block_terms:
        return [names] if n else []
    k = -(-2 * n // block_terms)
    return [names.filter(F.pmod(F.xxhash64("term"), F.lit(k)) == i) for i in range(k)]


def revealing_terms(docs: DataFrame, reach: int = 3, disclosure: float = 0.9, min_texts: int = 3, block_terms: int = 500_000) -> DataFrame:
    """(kind, term, disclosure) of the terms over the thresholds, from all documents."""
    spark = docs.sparkSession

    def digest8(x: str) -> int:
        return int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            kind, term, value, whole = zip(*counts, strict=True)
            columns = [pa.array([PROTECTED[k] for k in kind]), pa.array(term, pa.string()), pa.array(value, pa.int64()), pa.array(whole, pa.int64()), pa.array(counts.values(), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["kind", "term", "value", "whole", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.slice(at, 512).column(0).to_pylist():
                    spans = entities(text)
                    if not spans:
                        continue
                    whole, terms = digest8(text), terms_outside(text, spans)
                    starts, ends, names = [m.start() for m in terms], [m.end() for m in terms], [m[0].lower() for m in terms]
                    for kind, a, b in spans:
                        value, left, right = digest8(text[a:b]), bisect_right(ends, a), bisect_left(starts, b)
                        for term in (*names[max(0, left - reach) : left], *names[right : right + reach]):
                            counts[kind, term, value, whole] += 1
                if len(counts) > 200_000:
                    yield flush()
        if counts:
            yield flush()

    near = _per_text(docs, "kind string, term string, value long, whole long, n long", beside)
    by_text = cut(near.groupBy("kind", "term", "value", "whole").agg(F.sum("n").alias("n")), "pii-texts")
    by_value = by_text.groupBy("kind", "term", "value").agg(F.sum("n").alias("n_both"), F.count("*").alias("support"))
    texts = by_text.select("kind", "term", "whole").distinct().groupBy("kind", "term").agg(F.count("*").alias("support"))
    pairs = cut(by_text.groupBy("kind", "term").agg(F.sum("n").alias("n_both")).join(texts, ["kind", "term"]), "pii-pairs")
    kinds = {r[0]: r[1] for r in pairs.groupBy("kind").agg(F.sum("n_both")).collect()}  # a row per kind
    counted = None
    for block in _blocks(cut(pairs.filter(F.col("support") >= min_texts).select("term").distinct(), "pii-candidates"), block_terms):
        shared = spark.sparkContext.broadcast(frozenset(r[0] for r in block.collect()))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted, counts, total = shared.value, Counter(), 0
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    for text in batch.slice(at, 512).column(0).to_pylist():
                        terms = _TERM.findall(text.lower())
                        total += len(terms)
                        counts.update(filter(wanted.__contains__, terms))
            rows = [*counts.items(), (None, total)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["term", "n"])

        part = _per_text(docs, "term string, n long", count).groupBy("term").agg(F.sum("n").alias("n_term"))
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return pairs.select("kind", "term", F.lit(0.0).alias("disclosure")).limit(0)
    counted = cut(counted, "pii-counts")
    total = max(1, counted.filter("term is null").agg(F.max("n_term")).first()[0] or 0)
    share = F.create_map(*[x for k, n in kinds.items() for x in (F.lit(k), F.lit(min(1.0, n / total)))])
    known = counted.filter("term is not null")

    def scored(beside: DataFrame, p: Column) -> DataFrame:
        pmi = F.log2(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term")) / p)
        made = beside.filter(F.col("support") >= min_texts).join(known, "term")
        return made.select("kind", "term", F.when(p < 1, pmi / -F.log2(p)).otherwise(0.0).alias("disclosure")).filter(F.col("disclosure") >= disclosure)

    # A single value: how often terms stand beside it, of all terms.
    often = by_text.groupBy("kind", "value").agg(F.sum("n").alias("n_value"))
    single = by_value.filter(F.col("support") >= min_texts).join(often, ["kind", "value"])
    found = scored(pairs, share[F.col("kind")]).unionByName(scored(single, F.least(F.lit(1.0), F.col("n_value") / F.lit(total))))
    return found.groupBy("kind", "term").agg(F.max("disclosure").alias("disclosure"))


def all_spans(text: str, terms: dict[str, str]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, what it reveals) of the entities and of the terms outside of them, by start and kind. terms: the kind that each reveals."""
    found = entities(text)
    out = [(a, k, b, PROTECTED[k]) for k, a, b in found]
    if terms and not terms.keys().isdisjoint(_TERM.findall(text.lower())):
        out += [(m.start(), len(PROTECTED), m.end(), terms[m[0].lower()]) for m in terms_outside(text, found) if m[0].lower() in terms]
        out.sort(key=lambda s: s[:2])
    return [("term" if k == len(PROTECTED) else of, a, b, of) for a, k, b, of in out]


def _over_spans(docs: DataFrame, terms: DataFrame, block_terms: int, schema: T.StructType, finish: Callable) -> DataFrame:
    """What `finish` makes of each batch, its texts and their spans. Terms over one block are looked for block by block: the spans that were
    found go along with each row."""
    best = cut(terms.groupBy("term").agg(F.max(F.struct("disclosure", "kind")).alias("best")).select("term", "best.kind"), "pii-terms")
    blocks = _blocks(best, block_terms) or [best]
    spark, out = docs.sparkSession, docs.withColumn("_spans", F.lit(None).cast(SPAN))
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        shared = spark.sparkContext.broadcast({r[0]: r[1] for r in block.collect()})

        def rows(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    texts, spans = part.column("text").to_pylist(), []
                    for text, before in zip(texts, part.column("_spans").to_pylist(), strict=True):
                        now = all_spans(text or "", shared.value)
                        if before:  # entities are the same each time
                            now = sorted({*now, *((s["kind"], s["start"], s["end"], s["of"]) for s in before)}, key=lambda s: (s[1], (*PROTECTED, "term").index(s[0])))
                        spans.append(now)
                    if last:
                        yield finish(part, texts, spans)
                    else:
                        yield pa.RecordBatch.from_arrays([*part.columns[:-1], _as_arrow(spans)], names=part.schema.names)

        out = map_batches(out, [f"`{c}`" for c in out.columns], schema if last else out.schema, rows)
        if not last:
            out = cut(out, "pii-spans")
    return out


def _as_arrow(spans: list[list[tuple[str, int, int, str]]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end", "of"), s, strict=True)) for s in own] for own in spans], _SPAN)


def find_spans(docs: DataFrame, terms: DataFrame | None = None, reach: int = 3, disclosure: float = 0.9, min_texts: int = 3, block_terms: int = 500_000) -> DataFrame:
    """doc_id and its spans (kind, start, end, of: what it reveals; code points, end exclusive), by start and kind."""
    terms = revealing_terms(docs, reach, disclosure, min_texts, block_terms) if terms is None else terms

    def finish(part: pa.RecordBatch, _, spans: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), _as_arrow(spans)], ["doc_id", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _over_spans(source, terms, block_terms, T.StructType.fromDDL(f"doc_id long, spans {SPAN}"), finish)


def sanitise_text(text: str, spans: list[tuple[str, int, int, str]], remove_terms: bool) -> str:
    """The text with its spans generalised; what comes to look like an entity by that is too."""
    while spans:
        out, at = [], 0
        for kind, a, b, of in spans:
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], f"[{of.upper()}]" if kind != "term" else "" if remove_terms else f"[{of.upper()} TERM]"]
            at = b
        text = "".join([*out, text[at:]])
        spans = [(PROTECTED[k], a, b, PROTECTED[k]) for k, a, b in entities(text)]
    return text


def sanitise(docs: DataFrame, reach: int = 3, disclosure: float = 0.9, min_texts: int = 3, remove_terms: bool = False, block_terms: int = 500_000) -> DataFrame:
    """The documents with every span generalised. All columns stay."""
    place = docs.columns.index("text")

    def finish(part: pa.RecordBatch, texts: list, spans: list) -> pa.RecordBatch:
        cols = part.columns[:-1]
        cols[place] = pa.array([t if t is None else sanitise_text(t, own, remove_terms) for t, own in zip(texts, spans, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays(cols, names=part.schema.names[:-1])

    return _over_spans(docs, revealing_terms(docs, reach, disclosure, min_texts, block_terms), block_terms, docs.schema, finish)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def digests(found: DataFrame) -> DataFrame:
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return digests(find_spans(table(spark, sf_dir, "documents")))
