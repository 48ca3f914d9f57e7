"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from undula.lineage import new_path
from undula.llm import boosting, chat, components, decontam, lattice, packing, pii, queries, rules, similar, simhash, store, tokens, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, end string, ids string"
LONG = " ".join(f"word{i % 977} and" for i in range(20_000))
ODD = [
    (1, None, "en", "a", 0, "x", "y"),
    (2, "", "en", None, 0, "x", "y"),
    (3, LONG, None, "a", len(LONG), None, "y"),
    (4, "Same text here twice over, mail me at a.b@c-d.example.org now.", "en", "a", 10, "x", None),
    (5, "Same text here twice over, mail me at a.b@c-d.example.org now.", "en", "a", 10, "x", None),
    (5, "Same text here twice over, mail me at a.b@c-d.example.org now.", "en", "a", 10, "x", None),
    (None, "no id", "en", "a", 5, "x", "y"),
    (7, "日本語 の  text\twith\r\nodd white  space\n\n\nand ½ ²   marks <|endoftext|> 's", "ja", "b", 5, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


def run(spark, sf_dir, name):
    return [r.asDict() for r in queries.queries()[name](spark, sf_dir).collect()]


@lru_cache
def library():
    """The plain library, apart from what the operators make of it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def whole_ids(text, end):
    return np.array(library().encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


# tokens and packing


def test_split_encoding_equals_whole(documents):
    path = tokens.default_vocabulary()
    texts = [r["text"] for r in documents[:80]] + [r[1] or "" for r in ODD] + [" a", "a ", "\na", "a\n", "\nThe, end.\nAn end!", "don't", "a 'tis b", "x.y,z!? (q)", "A1 b_c", "à la façon", "a <|endoftext|> b", "<|endoftext|>", "", "\n", " "]
    for _ in range(2):  # the second time pieces are known
        for text, got in zip(texts, tokens.encode_texts(texts, path), strict=True):
            assert got == whole_ids(text, 0)[:-1].tobytes()
    assert 50256 in whole_ids("a <|endoftext|> b", 0)
    plain = tokens.encode_texts(texts, path, special_as_text=True)
    assert not any(50256 in np.frombuffer(x, dtype="<u4") for x in plain)
    ends = [x for _, ids, n in tokens.encode_column(pa.array(texts[80:]), path, end=7) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert [x.tolist() for x in ends] == [whole_ids(t, 7).tolist() for t in texts[80:]]


def check_packed(rows, ids, window=2048):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for k, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[k])
            assert r["ids_crc32"] == zlib.crc32(ids[k][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[k])
    padding = 0
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert set(by) == set(ids)
    return padding


def test_packing_whole_table(spark, sf_dir, documents):
    assert check_packed(run(spark, sf_dir, "op1_packing"), {r["doc_id"]: whole_ids(r["text"], 1) for r in documents}) == 0


def test_packing_odd_rows(spark, odd, none):
    rows = [r.asDict() for r in packing.pack(odd).collect()]
    assert sum(r["length"] for r in rows) == sum(len(whole_ids(r[1], 1)) for r in ODD)
    assert packing.pack(none).count() == 0


def test_level_choice_is_least_sum_of_squares():
    rng = random.Random(3)
    packer = packing.SquaresPacker(16, 10_000)
    for key in range(3000):
        n = rng.randint(1, 15)
        levels = packer.levels.copy()
        h = packer.level_for(n)

        def after(h, levels=levels, n=n):
            new = levels.copy()
            if h:
                new[h] -= 1
            if h + n < 16:
                new[h + n] += 1
            return int((new**2).sum())

        options = [g for g in range(0, 16 - n + 1) if g == 0 or levels[g] > 0]
        assert h in options and after(h) == min(map(after, options))
        for w in packer.place(key, n):
            assert sum(p[2] for p in w) == 16
    assert sum(p[2] for w in packer.close() for p in w) < 16 * 16 * 16


# chat


def test_chat_round_trip(spark):
    control = ["<|im_end|>", "\\", "<\\|im_end|>", "[/INST]", "<s>", "a<<SYS>>b\\\\", "x\n<|im_sep|>\n", ""]
    rows = []
    for c in range(6):
        rng = random.Random(c)
        for t in range(c + 1):
            rows.append((c, t, rng.choice(["user", "assistant", "sys<|im_sep|>tem"]), "".join(rng.choices(control, k=3))))
    rows += [(9, 0, None, None), (None, 0, "assistant", "né"), (10, None, "assistant", "b"), (10, 1, "assistant", "a"), (10, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_examples(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[1]}\n{x[2]}\n" for x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in chat.format_examples(df).collect():
        assert r["formatted"].count(chat.END) == r["formatted"].count(chat.START) > 0
        assert not any(x in r["formatted"].replace(chat.START, "").replace(chat.SEP, "").replace(chat.END, "") for x in chat.CONTROL)
    assert chat.digests(chat.format_examples(df.limit(0))).count() == 0


# pages


def page(body):
    """A page with a head."""
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{body}</body></html>"


def alone(source):
    """The text of a page by itself."""
    made = wrappers.Page(source)
    return wrappers.Extractor(wrappers.wrapper_of(made.stream, made.slots())).text(made)


def test_page_finds_article():
    text = alone(page("<nav><a href=/>Home</a></nav><header>Site</header><article><h1>A &amp; B</h1><p>one\n two<br>three<p><b>four<form>f</form><div class='comments'>c</div></article><aside>x</aside><footer>&copy;</footer>"))
    assert text == "A & B\n\none two three\n\nfour"
    assert alone("") == "" and alone("just text < 3 & more") == "just text < 3 & more"


def test_pages_lose_nothing_to_odd_markup():
    assert alone("<p>before</p><select><option>x<p>after words here</p>") == "before\n\nafter words here"
    assert alone("<article><p>E = <math>m</math> c</p><title>In title</title></article>") == "E = m c\n\nIn title"
    assert alone("<article><p>it's <a title=it's>don't</a> you</p></article>") == "it's don't you"
    assert alone("<p>one <svg><path/> two and three</p><!-- open > four and five") == "one\n\ntwo and three\n\nfour and five"
    assert alone("<p>kept</p><script>var a = '<p>no</p>'") == "kept"
    for s in ("<a " * 30_000, "<svg>" * 20_000, "<b>" * 20_000 + "</x>" * 20_000, "<p a='" * 20_000, '<a b="' * 20_000 + ">", "<!--" * 20_000, "<" * 50_000, "<b>" * 20_000 + "<p>" * 20_000, "<li>a<li>b" * 5000, "a < b " * 20_000):
        began = time.process_time()
        wrappers.Page(s)
        assert time.process_time() - began < 3


def test_wrappers_of_a_host_drop_constant_text(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<div class=x>Welcome to us</div><div id=t><p>Text {i} of the page</p>{f'<p>More {i}</p>' if i % 3 else ''}</div>")) for i in range(9)]
    rows += [(20, None, None), (21, "odd", ""), (3, "http://h.example/3", rows[3][2])]
    df = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, wrapper string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert got[0] == "Text 0 of the page" and got[4] == "Text 4 of the page\n\nMore 4"
    assert got[20] == got[21] == ""
    joined = {r["page_id"]: r["text"] for r in wrappers.extract(df, broadcast_chars=0).collect()}
    assert joined == got
    assert wrappers.extract(df.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<nav><a href=/>Home {i}</a></nav><article><h1>Title</h1><p>The same words on every page of this host, all of them</p></article><div class=ad>Ad {i}</div>")) for i in range(8)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Title\n\nThe same words on every page of this host, all of them"}


def without_names(html):
    """The page with nothing left that says what its parts are."""
    return re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", html or "").replace('<div class="ad">', "<div>")


def test_wrappers_find_main_text_where_names_say_nothing(spark, monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    named = spark.createDataFrame([(r["page_id"], r["url"], r["html"]) for r in pages], "page_id long, url string, html string")
    want = {r["page_id"]: r["text"] for r in wrappers.extract(named).collect()}
    first = {r["page_id"]: "".join(re.findall(r"<article><h1>(.*?)</h1>", r["html"] or "")) for r in pages}
    assert all(not first[k] or t.startswith(" ".join(html.unescape(first[k]).split())) for k, t in want.items())
    plain = spark.createDataFrame([(r["page_id"], r["url"], without_names(r["html"])) for r in pages], "page_id long, url string, html string")
    made = wrappers.infer_wrappers(plain)
    right = lambda d: sum(want[r["page_id"]] == r["text"] for r in d.collect()) / len(want)
    with_wrappers, without = right(wrappers.extract(plain, made)), right(wrappers.extract(plain, made.limit(0)))
    assert with_wrappers > 0.99 and without < with_wrappers  # a page alone takes an advert for its article now and then
    # However pages are dealt, the wrappers are the same.
    key = lambda d: sorted(map(str, d.collect()))
    assert key(wrappers.infer_wrappers(plain.repartition(7, "page_id"))) == key(made) == key(wrappers.infer_wrappers(plain.coalesce(1)))
    monkeypatch.setattr(wrappers, "STREAMS", 2)  # streams merge in a tree
    assert right(wrappers.extract(plain)) > 0.97


def test_repeats_become_groups_and_merging_takes_both():
    a = wrappers.Page("<ul><li>a</li><li>b</li></ul><p>x</p>").stream
    b = wrappers.Page("<ul><li>a</li></ul><h2>t</h2><p>x</p>").stream
    assert a == ["<ul", "(", "<li", "#", "</li", ")+", "</ul", "<p", "#", "</p"]
    w = wrappers.generalise(wrappers.wrapper_of(a, {}), wrappers.wrapper_of(b, {}))
    assert wrappers.as_expression(w) == "<ul (? <li # </li )+? </ul <h2? #? </h2? <p # </p"
    unit = "".join(f"<h{1 + i % 6}>a</h{1 + i % 6}>" for i in range(24))
    assert wrappers.Page(unit * 3).stream.count("<h1") < 5  # long parts repeat too


# personal data


def brute_base(text):
    out = []
    for k, (kind, p) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_base_spans_equal_patterns(spark, sf_dir, documents):
    text = {r["doc_id"]: r["text"] or "" for r in documents}
    for r in run(spark, sf_dir, "op4_pii"):
        assert r["base_sha256"] == hashlib.sha256(brute_base(text[r["doc_id"]]).encode()).hexdigest()
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choices(["a@b", ".", "@", "1.2", "255", "-", " ", "+1", "4465758382889437", "(", ")", "a", "x.y", "00", "é"], k=9))
        assert ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(s)) == brute_base(s)


def test_long_runs_are_read_once():
    for text in ("0" * 5000 + ".1.1.1", "1" * 100_000 + ".", "9" * 100_000, "1.1.1.1 " * 20_000, "a@" * 50_000, "+1" + " " * 100_000, "1." * 50_000, "x" * 100_000 + "1", "0-" * 50_000):
        began = time.process_time()
        spans = pii.entities(text)
        pii.terms_outside(text, spans)
        assert time.process_time() - began < 3
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)] and len(pii.base_spans("1.1.1.1 " * 20_000)) == 20_000
    assert pii.base_spans("1.2.3.4.5.6.7.8.9") == [(1, 0, 7), (1, 8, 15)] and pii.base_spans("300.2.3.4.5.6.7.8") == [(1, 10, 17)]


def brute_terms(texts, disclosure=0.9, min_texts=3, reach=3):
    """{(kind, term): disclosure} by the definition."""
    every, both, values = Counter(), defaultdict(list), Counter()
    for text in texts:
        spans = pii.entities(text)
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", text)]
        every.update(w for _, _, w in words)
        free = [w for w in words if not any(a < w[1] and w[0] < b for _, a, b in spans)]
        for k, a, b in spans:
            for w in [w[2] for w in free if w[1] <= a][-reach:] + [w[2] for w in free if w[0] >= b][:reach]:
                both[pii.PROTECTED[k], w].append((text[a:b], text))
                values[pii.PROTECTED[k], text[a:b]] += 1
    total, kinds, found = sum(every.values()), Counter(), {}
    for (kind, _), own in both.items():
        kinds[kind] += len(own)
    for (kind, w), own in both.items():
        options = [(own, kinds[kind])] + [([x for x in own if x[0] == v], values[kind, v]) for v in {x[0] for x in own}]
        for some, n in options:
            p = min(1.0, n / total)
            score = math.log2(min(1.0, len(some) / every[w]) / p) / -math.log2(p) if p < 1 else 0.0
            if len({x[1] for x in some}) >= min_texts and score >= disclosure:
                found[kind, w] = max(score, found.get((kind, w), 0.0))
    return found


def test_terms_equal_brute_force(spark, sf_dir, documents):
    secret = "9f8e7d6c5b4a39281706f5e4"
    rows = [(i, f"some words before reach zorblat number{'abc'[i % 3]} user{i}@mail.example.org then go on") for i in range(30)]
    rows += [(40 + i, f"of words number{'abcdef'[i % 6]} beside qwibble one@mail.example.org then go on {'abcdefgh'[i]}{i}") for i in range(6)]
    rows += [(50 + i, "the same text about vlorb two@mail.example.org and no more") for i in range(6)]  # copies are one text
    rows += [(60 + i, f'a passkey = "{secret}{i}" stands here, beside +1 (017) 555-77{i}3 and 10.0.0.{i}') for i in range(8)]
    rows += [(100 + i, "some words before reach then go on and on, beside the same text about number of things and no more " * 3) for i in range(60)]
    rows += [(None, None), (501, "Zorblat alone"), (502, "vlorb alone"), (501, ""), (503, "QWIBBLE, passkey")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, `_spans_` string")
    want = brute_terms([t or "" for _, t in rows])
    got = {(r["kind"], r["term"]): r["disclosure"] for r in pii.revealing_terms(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {("email", "zorblat"), ("email", "qwibble"), ("secret", "passkey")} <= got.keys() and not {t for _, t in got} & {"words", "before", "vlorb", "beside", "then"}
    assert {(r["kind"], r["term"]) for r in pii.revealing_terms(df, block_terms=2).collect()} == got.keys()
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    assert sorted(map(str, clean.collect())) == sorted(map(str, pii.sanitise(df, block_terms=2).collect()))
    text = defaultdict(list)
    for r in clean.collect():
        text[r["doc_id"]].append(r["text"])
    assert text[None] == [None] and sorted(text[501]) == ["", "[EMAIL TERM] alone"] and text[502] == ["vlorb alone"] and text[100] == [dict(rows)[100]]
    assert text[60][0].startswith('a [SECRET TERM] = "[SECRET]"') and "[EMAIL TERM] [EMAIL]" in text[40][0] and "@" not in text[0][0]
    key = lambda d: sorted(str(r) for r in d.collect())
    assert key(pii.find_spans(df)) == key(pii.find_spans(df, block_terms=2))
    assert pii.find_spans(df.limit(0)).count() == 0 and pii.sanitise(df.limit(0)).count() == 0
    texts = [r["text"] or "" for r in documents]
    found = pii.revealing_terms(spark.read.parquet(f"{sf_dir}/documents.parquet"), disclosure=0.5).collect()
    assert {(r["kind"], r["term"]) for r in found} == brute_terms(texts, disclosure=0.5).keys()


def test_personal_data_in_odd_rows(spark, odd, none):
    got = pii.digests(pii.find_spans(odd)).collect()
    assert len(got) == len(ODD) and sum(r["n_email"] for r in got) == 3 and sum(r["doc_id"] is None for r in got) == 1
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(none).count() == 0
    text = "mail me\nat first.last@some-host.example.org, +44 (0)20 7946 0000, 4465758382889437 or 10.1.2.3"
    assert pii.sanitise_text(text, pii.all_spans(text, {}), False) == "mail me\nat [EMAIL], [PHONE], [CARD] or [IP]"


# language-model scores


def test_base_scores(spark, sf_dir, documents):
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in documents}
    c = Counter(w for r in documents if not out[r["doc_id"]] for w in [*split(r["text"]), None])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in run(spark, sf_dir, "op5_lattice")}
    for r in documents:
        ws = [*split(r["text"]), None]
        g = got[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (out[r["doc_id"]], len(ws), sum(w in c for w in ws), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)


def test_head_and_tail_give_the_same(spark, odd, none):
    key = lambda rows: sorted((str(r["doc_id"]), r["n_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)
    assert key(lattice.score(odd).collect()) == key(lattice.score(odd, head_words=3).collect())
    assert lattice.score(none).count() == 0


def test_forward_sums_all_segmentations():
    weight = {"▁a": -1.0, "▁ab": -2.0, "b": -0.5, "c": -1.5, "bc": -2.5, "▁": -3.0}
    by_byte = [-6.0] * 256

    def all_paths(s):
        if not s:
            return 1.0
        total = math.exp(sum(by_byte[b] for b in s[0].encode())) * all_paths(s[1:])
        return total + sum(math.exp(w) * all_paths(s[len(p) :]) for p, w in weight.items() if s.startswith(p))

    for word in ("abc", "", "cab", "é"):
        assert lattice.forward(word, weight, by_byte, 3) == pytest.approx(math.log(all_paths("▁" + word)))


def test_scores_of_documents_equal_brute_force(spark, monkeypatch):
    """From the texts to `score`, by the definition, with words beyond the longest piece."""
    rng = random.Random(6)
    vocabulary = ["the", "cat", "sat", "naïve", "日本", "x" * 60, "antidisestablishmentarianism" * 3, "a-b"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12))), "k") for i in range(40)] + [(None, "the the", "k"), (7, None, "k"), (7, "Cat", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    path = lattice.default_vocabulary()
    sp, ids, byte_ids, end, _ = lattice._vocabulary(path)
    split = lambda t: (t or "").lower().split()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    uses = Counter()
    for i, t, _ in rows:
        if not held(i):
            uses.update(p for w in split(t) for p in sp.encode(w))
            uses[end] += 1
    total = sum(uses.values()) + 0.1 * sp.get_piece_size()
    p = lambda i: (uses[i] + 0.1) / total

    def marginal(word):
        s = lattice.MARK + word
        at = [1.0] + [0.0] * len(s)
        for j in range(1, len(s) + 1):
            at[j] = at[j - 1] * math.prod(p(byte_ids[b]) for b in s[j - 1].encode()) + sum(at[k] * p(ids[s[k:j]]) for k in range(j) if s[k:j] in ids)
        return at[-1]

    want = sorted((str(i), round(sum(math.log10(marginal(w)) for w in split(t)) + math.log10(p(end)), 6)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in lattice.score(df, head_words=3).collect()) == want
    assert lattice.own_weights(path) is None  # its scores are ranks
    monkeypatch.setitem(lattice._loaded, "unigram", (Unigram(), {"\u2581a": 3, "b": 4, "c": 5}, list(range(6, 262)), 2, 2))
    own = lattice.own_weights("unigram")
    assert own[3] == pytest.approx(math.log(0.5)) and own[2] == own[10] == pytest.approx(math.log(0.2) + math.log(0.01))


class Unigram:
    """A vocabulary with scores that are logs of probabilities."""

    def get_piece_size(self):
        return 262

    def get_score(self, i):
        return {3: math.log(0.5), 4: math.log(0.3), 5: math.log(0.2)}.get(i, 0.0)


# decontamination


def brute_hits(text, items, n=10):
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    ws, hit, found = split(text), set(), set()
    for item, t in items:
        b = split(t)
        size = min(n, len(b))
        windows = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1 if size else 0):
            if tuple(ws[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_odd_rows(spark, none):
    b = [(1, "The quick brown fox jumps over the lazy dog and runs away"), (2, "Short ONE"), (3, None), (4, "!!"), (2, "Short ONE"), (7, "short one")]
    d = [(1, "x THE quick-brown fox, jumps over the lazy dog and runs off; short one"), (2, None), (3, "short two one short one"), (4, LONG), (4, LONG)]
    docs = spark.createDataFrame([(*r, 1) for r in d], "doc_id long, text string, items int")
    bench = spark.createDataFrame(b, "item_id long, text string")
    want = sorted((i, *brute_hits(t, b)) for i, t in d)
    got = decontam.digest(decontam.find_hits(docs, bench)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == want
    clean = {r["doc_id"]: r["text"] for r in decontam.remove_hits(docs, bench).collect()}
    assert clean[3] == "short two one " and 1 not in clean and clean[2] is None and clean[4] == LONG
    blocks = decontam.digest(decontam.find_hits(docs.dropDuplicates(["doc_id"]), bench, block_chars=40)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in blocks) == sorted(set(want))
    assert decontam.find_hits(docs, bench.limit(0)).filter("size(hits) > 0").count() == 0
    assert decontam.find_hits(none, bench).count() == 0


def test_blocks_of_the_benchmark_give_what_one_block_gives(spark):
    w = [f"w{i}" for i in range(100)]
    b = [(1, " ".join(w[:12])), (2, " ".join(w[20:32])), (3, " ".join(w[40:52])), (4, "a b c d e f g h i j"), (5, " ".join(w[60:72]))]
    d = [(1, " ".join([*w[:12], "x1 x2 x3 x4 x5 x6", *w[20:32]])), (None, "y " * 30 + b[2][1]), (None, "y"), (7, "z " * 60 + "a b c d e " + b[0][1] + " f g h i j"), (7, b[4][1] + " q" * 40), (8, None)]
    docs = spark.createDataFrame([(*r, "k") for r in d], "doc_id long, text string, `gone` string")
    bench = spark.createDataFrame(b, "item_id long, text string")
    assert len(decontam.benchmark_blocks(bench, 40, 10)) > 2
    long = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[50:]) + " end")], "item_id long, text string")
    docs_of_long = spark.createDataFrame([(i, " ".join(w[i : i + 12])) for i in range(89)] + [(99, " ".join(w))], "doc_id long, text string")
    same = lambda chars: sorted(map(str, decontam.find_hits(docs_of_long, long, block_chars=chars).collect()))
    assert same(200) == same(8_000_000) and len(decontam.benchmark_blocks(long, 200, 10)) > 2
    key = lambda df: sorted(map(str, df.collect()))
    assert key(decontam.find_hits(docs, bench, block_chars=40)) == key(decontam.find_hits(docs, bench))
    one, many = decontam.remove_hits(docs, bench), decontam.remove_hits(docs, bench, block_chars=40)
    assert many.columns == docs.columns and key(many) == key(one)
    left = [(r["doc_id"], r["text"]) for r in many.collect()]
    assert not any(i == 1 for i, _ in left) and not any("a b c" in (t or "") for _, t in left) and (8, None) in left


# near-duplicates


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    ws = (text or "").encode().lower().split()
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] if ws else []
    h = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    ids, parent = list(fps), {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_simhash_whole_table(spark, sf_dir, documents):
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in documents}
    want = brute_components(fps)
    got = run(spark, sf_dir, "op7_simhash")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("compared", [2, 32])
def test_links_lose_nothing(spark, compared):
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.append(f)
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64)
    want = brute_components(dict(enumerate(fps)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in sorted(set(signed))], "fp long")
    root = {r["node"]: r["root"] for r in components.components(simhash.links(df, compared=compared)).collect()}
    classes = defaultdict(set)
    for i, s in enumerate(signed):
        classes[root.get(s, s)].add(want[i])
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set(want.values()))


def test_masks_cover_every_pair_within_radius():
    masks = [m % (1 << 64) for m in simhash.covering_masks(2)]
    for i in range(64):
        for j in range(i + 1):
            assert any(not m & ((1 << i) | (1 << j)) for m in masks)


def test_deduplicate_odd_rows(spark, odd, none):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "7", "None"]
    assert simhash.deduplicate(none).count() == 0


def brute_shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_near_copies_by_shingles_equal_brute_force(spark, sf_dir, documents, odd, none):
    import corpus_pipeline

    rng = random.Random(11)
    text = {r["doc_id"]: r["text"] for r in documents}
    for c in range(12):  # groups of edited copies on both sides of the threshold
        ws = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 200))]
        for k in range(12):
            copy = list(ws)
            for _ in range(rng.randint(0, max(1, len(ws) // 30))):
                copy[rng.randrange(len(ws))] = f"x{rng.randrange(5000)}"
            text[10_000 + 100 * c + k] = " ".join(copy)
    df = spark.createDataFrame([(i, t, "z") for i, t in text.items()] + [(None, "no id", "z")], "doc_id long, text string, id string")
    got = corpus_pipeline.near_duplicates(spark, df, sf_dir)
    assert got.columns == df.columns
    kept = {r["doc_id"] for r in got.collect()}
    sets = {i: brute_shingles(t) for i, t in text.items()}
    like = defaultdict(set)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 5 * len(a & b) >= 4 * len(a | b):
                like[i].add(j)
                like[j].add(i)
    assert sum(map(len, like.values())) > 500 and None in kept
    assert not any(j in kept for i in kept - {None} for j in like[i])
    reached = set()
    for i in sorted(kept - {None}):
        todo = [i]
        while todo:
            for j in like[todo.pop()] - reached - kept:
                reached.add(j)
                todo.append(j)
    assert reached == set(text) - kept


def test_sketches_bound_what_differs():
    rng = np.random.default_rng(3)
    t = Fraction(4, 5)
    for _ in range(300):
        n, gone = int(rng.integers(1, 3000)), rng.random() * 0.5
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > gone], rng.integers(0, 2**63, int(rng.integers(0, 300)), dtype=np.uint64))))
        apart = similar.differing(similar.odd_sketch(a), similar.odd_sketch(b))
        assert apart <= len(np.setxor1d(a, b)) and apart == similar.differing(similar.odd_sketch(b), similar.odd_sketch(a))
        if similar.similar(a, b, t):
            assert similar.may_be_similar(apart, len(a), len(b), t)


def test_deduplicate_tells_rows_of_one_id_apart(spark):
    other = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one text of its own that is like no other here", "a"), (1, other, "b"), (1, other, "b"), (None, other, "c"), (2, other + " end", "d"), (None, "alone without an id", "e"), (None, None, "f"), (None, "", "g")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, kept_id string, node string, _n string")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["kept_id"] for r in kept.collect() if r["kept_id"] in "abcde") == ["a", "b", "e"] and kept.count() == 4
    named = simhash.deduplicate(df.selectExpr("concat('id', doc_id) AS doc_id", "text", "kept_id"))
    assert sorted(r["kept_id"] for r in named.collect() if r["kept_id"] in "abcde") == ["a", "b", "e"]


# quality rules


def brute_counts(text):
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
    ws = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    at = defaultdict(list)
    for i in range(len(ws) - 7):
        at[tuple(ws[i : i + 8])].append(i)
    covered = {k for own in at.values() if len(own) > 1 for i in own for k in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_rule_counts(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in run(spark, sf_dir, "op8_quality_rules")}
    for d in documents:
        r = got[d["doc_id"]]
        assert tuple(r[c] for c in rules.COUNTS) == brute_counts(d["text"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_kept_equals_exact_quantiles(spark):
    """While a sketch holds all its values its quantiles are exact: the least value with at least that share at or below it."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghi", k=rng.randint(2, 9)))
    rows = []
    for i in range(260):
        text = "\n".join(" ".join(word() for _ in range(rng.randint(4, 9))) for _ in range(rng.randint(3, 9)))
        if i % 50 == 1:
            text = re.sub(r"(\w+)", r"\1\1\1", text)
        if i % 9 == 0:
            text += "\n" + "\n".join(["the same line"] * rng.randint(1, 4))
        if i % 11 == 0:
            text += " ###" * rng.randint(1, 9)
        rows.append((i, text, ["en", "de", None][i % 3], f"s{0 if i % 5 else i % 7}", "z"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_high string")
    ratio, groups = {}, defaultdict(list)
    for i, text, lang, source, _ in rows:
        n, chars, symbols, dup, repeats = brute_counts(text)
        lines = sum(1 for x in text.split("\n") if x.split())
        ratio[i] = {"mean_word": chars / max(n, 1), "symbols": symbols / max(chars, 1), "dup_lines": dup / max(lines, 1), "repeats": repeats / max(n, 1)}
        for key in ((lang, source), (lang,), ()):
            groups[key].append(i)

    def limits(ids, name):
        values = np.array([ratio[i][name] for i in ids])
        low, q1, q3, high = (float(np.quantile(values, q, method="inverted_cdf")) for q in (0.01, 0.25, 0.75, 0.99))
        return (q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)) if q3 > q1 else (low, high)

    got = {r["doc_id"]: r for r in rules.judge(df, min_rows=20).collect()}
    for i, text, lang, source, _ in rows:
        ids = next(g for g in (groups[lang, source], groups[lang,], groups[()]) if len(g) >= 20 or g is groups[()])
        n, *_, repeats = brute_counts(text)
        ok = n >= 20 and 100 * repeats <= 30 * n
        for name, (side, slack) in rules.RATIOS.items():
            low, high = limits(ids, name)
            ok = ok and ratio[i][name] <= high + slack and (side == "high" or ratio[i][name] >= low - slack)
        assert got[i]["kept"] == ok, (i, ratio[i])
    assert 0 < sum(not r["kept"] and not r["base_failed"] for r in got.values()) < 60


def test_rules_keep_clean_and_drop_odd(spark, odd, none):
    rng = random.Random(2)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "elit", "sed"]
    rows = [(i, " ".join(rng.choices(words, k=60)), "en", f"s{i % 2}") for i in range(200)] + [(999, "### $$$ %% && " * 30 + " ".join(rng.choices(words, k=60)), "en", "s0")]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(200)) and not got[999]["kept"]
    assert rules.judge(odd).count() == len(ODD) and rules.judge(none).count() == 0


def test_quantiles_set_the_limits_of_the_rules(spark):
    rng = random.Random(4)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "elit", "sed"]
    lines = lambda k: "\n".join(" ".join(rng.choices(words, k=10)) for _ in range(k))
    copied = "\n".join([lines(20), *["sed elit amet sit lorem"] * 10])  # nine of its thirty lines
    block = " ".join(rng.choices(words, k=12))
    repeated = " ".join([lines(18), block, block])  # under 30 % of its words
    rows = [(i, lines(20), "en", "s") for i in range(300)] + [(900, copied, "en", "s"), (901, repeated, "en", "s")]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert 0 < got[901]["n_repeat_words"] and not got[901]["base_failed"] and not got[901]["kept"]
    assert not got[900]["base_failed"] and not got[900]["kept"]
    # Of 302 values a sketch's quantiles are random within its error, and one text here (277) has a repeat by chance: beyond the exact 0.99 quantile.
    assert sum(got[i]["kept"] for i in range(300) if i != 277) == 299


# quality classifier


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    score = {r["doc_id"]: r for r in (x.asDict() for x in boosting.op9_quality(spark, sf).collect())}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    held = [(score[k]["predicted"], y) for k, y in labels.items() if score[k]["held_out"]]
    assert len(held) > 30 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in score.items())


def test_traversal_equals_walking_and_odd_rows(spark, odd, none):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(boosting.FEATURES)))
    y = (x[:, 3] + x[:, 5] > 0.2).astype(float)
    m = boosting.Boosted(trees=10).fit(x, y)

    def walk(row):
        total = m.base
        for f, c, leaf in zip(m.feature, m.cut, m.leaf, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + (row[f[i]] > c[i])
            total += leaf[i - len(f)]
        return 1 / (1 + math.exp(-total))

    assert m.predict(x) == pytest.approx([walk(r) for r in x])
    assert ((m.predict(x) > 0.5) == y).mean() > 0.9
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in boosting.score(odd, boosting.fit(odd, no_labels)).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert boosting.score(odd, boosting.fit(odd, some)).count() == len(ODD) and boosting.score(none, m).count() == 0


# store


def test_store_round_trip(spark, odd, none):
    path = store.write_store(odd, new_path(spark, "store"), part_tokens=20_000)
    back = store.read_store(spark, path).orderBy("first").collect()
    want = sorted(((-1 if r[0] is None else r[0]), whole_ids(r[1], 0).tobytes()) for r in ODD)
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), bytes(r["ids"])) for r in back) == want
    at = 0
    for r in back:
        assert r["first"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in back]
    assert ids == sorted(ids)
    chunks = spark.read.parquet(f"{path}/objects").filter("ids is not null")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert spark.read.parquet(f"{path}/manifest").agg({"level": "max"}).first()[0] >= 2
    empty = store.write_store(none, new_path(spark, "store"))
    assert store.read_store(spark, empty).count() == 0


def test_store_whole_table(spark, sf_dir, documents):
    at, want = 0, {}
    for r in sorted(documents, key=lambda r: r["doc_id"]):
        ids = whole_ids(r["text"], 0)
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, sf_dir, "op10_store")} == want


def test_store_leaves_nothing_in_the_catalog(spark, odd):
    path = store.write_store(odd, new_path(spark, "store"), bucket_bytes=10_000)
    assert spark.read.parquet(f"{path}/format").first()["buckets"] > 10
    assert store.read_store(spark, path).count() == len(ODD)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("undula_")]


def test_store_notices_damage(spark, odd):
    path = store.write_store(odd, new_path(spark, "store"))
    recipes = spark.read.parquet(f"{path}/recipes").collect()
    bad = spark.createDataFrame([(*r[:5], bytes(16)) for r in recipes], spark.read.parquet(f"{path}/recipes").schema)
    bad.write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(Exception, match="differs"):
        store.read_store(spark, path).collect()


def test_boundaries_follow_content():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 50_000, 5000)
    cuts = store.boundaries(store.marks(a, 8), 0, 5000, 64, 2048)
    assert cuts[-1] == 5000 and all(64 < y - x <= 2048 for x, y in zip([0, *cuts], cuts[:-1], strict=False))
    shifted = store.boundaries(store.marks(np.concatenate((rng.integers(0, 50_000, 300), a)), 8), 0, 5300, 64, 2048)
    assert len({c + 300 for c in cuts} & set(shifted)) > len(cuts) // 2


# pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= before.count()
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(brute_base(t) for t in left.values())
    rows = [{**r.asDict(), "ids_crc32": zlib.crc32(r["ids"])} for r in packing.pack(docs).collect()]
    assert check_packed(rows, {k: whole_ids(t, 1) for k, t in left.items()}) == 0
    assert sum(r["length"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sum(r["length"] for r in rows)


def test_oracle_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        order = sorted(columns)
        got = sorted(tuple(r[c] for c in order) for r in run(spark, sf_dir, name))
        assert got == sorted(tuple(dict(zip(columns, r, strict=True))[c] for c in order) for r in want.fetchall())
