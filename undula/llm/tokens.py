"""Byte-level BPE ids at corpus speed.

Byte-level BPE never merges across the cuts that its pattern makes, and one cut always lies before a
single space or a single line feed that stands between other characters. So texts of common Latin characters
are split there, a whole column at a time, each distinct piece is encoded once, and the ids are gathered by place. The ids of pieces are
kept in bounded columns; the tokenizers library encodes only pieces it hasn't seen: letters go to its model directly, as they are
one of the pattern's cuts. Texts with other characters, with longer white space or with the name of a special token go to the
library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where the cuts aren't known to hold: longer white space, other characters.
_WHOLE = "  | \n|\n |\n\n|[^\n\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xba\xbb\xbf-ɏ–—‘-„…€]"
#: Letters with marks behind them, which are one more cut; an apostrophe may belong to letters.
_MARKED = r"^(?P<word>[\x00\n]?\pL+)(?P<marks>[!-&(-/:-@\[-`{-~]+)$"
_KEPT = 150_000
#: Bytes of text that are encoded at a time; a longer text is one such part.
PART = 2_000_000

_loaded: dict[tuple[str, bool], Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _little(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _gathered(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the values, behind each other, and where each ends. Parts have fewer than 2^31 bytes, so places fit into 32 bits."""
    ends = np.cumsum(n, dtype=np.int32)
    at = np.repeat(starts - ends + n, n)
    at += np.arange(len(at), dtype=np.int32)
    return values[at], ends


class Ids:
    """Names and the ids of each: a column of names, and runs of a column of ids."""

    def __init__(self, names: pa.Array | None = None, ids: list[bytes] = ()):
        self.names = pa.array([], pa.string()) if names is None else names
        self.n = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
        self.values = np.frombuffer(b"".join(ids), dtype="<u4")
        self.starts = np.cumsum(self.n, dtype=np.int32) - self.n

    def with_more(self, more: Ids) -> Ids:
        out = Ids()
        out.names, out.n = pa.concat_arrays([self.names, more.names]), np.concatenate((self.n, more.n))
        out.values, out.starts = np.concatenate((self.values, more.values)), np.concatenate((self.starts, more.starts + np.int32(len(self.values))))
        return out

    def looked_up(self, names: pa.Array, encoded) -> tuple[Ids, np.ndarray]:
        """These, with those names added that weren't here, and the place of each name."""
        at = pc.index_in(names, value_set=self.names)
        new = names.filter(at.is_null()).unique()
        if not len(new):
            return self, at.to_numpy()
        added = pc.add(pc.index_in(names, value_set=new), pa.scalar(len(self.names), pa.int32()))
        return self.with_more(Ids(new, encoded(_strings(new)))), pc.coalesce(at, added).to_numpy()


class Encoder:
    """A tokenizer of the library and the ids of pieces that it has encoded."""

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(["", *map(re.escape, names)])
        self.feed = self.whole(["\n"])[0]
        self.words, self.marks = Ids(), Ids()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [_little(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, bodies: list[str]) -> list[bytes]:
        """The ids of bodies that are one cut of the pattern each: letters, with or without a space before them."""
        if not bodies:
            return []
        model = self.tokenizer.model.tokenize
        ids, ends = [], []
        for s in "\n".join(bodies).encode().decode("latin-1").translate(_LETTERS).split(_LETTERS[10]):
            ids += [t.id for t in model(s)]
            ends.append(4 * len(ids))
        raw = _little(ids)
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _pieces(self, names: list[str]) -> list[bytes]:
        """Ids of pieces. One that begins with a zero character is the start of a text; with a line feed, the start of a line; others
        have a space before them."""
        bodies = [p[1:] if p[:1] in ("\0", "\n") else f" {p}" for p in names]
        letters = [p.isalpha() or p[:1] in ("\0", "\n") and p[1:].isalpha() for p in names]
        quick, rest = iter(self._by_model([b for b, x in zip(bodies, letters, strict=True) if x])), iter(self.whole([b for b, x in zip(bodies, letters, strict=True) if not x]))
        ids = [next(quick if x else rest) for x in letters]
        return [self.feed + x if p[:1] == "\n" else x for p, x in zip(names, ids, strict=True)]

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, which can be split, and how many each has."""
        lines = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), "")
        pieces = pc.split_pattern(lines, " ")
        coded = pieces.flatten().dictionary_encode()
        two = pc.extract_regex(coded.dictionary, _MARKED)
        marked = two.is_valid()
        words, at_word = self.words.looked_up(pc.if_else(marked, pc.struct_field(two, "word"), coded.dictionary), self._pieces)
        marks, at_mark = self.marks.looked_up(pc.struct_field(two, "marks").filter(marked), self.whole)
        if len(self.words.names) < _KEPT:
            self.words = words
        if len(self.marks.names) < _KEPT // 10:
            self.marks = marks
        # Letters with marks behind them are two cuts: each distinct piece is a run of words and, maybe, one of marks.
        starts, n = (np.zeros((len(at_word), 2), dtype=np.int32) for _ in range(2))
        starts[:, 0], n[:, 0] = words.starts[at_word], words.n[at_word]
        has = marked.to_numpy(zero_copy_only=False)
        starts[has, 1], n[has, 1] = marks.starts[at_mark] + np.int32(len(words.values)), marks.n[at_mark]
        values, _ = _gathered(np.concatenate((words.values, marks.values)), starts.ravel(), n.ravel())
        size = n.sum(axis=1, dtype=np.int32)
        which = coded.indices.to_numpy()
        ids, ends = _gathered(values, (np.cumsum(size, dtype=np.int32) - size)[which], size[which])
        of = pieces.offsets.to_numpy().astype(np.int64)
        return ids, np.diff(np.concatenate(([0], ends))[of - of[0]])

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, _WHOLE + self.special).to_numpy(zero_copy_only=False)
        tail = np.zeros(0 if end is None else 1, dtype="<u4") + np.uint32(end or 0)
        n = np.zeros(len(texts), dtype=np.int64)
        ids, n_cut = self._cut(texts.filter(pa.array(~whole))) if not whole.all() else (np.zeros(0, dtype="<u4"), n[:0])
        n[~whole] = n_cut
        if not whole.any() and end is None:
            return ids, n
        alone = [np.frombuffer(x, dtype="<u4") for x in self.whole(texts.filter(pa.array(whole)).to_pylist())]
        n[whole] = [len(x) for x in alone]
        if not len(alone):  # only the end is added to each
            out = np.empty(len(ids) + len(n), dtype="<u4")
            last = np.cumsum(n + 1) - 1
            out[last] = tail
            keep = np.ones(len(out), dtype=bool)
            keep[last] = False
            out[keep] = ids
            return out, n + 1
        split, rest = iter(np.split(ids, np.cumsum(n_cut)[:-1])), iter(alone)
        return np.concatenate([x for w in whole.tolist() for x in (next(rest if w else split), tail)]), n + len(tail)


def encode_column(texts: pa.Array, path: str, special_as_text: bool = False, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For parts of the column (where it begins): all ids of its texts, little-endian unsigned 32-bit integers, and how many each text has; with
    `end` behind each. They equal those of encoding each text whole with add_special_tokens=False. The names of special tokens in a
    text are these tokens, as the library has it; with special_as_text they are ordinary text."""
    key = path, special_as_text
    if key not in _loaded:
        _loaded[key] = Encoder(path, special_as_text)
    texts = texts.cast(pa.string())
    at, total = 0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    while at < len(texts):
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + PART, side="right")))
        yield at, *_loaded[key].encode(texts.slice(at, to - at), end)
        at = to
    pa.default_memory_pool().release_unused()


def encode_texts(texts: list[str], path: str, special_as_text: bool = False) -> list[bytes]:
    """The ids of each text as bytes."""
    out = []
    for _, ids, n in encode_column(pa.array(texts, pa.string()), path, special_as_text):
        ends = np.cumsum(n)
        out += [ids[b - k : b].tobytes() for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
    return out
