"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

Each task packs the rows of its own partition, in their order, without a shuffle. A level array counts the partly
filled windows at each fill. A document's full windows leave at once; its rest, all of it that is kept, goes to the level at which the sum
of the squared counts grows least, a new window being level 0. What is open at the end of a task, or when
`open_limit` windows are open, is closed by cutting: the fullest windows are topped up from the emptiest, and what
one last window holds is written as sequences whose lengths are powers of two. So no token is padding.

Defined results: null text is an empty text, which is its end id alone; a null id stays null; repeated rows are
packed one by one; an empty table gives no rows; further columns of the input are not looked at. Ids are cast to long. Names of special
tokens in a text are these tokens, as the library has it, or ordinary text with `special_as_text`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm import tokens
from undula.llm.common import map_batches, table, text_column

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Sequence ids of a task start here times its partition.
SPAN = 1 << 36


class SquaresPacker:
    """Windows that are open, by level. `place` and `close` give finished sequences, lists of (key, start, length)."""

    def __init__(self, window: int, open_limit: int):
        self.window, self.open_limit = window, open_limit
        self.levels = np.zeros(window + 1, dtype=np.int64)  # the last is for full ones and stays 0
        self.at: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def level_for(self, n: int) -> int:
        """The level at which a piece of n tokens raises the sum of squares least; the fullest of several."""
        top = self.window - n
        growth = 2 * self.levels[n : self.window + 1] - 2 * self.levels[: top + 1] + 2
        growth[top] -= 1  # a window that gets full is no longer counted
        growth[0] = 2 * self.levels[n] + 1 if top else 0
        growth[1:][self.levels[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(growth[::-1]))

    def place(self, key, n: int) -> Iterator[list]:
        """Places a piece of fewer tokens than a window has."""
        h = self.level_for(n)
        if h:
            pieces = self.at[h].pop()
            self.levels[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append((key, 0, n))
        if h + n == self.window:
            yield pieces
        else:
            self.at[h + n].append(pieces)
            self.levels[h + n] += 1
            self.n_open += 1
        if self.n_open > self.open_limit:
            yield from self.close()

    def close(self) -> Iterator[list]:
        heap = [(fill, i, w) for i, (fill, w) in enumerate((h, w) for h in range(self.window, 0, -1) for w in self.at[h])]
        heap.sort(key=lambda x: -x[0])
        self.at = [[] for _ in range(self.window + 1)]
        self.levels[:] = 0
        self.n_open = 0
        last = len(heap) - 1
        i = 0
        while i < last:
            fill, _, pieces = heap[i]
            while fill < self.window and last > i:
                left, k, donor = heap[last]
                key, start, n = donor.pop()
                take = min(n, self.window - fill)
                pieces.append((key, start + n - take, take))
                if take < n:
                    donor.append((key, start, n - take))
                fill += take
                heap[last] = (left - take, k, donor)
                if not donor:
                    last -= 1
            heap[i] = (fill, i, pieces)
            if fill == self.window:
                yield pieces
                i += 1
        if i <= last and heap:
            fill, _, pieces = heap[i]
            if fill == self.window:
                yield pieces
            else:
                yield from _powers_of_two(pieces, fill)


def _powers_of_two(pieces: list, fill: int) -> Iterator[list]:
    """One window's pieces as sequences with lengths of the powers of two that add up to fill, largest first."""
    queue = list(reversed(pieces))
    for bit in range(fill.bit_length() - 1, -1, -1):
        need = fill & (1 << bit)
        out = []
        while need:
            key, start, n = queue.pop()
            take = min(n, need)
            out.append((key, start, take))
            if take < n:
                queue.append((key, start + take, n - take))
            need -= take
        if out:
            yield out


def pack(df: DataFrame, window: int = 2048, end_id: int = 1, vocabulary: str | None = None, open_limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """One row per piece: its document and place there, its sequence and place there, its ids (little-endian uint32)."""
    path = vocabulary or tokens.default_vocabulary()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SquaresPacker(window, open_limit)
        rests: dict[int, list] = {}  # row: [doc_id, all tokens, where the rest begins, its ids, tokens that aren't written yet]
        sequence = TaskContext.get().partitionId() * SPAN
        done: list[tuple] = []

        def write(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for row, start, n in pieces:
                d = rests[row]
                done.append((d[0], d[2] + start, n, d[1], sequence, offset, d[3][4 * start : 4 * (start + n)]))
                offset += n
                d[4] -= n
                if not d[4]:
                    del rests[row]
            sequence += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        row = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids, sizes in tokens.encode_column(batch.column(1), path, special_as_text, end_id):
                first = 0
                for k, n in enumerate(sizes.tolist()):
                    doc_id, whole = doc_ids[at + k], n - n % window
                    for start in range(0, whole, window):
                        done.append((doc_id, start, window, n, sequence, 0, ids[first + start : first + start + window].tobytes()))
                        sequence += 1
                    if n > whole:
                        rests[row] = [doc_id, n, whole, ids[first + whole : first + n].tobytes(), n - whole]
                        for pieces in packer.place(row, n - whole):
                            write(pieces)
                    row, first = row + 1, first + n
                    if len(done) >= 1000:
                        yield flush()
        for pieces in packer.close():
            write(pieces)
            if len(done) >= 1000:
                yield flush()
        if done:
            yield flush()

    source = text_column(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return map_batches(source, ["doc_id", "text"], SCHEMA, rows)


def digests(packed: DataFrame) -> DataFrame:
    """The checksum of each piece's ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
