"""Packing token sequences into fixed windows by online sum-of-squares.

A document is its ids and one end id. Whole windows are cut off its front; what remains, shorter than a window, is
placed online. `level[h]` counts the open windows filled up to h. Of all placements, on an open window of any level or
in a new one, the one is taken that makes the sum of level[h] ** 2 smallest; of equals, the fullest window.
Each task packs what it reads, on its own, so nothing is shuffled and a lost task is repeated alone and alike.

Open windows hold their pieces until they are full. When a task ends, or OPEN_WINDOWS are open, windows are closed, in the
second case one of the most crowded level. A closed window keeps its pieces, in order, and takes none of another window:
it is cut at powers of two, which need no padding, or, from `pad_from` of its size on, padded (1: none is). So at most
OPEN_WINDOWS windows of ids are held.

Defined results: a null text is the end id alone; equal rows are packed each for itself; no rows give no windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandex.llm.byte_bpe import codec

OPEN_WINDOWS = 8192
#: A task numbers its windows from its partition number times this.
WINDOWS_OF_A_TASK = 1 << 40

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Windows of `size` ids. Takes documents, one after another; `rows` gathers (doc, start, length, crc, doc_tokens, window, offset)."""

    def __init__(self, size: int, first: int = 0, open_windows: int = OPEN_WINDOWS, pad_from: float = 1.0):
        self.size, self.next, self.most, self.pad_from = size, first, open_windows, pad_from
        self.level = np.zeros(size + 1, dtype=np.int64)
        self.at: list[list[tuple[int, list]]] = [[] for _ in range(size + 1)]  # of each level, (window, its pieces)
        self.open = 0
        self.rows: list[tuple] = []

    def _emit(self, window: int, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, window, offset))
            offset += len(ids)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def choose(self, length: int) -> int:
        """The level to fill up with `length` ids; 0 is a new window."""
        level, top = self.level, self.size - length
        change = 2 * level[length : self.size + 1] + 1  # of the level that grows, for levels 0 to top
        change[top] = 0  # a full window is not a partial one
        change[1:] -= 2 * level[1 : top + 1] - 1
        change[1:][level[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return int(top - np.argmin(change[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        size, total = self.size, len(ids)
        whole = total // size * size
        for start in range(0, whole, size):
            self._emit(self._new(), [(doc, start, ids[start : start + size], total)])
        if whole == total:
            return
        piece = (doc, whole, ids[whole:].copy(), total)
        length = total - whole
        h = self.choose(length)
        if h:
            window, pieces = self.at[h].pop()
            self.level[h] -= 1
            self.open -= 1
        else:
            window, pieces = self._new(), []
        pieces.append(piece)
        if h + length == size:
            self._emit(window, pieces)
            return
        self.at[h + length].append((window, pieces))
        self.level[h + length] += 1
        self.open += 1
        if self.open >= self.most:
            self._close(int(self.size - np.argmax(self.level[::-1])))  # of equally crowded levels the fullest

    def finish(self) -> None:
        """Close all open windows, the fullest first."""
        for h in range(self.size - 1, 0, -1):
            while self.level[h]:
                self._close(h)

    def _close(self, h: int) -> None:
        """Close the window of level h that was opened last: padded if it is full enough, else in powers of two."""
        window, pieces = self.at[h].pop()
        self.level[h] -= 1
        self.open -= 1
        if h >= self.pad_from * self.size or h & (h - 1) == 0:
            self._emit(window, pieces)
            return
        rest = list(reversed(pieces))
        while h:
            room = 1 << h.bit_length() - 1
            h -= room
            held = []
            while room:
                doc, start, ids, total = rest.pop()
                held.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
                room -= len(held[-1][2])
            self._emit(window, held)
            window = self._new() if h else window


def pack(docs: DataFrame, path: str, pattern: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", pad_from: float = 1.0) -> DataFrame:
    """Tokenize every whole text and pack the ids; one row for each piece.

    (id, start: its document's ids before it, length, ids_crc32, doc_tokens with the end id, sequence_id, offset).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.uint32(end_id)
        own, packer, schema = codec(path, pattern), Packer(size, TaskContext.get().partitionId() * WINDOWS_OF_A_TASK, pad_from=pad_from), None

        def out():
            columns = list(zip(*packer.rows, strict=True)) or [()] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema), *(pa.array(c, pa.int64()) for c in columns[1:])], [id_col, *NAMES])

        for batch in batches:
            schema = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.append(own.encode_marked(text.as_py() or ""), end).astype("<u4", copy=False))
            yield out()
        if schema is not None:
            packer.finish()
            yield out()

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
