"""Blocks of tokens: words of many documents as numbers into the dictionary of their block.

A task reads texts piece by piece, finds words in whole Arrow buffers, and writes a row for about BLOCK words: the block's
distinct words once, and the words of its documents as numbers.  Operators then shuffle distinct words, or n-grams, of blocks
instead of tokens, and a frequent word is one row a block.  A document may go on in the next block of its class, so a long text
is no large row; `before` says how many of its words came earlier and the last `lead` of them are repeated in front.

Blocks are written as a table before anything uses them, so a lost executor can't change how documents fall into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import dealt

#: Words from which a block is closed, and bytes of text that are looked at at once.
BLOCK, PIECE = 1 << 20, 1 << 20
#: Lower-case A-Z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SCHEMA = "block long, class int, rows array<long>, doc_ids array<long>, sizes array<int>, before long, lead int, ended boolean, n_words long, words {words}, counts array<int>, ids binary"


def spaced() -> np.ndarray:
    """Words are what lies between U+0020 and U+0009 to U+000D."""
    out = np.ones(256, bool)
    out[[32, *range(9, 14)]] = False
    return out


def alphanumeric() -> np.ndarray:
    """Words are runs of digits, lower-case letters and all characters beyond ASCII."""
    out = np.zeros(256, bool)
    out[48:58] = out[97:123] = out[128:] = True
    return out


def packed(numbers: np.ndarray, width: int | None = None) -> bytes:
    """Numbers as compressed byte planes, the lowest first."""
    n = width or numbers.dtype.itemsize
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1)[:, :n].T), codec="zstd", asbytes=True) if len(numbers) else b""


def unpacked(data: bytes, n: int, width: int, dtype: type) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(dtype)


def words_in(text: np.ndarray, cuts: np.ndarray, word: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of lower-cased bytes, in which none spans a cut, and their starts."""
    low = LOWER[text]
    inside = word[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = cuts[cuts < len(text)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    ends = np.cumsum(inside, dtype=np.int32)
    solid = low[inside]
    offsets = np.append(ends[starts] - 1, len(solid)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(solid)), starts


def pieces(texts: pa.StringArray, word: np.ndarray) -> Iterator[tuple[int, pa.StringArray, np.ndarray, bool]]:
    """(first row, words, words of each row, whether the last row ends here): about PIECE bytes at once, cut after rows or beside words."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, row = int(offsets[0]) if len(offsets) else 0, 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, at + PIECE, "right")) - 1)  # rows that end within a piece
        end = int(offsets[last])
        if end - at > PIECE:  # a single long row: up to the next place beside a word
            end = at + PIECE
            while end < offsets[last]:
                out = np.flatnonzero(~word[LOWER[data[end : min(end + PIECE, offsets[last])]]])
                end = end + int(out[0]) if len(out) else min(end + PIECE, int(offsets[last]))
                if len(out):
                    break
        found, starts = words_in(data[at:end], offsets[row:last] - at if offsets[row] >= at else offsets[row + 1 : last] - at, word)
        bounds = np.clip(offsets[row : last + 1] - at, 0, end - at)
        done = end == offsets[last]
        yield row, found, np.diff(np.searchsorted(starts, bounds)), done
        at, row = end, last if done else row
        if done and row < len(texts):
            at = int(offsets[row])


class Open:
    """A block that still grows."""

    def __init__(self, lead: pa.StringArray, before: int):
        self.parts, self.lead, self.before, self.rows, self.doc_ids, self.sizes, self.n = [lead], len(lead), before, [], [], [], 0

    def add(self, words: pa.StringArray, rows: list[int], doc_ids: list[int | None], sizes: list[int]) -> None:
        self.parts.append(words)
        self.n += len(words)
        if self.rows and rows and rows[0] == self.rows[-1]:  # goes on
            self.sizes[-1] += sizes[0]
            rows, doc_ids, sizes = rows[1:], doc_ids[1:], sizes[1:]
        self.rows += rows
        self.doc_ids += doc_ids
        self.sizes += sizes

    def closed(self, number: int, kind: int, ended: bool, hashed: bool) -> dict:
        coded = pa.concat_arrays(self.parts).dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.uint32)
        if hashed:
            words, counts = packed(np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)), None
        else:
            words, counts = coded.dictionary.to_pylist(), np.bincount(ids[self.lead :], minlength=len(coded.dictionary)).tolist()
        return {
            "block": number, "class": kind, "rows": self.rows, "doc_ids": self.doc_ids, "sizes": self.sizes, "before": self.before, "lead": self.lead, "ended": ended, "n_words": len(coded.dictionary),
            "words": words, "counts": counts, "ids": packed(ids),
        }


def token_blocks(docs: DataFrame, word: np.ndarray, lead: int = 0, hashed: bool = False, block: int | None = None) -> DataFrame:
    """Blocks of docs(doc_id long, text string, class int); a block's documents are of one class.

    `rows` numbers the documents of all blocks; `words` holds the distinct words, `counts` how often each occurs; if hashed,
    `words` holds their 64-bit hashes alone.
    """
    schema = SCHEMA.format(words="binary" if hashed else "array<string>")
    block, empty = block or BLOCK, pa.array([], pa.string())
    kinds = {"block": pa.int64(), "class": pa.int32(), "rows": pa.list_(pa.int64()), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "before": pa.int64(), "lead": pa.int32(), "ended": pa.bool_(), "n_words": pa.int64(), "words": pa.binary() if hashed else pa.list_(pa.string()), "counts": pa.list_(pa.int32()), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, n_rows, n_blocks, opened = TaskContext.get().partitionId() << 36, 0, 0, {}

        def close(kind: int, ended: bool, lead_words: pa.StringArray, before: int) -> pa.RecordBatch:
            nonlocal n_blocks
            out = opened[kind].closed(high + n_blocks, kind, ended, hashed)
            n_blocks += 1
            opened[kind] = Open(lead_words, before)
            return pa.RecordBatch.from_pylist([out], pa.schema(kinds))

        for b in batches:
            ids, classes = b.column("doc_id").to_pylist(), b.column("class").to_numpy()
            tail, so_far = empty, 0  # of a row that goes on in the next piece: its last words and how many it had
            for row, words, sizes, done in pieces(b.column("text").fill_null(""), word):
                own = classes[row : row + len(sizes)]
                for kind in np.unique(own).tolist():
                    of = np.flatnonzero(own == kind)
                    held = opened.setdefault(kind, Open(empty, 0))
                    part = words if len(of) == len(own) else words.filter(pa.array(np.repeat(own == kind, sizes)))
                    held.add(part, [high + n_rows + row + i for i in of.tolist()], [ids[row + i] for i in of.tolist()], sizes[of].tolist())
                    # the last row of the piece is of this class and goes on
                    on = not done and own[-1] == kind
                    if on:
                        so_far += int(sizes[-1])
                        mine = words.slice(len(words) - int(sizes[-1]))
                        tail = pa.concat_arrays([tail, mine])
                        tail = tail.slice(max(0, len(tail) - lead))
                    if held.n >= block:
                        yield close(kind, not on, tail if on and lead else empty, so_far if on else 0)
                if done:
                    tail, so_far = empty, 0
            n_rows += b.num_rows
        for kind in list(opened):
            if opened[kind].rows:
                yield close(kind, True, empty, 0)

    return dealt(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("class").cast("int"))).mapInArrow(run, schema)


def by_row(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive whole numbers, `sizes` of them a row."""
    total = np.append(np.zeros(1, values.dtype), np.cumsum(values))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
