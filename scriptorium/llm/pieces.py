"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into words, before blanks and around line ends; no piece of the model reaches across, which is checked.  The distinct
words make the lattice: their substrings of bounded length are exploded and equi-joined to the piece table, the edges of a word stay
together, and a Viterbi fold walks them by their ends, those of many words at once: it keeps the best token that ends at each place.

For a unigram model the best is the greatest sum of scores.  The public model is a BPE model, whose scores are ranks of merges: the
greatest sum of them is not what the model's encoder returns.  There a transition between two tokens is allowed only if the encoder
would leave both as they are side by side, and the path of allowed transitions to each place is the only one, that of the encoder
itself.  Two tokens part if some piece across their border, made of parts of both that exist while they are merged, has an earlier
merge than those that take up the parts (of equal ones the left goes first).  What parts a piece passes through, and at which merge each is taken
up, is a property of the piece: `limits` has it for each length at its right and left end.

Characters without a piece become the pieces of their bytes.  A place that no edge goes across cuts a word's lattice in two that don't
depend on each other.  So the fold takes as many steps as the longest stretch between such places, and its work is linear in a text's length.

The query looks words up by hashes of 96 bits: the ids of the KNOWN most frequent words are broadcast once; occurrences of the others are
joined by shuffle and fill the gaps that they left.  So each row gets its ids, and the text that these decode to is compared with its own.

Defined results: null and empty texts have no tokens; repeated rows get equal results; rows of one doc_id with other texts are kept
apart by a digest of the text; U+2581 in a text decodes as a blank, as the model has it; no rows give no rows; other columns aren't
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import written

BLANK = "▁"
WORD = r" *[^ \n]+|\n+| +"
#: Words that are broadcast.
KNOWN = 1_000_000
#: Edges that are folded at once, but for those of a longer word.
EDGES = 300_000
#: Counts that are classes of their own, and parts in which the last class of known words is cut.
FINE, SLICES = 10_000, 4096
#: Documents that a task cuts into words at once, at most, and bytes of their texts: to count the words, and to look them up.
ROWS, COUNTED, LOOKED_UP = 2000, 8_000_000, 3_000_000
#: Words whose ids a task puts in at once, but for those of a longer text.
FILLED = 200_000
ALONE = "\0"
ODD = ("  ", "\n\n", " \n", "\n ", ALONE)
_SPLIT = re.compile(WORD).findall
#: A merge that never comes.
NEVER = 1 << 30
#: Two hashes that stand for a word.
KEY = (("a", "xxhash64(word)"), ("b", "crc32(cast(word as binary))"))
#: Bits of a piece's place in the table and of its length; the others are the end's.
PLACE_BITS, LENGTH_BITS = 20, 6


class Model:
    """The piece table of a SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = f.read()
        spec = pb.ModelProto()
        spec.ParseFromString(proto)
        if spec.normalizer_spec.name != "identity" or spec.normalizer_spec.remove_extra_whitespaces or not spec.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models without normalisation are supported")
        self.bpe = spec.trainer_spec.model_type == 2
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(sp.get_piece_size())
        self.bytes_at = sp.piece_to_id("<0x00>")
        self.pieces = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if len(self.pieces) >= 1 << PLACE_BITS or self.longest >= 1 << LENGTH_BITS:
            raise ValueError("the model has too many or too long pieces")
        if any(not re.fullmatch(WORD, p.replace(BLANK, " ")) for p, _, _ in self.pieces):
            raise ValueError("the model has a piece that reaches across words")

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    def table(self) -> list[tuple[str, int, int, float, list[int], list[int]]]:
        """(piece, id, rank, score, right, left) of each piece; a unigram model has no merges."""
        if not self.bpe:
            return [(p, i, NEVER, s, [], []) for p, i, s in self.pieces]
        order = sorted(self.pieces, key=lambda x: (-x[2], x[1]))
        ranks = {p: r for r, (p, _, _) in enumerate(order)}
        return [(p, i, ranks[p], 0.0, *found) for p, i, _ in order if (found := limits(p, ranks))]


def limits(piece: str, ranks: dict[str, int]) -> tuple[list[int], list[int]] | None:
    """For each length of a part at the piece's right, and left, end the rank of the merge that takes the part up.

    -1: there is no such part; NEVER: the piece itself.  None if the merges don't lead to the piece.
    """
    parts: list[tuple] = [(c, None, None) for c in piece]
    while len(parts) > 1:
        rank, k = min((ranks.get(a[0] + b[0], NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == NEVER:
            return None
        parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k], parts[k + 1])]
    found = []
    for side in (2, 1):
        own, part = [-1] * len(piece) + [NEVER], parts[0]
        while part[side]:
            own[len(part[side][0])] = ranks[part[0]]
            part = part[side]
        found.append(own)
    return found[0], found[1]


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words(text: Column) -> Column:
    """The words of a text, with the blank that the model puts before it."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit(BLANK), F.lit(" "))
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(WORD), F.lit(0)))


def cells(types: DataFrame, table: list[tuple], longest: int) -> DataFrame:
    """The columns of `types`, and `cell`: the substrings of each `unit` that are pieces, as longs of their end, start and place in the table.

    The columns of `types` stand in a unit's first row only.  A character that is no piece has the place after the last, so that none is
    lost.  The pieces are found by a hash, which takes less room and time than the text, and then compared.
    """
    pieces = types.sparkSession.createDataFrame(pa.table({"known": pa.array([p for p, *_ in table], pa.string()), "at": pa.array(range(len(table)), pa.int32())})).withColumn("h", F.xxhash64("known"))
    each = types.select("*", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("e"))
    each = each.select("*", F.explode(F.sequence(F.least("e", F.lit(longest)), F.lit(1), F.lit(-1))).alias("size"))  # by ends, then starts
    each = each.withColumn("piece", F.expr("substring(unit, e - size + 1, size)")).withColumn("h", F.xxhash64("piece"))
    found = each.join(F.broadcast(pieces), "h", "left").withColumn("at", F.when(F.col("piece") == F.col("known"), F.col("at")))  # the piece table: as large as the model
    found = found.filter(F.col("at").isNotNull() | (F.col("size") == 1)).withColumn("at", F.coalesce("at", F.lit(len(table))))
    cell = F.expr(f"shiftleft(cast(e as bigint), {LENGTH_BITS + PLACE_BITS}) + shiftleft(cast({longest} - size as bigint), {PLACE_BITS}) + at")
    return found.select(*[F.when(F.col("e") == 1, F.col(c)).alias(c) for c in types.columns], cell.alias("cell"))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """The rows of whole units, their cells, and where each unit's begin; a join with broadcast rows keeps the order, so they follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in _ended(batches):
        held += [batch] if batch else []
        if not held or batch and sum(b.num_rows for b in held) < EDGES:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        first = np.flatnonzero(rows["unit"].is_valid().to_numpy())
        end = int(first[-1]) if batch else rows.num_rows  # the last unit may go on
        held = rows.slice(end).to_batches()
        first = first[first < end]
        if len(first):
            yield rows.drop_columns("cell").take(pa.array(first)).combine_chunks(), rows["cell"].to_numpy()[:end], np.append(first, end)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


class Lattice:
    """The edges of many units, by unit, end and start: the place in the table, and in the order of all characters their start and end.

    lane: for each place the last one up to it that no edge goes across.
    """

    def __init__(self, cell: np.ndarray, offsets: np.ndarray, longest: int):
        self.piece = cell & ((1 << PLACE_BITS) - 1)
        self.size = longest - (cell >> PLACE_BITS & ((1 << LENGTH_BITS) - 1))
        e = cell >> (LENGTH_BITS + PLACE_BITS)
        self.lengths = e[offsets[1:] - 1]
        self.base = np.cumsum(self.lengths + 1) - self.lengths - 1  # the place before each unit's first character
        self.end = np.repeat(self.base, np.diff(offsets)) + e
        self.start = self.end - self.size
        self.wide = np.flatnonzero(self.size > 1)
        places = int(self.base[-1] + self.lengths[-1]) + 1
        across = np.cumsum(np.bincount(self.start[self.wide] + 1, minlength=places) - np.bincount(self.end[self.wide], minlength=places))
        self.lane = np.maximum.accumulate(np.where(across == 0, np.arange(places), 0))
        step = self.end - self.lane[self.start]
        self.order = np.argsort(step, kind="stable")
        self.cuts = np.searchsorted(step[self.order], np.arange(1, step.max() + 2)).tolist()

    def steps(self) -> Iterator[np.ndarray]:
        """The edges in an order in which those that end at an edge's start come before it."""
        yield from (self.order[x:y] for x, y in pairwise(self.cuts))

    def tokens(self, best: np.ndarray) -> np.ndarray:
        """The edges of the path, in order, from the one that is best at each place: from the lanes' ends back."""
        on_path = np.zeros(len(best), bool)
        at = np.flatnonzero(self.lane == np.arange(len(best)))
        at = np.setdiff1d(at, self.base, assume_unique=True)
        while len(at):
            on_path[at] = True
            at = self.start[best[at]]
            at = at[self.lane[at] != at]
        return best[on_path]


def merged_path(x: Lattice, ranks: np.ndarray, flat: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each place the edge that ends there on the only path of allowed transitions.

    ranks, by place in the table; own: where a piece's limits, at its right and then its left end, begin in `flat`.
    An edge is out if a merge across the border of the best token before it, and it, comes before theirs.
    """
    best, out = np.full(len(x.lane), -1), np.zeros(len(x.piece), bool)
    wide_before = np.cumsum(x.size > 1) - (x.size > 1)
    first = np.searchsorted(x.end[x.wide], x.start, "right")  # the first wide edge that ends behind the start
    many = np.where(x.lane[x.start] == x.start, 0, wide_before - first)[x.order]  # those up to this edge
    edge = np.repeat(x.order, many)
    over = x.wide[first[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many)]
    keep = x.start[over] < x.start[edge]
    edge, over = edge[keep], over[keep]
    keep = ranks[x.piece[over]] <= flat[own[x.piece[edge]] + x.size[edge] + 1 + x.end[over] - x.start[edge]]
    edge, over = edge[keep], over[keep]
    start, lower, rank = x.start[edge], x.start[over], ranks[x.piece[over]]
    cuts = np.searchsorted(x.end[edge] - x.lane[start], np.arange(1, len(x.cuts) + 1))
    for k, edges in enumerate(x.steps()):
        part = slice(cuts[k], cuts[k + 1])
        if part.start < part.stop:
            before = best[start[part]]
            able = lower[part] >= x.start[before]
            reach = np.where(able, start[part] - lower[part], 0)
            out[edge[part][able & (rank[part] < flat[own[x.piece[before]] + reach])]] = True
        edges = edges[~out[edges]][::-1]  # of several the first stays
        best[x.end[edges]] = edges
    return best


def greatest_path(x: Lattice, scores: np.ndarray) -> np.ndarray:
    """For each place the edge that ends there on the path to it of the greatest sum of scores."""
    best, total = np.full(len(x.lane), -1), np.full(len(x.lane), -np.inf)
    for edges in x.steps():
        start, end = x.start[edges], x.end[edges]
        score = np.where(x.lane[start] == start, 0.0, total[start]) + scores[x.piece[edges]]  # each lane has a sum of its own
        np.maximum.at(total, end, score)
        edges = edges[score == total[end]][::-1]
        best[x.end[edges]] = edges
    return best


def encode_units(types: DataFrame, model: Model) -> DataFrame:
    """The columns of `types` and `ids`: the tokens of each distinct `unit`, a word or part of one."""
    table, longest, bytes_at, bpe = model.table(), model.longest, model.bytes_at, model.bpe
    missing = min((x[3] for x in table), default=0.0) - (0 if bpe else 10)
    rows = [*table, ("", -1, NEVER, missing, [-1, NEVER], [-1, NEVER])]  # the last: a character without a piece
    # as arrays, which a worker reads at once
    numbers, ranks, scores = np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), np.array([x[3] for x in rows])
    flat, own = np.concatenate([x[4] + x[5] for x in rows]), np.cumsum([0, *(len(x[4]) + len(x[5]) for x in rows[:-1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units, cell, offsets in grouped(batches):
            x = Lattice(cell, offsets, longest)
            if (np.add.reduceat((x.size == 1).astype(np.int64), offsets[:-1]) != pc.utf8_length(units["unit"]).to_numpy()).any():
                raise RuntimeError("a unit's edges don't follow one another")
            path = x.tokens(merged_path(x, ranks, flat, own) if bpe else greatest_path(x, scores))
            token, times = numbers[x.piece[path]], np.ones(len(path), np.int64)
            row = np.searchsorted(offsets, path, "right") - 1
            lost = np.flatnonzero(token < 0)
            raw = [units["unit"][r].as_py()[k - 1].encode("utf-8", "surrogatepass") for r, k in zip(row[lost].tolist(), (x.end[path[lost]] - x.base[row[lost]]).tolist(), strict=True)]
            times[lost] = [len(c) for c in raw]
            token, row = np.repeat(token, times), np.repeat(row, times)
            token[token < 0] = bytes_at + np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
            cuts = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(cuts), pa.array(token.astype(np.int32)))
            yield from units.append_column("ids", ids).to_batches()

    schema = ", ".join(f"{c} {t}" for c, t in types.dtypes)
    return cells(types, table, longest).mapInArrow(run, f"{schema}, ids array<int>")


def decoder(model: Model):
    """A function from lists of ids to texts: the ids' pieces in order, with blanks."""
    raw = dict([(i, p.replace(BLANK, " ").encode()) for p, i, _ in model.pieces] + [(model.bytes_at + b, bytes([b])) for b in range(256)])
    table = pa.array([raw.get(i, b"") for i in range(max(raw) + 1)], pa.binary())

    def decode(ids: pa.ListArray) -> pa.Array:
        whole = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, table.take(ids.values)), b"")
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:  # ids that don't make whole characters
            return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())

    return decode


def decode_ids(encoded: DataFrame, model: Model, key: str = "unit") -> DataFrame:
    """(key, ids, text): the texts that the ids decode to."""
    decode = decoder(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, decode(b.column(1))], [key, "ids", "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {dict(encoded.dtypes)[key]}, ids array<int>, text string")


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """How many words each text has, the distinct words, and the words in order as places among these."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), BLANK, " ")
    odd = pc.match_substring_regex(texts, f"  |\n\n| \n|\n |{ALONE}|^[ \n]|[ \n]$|^$").to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", f" {ALONE}\n {ALONE}"), " ")
    if odd.any():
        rest = pa.array([keys(t) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        place = np.empty(len(odd), np.int64)
        place[np.flatnonzero(~odd)], place[np.flatnonzero(odd)] = np.arange(len(split)), len(split) + np.arange(len(rest))
        split = pa.concat_arrays([split, rest]).take(pa.array(place))
    coded = split.flatten().dictionary_encode()
    found = pc.if_else(pc.starts_with(coded.dictionary, ALONE), pc.utf8_slice_codeunits(coded.dictionary, 1), pc.binary_join_element_wise(" ", coded.dictionary, ""))
    return pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64), found, coded.indices.to_numpy(zero_copy_only=False)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows, ROWS at once at most and so many that a column of texts, or of sizes, sums up to `most` bytes at most; one row at least."""
    for batch in batches:
        own = batch.column(column)
        ends = np.cumsum((own if pa.types.is_integer(own.type) else pc.fill_null(pc.binary_length(own), 0)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right"))
            end = min(max(end, start + 1), start + ROWS, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of many texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, COUNTED):
            _, found, own = tokens(b.column(0))
            yield pa.RecordBatch.from_arrays([found, pa.array(np.bincount(own, minlength=len(found)))], ["word", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, model: Model) -> DataFrame:
    """(word, n, ids) of all distinct words: how often each occurs and its tokens in order."""
    counted = counts(docs).groupBy("word").agg(F.sum("n").alias("n"))
    coded = encode_units(counted.select(F.replace("word", F.lit(" "), F.lit(BLANK)).alias("unit"), "n"), model)
    return coded.select(F.replace("unit", F.lit(BLANK), F.lit(" ")).alias("word"), "n", "ids")


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, h, ids) of each row with tokens: all ids in order; h: the text's hash, repeated rows once."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text.alias("text")).dropDuplicates(["doc_id", "h"])
    each = rows.select("doc_id", "h", F.posexplode(words(F.col("text"))).alias("at", "word"))
    found = each.join(vocabulary(docs, model), "word").groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("x"))
    return found.select("doc_id", "h", F.flatten(F.transform("x", lambda x: x["ids"])).alias("ids"))


def rank_of(n: Column) -> Column:
    """A class of counts, higher for more frequent words: each count below FINE has its own, above there are 64 for each power of two."""
    return F.when(n < FINE, n).otherwise(FINE + F.floor(F.log2(n / FINE) * 64)).cast("long")


def known_words(spelt: DataFrame, most: int) -> Column:
    """A condition that the most frequent words fulfil, `most` of them at most.

    The first class of counts that doesn't fit as a whole is cut by the words' hashes, in SLICES parts.
    """
    counts = spelt.groupBy(rank_of(F.col("n")).alias("rank")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("rank")).collect()  # FINE and 64 rows a power of two at most
    total, rank = 0, None
    for r in counts:
        if total + r.k > most:
            rank = r["rank"]
            break
        total += r.k
    if rank is None:
        return F.lit(True)
    own, part = rank_of(F.col("n")), F.pmod("b", F.lit(SLICES))
    slices, least = spelt.filter(own == rank).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k")).orderBy("part").collect(), 0  # SLICES rows at most
    for r in slices:
        if total + r.k > most:
            break
        total, least = total + r.k, r.part + 1
    return (own > rank) | ((own == rank) & (part < least))


def spelt_words(coded: DataFrame) -> DataFrame:
    """(a, b, n, ids): of each word, under the two hashes that stand for it, its count and the ids of its tokens in order."""
    return coded.select(*[F.expr(x).alias(c) for c, x in KEY], "n", "ids")


class Known:
    """The ids of the words that are broadcast, numbered from the most frequent on; words are looked up by their hashes."""

    def __init__(self, table: pa.Table, dtype: type):
        ids = table.sort_by([("n", "descending"), ("a", "ascending")]).combine_chunks()
        lists = ids["ids"].combine_chunks() if ids.num_rows else pa.array([], pa.list_(pa.int32()))
        a = ids["a"].to_numpy()
        self.number = np.argsort(a).astype(np.int32)
        self.a, self.b = a[self.number], ids["b"].to_numpy().astype(np.uint32)[self.number]
        # the last number is a word that isn't known: a gap
        self.starts = np.append(lists.offsets.to_numpy(), np.int32(len(lists.values) + 1))
        self.flat = np.append(lists.values.to_numpy().astype(dtype), np.array([np.iinfo(dtype).max], dtype))

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Known:
        """From vars() of another: a broadcast pickles plain arrays, and executors need no copy of this package."""
        own = cls.__new__(cls)
        own.__dict__.update(arrays)
        return own

    def looked_up(self, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Many rows at once, how many words each has, the words in order as places among the distinct ones, and these words' numbers and two hashes."""
        for batch in slices(batches, column, LOOKED_UP):
            sizes, found, own = tokens(batch.column(column))
            raw = bytes_of(found)
            a, b = np.array([xxhash.xxh64_intdigest(w, 42) for w in raw], np.uint64).view(np.int64), np.array([zlib.crc32(w) for w in raw], np.int64)
            number = np.full(len(raw), len(self.a), np.int32)
            if len(self.a):
                at = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
                number = np.where((self.a[at] == a) & (self.b[at] == b), self.number[at], number)
            yield batch, sizes, own, [number, a, b]

    def spelt(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, with a gap for each that isn't known, and how many each has."""
        starts = self.starts[number].astype(np.int64)
        count = self.starts[number + 1] - starts
        ends = np.cumsum(count)
        return self.flat[np.repeat(starts - (ends - count), count) + np.arange(int(count.sum()))], count


def bytes_of(texts: pa.Array) -> list[bytes]:
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else [0]
    raw = texts.buffers()[2].to_pybytes() if texts.buffers()[2] else b""
    return [raw[x:y] for x, y in pairwise(ends)]


def marked(docs: DataFrame) -> DataFrame:
    """(row, mark, doc_id, text); two hashes stand for a row, so that it doesn't matter in which order a table is read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("row"), F.hash("doc_id", "text").alias("mark"), "doc_id", "text")


def far_words(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """(row, mark, at, a, b) of each word that isn't known; `at` is its place in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known.of(shared.value)
        for batch, sizes, own, (number, a, b) in known.looked_up(batches, 2):
            far = np.flatnonzero((number == len(known.a))[own])
            row = np.repeat(np.arange(len(sizes)), sizes)[far]
            at = far - (np.cumsum(sizes) - sizes)[row]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in (0, 1)), pa.array(at.astype(np.int32)), pa.array(a[own[far]]), pa.array(b[own[far]])], ["row", "mark", "at", "a", "b"])

    return rows.select("row", "mark", "text").mapInArrow(run, "row long, mark int, at int, a long, b long")


def far_ids(far: DataFrame, spelt: DataFrame) -> DataFrame:
    """(row, mark, far): the ids of each row's words that aren't known, in order; repeated rows once."""
    found = far.join(spelt.select("a", "b", "ids"), ["a", "b"]).groupBy("row", "mark").agg(F.array_sort(F.collect_set(F.struct("at", "ids"))).alias("far"))
    return found.select("row", "mark", F.transform("far", lambda x: x["ids"]).alias("far"))


def partly_encoded(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """(row, mark, doc_id, n_words, wanted, partial): the numbers of a text's words, byte by byte and compressed; words that aren't known have the last number.

    Numbers take less room than the ids.  wanted: hash of the text that the ids are to decode to.
    """
    names = ["row", "mark", "doc_id", "n_words", "wanted", "partial"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known.of(shared.value)
        for batch, sizes, own, (number, *_) in known.looked_up(batches, 3):
            each = number.astype("<u4").view(np.uint8).reshape(-1, 4)[own]
            cuts = np.append(0, np.cumsum(sizes)).tolist()
            partial = [pa.compress(each[x:y].T.tobytes(), codec="zstd", asbytes=True) for x, y in pairwise(cuts)]
            wanted = [text_hash(b" " + t if t else b"") for t in pc.replace_substring(pc.fill_null(batch.column(3), ""), BLANK, " ").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes), pa.array(wanted, pa.int64()), pa.array(partial, pa.binary())], names)

    return rows.mapInArrow(run, "row long, mark int, doc_id long, n_words long, wanted long, partial binary")


def text_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def whole(rows: DataFrame, model: Model, shared: Broadcast, gap: int) -> DataFrame:
    """(doc_id, n_words, n_tokens, checksum, exact, ids, text) from (doc_id, n_words, wanted, partial, far); far: the ids of the words in the gaps."""
    decode = decoder(model)
    names = ["doc_id", "n_words", "n_tokens", "checksum", "exact", "ids", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known.of(shared.value)
        for b in slices(batches, 1, FILLED):
            n_words = b.column(1).to_numpy()
            raw = [pa.decompress(x, 4 * n, codec="zstd", asbytes=True) if n else b"" for x, n in zip(b.column(3).to_pylist(), n_words.tolist(), strict=True)]
            number = np.concatenate([np.zeros(0, "<u4"), *(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel() for x in raw if x)])
            partial, count = known.spelt(number)
            n = np.diff(np.append(0, np.cumsum(count))[np.append(0, np.cumsum(n_words))])
            gaps = partial == gap
            lists = b.column(4).flatten()  # of all rows, in order; rows without such words have null
            if len(lists) != gaps.sum():
                raise RuntimeError("a word isn't in the vocabulary")
            times = np.ones(len(partial), np.int64)
            times[gaps] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ids = np.repeat(partial, times).astype(np.int32)
            ids[np.repeat(gaps, times)] = lists.flatten().to_numpy()
            cuts = np.append(0, np.cumsum(times))[np.append(0, np.cumsum(n))]
            found = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
            text = decode(found)
            exact = [text_hash(x) == y for x, y in zip(text.cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True)]
            checksum = [text_hash(ids[x:y].tobytes()) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(cuts)), pa.array(checksum, pa.int64()), pa.array(exact, pa.bool_()), found, text], names)

    rows = rows.select("doc_id", "n_words", "wanted", "partial", "far")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, checksum long, exact boolean, ids array<int>, text string")


def keys(text: str) -> list[str]:
    """The words of a text, without the one blank before them; other words have ALONE before them."""
    text = text.replace(BLANK, " ")
    if not any(x in text for x in ODD) and text[0] not in " \n" and text[-1] not in " \n":  # single blanks, and single line ends, between words
        return text.replace("\n", f" {ALONE}\n {ALONE}").split(" ")
    return [w[1:] if w[0] == " " and len(w) > 1 and w[1] not in f" {ALONE}" else ALONE + w for w in _SPLIT(" " + text)]


def report(docs: DataFrame, model: Model, most: int = KNOWN) -> DataFrame:
    """doc_id, n_words, n_tokens, checksum (a hash of the ids), exact (the ids decode to the text), ids and the text that they decode to, of each row.

    The ids of known words are put in at once and the others' come by join; what is shuffled of a text are its compressed words' numbers.
    """
    spelt = written(spelt_words(vocabulary(docs, model)), "spelt")
    dtype = np.uint16 if max((i for _, i, _ in model.pieces), default=0) + 256 < np.iinfo(np.uint16).max else np.uint32
    common = known_words(spelt, most)
    known = Known(spelt.filter(common).select("a", "b", "n", "ids").toArrow(), dtype)  # `most` rows at most, of 16 bytes and the ids
    shared = docs.sparkSession.sparkContext.broadcast(vars(known))  # one copy for all steps
    far = written(far_ids(far_words(marked(docs), shared), spelt.filter(~common)), "far")
    # by shuffle even if `far` is small: else both steps would run in one task, with two Python workers that hold the known words
    return whole(partly_encoded(marked(docs), shared).join(far.hint("merge"), ["row", "mark"], "left"), model, shared, np.iinfo(dtype).max)


def with_model(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    return report(docs, Model(path or public_model()))
