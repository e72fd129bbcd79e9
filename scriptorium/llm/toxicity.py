"""Toxicity with noisy-channel deobfuscation.

A disguised word is a lattice: each character may stand for letters (leetspeak, other signs), a repeated one or a separator for
nothing, and signs at either end for punctuation.  The Viterbi decode finds the reading of the greatest probability under a model of
letters, times the channel's costs.  The model is of order ORDER inside words, with interpolated back-off (Witten and Bell): its
n-grams are counted in all documents and their table grows with the texts, up to the LETTERS ** ORDER that there can be.  A state of
the decode is the last ORDER - 1 letters; all states that a lattice reaches are kept.

Words of plain letters, no two equal ones running, have a single reading and need no decode; all other words get one, distinct
words of a task once.  Runs of three or more single characters, with blanks or other separators between, are one lattice.

Restored texts are scored by a logistic regression on the words, and beginnings of words, that labels show to be toxic.  It is fitted on labelled rows
whose crc32(doc_id as text) mod 3 isn't 1, on FIT_ROWS of them at most, taken by the hash of doc_id.

Defined results: null and empty texts, and texts without words, have no toxic words and get the least score; without usable labels
every score is 0; repeated rows get equal scores; a null doc_id isn't held out and isn't learnt from; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import dealt, written

FIT_ROWS = 20_000
#: A toxic word is in at least so many of the rows with the label, its share there is RATIO times that in the others, and its
#: likelihood ratio G2 is at least twice the logarithm of the number of rows.
WORD_ROWS, RATIO = 4, 8.0
#: Lengths of the beginnings of words that are features too: compounds of a toxic beginning are too many to be known each.
BEGINNINGS = range(4, 9)
THRESHOLD = 0.7
ORDER = 5
LETTERS = 28  # 0: word boundary, 1 to 26: a to z, 27: another letter
#: Readings of signs, most likely first.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "*": "aeiou", "€": "e", "£": "l", "%": "o", "#": "h", "&": "e"}
#: Natural logarithms: a sign read as a letter, and less for each further reading; a separator or other sign, a letter of three or
#: more running, one of two running, or a sign at the word's end read as nothing.
READ, FURTHER, SKIP, REPEAT, TWICE, END = -1.0, -0.3, -0.5, -0.7, -6.0, -0.3
#: Signs at the ends of words that never stand for letters.
EDGE = ".,;:?\"')[]{}<>«»“”…~=^-_/\\"
_SIGNS = re.escape("".join(READINGS).replace("*", ""))
SPACED = re.compile(rf"(?<!\S)(?:[^\W\d_]|[{_SIGNS}])(?:[\s.\-_*]{{1,2}}(?:[^\W\d_]|[{_SIGNS}])){{2,}}(?=[\s.,;:?!]|$)")
BLANK = re.compile(r"\s")
TWO = re.compile(r"([^\W\d_])\1")
#: Readings that a worker keeps.
KEPT = 500_000
#: Symbols that are counted at once.
STEP = 1 << 22

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[192:] = 27  # the first byte of a character beyond ASCII


def grams_of(text: str) -> np.ndarray:
    """Codes of the n-grams that end at each letter, or end of a word, of a lower-cased text; what is before the word counts as boundary."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    s = np.concatenate([[0], _SYMBOL[raw[(raw & 0xC0) != 0x80]], [0]]).astype(np.int32)
    code, place, before = s.copy(), 1, np.ones(len(s), bool)
    for k in range(1, ORDER):
        place *= LETTERS
        at = np.zeros(len(s), np.int32)
        at[k:] = s[:-k] if k < len(s) else 0
        before &= at > 0
        code += np.where(before, at, 0) * place
    return code[code > 0]


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes as one, with the sum of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, int)
    return codes[starts], np.add.reduceat(counts, starts) if len(codes) else counts


def letter_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each n-gram of letters occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

        def add(parts: list[np.ndarray]) -> None:
            nonlocal codes, counts
            x = np.sort(np.concatenate(parts))
            starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            codes, counts = summed(np.append(codes, x[starts]), np.append(counts, np.diff(np.append(starts, len(x)))))

        parts, n = [], 0
        for b in batches:
            for t in b.column(0):
                text = (t.as_py() or "").lower()
                k = 0
                while k < len(text):  # longer texts are cut between words
                    cut = BLANK.search(text, k + STEP) if len(text) - k > STEP else None
                    end = cut.start() if cut else len(text)
                    if len(g := grams_of(text[k:end])):
                        parts.append(g)
                        n += len(g)
                    if n >= STEP:
                        add(parts)
                        parts, n = [], 0
                    k = end
        if parts:
            add(parts)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], ["gram", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Letters:
    """Log probabilities of a letter after those before it in its word.

    `base`: of all n-grams one shorter than ORDER; `seen`: of the n-grams that occur; `less`: what a context leaves for the others.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        grams, counts = summed(grams.astype(np.int64), counts.astype(float))
        p = np.full(LETTERS, 1 / LETTERS)
        for order in range(1, ORDER):
            n = np.zeros((LETTERS ** (order - 1), LETTERS))
            np.add.at(n.reshape(-1), grams % LETTERS**order, counts)
            total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
            lower = np.tile(p.reshape(-1, LETTERS), (len(n) // max(1, p.size // LETTERS), 1))
            p = np.where(total > 0, (n + kinds * lower) / np.maximum(total + kinds, 1), lower)
        self.base = np.log(p).astype(np.float32).reshape(-1)
        context, short = grams // LETTERS, grams % LETTERS ** (ORDER - 1)
        at, whole = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(whole, counts, len(at)), np.bincount(whole, minlength=len(at))
        lower = p.reshape(-1)[short]
        self.grams, self.seen = grams.astype(np.int32), np.log((counts + kinds[whole] * lower) / (total + kinds)[whole]).astype(np.float32) if len(grams) else np.zeros(0, np.float32)
        self.contexts, self.less = at, np.log(kinds / (total + kinds)).astype(np.float32)
        self.key = xxhash.xxh64_hexdigest(self.grams.tobytes() + counts.tobytes())
        self._table = None

    @property
    def table(self) -> memoryview:
        """The log probability of each n-gram's last letter: LETTERS ** ORDER floats, put together once in each task."""
        if self._table is None:
            less = np.zeros(LETTERS ** (ORDER - 1), np.float32)
            less[self.contexts] = self.less
            whole = np.tile(self.base.reshape(-1, LETTERS), (LETTERS, 1))  # by the letters before but for the first
            whole += less[:, None]
            whole = whole.reshape(-1)
            whole[self.grams] = self.seen
            self._table = memoryview(whole)
        return self._table

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def of(self, context: int, letter: int) -> float:
        """The log probability of a letter after the code of the ORDER - 1 before it."""
        return self.table[context * LETTERS + letter]


def letter_model(docs: DataFrame) -> Letters:
    table = letter_counts(docs).toArrow()  # LETTERS ** ORDER rows at most, however many documents
    return Letters(table["gram"].to_numpy(), table["n"].to_numpy())


def options(c: str) -> list[tuple[str, int, float]]:
    """The readings of a character as (letter, symbol, cost); none: it says nothing."""
    if "a" <= c <= "z":
        return [(c, ord(c) - 96, 0.0)]
    if c in READINGS:
        return [(x, ord(x) - 96, READ + FURTHER * k) for k, x in enumerate(READINGS[c])]
    return [(c, 27, 0.0)] if c.isalpha() else []


_PLAIN = {c: (options(c), None) for c in map(chr, range(97, 123))}


def lattice(token: str) -> list[tuple[list[tuple[str, int, float]], float | None]]:
    """Each character's readings and the cost of reading it as nothing (None: it can't be); at its ends signs cost END."""
    out, n = [], len(token)
    head = next((k for k, c in enumerate(token) if c.isalnum()), n)
    tail = n - next((k for k, c in enumerate(reversed(token)) if c.isalnum()), n)
    last = twice = ""
    for k, c in enumerate(token):
        if c != last:
            if c in _PLAIN:
                out.append(_PLAIN[c])
            elif found := options(c):
                out.append((found, END if (k < head or k >= tail) and not c.isalnum() else None))
            else:
                out.append(([], SKIP))
        elif c.isalpha():  # a letter once more
            out.append((options(c), REPEAT if twice == c or token[k + 1 : k + 2] == c else TWICE))
        elif twice == c or not options(c):  # of a sign that runs on two at most are read
            out.append(([], SKIP))
        else:
            out.append((options(c), END if k < head or k >= tail else None))
        last, twice = c, last
    return out


def decode_one(token: str, model: Letters) -> str:
    """The most likely reading.  A state keeps its last letter and the way to it, so that a long token takes linear time and room."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    table, low = model.table, LETTERS ** (ORDER - 2)
    for readings, skip in lattice(token):
        if skip is None:
            now: dict[int, tuple[float, tuple | None]] = {}
        elif readings:
            now = {context: (score + skip, way) for context, (score, way) in states.items()}
        else:  # costs all states the same
            continue
        for context, (score, way) in states.items():
            to, at = (context % low) * LETTERS, context * LETTERS
            for letter, symbol, cost in readings:
                s = score + cost + table[at + symbol]
                if to + symbol not in now or s > now[to + symbol][0]:
                    now[to + symbol] = (s, (letter, way))
        states = now
    way = max(((score + table[context * LETTERS], way) for context, (score, way) in states.items()), key=lambda x: x[0])[1]
    letters = []
    while way:
        letter, way = way
        letters.append(letter)
    return "".join(reversed(letters))


def halved(word: str, k: int, model: Letters) -> bool:
    """Whether decode_one reads the only two equal letters running of a plain word, at k and k + 1, as one: its lattice has two paths."""
    low, table = LETTERS ** (ORDER - 2), model.table
    symbols = [ord(c) - 96 if "a" <= c <= "z" else 27 for c in word]
    twice = 0
    for x in symbols[max(0, k + 2 - ORDER) : k + 1]:
        twice = (twice % low) * LETTERS + x
    once, gain = twice, TWICE - table[twice * LETTERS + symbols[k]]
    twice = (twice % low) * LETTERS + symbols[k]
    for x in [*symbols[k + 2 :], 0]:
        gain += table[once * LETTERS + x] - table[twice * LETTERS + x]
        once, twice = (once % low) * LETTERS + x, (twice % low) * LETTERS + x
        if once == twice:  # from here on the paths are the same
            break
    return gain > 0


def decode(tokens: list[str], model: Letters) -> list[str]:
    """The most likely readings of lower-cased tokens."""
    return [decode_one(t, model) for t in tokens]


_READ: dict[str, str] = {}


def reading(token: str, model: Letters) -> str:
    """decode_one, remembered."""
    known = _READ.get(token)
    if known is None:
        known = _READ[token] = plain(token, model) if token.isalpha() else decode_one(token, model)
    return known


def plain(word: str, model: Letters) -> str:
    """decode_one of a word of letters."""
    found = TWO.search(word)
    if not found:
        return word
    k = found.start()
    if word[k + 2 : k + 3] == word[k] or TWO.search(word, k + 2):
        return decode_one(word, model)
    return word[:k] + word[k + 1 :] if halved(word, k, model) else word


def read(token: str, model: Letters) -> str:
    """What a lower-cased token says, without the signs around it."""
    w = token.strip(EDGE)
    return reading(w, model) if w and (not w.isalpha() or TWO.search(w)) else w


def spaced(text: str, model: Letters) -> list[str]:
    """The words of a lower-cased text that are spelt with blanks between their letters."""
    return [w for m in SPACED.finditer(text) if any(c.isalpha() for c in m.group()) and any(c.isspace() for c in m.group()) and (w := reading(m.group().replace("*", " "), model))]


def remember(model: Letters) -> None:
    """Readings of another model, and too many, are forgotten."""
    if len(_READ) >= KEPT or _READ.get("") != model.key:  # no token is empty
        _READ.clear()
        _READ[""] = model.key


def restored(texts: list[str], model: Letters) -> list[list[str]]:
    """The words of each text as they read once restored."""
    remember(model)
    out = []
    for t in texts:
        t = t.lower()
        words = []
        for w, n in Counter(t.split()).items():
            if w := read(w, model):
                words += [w] * n
        out.append(words + spaced(t, model))
    return out


def split_of(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def features(word: str) -> list[str]:
    """The word, and its beginnings."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


class Telling(dict):
    """The weight of a word's most telling feature, 0 if none is; each word is looked at once."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.heads = weights, {x[1 : 1 + BEGINNINGS[0]] for x in weights if x[0] == "^"}

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT // 2:
            self.clear()
        self[word] = most = self.of(word)
        return most

    def of(self, word: str) -> float:
        if word not in self.weights and word[: BEGINNINGS[0]] not in self.heads:  # most words, at little cost
            return 0.0
        return max((self.weights[x] for x in features(word) if x in self.weights), default=0.0)


def toxic_in(words: list[str], telling: Telling) -> dict[str, tuple[int, float]]:
    """The toxic words: how often each occurs, and the weight of its most telling feature."""
    return {w: (n, most) for w, n in Counter(words).items() if (most := telling[w])}


class Judged(dict):
    """A token's toxic word with its weight, an empty word if the token says nothing, None for any other; each token is read once."""

    def __init__(self, model: Letters, weights: dict[str, float]):
        self.model, self.telling = model, Telling(weights)

    def __missing__(self, token: str) -> tuple[str, float] | None:
        word = read(token, self.model)
        most = self.telling.of(word) if word else 0.0
        self[token] = found = (word, most) if most or not word else None
        return found


def toxic_of(texts: list[str], judged: Judged) -> tuple[list[dict[str, tuple[int, float]]], list[int]]:
    """toxic_in() of the restored words of each text, and how many words it has."""
    rows, sizes = [], []
    for t in texts:
        remember(judged.model)
        if len(judged) >= KEPT // 2:
            judged.clear()
        t = t.lower()
        tokens, more = t.split(), spaced(t, judged.model)
        found: Counter[tuple[str, float]] = Counter()
        for token, n in Counter(tokens).items():
            if (x := judged[token]) is not None:
                found[x] += n
        found.update((w, most) for w in more if (most := judged.telling[w]))
        sizes.append(len(tokens) + len(more) - found.pop(("", 0.0), 0))
        rows.append({w: (n, most) for (w, most), n in found.items()})
    return rows, sizes


def hits(rows: list[dict[str, tuple[int, float]]], sizes: list[int]) -> np.ndarray:
    """Measures of toxic words: different ones, all of them (log), their weights' sum, the greatest, and their share of the words."""
    out = np.zeros((len(rows), 5))
    for i, (found, n) in enumerate(zip(rows, sizes, strict=True)):
        if found:
            count, weight = sum(k for k, _ in found.values()), [w for _, w in found.values()]
            out[i] = len(found), np.log1p(count), sum(sorted(weight)) / 5, max(weight), 100 * count / n
    return np.minimum(out, 10)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a logistic regression, the constant first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, model: Letters, fit_rows: int = FIT_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Toxic words with their weights, and the regression's coefficients."""
    usable = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y")).filter(split_of() != 1)
    n = usable.count()
    if n > fit_rows:  # a share of all by hash, then exactly fit_rows: a bounded sort
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, 1.2 * fit_rows / n))))
        usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")  # at most fit_rows

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(restored(b.column(0).to_pylist(), model), pa.list_(pa.string())), b.column(1)], ["words", "y"])

    rows = written(rows.select("text", "y").mapInArrow(restore, "words array<string>, y int"), "restored")

    def count(wanted: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: Counter[str] = Counter()
                for words in b.column(0).to_pylist():
                    found.update({x for w in set(words) for x in features(w) if wanted is None or x in wanted})
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        return lambda part: part.select("words").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    total = rows.agg(F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0)).alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    if not total.toxic or total.toxic == total.n:
        return {}, np.zeros(6)
    toxic = {r.word: r.n for r in count(None)(rows.filter("y = 1")).filter(F.col("n") >= WORD_ROWS).collect()}  # features of fit_rows texts at most
    clean = {r.word: r.n for r in count(set(toxic))(rows.filter("y <> 1")).collect()}
    weights = {w: x for w, k in toxic.items() if (x := weight(k, clean.get(w, 0), total.toxic, total.n - total.toxic))}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = Telling(weights)
        for b in batches:
            words = b.column(0).to_pylist()
            x = hits([toxic_in(w, telling) for w in words], [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T] + [b.column(1)], ["a", "b", "c", "d", "e", "y"])

    fit = rows.mapInArrow(featured, "a double, b double, c double, d double, e double, y int").toPandas()  # about fit_rows small rows
    fit = fit.sort_values(list(fit.columns))
    return weights, fitted(fit[["a", "b", "c", "d", "e"]].to_numpy(), (fit["y"] == 1).to_numpy(float))


def weight(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """The logarithm of how much more often toxic rows have a feature, or 0 if that isn't sure."""
    ratio = (toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1))
    n, g2 = n_toxic + n_clean, 0.0
    for seen, mean in ((toxic, n_toxic * (toxic + clean) / n), (clean, n_clean * (toxic + clean) / n), (n_toxic - toxic, n_toxic * (n - toxic - clean) / n), (n_clean - clean, n_clean * (n - toxic - clean) / n)):
        g2 += 2 * seen * np.log(seen / mean) if seen else 0.0
    return float(np.log(ratio)) if ratio >= RATIO and g2 >= 2 * np.log(n) else 0.0


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, and toxic_words (comma-joined) of each row."""
    docs = dealt(docs)
    model = letter_model(docs)
    weights, b = learn(docs, labels, model, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = Judged(model, weights)
        for batch in batches:
            found, sizes = toxic_of([t or "" for t in batch.column(1).to_pylist()], judged)
            x = hits(found, sizes)
            score = np.zeros(len(x)) if not weights else 1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30)))
            words = [",".join(sorted(f)) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(words, pa.string())], ["doc_id", "held_out", "score", "predicted", "toxic_words"])

    held = F.coalesce(split_of() == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, toxic_words string")
