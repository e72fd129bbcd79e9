"""The training-data operators against plain versions, on awkward rows and on the smallest tables."""

import collections
import hashlib
import itertools
import math
import re
import sys
import time
import types
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
import helpers
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import chunks, common, near_copies, packing, pieces, pii, quality, simhash, token_scan, toxicity, url_rules, winnowing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return helpers.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return helpers.frame(spark, [])


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1 packing


def test_packing_is_optimal():
    rng = np.random.default_rng(1)
    for round_ in range(40):
        lengths = np.unique(rng.integers(1, 40 if round_ % 2 else 30_000, 9)).tolist()
        count = rng.integers(1, 9 if round_ % 3 else 10**6, len(lengths)).tolist()
        for buckets in (1, 2, 3, 5, 20):
            got = packing.boundaries(lengths, count, buckets)

            def cost(ends, lengths=lengths, count=count):
                return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, count, strict=True))

            best = min(cost({*own, lengths[-1]}) for k in range(buckets) for own in itertools.combinations(lengths[:-1], min(k, len(lengths) - 1)))
            assert cost(got) == best and len(got) <= buckets
    assert packing.boundaries([], [], 3) == []


def test_packing_parts_close_lengths(spark):
    """A third of the rows lie just below a single longer one: an exact histogram can part them."""
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 20_001).when(F.col("id") == 1, 20_090).otherwise(F.col("id") % 7 + 1).cast("long").alias("n_tokens"))
    assert {r.n_tokens: r.padding for r in packing.pack(rows, buckets=9).collect()}[20_001] == 0


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    out = packing.pack_documents(df, buckets=4, budget=5000).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in out) == collections.Counter((i, len((t or "").encode()) + 1) for i, t in rows_of(df))
    batches = collections.defaultdict(list)
    for r in out:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), own in batches.items():
        assert sorted(r.place for r in own) == list(range(len(own)))
        room = max(1, 5000 // own[0].bucket_len)
        assert len(own) == room or (bucket, batch + 1) not in batches and len(own) <= room


# 2 URL filters


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://example.net/de/", "http://x.example.com/de/a#b", "http://notnet/", "http://net", "http://net/", "http://sub.org/fr/", "http://org/frx", None, "", "no scheme", "a://b://c/d", "http://h?q/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.page_id: r for r in url_rules.judged(pages, labels).collect()}
    assert [out[i].rule for i in range(len(urls))] == ["example.net/en/", "net/", "example.com/de/", None, None, "net/", "org/fr/", None, None, None, None, None, None]
    assert [out[i].verdict for i in (0, 1, 2, 3, 5)] == ["allow", "block", "block", "allow", "block"]
    assert (out[0].host, out[0].path) == ("a.example.net", "/en/1") and (out[4].host, out[4].path) == ("net", "") and (out[8].host, out[10].path) == ("", "") and out[12].host == "h"
    assert url_rules.judged(pages, labels).count() == len(urls) + 1


def test_mined_rules(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(url_rules, "SUPPORT", 5)
    rows = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.example.org/{'x' if i % 2 else 'y'}/{i}") for i in range(60)]
    marks = [(i, 0 if i % 3 == 0 and i % 2 or i == 1 else 1, 0) for i in range(60)]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = url_rules.judged(pages, labels)
    got = sorted(map(tuple, out.collect()))
    assert {r[0]: r[5] for r in got if r[4] == "block"} == {i: 1.0 if i % 2 else 0.5 for i in range(0, 60, 3)}
    c = duckdb.connect()
    c.register("pages", pages.toPandas())
    c.register("labels", labels.toPandas())
    q = c.execute(url_rules.oracle())
    assert [d[0] for d in q.description] == out.columns and sorted(q.fetchall()) == got


def test_rules_reach_the_whole_url(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "SUPPORT", 5)
    rows, marks = [], []
    for i in range(486):
        digits = [i // 3**k % 3 for k in range(4)]  # bad only if all four are 2
        path = "/".join(n + "xyz"[d] for n, d in zip("pqrs", digits, strict=True))
        rows.append((i, f"http://a.b.c.example.org/{path}/{i}"))
        marks.append((i, 0 if digits == [2] * 4 else 1, 0))
    deep = [(1000 + i, u) for i, u in enumerate(("http://x.y/en/a/casino/1", "http://bad.a.b.c.d/", "http://h/?a&b&c&d&e"))]
    more = [(2000 + 10 * k + i, u) for k in range(10) for i, (_, u) in enumerate(deep)]
    pages = spark.createDataFrame(rows + more, "page_id long, url string")
    labels = spark.createDataFrame(marks + [(i, 0, 0) for i, _ in more], "doc_id long, quality int, toxic int")
    unseen = [(5000, "http://u.v/x/y/casino/z"), (5001, "http://bad.q.w.e.r/"), (5002, "http://k/?v&w&x&y&e"), (5003, "http://k/?v&w&x&y")]
    out = {r.page_id: r.verdict for r in url_rules.judged(pages.union(spark.createDataFrame(unseen, pages.schema)), labels, []).collect()}
    assert [i for i in range(486) if out[i] == "block"] == [i for i in range(486) if i % 81 == 80]
    assert [out[i] for i, _ in unseen] == ["block", "block", "block", "allow"]


# 3 fingerprints


def plain_winnow(text, k=winnowing.K, w=winnowing.W):
    kept = [(i, ord(c) + 32 if "A" <= c <= "Z" else ord(c)) for i, c in enumerate(text) if ord(c) > 32]
    if not kept:
        return []
    k, grams = min(k, len(kept)), []
    for i in range(len(kept) - k + 1):
        h = 0
        for _, c in kept[i : i + k]:
            h = (h * int(winnowing.BASE) + (c + 1) * int(winnowing.MIX)) % 2**64
        h = (h ^ h >> 31) * int(winnowing.MIX) % 2**64
        grams.append((h ^ h >> 29) >> 24)
    chosen = set()
    for s in range(max(1, len(grams) - w + 1)):
        own = grams[s : s + w]
        chosen.add(s + max(i for i, v in enumerate(own) if v == min(own)))
    return [(kept[i][0], grams[i]) for i in sorted(chosen)]


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_winnowing(which, request, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE", 30)
    df = request.getfixturevalue(which)
    order = sorted(((i, t or "") for i, t in rows_of(df)), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1].encode()))
    expected = collections.Counter()
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        full = [plain_winnow(x) for x in (t, edited, after)] if which == "odd" or n % 5 == 0 else None
        sets = full and [{h >> 8 for _, h in x} for x in full]
        prints = full and tuple("".join(f"{p:08x}{h >> 8:08x}" for p, h in x) for x in full[:2])
        near = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), sets and (*prints, near(sets[0], sets[1]), near(sets[0], sets[2]))] += 1
    exact = {(k[0], k[2]) for k in expected if k[3]}
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) if (r.doc_id, r.edited_sha256) in exact else None) for r in winnowing.report(df).collect())
    assert got == expected


def test_winnowing_blocks(monkeypatch):
    text = "".join(chr(97 + i * i % 26) for i in range(3000))
    whole, plain = winnowing.winnow(text), plain_winnow(text)
    assert whole[0].tolist() == [p for p, _ in plain] and whole[1].tolist() == [h for _, h in plain]
    for block in (64, 128, 1024):
        monkeypatch.setattr(winnowing, "BLOCK", block)
        cut = winnowing.winnow(text)
        assert cut[0].tolist() == whole[0].tolist() and cut[1].tolist() == whole[1].tolist()


# 4 toxicity


TOXIC = "idiot stupid moron scum worthless clown loser"


@pytest.fixture(scope="module")
def letters(docs):
    return toxicity.letter_model(docs.union(docs.select(*[F.lit(TOXIC).alias(c) if c == "text" else F.col(c) for c in docs.columns]).limit(50)))


def test_decoding(letters):
    disguised = {
        "1d10t": "idiot", "!diot": "idiot", "|diot": "idiot", "idio+": "idiot", "i.d.i.o.t": "idiot", "iddiot": "idiot", "idiot!!": "idiot", "5tup1d": "stupid", "stuuuupid": "stupid",
        "stup*d": "stupid", "m0r0n": "moron", "m*ron": "moron", "s-c-u-m": "scum", "w0rthl3ss": "worthless", "c10wn": "clown", "c1own": "clown", "c|own": "clown", "cl*wn": "clown", "clowwn": "clown",
        "1oser": "loser", "|oser": "loser", "l*ser": "loser", "(lown": "clown",
    }
    for word, plain in disguised.items():
        assert toxicity.restored([f"the {word}, and"], letters) == [["the", plain, "and"]], word
    assert toxicity.restored(["Plain words, stay", "", "., :"], letters) == [["plain", "words", "stay"], [], []]
    assert all("idiot" in toxicity.restored([x], letters)[0] for x in ("an i d i o t.", "an 1 d 1 0 t", "i-d-i-o-t", "I D I O T"))
    assert toxicity.decode([""], letters) == [""]


def test_letters_against_plain_counts(docs, letters):
    """Interpolated probabilities sum to one, and follow the recursion on plain counts."""
    counts = collections.Counter()
    for _, t in [*rows_of(docs), *[(0, TOXIC)] * 50]:
        s = [0]
        for c in (t or "").lower():
            symbol = ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0
            if symbol or s[-1]:
                s.append(symbol)
                start = max(k for k in range(len(s) - 1) if s[k] == 0)
                own = ([0] * 4 + s[start:])[-5:]
                counts[tuple(own)] += 1
        if s[-1]:
            start = max(k for k in range(len(s)) if s[k] == 0)
            counts[tuple(([0] * 4 + s[start:] + [0])[-5:])] += 1

    def p(context, letter):
        if context is None:
            return 1 / 28
        own = [(g[-1], n) for g, n in counts.items() if g[4 - len(context) : 4] == context]
        total, kinds = sum(n for _, n in own), len({x for x, _ in own})
        lower = p(context[1:] if context else None, letter)
        return (sum(n for x, n in own if x == letter) + kinds * lower) / (total + kinds) if total else lower

    code = lambda g: sum(x * 28**k for k, x in enumerate(reversed(g)))
    for context in ((0, 0, 0, 0), (0, 0, 0, 20), (0, 19, 20, 21), (20, 8, 5, 18), (26, 26, 26, 26)):
        assert abs(sum(math.exp(letters.of(code(context), x)) for x in range(28)) - 1) < 1e-4
        assert all(abs(math.exp(letters.of(code(context), x)) - p(context, x)) < 1e-5 for x in (0, 1, 5, 20))


def test_viterbi_against_all_readings(letters):
    def best(token):
        scores = {}
        for path in itertools.product(*[[(x, s, c) for x, s, c in readings] + ([(None, None, skip)] if skip is not None else []) for readings, skip in toxicity.lattice(token)]):
            symbols = [s for _, s, _ in path if s is not None]
            score, context = sum(c for _, _, c in path), [0] * 4
            for s in [*symbols, 0]:
                score += letters.of(sum(x * 28**k for k, x in enumerate(reversed(context))), s)
                context = [*context[1:], s]
            word = "".join(x for x, s, _ in path if s is not None)
            scores[word] = max(score, scores.get(word, -math.inf))
        return scores

    for token in ("1d!0t", "5+*p", "c|0wn", "a.b-c", "h3110", "$1", "!diot!", "aabbcc", "stuuup", "*5$$$", "|l1!", "é4é"):
        scores = best(token)
        assert abs(scores[toxicity.decode([token], letters)[0]] - max(scores.values())) < 1e-4


def test_long_texts_are_cut_between_words(docs, monkeypatch):
    whole = {r.gram: r.n for r in toxicity.letter_counts(docs).collect()}
    monkeypatch.setattr(toxicity, "STEP", 40)
    assert {r.gram: r.n for r in toxicity.letter_counts(docs).collect()} == whole


def test_long_tokens_take_linear_time(letters):
    times = []
    for n in (10_000, 80_000):
        began = time.process_time()
        out = toxicity.decode_one("0*1" * (n // 3), letters)
        times.append(time.process_time() - began)
        assert len(out) >= n // 3
    assert times[1] < 8 * 2.5 * max(times[0], 0.05)


def test_table_is_what_its_parts_say(letters):
    rng = np.random.default_rng(5)
    seen = dict(zip(letters.grams.tolist(), letters.seen.tolist()))
    less = dict(zip(letters.contexts.tolist(), letters.less.tolist()))
    for code in [*rng.integers(0, toxicity.LETTERS**toxicity.ORDER, 500).tolist(), *letters.grams[:200].tolist()]:
        context, letter = divmod(code, toxicity.LETTERS)
        p = seen.get(code, less.get(context, 0.0) + float(letters.base[code % toxicity.LETTERS ** (toxicity.ORDER - 1)]))
        assert abs(letters.of(context, letter) - p) < 1e-5


def test_doubled_letters(docs, letters):
    """The shortcut for words of one doubled letter reads as the decode does."""
    words = {w for _, t in rows_of(docs) for w in (t or "").lower().split() if w.isalpha() and toxicity.TWO.search(w)} | {"iddiot", "clowwn", "stuupid", "aa", "baa", "aab", "éé", "moronn", "llooser", "aaa"}
    assert len(words) > 500 and [toxicity.plain(w, letters) for w in words] == toxicity.decode(list(words), letters)


@pytest.mark.parametrize("sf, recall", [("sf0.01", 0.7), ("sf0.1", 0.9)])
def test_toxicity(spark, sf, recall):
    """Held-out recall; the labels of sf0.01 show 33 toxic rows, too few to learn all words from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.scored(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    clean = [r.predicted for r in out if r.held_out and toxic.get(r.doc_id) == 0]
    found = [r.predicted for r in out if r.held_out and toxic.get(r.doc_id) == 1]
    assert sum(clean) <= 0.01 * len(clean) and sum(found) >= recall * len(found)


def test_toxicity_odd(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.scored(odd, none).collect()} == {0.0}
    assert toxicity.scored(odd, none).count() == len(helpers.AWKWARD) and toxicity.scored(empty, none).count() == 0


def test_words_are_weighed_once(docs, monkeypatch):
    """A token's reading and weight are found once however many texts have it, and come to what the restored words have."""
    texts = [(r.text or "") for r in docs.select("text").limit(60).collect()]
    texts += ["Idiot, i d i o t 1d10t ... idiot! -- *** m.o.r.o.n", "", "...", "IDIOTS iddiot idiot.", "a b c d"] * 3
    codes, counts = np.unique(np.concatenate([toxicity.grams_of(t.lower()) for t in texts]), return_counts=True)
    letters, weights = toxicity.Letters(codes, counts), {"idiot": 3.0, "^idio": 2.0, "moron": 1.5, "a": 0.5}
    words = toxicity.restored(texts, letters)
    plain = [{w: (n, most) for w, n in collections.Counter(r).items() if (most := max((weights.get(x, 0.0) for x in toxicity.features(w)), default=0.0))} for r in words]
    assert toxicity.toxic_of(texts, toxicity.Judged(letters, weights)) == (plain, [len(r) for r in words])
    assert [toxicity.toxic_in(r, toxicity.Telling(weights)) for r in words] == plain
    seen, read = [], toxicity.read
    monkeypatch.setattr(toxicity, "read", lambda w, model: seen.append(w) or read(w, model))
    toxicity.toxic_of(["one two idiot."] * 50, toxicity.Judged(letters, weights))
    assert sorted(seen) == ["idiot.", "one", "two"]
    monkeypatch.setattr(toxicity, "KEPT", 2)
    assert toxicity.toxic_of(["idiot moron a", "b idiot"] * 2, toxicity.Judged(letters, weights))[1] == [3, 2] * 2


# 5 pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.public_model())


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())


RUNS = ["=" * 37, "a" * 50, "-" * 300, " " * 70 + "x", "\n\n \n", "日本語。" * 20 + "〇𠀀", "\u2581a\u2581\u2581b", "tab\there\r\nend", "x" * 2000]


def test_encoding(docs, odd, model, library):
    rows = docs.select("doc_id", "text").filter("doc_id < 12").union(odd.select(F.col("doc_id") + 100_000, "text").filter("doc_id is not null"))
    rows = rows.union(docs.sparkSession.createDataFrame([(200_000 + k, t) for k, t in enumerate(RUNS)], "doc_id long, text string"))
    found = {r.doc_id: r.ids for r in pieces.encode(rows, model).collect()}
    for i, t in rows_of(rows):
        assert found.get(i, []) == library.encode(t or ""), i
    back = {r.doc_id: r.text for r in pieces.decode_ids(pieces.encode(rows, model), model, "doc_id").collect()}
    assert all(back[i] == " " + t.replace("\u2581", " ") for i, t in rows_of(rows) if t)


@pytest.mark.parametrize("which, most", [("odd", 200_000), ("odd", 5), ("docs", 300), ("empty", 5)])
def test_pieces_report(which, most, request, model, library):
    df = request.getfixturevalue(which)
    out = pieces.report(df, model, most).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.exact) for r in out) == collections.Counter((i, len(library.encode(t or "")), True) for i, t in rows_of(df))
    # equal texts have equal checksums, others don't
    assert len({r.checksum for r in out if r.n_tokens}) == len({t for _, t in rows_of(df) if t})


@pytest.mark.parametrize("most", [200_000, 5, 0])
def test_pieces_report_ids_and_text(spark, odd, model, library, most):
    """The query itself gives each row's ids, those of the library, and the text that they decode to; words that aren't broadcast fill their gaps."""
    rows = odd.select("doc_id", "text").union(spark.createDataFrame([(200_000 + k, t) for k, t in enumerate(RUNS)], "doc_id long, text string"))
    out = pieces.report(rows, model, most).collect()
    wanted = [(i, tuple(library.encode(t or "")), " " + t.replace("\u2581", " ") if t else "", True) for i, t in rows_of(rows)]
    assert collections.Counter((r.doc_id, tuple(r.ids), r.text, r.exact) for r in out) == collections.Counter(wanted)


def test_pieces_of_rows_in_any_order(spark, docs, library, model, monkeypatch):
    """Known words go to the executors in one broadcast, not with each step's function, and no step relies on the order of rows of another."""

    def pickled(_):
        raise AssertionError("the known words were pickled with a function")

    monkeypatch.setattr(pieces.Known, "__getstate__", pickled)
    rows = docs.filter("doc_id < 200").select("doc_id", "text")
    out = pieces.report(rows.orderBy(F.rand()), model, 50).collect()
    assert {r.doc_id: r.ids for r in out} == {i: library.encode(t or "") for i, t in rows_of(rows)} and all(r.exact for r in out)


def test_pieces_steps_have_tasks_of_their_own(spark, docs, model):
    """With few other words a broadcast of their ids would put both Python steps, each with the known words, in one task."""
    plan = pieces.report(docs.select("doc_id", "text"), model)._jdf.queryExecution().executedPlan().toString()
    filled, looked_up = [k for k, line in enumerate(plan.split("\n")) if "MapInArrow" in line]
    assert any("Exchange hashpartitioning" in line for line in plan.split("\n")[filled:looked_up]), plan


def test_pieces_hold_a_bounded_volume(spark, odd, model, library, monkeypatch):
    """A task looks up and fills in words by volume, however many rows and however long texts these are in."""
    monkeypatch.setattr(pieces, "FILLED", 6, raising=False)
    texts = ["a b c", "d e f g", "", None, "h " * 7 + "h", "i", "j k"]
    shared = types.SimpleNamespace(value=vars(pieces.Known(pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))}), np.uint16)))
    frame = types.SimpleNamespace(mapInArrow=lambda run, _: run, select=lambda *_: frame)
    rows = pa.record_batch([pa.array(range(7)), pa.array([0] * 7, pa.int32()), pa.array(range(7)), pa.array(texts)], ["row", "mark", "doc_id", "text"])
    coded = pa.Table.from_batches(pieces.partly_encoded(frame, shared)(iter([rows])))
    far = pa.array([[library.encode(w.strip()) for w in (t or "").split()] or None for t in texts], pa.list_(pa.list_(pa.int32())))
    out = list(pieces.whole(frame, model, shared, 65535)(iter(coded.select(["doc_id", "n_words", "wanted", "partial"]).append_column("far", far).combine_chunks().to_batches())))
    assert [b.column(1).to_pylist() for b in out] == [[3], [4, 0, 0], [8], [1, 2]]
    assert [x for b in out for x in b.column(5).to_pylist()] == [library.encode(t or "") for t in [x and x.strip() for x in texts]]
    assert [x for b in out for x in b.column(4).to_pylist()] == [True] * 7
    for column, most, wanted in ((3, 4, [1, 1, 2, 1, 2]), (0, 9, [4, 2, 1])):
        assert [b.num_rows for b in pieces.slices(iter([rows]), column, most)] == wanted
    monkeypatch.setattr(pieces, "LOOKED_UP", 20)
    monkeypatch.setattr(pieces, "COUNTED", 20)
    found = pieces.report(odd.select("doc_id", "text"), model, 5).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), r.exact) for r in found) == collections.Counter((i, tuple(library.encode(t or "")), True) for i, t in rows_of(odd))


def test_lanes_of_words(spark, model, library):
    """Words whose lattice falls apart, long ones and short ones, are folded at once, and each on its own."""
    texts = ["a" * 700 + "7" * 5 + "é語" * 90 + "the.then/others" * 60, "x", "語", "\u0378\u0378", "=" * 40 + "a", "__init__(self):" * 300]
    found = pieces.encode_units(spark.createDataFrame([("\u2581" + t, k) for k, t in enumerate(texts)], "unit string, n long").coalesce(1), model).collect()
    assert {r.n: r.ids for r in found} == {k: library.encode(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("counts, most", [([20_000] * 20, 5), ([20_000 + 900 * k for k in range(20)], 5), ([3] * 50 + [4] * 4, 6), ([3] * 50 + [4] * 4, 54), ([7], 0), ([], 3), ([1] * 3000 + [10**9, 9999, 10_000, 10_001], 100)])
def test_known_words_have_a_bound(spark, counts, most):
    spelt = spark.createDataFrame([(k, k * 7919 % 100_003, n) for k, n in enumerate(counts)], "a long, b long, n long")
    known = [r.n for r in spelt.filter(pieces.known_words(spelt, most)).collect()]
    assert min(most, len(counts)) * 0.8 <= len(known) <= most
    assert not known or min(known) * 1.011 + 1 >= max([n for n in counts if n not in known] or [0])


def test_keys_of_words(spark):
    texts = ["one two", " lead", "trail ", "a\nb c\n\nd", "a \n b", "a  b", "\n", " ", "x\0y \0z", "\0", "p\nq", "\u2581u\u2581v w"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", pieces.words(F.col("text")).alias("w"))
    for r in df.collect():
        assert [k[1:] if k[0] == pieces.ALONE else " " + k for k in pieces.keys(r.text)] == r.w, r.text


def test_words_take_numbers_by_frequency():
    """What is shuffled of a text are its words' numbers, small ones for frequent words, whatever number of tokens they have."""
    texts = ["b a b", None, "", "b  c\nb", " a"]
    sizes, found, own = pieces.tokens(pa.array(texts))
    flat = [found[k].as_py() for k in own.tolist()]
    assert sizes.tolist() == [3, 0, 0, 4, 1] and flat == [" b", " a", " b", " b", "  c", "\n", "b", "  a"]
    raw = [" a", " b"]
    table = {"a": [xxhash.xxh64_intdigest(w, 42) for w in raw], "b": [zlib.crc32(w.encode()) for w in raw], "n": [1, 3], "ids": pa.array([[7, 8, 9], [5]], pa.list_(pa.int32()))}
    table["a"] = pa.array(np.array(table["a"], np.uint64).view(np.int64))
    known = pieces.Known(pa.table(table), np.uint16)
    (_, _, own, (number, *_)), *_ = known.looked_up(iter([pa.record_batch([pa.array(texts)], ["text"])]), 0)
    assert number[own].tolist() == [0, 1, 0, 0, 2, 2, 2, 2]
    ids, count = known.spelt(number[own])
    assert ids.tolist() == [5, 7, 8, 9, 5, 5, *[65535] * 4] and count.tolist() == [1, 3, 1, 1, 1, 1, 1, 1]


def test_every_place_has_one_allowed_token(model):
    """The fold's premise, and its path, by plain Python over random strings of pieces' parts."""
    rng = np.random.default_rng(2)
    table = {p: (rank, right, left) for p, _, rank, _, right, left in model.table()}
    parts = [p for p in table if p.isascii() and len(p) < 5]
    assert len(table) == len(model.pieces)
    for _ in range(300):
        u = "".join(rng.choice(parts, 4))
        best = [[]]
        for e in range(1, len(u) + 1):
            able = []
            for s in range(max(0, e - model.longest), e):
                if u[s:e] in table:
                    left, before = table[u[s:e]][2], best[s]
                    right = table[before[-1]][1] if before else []
                    apart = [1 for a in range(s - len(right) + 1, s) for b in range(s + 1, e + 1) if u[a:b] in table and table[u[a:b]][0] < right[s - a] and table[u[a:b]][0] <= left[b - s]]
                    able += [] if apart else [[*before, u[s:e]]]
            assert len(able) == 1, u
            best.append(able[0])
        words = list(u)
        while len(words) > 1:  # the encoder: the best merge, of equal ones the leftmost, until none is left
            rank, k = min((table[a + b][0] if a + b in table else pieces.NEVER, k) for k, (a, b) in enumerate(zip(words, words[1:], strict=False)))
            if rank == pieces.NEVER:
                break
            words[k : k + 2] = [words[k] + words[k + 1]]
        assert words == best[-1]


def test_unigram_path(spark):
    scores = {"▁a": -1.0, "a": -2.0, "b": -2.5, "▁": -3.0, "ab": -3.2, "ba": -2.2, "bab": -6.0}

    unigram = object.__new__(pieces.Model)
    unigram.pieces, unigram.bpe, unigram.bytes_at = [(p, i, s) for i, (p, s) in enumerate(scores.items())], False, 100

    def best(u):
        table = [(0.0, [])] + [None] * len(u)
        for e in range(1, len(u) + 1):
            table[e] = max((table[s][0] + scores[u[s:e]], table[s][1] + [u[s:e]]) for s in range(e) if u[s:e] in scores and table[s])
        return table[-1]

    words = ["▁abab", "▁ba", "▁babab", "▁aab", "▁", "▁aéb"]
    index = list(scores)
    out = {r.unit: r.ids for r in pieces.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), unigram).collect()}
    assert out.pop("▁aéb") == [0, 100 + 0xC3, 100 + 0xA9, 2]
    for u, ids in out.items():
        assert abs(sum(scores[index[i]] for i in ids) - best(u)[0]) < 1e-9 and "".join(index[i] for i in ids) == u


# 6 personal data


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_base_spans(which, request):
    df = request.getfixturevalue(which)
    expected = collections.Counter()
    for i, t in rows_of(df):
        spans = helpers.base_spans(t)
        counts = [sum(s.startswith(k + ":") for s in spans) for k in helpers.BASE]
        expected[i, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    out = pii.report(df).collect()
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == expected
    assert all(not r.spans.startswith("term") or r.n_email + r.n_ip + r.n_card + r.n_phone for r in out)


def test_disclosing_terms(spark):
    rows = [(i, f"common words number {i} here", "") for i in range(200)]
    rows += [(1000 + i, f"{['alpha', 'bravo', 'charlie', 'delta', 'echoes'][i]} says Quimby Smith wrote to me q@mail.example.com about common words", "") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.spans for r in pii.report(df).collect()}
    text = rows[-1][1]
    assert f"term:{text.index('Quimby')}:{text.index('Quimby') + 6}" in out[1004].split(",") and all("term" not in out[i] for i in range(200))
    assert not any(f"term:{text.index('common')}:" in s for s in out[1004].split(","))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Quimby" not in clean[1004] and "[EMAIL]" in clean[1004] and "common words" in clean[1004] and clean[3] == rows[3][1]


def plain_disclosure(rows):
    """All spans of each text by counting, over distinct texts, every pair of an entity and a term near it."""
    texts = {t or "" for _, t in rows}
    base = {t: [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in helpers.base_spans(t)] for t in texts}
    words = lambda x: [w.lower() for w in re.findall(r"[^\W\d_]+", x)]
    holds = {t: set(words(t)) for t in texts}
    near, of = collections.defaultdict(set), collections.defaultdict(set)
    for t in texts:
        for kind, a, b in base[t]:
            e = f"{kind}:{t[a:b].lower()}"
            of[e].add(t)
            for w in words(t[:a])[::-1][:8] + words(t[b:])[:8]:
                if len(w) >= 4:
                    near[e, w].add(t)
    strong, n = collections.defaultdict(dict), len(texts)
    for (e, w), own in near.items():
        if len(own) >= 3 and len(of[e]) < n:
            pmi = math.log2(len(own) / len(of[e]) / (sum(w in h for h in holds.values()) / n))
            if (s := min(1.0, pmi / -math.log2(len(of[e]) / n))) >= pii.GENERALISE:
                strong[e][w] = s
    out = {}
    for t in texts:
        told = {w for kind, a, b in base[t] for w in strong[f"{kind}:{t[a:b].lower()}"]}
        more = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]+", t) if m.group().lower() in told and not any(a < m.end() and m.start() < b for _, a, b in base[t])]
        out[t] = ",".join(helpers.base_spans(t) + more)
    return out


@pytest.mark.parametrize("copies, few", [(1, 1_000_000), (40, 1_000_000), (40, 0)])
def test_disclosure_against_counting(spark, monkeypatch, copies, few):
    """Copies of a text change neither what discloses nor what is found."""
    monkeypatch.setattr(pii, "FEW_TEXTS", few)
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "zu") for b in ("ren", "tal", "vos") for c in ("da", "pe", "shi")]
    names = [f"{x}name" for x in ("quin", "zelda", "orso", "yara", "wim")]
    rows = []
    for k in range(150):
        w = rng.choice(vocabulary, 30).tolist()
        if k % 3 == 0:
            who = k // 3 % 5
            w[10:10] = [names[who].title() if k % 2 else names[who], f"user{who}@mail.example.com", *(["+49 30 901820"] if k % 5 == 0 else [])]
            w[25:25] = [names[who], *([f"10.0.0.{who}"] if k % 4 == 0 else [])]
        rows += [(k, " ".join(w))] * (copies if k % 3 == 0 else 1)
    expected = plain_disclosure(rows)
    out = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert collections.Counter((r.doc_id, r.spans) for r in out) == collections.Counter((i, expected[texts[i]]) for i, _ in rows)
    assert sum("term" in s for s in expected.values()) == 50


@pytest.mark.parametrize("length", [300, 330, 5000])
def test_words_around_long_ones(spark, length):
    """A word counts as one however long it is, and what a window cuts is no term."""
    rows = [(i, f"common words number {i} here", "") for i in range(100)]
    rows += [(1000 + i, f"{x} gammaword {'y' * length} me@mail.example.com {'z' * length} deltaword {x}", "") for i, x in enumerate(("one", "two", "three", "four"))]
    rows = [(i, t) for i, t, _ in rows]
    expected = plain_disclosure(rows)
    out = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: expected[t] for i, t in rows}
    at = rows[-1][1].index("gammaword"), rows[-1][1].index("deltaword")
    assert all(f"term:{k}:{k + 9}" in out[1003] for k in at)


def test_disclosure_clashing_names(spark):
    rows = [(1, "a@b.example.com", "k", "t", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _told string, _spans string, key string").select("*", *[F.lit("clash").alias(c) for c in ("spans", "row", "t", "base", "told", "n")])
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.first() == (1, "[EMAIL]", "k", "t", "s", "x", *["clash"] * 6)
    good = quality.keep_good(df.select("*", F.lit("s").alias("source"), F.lit("clash").alias("_host"), F.lit("clash").alias("_salt")).withColumn("text", F.lit(" ".join(f"word{k}" for k in range(60)))))
    assert good.first()["_host"] == good.first()["_salt"] == "clash"


# 7 token scan


@pytest.mark.parametrize("block", [1 << 19, 1000, 7, 1])
def test_token_scan(spark, odd, tmp_path, block, monkeypatch):
    monkeypatch.setattr(token_scan, "FILE_BYTES", 2_000)
    path = str(tmp_path / "tokens")
    token_scan.write_tokens(odd.repartition(2), path)
    files = list(Path(path).rglob("part-*"))
    assert len(files) > 2 and all(f.stat().st_size <= 2_000 for f in files)
    out = token_scan.scan(spark, path, block=block, keyed=True).collect()
    for f in files:
        ends = np.flatnonzero(np.fromfile(f, "<u2") == 0)
        starts = np.append(0, ends[:-1] + 1)[: len(ends)]
        assert sorted((r.document, r.start, r.n_tokens) for r in out if r.file == f"{f.parent.name}/{f.name}") == [(i, s, e - s - token_scan.KEY) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]
    assert collections.Counter((r.doc_id, r.n_tokens) for r in out) == collections.Counter((i, len((t or "").encode().split())) for i, t in helpers.AWKWARD)


def test_a_long_text_shares_a_file(spark, tmp_path, monkeypatch):
    """One long text among 500 short ones doesn't split all files; one beyond FILE_BYTES has a file of its own."""
    monkeypatch.setattr(token_scan, "FILE_BYTES", 1 << 20)
    rows = [(k, "word " * (200_000 if k == 250 else 700_000 if k == 400 else 5)) for k in range(501)]
    path = str(tmp_path / "tokens")
    token_scan.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path)
    assert len(list(Path(path).rglob("part-*"))) == 3
    out = token_scan.scan(spark, path, keyed=True).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ended) for r in out) == [(k, t.count(" "), True) for k, t in rows]


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_token_counts(which, request):
    df = request.getfixturevalue(which)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ended) for r in token_scan.counted(df).collect())
    assert got == collections.Counter((i, len((t or "").encode().split()), True) for i, t in rows_of(df))


def test_doc_ids_as_tokens():
    for i in (None, 0, 1, -1, 65_534, 65_535, 2**63 - 1, -(2**63)):
        tokens = np.frombuffer(token_scan.key_tokens(i), "<u2")
        assert len(tokens) == token_scan.KEY and tokens.min() > 0 and token_scan.doc_id_of(tokens) == i


def test_token_scan_open_end(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(np.array([5, 0, 0, 7, 8], "<u4").tobytes())
    out = token_scan.scan(spark, str(tmp_path), width=4, block=2).collect()
    assert sorted((r.document, r.start, r.n_tokens, r.ended) for r in out) == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 2, False)]


# 8 SimHash


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    fps = [(i, helpers.simhash(t)) for i, t in rows_of(df)]
    least = helpers.components(fps)
    got = collections.Counter((r.doc_id, r.fp & 2**64 - 1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == collections.Counter((i, f, least[f]) for i, f in fps)


def test_simhash_plans_and_splits(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    values = {centre}
    for _ in range(400):
        v = int(rng.choice(list(values)))
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    values |= {int(x) for x in rng.integers(0, 2**63, 200, dtype=np.uint64)}
    expected = helpers.components([(i, v) for i, v in enumerate(sorted(values))])
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    for parts in ([(list(range(k, 64, 5)), 0) for k in range(5)], [(list(range(22)), 1), (list(range(22, 43)), 1), (list(range(43, 64)), 0)]):
        edges = simhash.links(simhash.split_large(simhash.probes(fps, parts), 20)).collect()
        root = {v: v for v in values}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = a & 2**64 - 1, b & 2**64 - 1
            assert (a ^ b).bit_count() <= 4
            root[find(a)] = find(b)
        assert len({find(v) for v in values}) == len(set(expected.values()))


def test_simhash_thresholds():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (500, 64))
    for n in (10**3, 10**6, 10**10):
        parts = simhash.plan(n, ((x.T @ x) * (n / 500)).astype(np.int64))
        assert sum(t + 1 for _, t in parts) == simhash.RADIUS + 1
        assert len({b for p, _ in parts for b in p}) == sum(len(p) for p, _ in parts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a long, b long").filter("a <> b")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 150, 200)} == {100}


# 9 quality rules


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_quality(which, request):
    df = request.getfixturevalue(which)
    expected = collections.Counter()
    for i, t in rows_of(df):
        q = helpers.quality(t)
        expected[i, *q, q[0] < 50 or 100 * q[4] > 50 * q[0]] += 1
    out = quality.judged(df).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == expected
    assert all(r.kept == (not r.base_failed and r.host_rate < quality.HOST_RATE) for r in out)


def test_host_rates(spark):
    rows = spark.createDataFrame([(h, i < f) for h, n, f in (("a", 100, 10), ("b", 100, 90), ("c", 2, 2), (None, 50, 5)) for i in range(n)], "host string, any_failed boolean")
    rates = {r.host: r.rate for r in quality.host_rates(rows).collect()}
    n, f = np.array([100, 100, 2, 50]), np.array([10, 90, 2, 5])
    m = f.sum() / n.sum()
    k = m * (1 - m) / ((f * f / n).sum() / n.sum() - m * m) - 1
    assert np.allclose([rates["a"], rates["b"], rates["c"], rates[None]], (f + m * k) / (n + k)) and rates["c"] < 1
    assert quality.keep_good(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("few", [10_000, 0])
def test_rejected_hosts(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW_HOSTS", few)
    text = " ".join(f"word{i}" for i in range(60))
    # documents of `odd` pass both rejecting rules, but nearly all fail one that speaks of the host only
    strange = " ".join(f"{'averylongwordindeed' * 2}{i}" for i in range(60))
    rows = [(i, "short" if h == "bad" and i % 20 else strange if h == "odd" and i % 20 else text, h) for h in ("bad", "good", "odd", None) for i in range(200)]
    out = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert collections.Counter(r.source for r in out) == {"good": 200, None: 200} and out[0].asDict().keys() == {"doc_id", "text", "source"}


# 10 substring dedup


def xx(text):
    return xxhash.xxh64_intdigest((text or "").encode(), 42) ^ 1 << 63  # in the order of signed longs


def plain_cuts(text):
    """Ends of the chunks, by sums of the gear's values and comparison with all characters near."""
    gear, n = [], len(text)
    for i in range(1, 257):
        x = i * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        gear.append(x ^ x >> 31)
    value = [(sum(gear[ord(text[i - j]) % 256] << j for j in range(min(16, i + 1))) % 2**64) >> 40 for i in range(n)]

    def greatest(places):
        held = set(places)
        near = lambda i: [j for j in range(i - 19, i + 20) if j in held and j != i]
        return [i + 1 for i in places if all(value[j] < value[i] or value[j] == value[i] and j > i for j in near(i))]

    ends = greatest([i for i in range(n) if text[i] <= " " and value[i] % 2])
    bounds = [0, *ends, n]
    for a, b in zip(bounds, bounds[1:]):
        if b - a > 128:
            ends = ends + greatest(range(a + 64, b - 64))
    out, last = [], 0
    for e in [*sorted(ends), n]:
        while e - last > 512:
            last += 512
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return out


def test_cuts_by_hand(docs):
    for _, t in [r for r in rows_of(docs) if len(r[1] or "") < 4000][:60] + helpers.AWKWARD + [(0, "漢字かな交じり文" * 90), (0, "ab" * 700)]:
        assert chunks.chunk_digests(t or "")[0] == plain_cuts(t or "")


def plain_chunks(rows):
    """Spans of each (doc_id, text): every chunk compared with all before it, runs of neighbours merged."""
    seen, dup = {}, collections.defaultdict(set)
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, xx(r[1]))):
        last = 0
        for e in plain_cuts(t or "") if len(t or "") < 1000 else chunks.cuts(np.array(list(map(ord, t)), np.uint32)):  # test_cuts_by_hand
            if seen.setdefault(t[last:e], (i, t, last)) != (i, t, last):
                dup[i, t].add((last, e))
            last = e
    out = {}
    for row, own in dup.items():
        merged = []
        for a, b in sorted(own):
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        out[row] = [s for s in merged if s[1] - s[0] >= chunks.RUN]
    return {row: s for row, s in out.items() if s}


def test_chunks_cover_texts(docs):
    for _, t in rows_of(docs) + helpers.AWKWARD:
        ends, _ = chunks.chunk_digests(t or "")
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(t or "")


SHARED = [(5, "a short text of its own"), (5, f"{helpers.PASSAGE} first under five"), (None, f"without id {helpers.PASSAGE}"), (None, f"none either {helpers.PASSAGE} x"), (None, "alone"), (3, "y" * 900), (4, "y" * 900)]


@pytest.mark.parametrize("which", ["docs", "odd", "empty", "shared"])
def test_substrings(which, request, spark):
    df = helpers.frame(spark, SHARED) if which == "shared" else request.getfixturevalue(which)
    rows = rows_of(df)
    expected = plain_chunks(rows)
    want = lambda i, t: ",".join(f"{a}:{b}" for a, b in expected.get((i, t), []))
    out = chunks.report(df.repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.spans) for r in out) == collections.Counter((i, len(t or ""), want(i, t)) for i, t in rows)
    assert all(r.dup_chars == sum(b - a for a, b in (map(int, s.split(":")) for s in r.spans.split(",") if s)) for r in out)


def test_cut_texts(spark, odd):
    cut = {r.doc_id: r.text for r in chunks.dedup_substrings(odd).collect()}
    assert "word7 of the passage" in cut[8] and "word7 of the passage" not in cut[9] and cut[9].startswith("begin other") and cut[9].endswith("end two")
    clash = helpers.frame(spark, SHARED).select("*", *[F.lit("clash").alias(c) for c in ("_id", "_spans", "spans", "row", "th", "own", "id", "start")])
    out = chunks.dedup_substrings(clash)
    assert out.columns == clash.columns and {r["spans"] for r in out.collect()} == {"clash"}
    texts = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert texts[5, SHARED[0][1]] == texts[5, SHARED[1][1]] == texts[None, "alone"] == 1
    assert sum(i is None and helpers.PASSAGE not in t for i, t in texts) == 3


def test_passages_without_blanks():
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n)))
    found = collections.Counter()
    for _ in range(100):
        for n in (200, 300, 400):
            shared = word(n)
            a, b = set(chunks.chunk_digests(word(300) + shared + word(300))[1]), chunks.chunk_digests(word(401) + shared + word(77))
            known = sum(e - s for s, e, d in zip([0, *b[0]], b[0], b[1], strict=False) if d in a)
            found[n] += known >= chunks.RUN
    assert found[200] >= 80 and found[300] >= 97 and found[400] >= 99
    sizes = np.diff([0, *chunks.cuts(np.array(rng.integers(0x4E00, 0x9FA5, 20000), np.uint32))])
    assert 30 < sizes.mean() < 50


def test_shift():
    text = helpers.PASSAGE * 3
    a, b = set(chunks.chunk_digests(text)[1]), set(chunks.chunk_digests("inserted " + text)[1])
    assert len(a & b) >= len(a) - 2


# the pipeline


def test_pipeline(spark, docs, tmp_path):
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        rows = rows_of(kept)
        out = stage(spark, kept, SF)
        if name == "quality":
            ids = {i for i, t in rows if not ((q := helpers.quality(t))[0] < 50 or 100 * q[4] > 50 * q[0])}
            assert {r.doc_id for r in out.collect()} == ids
        elif name == "near_duplicates":
            assert {r.doc_id for r in out.collect()} == {i for i, least in plain_groups(rows).items() if i == least}
        elif name == "repeated_passages":
            spans = plain_chunks(rows)
            for r in out.collect():
                text = dict(rows)[r.doc_id]
                for a, b in reversed(spans.get((r.doc_id, text), [])):
                    text = text[:a] + text[b:]
                assert r.text == text and r.n_chars == len(text)
        elif name == "personal_data":
            assert all(not helpers.base_spans(r.text) for r in out.collect())
        if name != "packing":
            assert out.columns == docs.columns
            kept = out
    assert {r.doc_id for r in out.collect()} == {i for i, _ in rows} == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}


def test_pipeline_odd(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df.withColumn("text", F.when(F.col("doc_id") != 4, F.col("text"))), SF)
            assert out.count() <= df.count()


def plain_groups(rows):
    """The smallest id of each row's group, by comparing all pairs of sets."""
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in rows for w in [t.lower().split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [4096, 3])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    line, texts = word(40), []
    for k in range(60):
        base = word(int(rng.integers(50, 200))) + (line if k % 2 else [])
        texts.append(" ".join(base))
        for edits in range(1, 30 if k == 0 else 6):  # Jaccard from 0.98 down to 0.6
            copy = list(base)
            for at in rng.choice(len(base), edits, replace=False):
                copy[at] = word(1)[0]
            texts.append(" ".join(copy))
    rows = list(enumerate(rng.permutation(texts).tolist()))
    out = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = {i for i, least in plain_groups(rows).items() if i == least}
    assert 60 < len(expected) < 300 and sorted(r.doc_id for r in out.collect()) == sorted(expected)


@pytest.mark.parametrize("far", [-1, 6])
def test_near_copies_beyond_sketches(spark, monkeypatch, far):
    """Pairs whose sketches differ too much are found all the same."""
    monkeypatch.setattr(near_copies, "FAR", far)
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(20, 150)))]
        for edits in range(5):
            texts.append(" ".join([f"new{rng.integers(0, 99)}" if k in rng.choice(len(base), edits, replace=False) else w for k, w in enumerate(base)]))
    rows = [*enumerate(texts), (900, ""), (901, "one"), (902, "one two"), (903, "one two three four five six"), (904, "one two three four five six seven")]
    out = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, least in plain_groups(rows).items() if i == least)


def test_near_copies_frequent_in_any_table(spark, monkeypatch):
    """What counts as frequent doesn't grow with the table beyond the sample; the rarest come first."""
    monkeypatch.setattr(near_copies, "SAMPLE", 100)
    line, other = ([f"{x}{k}" for k in range(12)] for x in ("line", "other"))
    rows = [(i, " ".join([*(f"own{i * 40 + k}" for k in range(20)), *(line if i % 10 < 2 else []), *(other if i % 5 < 2 else [])])) for i in range(1000)]
    known, places = near_copies.frequent(spark.createDataFrame(rows, "doc_id long, text string"))
    lines, others = (near_copies.shingles(" ".join(x)) for x in (line, other))
    assert np.isin(lines, known).all() and np.isin(others, known).all()
    assert places[np.isin(known, lines)].max() < places[np.isin(known, others)].min()
    own = near_copies.shingles(rows[0][1])
    assert not np.isin(near_copies.prefix(own, (known, places)), known).any()


def test_cut_lets_shuffle_files_go(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {x for x in disk.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    before = names()
    assert len(common.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).collect()) == 7
    for _ in range(50):
        if names() <= before:
            break
        time.sleep(0.2)
    assert names() <= before


def test_few_links_take_one_task(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long").repartition(4, "a")
    out = simhash.components(edges)
    assert {(r.node, r.root) for r in out.collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)} and out.count() == 43


def test_pipeline_drops_edited_copies(spark):
    base = [f"w{k * k % 997}" for k in range(150)]
    edited = [f"new{k}" if k in (40, 90) else w for k, w in enumerate(base)]
    other = [f"w{k * k % 991 + 7}" for k in range(150)]
    rows = [(i, " ".join(w), "en", "a", 0) for i, w in enumerate((base, edited, other))]
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_near_copies_without_ids(spark):
    one, two, three = (" ".join(f"{x}{k * k % 97}" for k in range(60)) for x in "abc")
    rows = [(None, one), (None, one), (None, two), (7, three), (7, three), (None, three), (9, three + " end"), (None, None), (None, "")]
    out = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in out) == sorted([("None", one), ("None", two), ("7", three), ("7", three), ("None", "")])


def test_near_copies_odd_rows(odd):
    kept = collections.Counter((r.doc_id, r.text) for r in near_copies.drop_near_copies(odd).collect())
    assert {i for i, _ in kept} == {None, 1, 4, 6, 8, 10, 11, 12, 13, 14, 15}  # 9 has the passage of 8
    assert kept[(None, "no id at all")] == 1 and (None, None) not in kept and (7, "tie " * 60) not in kept


def test_lookup_salts(spark):
    left = spark.createDataFrame([(i, 1 if i < 900 else i) for i in range(1000)], "doc_id long, k long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    out = common.lookup(left, right, "k", "doc_id", 1000).collect()
    assert len(out) == 1000 and all(r.v == r.k * 2 for r in out)


def test_no_folder_on_a_cluster():
    class Context:
        master = "spark://a:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.shared_folder(Session())
