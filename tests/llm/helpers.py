"""Plain versions that the training-data operators are held against, and awkward rows."""

import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, component_id string, key string"
PASSAGE = " ".join(f"word{i} of the passage" for i in range(15))
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (None, "no id at all"), (None, None),
    (6, "tie " * 60), (7, "tie " * 60), (8, f"start {PASSAGE} end one"), (9, f"begin other words here {PASSAGE} and an end two"),
    (10, "x" * 5000 + " " + "é日 " * 700), (11, "a.b@mail.example.com, 1.2.3.4 and 999.1.1.1; 4111 1111 1111 1111 +1 (555) 123-4567 😀"), (12, "1-2-3 " * 400),
    (13, "a\tb\x0bc\x0cd\re f\n\nf\nf\n"), (14, "-".join(["9"] * 3000)), (15, "A" * 3000 + "@" + "b." * 2000 + "c"),
]


def frame(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else f"src{(i or 0) % 2}", len(t or ""), "clash", "clash", "clash") for i, t in rows], SCHEMA)


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    """Smallest id reachable, by (id, fingerprint); null ids link but name nothing."""
    values = sorted({f for _, f in fps})
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in values}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
