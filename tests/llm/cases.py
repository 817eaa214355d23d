"""Documents with every awkward case, and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_words int, digest string, hits string, judged string, id int, part int"


def awkward_texts() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(2, 7))) for _ in range(300)]
    base = [rng.choice(vocabulary) for _ in range(160)]
    texts: list[str | None] = [None, "", " \t\n", "7 7 -- !", "one", "One two three", " ".join(base), "  " + "\n".join(base) + " "]
    for edits in (1, 2, 3, 6, 12, 30):  # near copies, some within the threshold
        for _ in range(4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    passage = [rng.choice(vocabulary) for _ in range(70)]
    for _ in range(6):  # a passage that several documents share
        own = [rng.choice(vocabulary) for _ in range(90)]
        at = rng.randrange(60)
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += ["be " * 120, "BE " * 130, " ".join(passage[:49]), " ".join(rng.choices(vocabulary, k=20_000))]
    texts += [f"password = \"{'x1' * k}\" AKIA{'Z9' * k} {'0a' * k} secret=token:abcdefgh Token:=x" for k in (2, 8, 12, 20)]
    rows = [(i * 3 % 101 if i % 7 else i * 3, t) for i, t in enumerate(texts)]
    ids = random.Random(1).sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    rows += [rows[6], rows[6], (None, texts[6]), (None, None), (rows[9][0], texts[10])]  # repeated rows, null ids, one id twice
    return rows


def awkward_docs(spark):
    rows = [
        (i, t, (None, "en", "fr")[n % 3], (None, "a", "b", "B")[n % 4], n, "digest", "hits", "judged", n, n)
        for n, (i, t) in enumerate(awkward_texts())
    ]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def white_words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(A_TO_Z) if lower else text)


def shingles(text: str | None) -> set[tuple]:
    words = white_words(text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_components(rows: list[tuple]) -> dict[int, int]:
    """Per doc_id the smallest doc_id reachable."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1:]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}


def repeats(rows: list[tuple], window: int = 50) -> list[tuple]:
    last = 1 << 63
    least: dict[tuple, int] = {}
    texts = [(last if i is None else i, white_words(t, False)) for i, t in rows]
    for i, w in texts:
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            least[key] = min(least.get(key, last), i)
    out = []
    for (original, _), (i, w) in zip(rows, texts):
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        out.append((original, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def exact_groups(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), sha(text)) for m in members]
    return out


def secrets(text: str | None) -> list[tuple]:
    text, out = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for order, (kind, pattern, group, least) in enumerate((
        ("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24),
    )):
        out += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def leaks(text: str | None, items: list[tuple]) -> tuple[int, int, list[str]]:
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_TO_Z))

    own, hit, names = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9)) if w else ():
            part = w[p:p + 10]
            for q in range(len(own) - len(part) + 1):
                if own[q:q + len(part)] == part:
                    hit.update(range(q, q + len(part)))
                    names.add("" if item is None else str(item))
    return len(own), len(hit), sorted(names)


def out_of_place(text: str | None, profiles: dict[str, list[str]], top: int) -> tuple[str, float]:
    own = gram_ranks(gram_counts(text), top)
    if not own or not profiles:
        return "und", 0.0
    best = min(
        (sum(abs(r - p.index(g)) if g in p else top for r, g in enumerate(own)), lang) for lang, p in profiles.items()
    )
    return best[1], 1 - best[0] / (top * len(own))


def gram_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for word in "".join(c.lower() if c.isalpha() else " " for c in text or "").split():
        line = f" {word} "
        counts.update(word)
        counts.update(line[i:i + 3] for i in range(len(line) - 2))
    line = " ".join("".join(c.lower() if c.isalpha() else " " for c in text or "").split())
    if line:
        line = f" {line} "
        counts.update(line[i:i + 2] for i in range(len(line) - 1))
    return counts


def gram_number(gram: str) -> int:
    codes = [0 if c == " " else ord(c) for c in gram]
    if len(codes) == 1:
        return codes[0] << 42
    if len(codes) == 2:
        return -((codes[0] << 21) | codes[1])
    return (codes[0] << 42) | (codes[1] << 21) | codes[2]


def gram_ranks(counts: Counter, top: int) -> list[str]:
    return sorted(counts, key=lambda g: (-counts[g], gram_number(g)))[:top]
