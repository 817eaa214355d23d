"""Quality rules: base rules on counts of a text, and gradient-boosted trees over its statistics.

The trees are learned from labelled documents (quality 0 or 1) by logistic boosting over quantile bins. Some statistics may
only count against a text (``FALLING``): a split on one of them never gives the side of greater values the greater weight, and
the weights below each side stay on their side of the middle, so the score falls, or stays, wherever such a value grows. All
trees are flattened into one set of node arrays, and a batch of texts walks all of them at once, level by level.

Statistics are made where a text is read, of the whole text; nothing is shuffled. Learning reads the texts of at most
``LABELLED_ROWS`` labelled documents, those of the least hash of their id; that is the documented bound of what comes to the
driver, as a few numbers a document. Everything else covers all rows, and the model is a few kilobytes.

Defined results: null text counts as empty; a text without words has zeros and fails the base rules. Labels without id or
quality are not read, an id labelled twice has its least quality, and of rows that share an id one is learned from. Unless both
qualities are met nothing is learned, the score is 1 and only the base rules decide. Repeated rows get equal results; other
columns pass through. Word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.llm.hashing import Words, window_hashes
from hiregrid.llm.support import WHITE, fresh

LABELLED_ROWS = 20_000  # the most labelled documents that are learned from
WINDOW = 3  # words of a repeated window
LEAST_WORDS, MOST_REPEATED = 50, 50  # words that the base rules ask for, and the percentage of repeated ones they allow
TREES, DEPTH, BINS, RATE, SHRINK, LEAST_WEIGHT = 60, 3, 64, 0.15, 1.0, 2.0
KEEP_FROM = 0.5  # scores from here are kept

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = [
    "words_log", "word_length", "symbols", "dup_lines", "repeated", "capitals", "digits", "stops", "shouts", "distinct", "commonest",
    "line_words", "blanks", "long_words", "wordless",
]
#: Greater values may only lower the score.
FALLING = {"symbols", "dup_lines", "repeated", "shouts", "commonest"}
SIGNS = np.array([-1 if name in FALLING else 0 for name in STATISTICS])

KEEP_CASE = bytes(32 if b in WHITE else b for b in range(256))


def marked(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


SYMBOLS, CAPITALS, DIGITS = marked(b"#*$%&|<>"), marked(bytes(range(65, 91))), marked(bytes(range(48, 58)))
STOPS, SHOUTS, BLANKS = marked(b".,;:?"), marked(b"!"), marked(WHITE)
LETTERS = marked(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))

T_JUDGED = T.StructType()
for _name in COUNTS:
    T_JUDGED.add(_name, T.LongType())
T_JUDGED.add("base_failed", T.BooleanType()).add("score", T.DoubleType())
JUDGED_ARROW = pa.struct([*((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("score", pa.float64())])


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows that stand twice or more in the text."""
    windows = window_hashes(hashes, WINDOW)
    if not len(windows):
        return 0
    _, place, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.concatenate((counts[place] > 1, np.zeros(WINDOW - 1, bool)))
    covered = again.copy()
    for back in range(1, WINDOW):
        covered[back:] |= again[:-back]
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts and the statistics of a text."""
    text = text or b""
    words = Words(text, KEEP_CASE)
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(STATISTICS)
    held = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    blanks = int(held[BLANKS].sum())
    chars = len(text) - int(held[128:192].sum()) - blanks  # bytes that only continue a character are none
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
    copies = len(lines) - len(set(lines))
    symbols, again = int(held[SYMBOLS].sum()), repeated_words(words.hashes)
    kinds = np.unique(words.hashes, return_counts=True)[1]
    lengths = words.ends - words.starts
    lettered = np.concatenate(([0], np.cumsum(LETTERS[np.frombuffer(text, np.uint8)])))
    statistics = [
        np.log1p(n), chars / n, symbols / chars, copies / len(lines), again / n, held[CAPITALS].sum() / chars, held[DIGITS].sum() / chars,
        held[STOPS].sum() / chars, held[SHOUTS].sum() / chars, len(kinds) / n, kinds.max() / n, n / len(lines), blanks / len(text),
        (lengths > 15).sum() / n, (lettered[words.ends] == lettered[words.starts]).sum() / n,
    ]
    return [n, chars, symbols, copies, again], [float(s) for s in statistics]


@dataclass
class Forest:
    """Trees as node arrays: the statistic asked for (-1 at a leaf), the greatest value that goes left, both ways, the weight."""

    roots: np.ndarray
    asked: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    weight: np.ndarray
    base: float
    depth: int

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The chance of quality 1 for rows of statistics; all rows step down all trees together."""
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        each = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            asked = self.asked[at]
            lower = rows[each, np.maximum(asked, 0)] <= self.limit[at]
            at = np.where(asked < 0, at, np.where(lower, self.left[at], self.right[at]))
        return 1 / (1 + np.exp(-(self.base + self.weight[at].sum(axis=1))))


class Nodes:
    """Node arrays as they grow."""

    def __init__(self):
        self.rows: list[list[float]] = []

    def add(self, weight: float) -> int:
        self.rows.append([-1, 0.0, -1, -1, weight])
        return len(self.rows) - 1

    def forest(self, roots: list[int], base: float, depth: int) -> Forest:
        asked, limit, left, right, weight = (np.array(c) for c in zip(*self.rows)) if self.rows else (np.zeros(0),) * 5
        whole = [c.astype(np.int64) for c in (np.array(roots), asked, left, right)]
        return Forest(whole[0], whole[1], limit, whole[2], whole[3], weight, base, depth)


def best_split(bins: np.ndarray, slope: np.ndarray, bend: np.ndarray, width: int, signs: np.ndarray, low: float, high: float):
    """The split of most gain that keeps the signs: (gain, statistic, bin, weight left, weight right), or None."""
    best = None
    whole = slope.sum() ** 2 / (bend.sum() + SHRINK)
    for feature in range(bins.shape[1]):
        g = np.cumsum(np.bincount(bins[:, feature], slope, width))[:-1]
        h = np.cumsum(np.bincount(bins[:, feature], bend, width))[:-1]
        rest_g, rest_h = slope.sum() - g, bend.sum() - h
        ours, theirs = np.clip(-g / (h + SHRINK), low, high), np.clip(-rest_g / (rest_h + SHRINK), low, high)
        gain = g ** 2 / (h + SHRINK) + rest_g ** 2 / (rest_h + SHRINK) - whole
        gain[(h < LEAST_WEIGHT) | (rest_h < LEAST_WEIGHT) | (signs[feature] * (theirs - ours) < 0)] = 0
        at = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
            best = (gain[at], feature, at, ours[at], theirs[at])
    return best


def grow(nodes: Nodes, node: int, rows: np.ndarray, low: float, high: float, depth: int, learned: tuple, signs: np.ndarray) -> None:
    """Split a node's rows as deep as allowed; weights stay between ``low`` and ``high``."""
    bins, edges, slope, bend = learned
    split = best_split(bins[rows], slope[rows], bend[rows], BINS, signs, low, high) if depth and len(rows) > 1 else None
    if split is None:
        return
    _, feature, at, ours, theirs = split
    middle = (ours + theirs) / 2
    sides = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[feature])]
    lower = bins[rows, feature] <= at
    left, right = nodes.add(ours), nodes.add(theirs)
    nodes.rows[node] = [feature, edges[feature][at], left, right, 0.0]
    grow(nodes, left, rows[lower], *sides[0], depth - 1, learned, signs)
    grow(nodes, right, rows[~lower], *sides[1], depth - 1, learned, signs)


def boost(rows: np.ndarray, labels: np.ndarray, signs: np.ndarray = SIGNS) -> Forest | None:
    """Trees for rows of statistics and labels 0 or 1; None unless both labels are there. The same rows give the same trees."""
    if len(set(labels.tolist())) < 2:
        return None
    base = float(np.log(labels.mean() / (1 - labels.mean())))
    edges = []
    for column in rows.T:
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1], method="lower"))
        edges.append(np.concatenate((cuts, np.full(BINS - len(cuts), np.inf))))
    bins = np.stack([np.searchsorted(e, column) for e, column in zip(edges, rows.T)], axis=1)
    nodes, roots, total = Nodes(), [], np.full(len(rows), base)
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-total))
        root = nodes.add(0.0)
        grow(nodes, root, np.arange(len(rows)), -np.inf, np.inf, DEPTH, (bins, edges, chance - labels, chance * (1 - chance)), signs)
        for node in nodes.rows[root:]:
            node[4] *= RATE
        roots.append(root)
        tree = nodes.forest([root], 0.0, DEPTH)
        total += np.log((s := tree.scores(rows)) / (1 - s))
    return nodes.forest(roots, base, DEPTH)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pa.Array) -> pa.Array:
    return pa.array([measure(t.as_py())[1] for t in texts.cast(pa.binary())], pa.list_(pa.float64()))


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Forest | None:
    """A forest from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, of at most ``rows`` labelled documents."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    learned = texts.select("doc_id", "quality", statistics(F.col("text")).alias("s")).groupBy("doc_id", "quality").agg(F.min("s").alias("s"))
    found = sorted((r["doc_id"], r["quality"], r["s"]) for r in learned.collect())
    if not found:
        return None
    return boost(np.array([f[2] for f in found]), np.array([float(f[1] > 0) for f in found]))


def judge(docs: DataFrame, forest: Forest | None, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: the counts, base_failed, and the score (0 to 1)."""

    @F.arrow_udf(T_JUDGED)
    def judged(texts: pa.Array) -> pa.Array:
        measured = [measure(t.as_py()) for t in texts.cast(pa.binary())]
        counts = np.array([m[0] for m in measured], np.int64).reshape(-1, len(COUNTS))
        scores = forest.scores(np.array([m[1] for m in measured]).reshape(-1, len(STATISTICS))) if forest else np.ones(len(measured))
        failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
        columns = [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(scores)]
        return pa.StructArray.from_arrays(columns, fields=list(JUDGED_ARROW))

    return docs.withColumn(name, judged(F.col(text)))


def is_kept(name: str, keep_from: float = KEEP_FROM) -> Column:
    return ~F.col(f"{name}.base_failed") & (F.col(f"{name}.score") >= keep_from)


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """``docs`` without the rows that the rules or the trees reject, all columns kept."""
    name = fresh("quality", docs)
    return judge(docs, forest, name).where(is_kept(name)).drop(name)
