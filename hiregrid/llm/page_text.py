"""HTML extraction with a suffix array per host.

Pages are cut into blocks, and their markup sorts out what it can: blocks in menus, footers, forms and the like go, and what
is left in an article (else in a main part) is a told article; on pages whose markup tells none, all blocks left are open.
Then every page is judged by repetition: the token streams of a host's pages are concatenated, a suffix array finds runs of
``RUN`` tokens, and those that stand on at least ``SHARE`` of the host's distinct pages, and on ``LEAST``, are repeated. A block
that repeated runs cover to ``COVER`` is removed as a whole; all others are kept whole, so a passage that some pages quote or
copy stays.

* Told articles are compared with the told articles of the host only, each distinct one counting once, so neither a title in
  a menu nor one article at many addresses is repeated. Headings stay, and all of an article stays if half of its tokens or
  more would go: that is a copy, not a notice within an article.
* Open blocks are compared with the open and the marked blocks of all the host's distinct pages. There a block of fewer than
  ``RUN`` tokens that stands as a whole on so many is repeated too.

The array is cut off at ``RUN`` tokens, since a longer common run is a chain of them. Spark brings the streams of a host
together, those of a host of more than ``PART`` pages in parts chosen by hash. Each task sorts the suffixes of one host's
streams by prefix doubling, a piece of ``PIECE`` pages at a time, and returns the prefixes that can be repeated: of a host in
one piece exactly those that are; of several pieces, each a sample by hash, those not eight standard deviations rarer in
it than ``SHARE``. Spark adds up the pieces. A page is parsed once for its stream and once for its text, so only streams
are shuffled and no text is written in between.

Defined results: null html is empty; a page without blocks has empty text; pages of a host with equal blocks (repeated rows, one
article at two addresses) are one page, so that they don't make each other boilerplate; pages without a host are pages of the
empty host.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.llm.hashing import Words, window_hashes
from hiregrid.llm.html_blocks import HEADING, judged_by_markup
from hiregrid.llm.support import WHITE
from hiregrid.llm.url_filter import url_parts
from hiregrid.session import materialize

RUN = 8  # tokens of a run
SHARE, LEAST = 0.5, 3  # of a host's distinct pages, and pages, that a repeated run stands on
COVER = 0.9  # of a block's tokens
JOINT = "\n\n"
TABLE = bytes(32 if byte in WHITE else byte for byte in range(256))
PART = 256  # pages of a host that one task takes
PIECE, PIECE_CHARS = 1_024, 64 << 20  # pages, and characters of their blocks, that one array holds
SLICE = 256  # rows of a batch taken at once
#: Of which pool a stream is (told articles, or other blocks), how many parts its host has, whether its page is open, and a hash of
#: what makes it distinct: the article, or the whole page.
STREAMS = "host string, told boolean, parts bigint, content bigint, open boolean, blocks array<string>"
STREAMS_ARROW = pa.schema([
    ("host", pa.string()), ("told", pa.bool_()), ("parts", pa.int64()), ("content", pa.int64()), ("open", pa.bool_()),
    ("blocks", pa.list_(pa.string()))])
PREFIXES = "host string, told boolean, prefix bigint, pages bigint"
Key = tuple[str, bool, int]  # host, told, content


def content_hash(told: bool, *parts: list[str]) -> int:
    """Of lists of blocks, which are never empty and have no line ends."""
    text = f"{told}\n\n" + "\n\n".join("\n".join(blocks) for blocks in parts)
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def page_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (host, parts, html) to ``STREAMS``: a page's other blocks, and its told article; copies in a batch once."""
    for batch in batches:
        pages, seen = set(), set()
        for at in range(0, batch.num_rows, SLICE):
            rows = []
            for host, parts, page in zip(*(column.to_pylist() for column in batch.slice(at, SLICE).columns)):
                digest = hashlib.blake2b((page or "").encode(), digest_size=16).digest()
                if (host, digest) in pages:
                    continue
                pages.add((host, digest))
                told, own, marked = judged_by_markup(page)
                texts = [text for text, _ in own]
                found = [(host, False, parts, content_hash(told, texts, marked), not told, marked if told else texts + marked)]
                if told:
                    found.append((host, True, parts, content_hash(told, texts), False, texts))
                rows += [row for row in found if row[:4] not in seen]
                seen.update(row[:4] for row in found)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(zip(*rows), STREAMS_ARROW)], schema=STREAMS_ARROW)


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` tokens, by prefix doubling; equal ranks mean equal prefixes."""
    ranks, reach = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth:
        step = min(reach, depth - reach)
        following = np.concatenate((ranks[step:], np.full(min(step, len(ranks)), -1)))
        ranks = np.unique(ranks * (len(ranks) + 1) + following + 1, return_inverse=True)[1].astype(np.int64)
        reach += step
    return ranks


class Stream:
    """The token hashes of blocks, and where each block is; a run may go on from one block to the next."""

    def __init__(self, blocks: list[str]):
        texts = [block.encode() for block in blocks]
        words = Words(b" ".join(texts), TABLE)
        self.hashes = words.hashes
        ends = np.cumsum([len(text) + 1 for text in texts], dtype=np.int64)
        self.lengths = np.bincount(np.searchsorted(ends, words.starts, side="right"), minlength=len(texts))
        self.firsts = np.cumsum(self.lengths) - self.lengths

    def runs(self) -> np.ndarray:
        return window_hashes(self.hashes, RUN)

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of fewer than ``RUN`` tokens: their numbers and hashes, which are unlike those of runs."""
        places = np.flatnonzero((self.lengths > 0) & (self.lengths < RUN))
        hashes = np.zeros(len(places), np.uint64)
        for n in np.unique(self.lengths[places]).tolist():
            of_n = self.lengths[places] == n
            hashes[of_n] = window_hashes(self.hashes, n, seed=n)[self.firsts[places[of_n]]]
        return places, hashes


def prefixes_of(pages: list[list[str]], short_too: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of one host's distinct pages, each distinct run (and short block), and on how many pages it stands."""
    streams = [Stream(blocks) for blocks in pages]
    short, on = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short_too:
        short, on = np.unique(np.concatenate([np.unique(s.short()[1]) for s in streams]), return_counts=True)
    lengths = [len(s.hashes) for s in streams]
    owner = np.repeat(np.arange(len(streams)), lengths)
    # No run goes over the end of a page.
    left = np.concatenate([np.arange(n, 0, -1) for n in lengths])
    whole = left >= RUN
    if not whole.any():
        return short, on
    tokens = np.concatenate([s.hashes for s in streams])
    order = np.argsort(suffix_ranks(tokens, RUN), kind="stable")
    order = order[whole[order]]
    prefixes = np.concatenate([np.pad(s.runs(), (0, min(len(s.hashes), RUN - 1))) for s in streams])[order]
    new = np.concatenate(([True], prefixes[1:] != prefixes[:-1]))
    starts = np.flatnonzero(new)
    # Equal prefixes stand in the order of their pages.
    pages_sorted = owner[order]
    other_page = new | np.concatenate(([True], pages_sorted[1:] != pages_sorted[:-1]))
    return np.append(short, prefixes[starts]), np.append(on, np.add.reduceat(other_page, starts, dtype=np.int64))


def counted(host: str, told: bool, streams: list[list[str]], whole: bool) -> Iterator[pa.RecordBatch]:
    """The prefixes that can be repeated, and the number of pages beside a null prefix."""
    n = len(streams)
    if whole and n < LEAST:
        return
    prefixes, on = prefixes_of(streams, short_too=not told)
    least = max(LEAST, SHARE * n) if whole else SHARE * n - 4 * n ** 0.5
    prefixes, on = prefixes[on >= least], on[on >= least]
    yield pa.RecordBatch.from_arrays([
        pa.array([host] * (len(on) + 1), pa.string()), pa.array([told] * (len(on) + 1), pa.bool_()),
        pa.array([None, *prefixes.view(np.int64).tolist()], pa.int64()), pa.array([n, *on.tolist()], pa.int64()),
    ], names=["host", "told", "prefix", "pages"])


def possible_prefixes(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``STREAMS``, sorted by host, told and content, to ``PREFIXES``."""
    streams: list[list[str]] = []
    last: Key | None = None
    any_open, chars, whole = False, 0, True

    def done() -> Iterator[pa.RecordBatch]:
        # Other blocks are only needed of hosts that have an open page, which may be in another piece.
        if streams and (last[1] or any_open or not whole):
            yield from counted(last[0], last[1], streams, whole)

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            for host, told, parts, content, is_open, blocks in zip(*(column.to_pylist() for column in batch.slice(at, SLICE).columns)):
                if last is None or (host, told) != last[:2]:
                    yield from done()
                    streams, any_open, chars, whole = [], False, 0, parts == 1
                elif (host, told, content) == last:
                    continue
                elif len(streams) >= piece or chars >= PIECE_CHARS:
                    whole = False
                    yield from done()
                    streams, chars = [], 0
                streams.append(blocks)
                any_open, chars, last = any_open or is_open, chars + sum(map(len, blocks)), (host, told, content)
    yield from done()


def unrepeated(blocks: list[tuple[str, int]], told: bool, repeated: np.ndarray) -> str:
    """The blocks that the repeated runs don't cover and that aren't repeated short blocks."""
    texts = [text for text, _ in blocks]
    if not texts or not len(repeated):
        return JOINT.join(texts)
    own = Stream(texts)
    at = np.flatnonzero(np.isin(own.runs(), repeated))
    covered = np.zeros(len(own.hashes) + 1, bool)
    for i in range(RUN):
        covered[at + i] = True
    sums = np.concatenate(([0], np.cumsum(covered)))
    gone = sums[own.firsts + own.lengths] - sums[own.firsts] >= COVER * own.lengths
    if told:
        gone &= np.array([shape != HEADING for _, shape in blocks])
        if 2 * own.lengths[gone].sum() >= len(own.hashes):
            gone[:] = False
    else:
        places, short = own.short()
        gone[places[np.isin(short, repeated)]] = True
    return JOINT.join(text for text, out in zip(texts, gone) if not out)


@F.arrow_udf(T.StringType())
def main_text(pages: pa.Array, in_articles: pa.Array, in_others: pa.Array) -> pa.Array:
    """The text of each page, given the repeated prefixes of its host's told articles and of its other blocks."""
    out = []
    for page, *repeated in zip(pages, in_articles, in_others):
        told, own, _ = judged_by_markup(page.as_py())
        prefixes = repeated[0 if told else 1].values
        out.append(unrepeated(own, told, np.array([] if prefixes is None else prefixes, np.int64).view(np.uint64)))
    return pa.array(out, pa.string())


def extract_text(pages: DataFrame, piece: int = PIECE) -> DataFrame:
    """``pages(page_id, url, html)`` to page_id, url and the main text."""
    keyed = pages.select("page_id", "url", url_parts(F.col("url"))["host"].alias("host"), "html")
    large = materialize(keyed.groupBy("host").agg(F.ceil(F.count("*") / PART).alias("parts")).where(F.col("parts") > 1), "large-hosts")
    streams = keyed.join(large, "host", "left").select("host", F.coalesce("parts", F.lit(1)).alias("parts"), "html").mapInArrow(
        page_streams, STREAMS)
    gathered = streams.repartition(F.col("host"), F.col("told"), F.pmod("content", "parts")).sortWithinPartitions("host", "told", "content")
    found = materialize(gathered.mapInArrow(partial(possible_prefixes, piece=piece), PREFIXES).groupBy("host", "told", "prefix").agg(
        F.sum("pages").alias("pages")), "page-prefixes")
    sizes = found.where(F.col("prefix").isNull()).select("host", "told", F.col("pages").alias("size"))
    repeated = found.where(F.col("prefix").isNotNull() & (F.col("pages") >= LEAST)).join(sizes, ["host", "told"]).where(
        F.col("pages") >= SHARE * F.col("size"))
    by_host = materialize(repeated.groupBy("host").agg(
        F.collect_list(F.when(F.col("told"), F.col("prefix"))).alias("in_articles"),
        F.collect_list(F.when(~F.col("told"), F.col("prefix"))).alias("in_others")), "repeated-prefixes")
    return keyed.join(by_host, "host", "left").select(
        "page_id", "url", main_text(F.col("html"), F.col("in_articles"), F.col("in_others")).alias("text"))
