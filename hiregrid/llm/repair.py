"""Conversation structure repair by depth-first branch-and-bound.

A conversation is to read ``(s?(ua)+)?`` in the initials of its roles: nothing, or pairs of user and assistant after at most one
system message. Rows are faulty if they are blank, repeat an earlier role and text, or end without a full stop; the first of
these counts. Edits, each with a cost: Keep, Rerole to user or assistant, Delete (required for blank and repeated rows), Insert
an empty user or assistant message. The cheapest edits are wanted, and of equally cheap ones those whose initials come first.

The search works on one letter per row, never on texts. Its nodes are (rows read, state of the pattern). An explicit stack
holds open prefixes; a prefix is dropped if its cost and the suffix's lower bound exceed the incumbent (cost, audit), or if the
table of its node holds a prefix no worse. The search ends when the stack is empty: then the incumbent is proved. The bounds
are the least cost of completing a suffix from each state; they are tight in cost, so the first dive finds the cost and the
rest of the search only settles audits, in time that grows with the rows.

Every conversation is cut into chunks of ``CHUNK`` rows. A chunk is summed up as a table of costs from state to state, those of
the later chunks give the bounds at its end, and it is searched for every state that an earlier chunk can leave it in; inserts
at a border belong to the later chunk. So tasks hold a chunk, or a few numbers for each chunk of a conversation, and a
conversation with very many rows is searched by many tasks. Rows are numbered by ``number_rows``, repeats found by an aggregate
and a join, and texts joined back by number. Only a digest of a whole conversation (``digests``) reads it in one task, row by row.

Defined results: rows come in order of turn (nulls first), then role and text; repeated rows are kept as repeats. Null roles and
texts count as empty, and an empty role has no initial; null conversation ids are one conversation with a null id. Any other
initial than s, u, a has to be reroled or deleted. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.operators.ranking import WINDOW_ROWS, number_rows
from hiregrid.session import materialize

CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs of the edits, and of a truncated row that is not deleted
# States of the pattern: nothing yet, after the system message, after a user's, after an assistant's. The first and last may end.
START, SYSTEM, USER, DONE = range(4)
FREE = 1 << 60  # no way
#: A row's letter: its role's initial (s, u, a, other) times three, and whether it is sound, truncated or to be deleted.
LETTERS = "abcdefghijkl"
SPACES = r"[\x20\x09-\x0D]"
ILLEGAL = "illegal"
LONG, TEXT = T.LongType(), T.StringType()
COSTS = T.ArrayType(LONG)
ENDS = T.ArrayType(T.StructType().add("chunk", LONG).add("ends", COSTS))
FOUND = T.StructType().add("illegal", LONG).add("ways", T.ArrayType(
    T.StructType().add("audit", TEXT).add("cost", LONG).add("state", T.IntegerType())))
LINKS = T.StructType().add("illegal", LONG).add("links", T.ArrayType(T.StructType().add("chunk", LONG).add("entry", T.IntegerType())))
SCRIPT = T.ArrayType(T.StructType().add("at", LONG).add("edit", TEXT).add("role", TEXT))
FOUND_ARROW = pa.struct([("illegal", pa.int64()), ("ways", pa.list_(pa.struct(
    [("audit", pa.string()), ("cost", pa.int64()), ("state", pa.int32())])))])
ENDS_ARROW = pa.list_(pa.struct([("chunk", pa.int64()), ("ends", pa.list_(pa.int64()))]))
LINKS_ARROW = pa.struct([("illegal", pa.int64()), ("links", pa.list_(pa.struct([("chunk", pa.int64()), ("entry", pa.int32())])))])
SCRIPT_ARROW = pa.list_(pa.struct([("at", pa.int64()), ("edit", pa.string()), ("role", pa.string())]))
KEY = ["conv", "none"]


@dataclass
class Repair:
    report: DataFrame  # per conversation: conv_id, blank, duplicate, truncated, illegal, cost, audit
    messages: DataFrame  # conv_id, position (from 1), role, text, edit (K, R or I), of the repaired conversations


def answer(state: int) -> int:
    """The state after the only message that may be inserted, or that a row may be reroled to."""
    return DONE if state == USER else USER


def kept_state(initial: int, state: int) -> int | None:
    """The state after a row with its own role: 0 for system, 1 user, 2 assistant, 3 any other; None if it may not follow."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 3 or (initial == 2) != (state == USER):
        return None
    return DONE if initial == 2 else USER


def edits(letter: str, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a row in a state: (edit, cost, next state), in order of the edits' initials."""
    initial, fault = divmod(LETTERS.index(letter), 3)
    ways = [("D", DELETE, state)]
    if fault < 2:
        cut = CUT * fault
        kept = kept_state(initial, state)
        if kept is not None:
            ways.append(("K", KEEP + cut, kept))
        ways.append(("R", REROLE + cut, answer(state)))
    return ways


EDITS = {letter: [edits(letter, state) for state in range(4)] for letter in LETTERS}


def with_inserts(costs: list[int]) -> list[int]:
    """Costs of completing from each state, if messages may be inserted first."""
    start, system, user, done = costs
    user, done = min(user, INSERT + done), min(done, INSERT + user)
    return [min(start, INSERT + user), min(system, INSERT + user), user, done]


def suffix_bounds(letters: str, ends: list[int] | None) -> list[list[int]]:
    """For every suffix and state the least cost of completing it; ``ends`` are those after the last row, None if none follow."""
    bounds = [with_inserts([0, FREE, FREE, 0]) if ends is None else list(ends)]
    for letter in reversed(letters):
        after = bounds[-1]
        bounds.append(with_inserts([min(cost + after[to] for _, cost, to in ways) for ways in EDITS[letter]]))
    return bounds[::-1]


def search(letters: str, entry: int, ends: list[int] | None, bounds: list[list[int]] | None = None) -> tuple[str, int, int] | None:
    """The cheapest edits from a state: (audit, their cost, state reached); equal costs with what follows by ASCII order.

    ``bounds`` may be any lower bounds on ``suffix_bounds``; weaker ones give the same result later.
    """
    rows = len(letters)
    bounds = bounds or suffix_bounds(letters, ends)
    closing = [0, FREE, FREE, 0] if ends is None else ends
    best: tuple[int, str] | None = None
    found = None
    held: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        row, state, cost, audit = stack.pop()
        known = held.get((row, state))
        if known is not None and known <= (cost, audit):
            continue
        least = cost + bounds[row][state]
        if least >= FREE or best is not None and (least > best[0] or least == best[0] and audit > best[1][:len(audit)]):
            continue
        held[row, state] = (cost, audit)
        if row == rows and cost + closing[state] < FREE and (best is None or (cost + closing[state], audit) < best):
            best, found = (cost + closing[state], audit), (audit, cost, state)
        ways = [(*way, 1) for way in EDITS[letters[row]][state]] if row < rows else []
        if row < rows or ends is None:
            ways.append(("I", INSERT, answer(state), 0))
        # The most promising last, so that it is taken first.
        ways.sort(key=lambda w: (w[1] + bounds[row + w[3]][w[2]], w[0]), reverse=True)
        stack.extend((row + step, to, cost + more, audit + edit) for edit, more, to, step in ways)
    return found


def count_illegal(letters: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    initials = ["suax"[LETTERS.index(c) // 3] for c in letters]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


@F.arrow_udf(COSTS)
def chunk_costs(letters: pa.Array) -> pa.Array:
    """The costs from each state to each state over a chunk, 16 numbers."""
    out = []
    for chunk in letters.to_pylist():
        columns = [suffix_bounds(chunk, [0 if state == to else FREE for state in range(4)])[0] for to in range(4)]
        out.append([min(columns[to][state], FREE) for state in range(4) for to in range(4)])
    return pa.array(out, pa.list_(pa.int64()))


@F.arrow_udf(ENDS)
def chunk_ends(chunks: pa.Array) -> pa.Array:
    """For the chunks of a conversation in order, (chunk, costs), the costs of all that follows from each state; null at the last."""
    out = []
    for conversation in chunks.to_pylist():
        ends, held = None, []
        for chunk in reversed(conversation):
            held.append({"chunk": chunk["chunk"], "ends": ends})
            last = ends or with_inserts([0, FREE, FREE, 0])
            ends = [min(chunk["costs"][4 * state + to] + last[to] for to in range(4)) for state in range(4)]
        out.append(held)
    return pa.array(out, ENDS_ARROW)


@F.arrow_udf(FOUND)
def search_chunks(letters: pa.Array, chunks: pa.Array, ends: pa.Array) -> pa.Array:
    """The best edits of a chunk for every state it may begin in; a first chunk begins in the first state only."""
    out = []
    for text, chunk, last in zip(letters.to_pylist(), chunks.to_pylist(), ends.to_pylist()):
        bounds = suffix_bounds(text, last)
        ways = [search(text, state, last, bounds) if chunk or state == START else None for state in range(4)]
        out.append({"illegal": count_illegal(text), "ways": [w and dict(zip(("audit", "cost", "state"), w)) for w in ways]})
    return pa.array(out, FOUND_ARROW)


@F.arrow_udf(LINKS)
def link_chunks(chunks: pa.Array) -> pa.Array:
    """For the chunks of a conversation in order, (chunk, first and last letter, states): the state each begins in, and
    how many borders have an illegal pair."""
    out = []
    for conversation in chunks.to_pylist():
        entry, links = START, []
        for chunk in conversation:
            links.append({"chunk": chunk["chunk"], "entry": entry})
            entry = chunk["states"][entry]
        borders = sum(count_illegal(a["rim"][1] + b["rim"][0]) for a, b in zip(conversation, conversation[1:]))
        out.append({"illegal": borders, "links": links})
    return pa.array(out, LINKS_ARROW)


@F.arrow_udf(SCRIPT)
def scripts(audits: pa.Array, entries: pa.Array, letters: pa.Array) -> pa.Array:
    """What the edits of a chunk leave, in order: row of the chunk (null: inserted), edit, new role (null: its own)."""
    out = []
    for audit, state, text in zip(audits.to_pylist(), entries.to_pylist(), letters.to_pylist()):
        row, left = 0, []
        for edit in audit:
            if edit == "K":
                state = kept_state(LETTERS.index(text[row]) // 3, state)
                left.append({"at": row, "edit": edit, "role": None})
            elif edit != "D":
                state = answer(state)
                left.append({"at": row if edit == "R" else None, "edit": edit, "role": "assistant" if state == DONE else "user"})
            row += edit != "I"
        out.append(left)
    return pa.array(out, SCRIPT_ARROW)


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def is_truncated(text: Column) -> Column:
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def with_faults(numbered: DataFrame) -> DataFrame:
    """Rows without texts: key, n, chunk, letter and one flag for each fault."""
    rows = numbered.select(
        *KEY, "n", F.substring("role", 1, 1).alias("initial"), F.sha2(F.concat_ws("\n", F.length("role"), "role", "text"), 256).alias("same"),
        is_blank(F.col("text")).alias("blank"), is_truncated(F.col("text")).alias("cut"),
    )
    # Texts that a conversation repeats, with their first rows; counted before the shuffle, so that a very common one is no burden.
    firsts = rows.groupBy(*KEY, "same").agg(F.min("n").alias("first"), F.max("n").alias("last")).where("first < last")
    repeats = materialize(firsts.drop("last"), "repeats")
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    duplicate = ~F.col("blank") & F.coalesce(F.col("first") < F.col("n"), F.lit(False))
    judged = rows.join(repeats, [*KEY, "same"], "left").withColumn("duplicate", duplicate).withColumn(
        "truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("cut"))
    fault = F.when(F.col("blank") | F.col("duplicate"), 2).when(F.col("truncated"), 1).otherwise(0)
    letter = F.substr(F.lit(LETTERS), 3 * role + fault + 1, F.lit(1))
    return judged.select(*KEY, "n", letter.alias("letter"), "blank", "duplicate", "truncated")


def in_order(chunk: str, *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(chunk, *columns)))


def repair(messages: DataFrame, chunk: int = CHUNK, window_rows: int = WINDOW_ROWS) -> Repair:
    """``messages(conv_id, turn, role, text)`` of bigint ids, repaired."""
    rows = messages.select(
        F.coalesce("conv_id", F.lit(0)).cast("bigint").alias("conv"), F.col("conv_id").isNull().alias("none"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = materialize(number_rows(rows, KEY, order, "n", window_rows), "numbered")
    judged = with_faults(numbered).withColumn("chunk", F.floor((F.col("n") - 1) / chunk).cast("bigint"))

    def count(fault: str) -> Column:
        return F.count_if(fault).alias(fault)

    pieces = materialize(judged.groupBy(*KEY, "chunk").agg(
        F.array_join(in_order("n", "letter")["letter"], "").alias("letters"), count("blank"), count("duplicate"), count("truncated"),
    ), "pieces")
    long = pieces.where("chunk > 0").select(*KEY).distinct()  # conversations of several chunks
    ends = pieces.join(long, KEY).select(*KEY, "chunk", chunk_costs("letters").alias("costs")).groupBy(*KEY).agg(
        in_order("chunk", "costs").alias("chunks")).select(*KEY, F.inline(chunk_ends("chunks")))
    searched = materialize(pieces.join(ends, [*KEY, "chunk"], "left").select(
        *KEY, "chunk", "letters", "blank", "duplicate", "truncated", search_chunks("letters", "chunk", "ends").alias("found")), "searched")
    rims = F.concat(F.substring("letters", 1, 1), F.substring("letters", -1, 1))
    linked = searched.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(
        "chunk", rims.alias("rim"), F.col("found.ways.state").alias("states")))).alias("chunks"))
    links = linked.select(*KEY, link_chunks("chunks").alias("l")).select(*KEY, F.col("l.illegal").alias("borders"), F.inline("l.links"))
    chosen = materialize(searched.join(links, [*KEY, "chunk"]).select(
        *KEY, "chunk", "letters", "entry", "borders", "blank", "duplicate", "truncated", "found.illegal",
        F.element_at("found.ways", F.col("entry") + 1).alias("way")), "chosen")
    conv_id = F.when(~F.col("none"), F.col("conv")).alias("conv_id")
    report = chosen.groupBy(*KEY).agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), (F.sum("illegal") + F.max("borders")).alias(ILLEGAL),
        F.sum("way.cost").alias("cost"), F.array_join(F.array_sort(F.collect_list(F.struct("chunk", "way.audit")))["audit"], "").alias("audit"),
    ).select(conv_id, "blank", "duplicate", "truncated", ILLEGAL, "cost", "audit")

    # A row left is numbered by the rows left in earlier chunks and its place in its own.
    left = chosen.select(*KEY, "chunk", F.posexplode(scripts("way.audit", "entry", "letters")).alias("place", "s")).select(
        *KEY, "chunk", "place", (F.col("s.at") + F.col("chunk") * chunk + 1).alias("n"), F.col("s.role").alias("new"), "s.edit")
    earlier = Window.partitionBy(*KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.replace("way.audit", F.lit("D")))
    before = chosen.select(*KEY, "chunk", F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias("before"))
    placed = left.join(before, [*KEY, "chunk"]).join(numbered.select(*KEY, "n", "role", "text"), [*KEY, "n"], "left")
    out = placed.select(
        conv_id, (F.col("before") + F.col("place") + 1).alias("position"), F.coalesce("new", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), "edit",
    )
    return Repair(report, out)


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines ``role:text`` of each conversation, for rows that come in order; one row at a time is held."""
    key, state = None, None
    done: list[tuple[int | None, str]] = []

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "sha256"])
        done.clear()
        return batch

    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (conv,):
                if key is not None:
                    done.append((key[0], state.hexdigest()))
                key, state = (conv,), hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield flushed()
    if key is not None:
        done.append((key[0], state.hexdigest()))
        yield flushed()


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``Repair.messages``; conversations without messages have no row."""
    ordered = messages.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.select("conv_id", "role", "text").mapInArrow(digest_rows, "conv_id bigint, sha256 string")
