"""Conversation repair against exhaustive search, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import itertools
import random
import re

import pytest

from hiregrid.llm import repair
from hiregrid.llm.queries import QUERIES
from tests.llm.cases import sha

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, none boolean, n int, letters string, position int"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """The cheapest (cost, audit, messages), of all edits with at most two inserts at a place."""
    best = None
    faults = faults_of(rows)
    gaps = [list(itertools.chain([()], itertools.product(("user", "assistant"), repeat=1), itertools.product(("user", "assistant"), repeat=2)))]

    def walk(row, cost, audit, left):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for added in gaps[0]:
            more = left + [(role, "") for role in added]
            price, text = cost + 3 * len(added), audit + "I" * len(added)
            if row == len(rows):
                if LEGAL.match("".join(role[:1] for role, _ in more)) and all(len(r) for r, _ in more):
                    if best is None or (price, text) < best[:2]:
                        best = (price, text, more)
                continue
            walk(row + 1, price + 4, text + "D", more)
            if faults[row] not in ("b", "d"):
                cut = 3 if faults[row] == "t" else 0
                walk(row + 1, price + cut, text + "K", more + [rows[row]])
                for role in ("user", "assistant"):
                    walk(row + 1, price + cut + 3, text + "R", more + [(role, rows[row][1])])

    walk(0, 0, "", [])
    return best


def letters_of(rows):
    return "".join(repair.LETTERS[3 * ("sua".find(r[:1]) if r[:1] in ("s", "u", "a") else 3) + {"": 0, "t": 1}.get(f, 2)]
                   for (r, _), f in zip(rows, faults_of(rows)))


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "assistant", "user", "system", "tool", ""]), rng.choice(["a.", "b!", "c?", "cut", " \t", f"x{rng.random()}."]))
            for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_search_is_exhaustive(seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randint(0, 4))
    cost, audit, _ = exhaustive(rows)
    letters = letters_of(rows)
    assert repair.search(letters, repair.START, None)[:2] == (audit, cost)
    nothing = [[0] * 4] * (len(letters) + 1)  # the weakest bounds of all
    assert repair.search(letters, repair.START, None, nothing)[:2] == (audit, cost)


def plain_report(rows):
    initials = [r[:1] for r, _ in rows]
    faults = faults_of(rows)
    return faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def awkward_rows():
    rng = random.Random(8)
    rows = [(c, None if rng.random() < 0.1 else t, *m) for c in [*range(12), None] for t, m in enumerate(random_rows(rng, rng.randint(1, 4)))]
    rows += [(50, 1, "user", "long " * 40_000 + "end."), (50, 2, "assistant", None), (51, 0, None, None), (52, 5, "user", "same."), (52, 5, "user", "same.")]
    return rows


def conversations_of(rows):
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [r[2:] for r in sorted(v)] for conv, v in held.items()}


@pytest.mark.parametrize("chunk, window_rows", [(4096, 1_000_000), (1, 1_000_000), (2, 10)])
def test_repair(spark, chunk, window_rows):
    """Chunks of any size, and numbering by ranges, give the same results."""
    rows = awkward_rows()
    frame = spark.createDataFrame([(*r, "x", True, 7, "abc", 0) for r in rows], SCHEMA)
    done = repair.repair(frame, chunk, window_rows)
    report = {r["conv_id"]: r for r in done.report.collect()}
    messages = {}
    for r in done.messages.collect():
        messages.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["text"], r["edit"]))
    digests = {r["conv_id"]: r["sha256"] for r in repair.digests(done.messages).collect()}
    expected = conversations_of(rows)
    assert report.keys() == expected.keys()
    for conv, held in expected.items():
        cost, audit, left = exhaustive(held)
        row = report[conv]
        assert (row["cost"], row["audit"]) == (cost, audit)
        assert (row["blank"], row["duplicate"], row["truncated"], row["illegal"]) == plain_report(held)
        found = sorted(messages.get(conv, []))
        assert [m[1:3] for m in found] == left and [m[0] for m in found] == list(range(1, len(left) + 1))
        assert "".join(m[3] for m in found) == audit.replace("D", "")
        assert digests.get(conv, sha("")) == sha("\n".join(f"{r}:{t}" for r, t in left))


def test_one_long_conversation_in_chunks(spark):
    rng = random.Random(2)
    rows = [(1, n, *m) for n, m in enumerate(random_rows(rng, 1500))]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole, parts = (repair.repair(frame, chunk).report.collect() for chunk in (4096, 37))
    assert whole == parts and len(whole) == 1


def test_work_follows_the_rows():
    """The first dive proves the cost, so that the search of a long conversation stays linear."""
    rng = random.Random(4)
    letters = "".join(rng.choice(repair.LETTERS) for _ in range(4096))
    audit, cost, _ = repair.search(letters, repair.START, None)
    assert cost == repair.suffix_bounds(letters, None)[0][repair.START] and len(audit.replace("I", "")) == 4096


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    done = repair.repair(empty)
    assert done.report.count() == done.messages.count() == repair.digests(done.messages).count() == 0
    spark.createDataFrame([(3, 0, "user", "x."), (None, None, None, None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in QUERIES["op11_repair"](spark, str(tmp_path)).collect()}
    assert found.keys() == {3, None} and found[None]["gaps"] == 0
