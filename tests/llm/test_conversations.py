"""Repaired conversations against an exhaustive search and a plain version of the query."""

import heapq
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from scalefold.llm import conversation_queries, conversations
from tests.llm.samples import same_rows

SPACES = " \t\n\x0b\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def forced(state):
    return "a" if state == "u" else "u"


def cheapest(rows):
    """Cost and least audit of rows (initial, fault) by a shortest-path search over (cost, audit)."""
    queue = [(0, "", 0, "")]
    seen = set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        heapq.heappush(queue, (cost + 5, audit + "I", i, forced(state)))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if (state, initial) in NEXT:
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, NEXT[state, initial]))
            heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, forced(state)))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not text.strip(SPACES):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(SPACES)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(conv, rows):
    """The row of one conversation from its (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r))
    fault = faults([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, fault)])
    lines, left, state = [], iter(rows), ""
    for edit in audit:
        _, role, text = (None, None, "") if edit == "I" else next(left)
        if edit != "D":
            state = NEXT[state, role[:1]] if edit == "K" else forced(state)
            lines.append((role if edit == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
    digest = sha256("\n".join(lines).encode()).hexdigest()
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (conv, gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), lines


def test_costs_and_audits_of_random_codes():
    rng = random.Random(1)
    kinds = [(i, f) for i in "suao" for f in ("", "truncated", "blank")]
    for _ in range(400):
        rows = [rng.choice(kinds[:9] if rng.random() < 0.5 else kinds) for _ in range(rng.randrange(1, 14))]
        text = "".join(chr(65 + kinds.index(r)) for r in rows)
        chunks = conversations.Chunks([text])
        starts, between = chunks.run(conversations.END[None, :], keep=True)
        costs = np.array([v[0] for v in between[::-1]])
        own = np.frombuffer(text.encode(), np.uint8).astype(int) - 65
        want = cheapest(rows)
        audit, cost = conversations.traced(own, conversations.choices(own, costs), 0, True)
        assert (cost, audit) == want and starts[0][0] == want[0]


def test_ranks_converge():
    """A fix-up stops after a few rows of a usual conversation, and gives what a whole run gives."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("ADDGGEHCFI") for _ in range(n)) for n in (3000, 40, 1, 700)]
    chunks = conversations.Chunks(texts)
    old, new = np.zeros((4, 4), np.int64), np.array([[0, 10, 5, 0], [3, 0, 1, 4], [0, 10, 5, 0], [7, 7, 2, 0]])
    starts, walked = chunks.fixed(old, chunks.run(old)[0], new)
    assert (starts == chunks.run(new)[0]).all()
    assert walked[0] < 60 and walked[3] < 60


def conversation(rng, n, roles=("user", "assistant")):
    ends = (".", "!", "", " ?", "\u2028", ". \n")
    rows = []
    for i in range(n):
        role = roles[i % 2] if rng.random() < 0.7 else rng.choice(["user", "assistant", "system", "tool", "", None])
        text = rng.choice(["", " \t", None]) if rng.random() < 0.1 else f"t{rng.randrange(40)}{rng.choice(ends)}"
        rows.append((None if rng.random() < 0.05 else i + rng.randrange(3), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, pos string, conv string, fault string"


@pytest.mark.parametrize("chunk, task, passes", [(4096, 200_000, 4), (3, 200_000, 4), (3, 5, 1), (2, 5, 0)])
def test_repairs(spark, monkeypatch, chunk, task, passes):
    for name, value in (("CHUNK_ROWS", chunk), ("TASK_ROWS", task), ("PASSES", passes)):
        monkeypatch.setattr(conversations, name, value)
    rng = random.Random(3)
    held = {c: conversation(rng, rng.randrange(1, 30)) for c in range(60)}
    held[60] = [(i, "tool", f"x{i}.") for i in range(50)]  # differences that never settle
    held[61] = [(i, "user", "") for i in range(40)]
    held[62] = [(None, None, None)] * 3
    held[63] = [(1, "user", "y" * 100_000 + ".")] * 4
    held[None] = conversation(rng, 12)
    rows = [(c, *r, "a", "b", "c") for c, many in held.items() for r in many]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = {c: plain(c, many) for c, many in held.items()}
    same_rows(conversations.repairs(df), [w[0] for w in want.values()])
    lines = {}
    for r in sorted(conversations.repaired(df).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: w[1] for c, w in want.items() if w[1]}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.repairs(df).count() == 0 and conversations.repaired(df).count() == 0


def test_query_against_a_plain_version(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, *r) for c in [*range(150), None] for r in conversation(rng, rng.randrange(1, 9))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    held = {}
    for c, turn, role, text in rows:
        left = held.setdefault(c, [])
        shown = [" " if x is None else x for x in (c, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if kind == 4:
            role = "user"
        left += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = [plain(c, left)[0] for c, left in held.items()]
    same_rows(conversation_queries.op12_conversation_repair(spark, str(tmp_path)), want)


def test_query(spark):
    assert conversation_queries.op12_conversation_repair(spark, "/root/testdata/sf0.001").count() > 0
