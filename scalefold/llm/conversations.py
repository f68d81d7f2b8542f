"""Repair of turn structure by rank-convergence parallel Viterbi.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows are kept, given another
role, deleted or preceded by inserted empty rows at least cost. The cost to the end of the
conversation is a vector over four states (nothing yet, after system, after user, after
assistant) that runs backward over the rows. A long conversation is cut into chunks that all
start from a speculative vector. A fix-up pass gives a chunk the vector its right
neighbour has come to and walks old and new vector side by side until they differ only by
a constant: from there on nothing changes but that constant. When no vector changes any more the costs
are stitched, and the least audit is traced forward from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalefold.operators.indexing import dense_index
from scalefold.session import land

#: Rows of a chunk, and of a conversation that one task may sort.
CHUNK_ROWS = 4096
TASK_ROWS = 200_000
#: Fix-up passes; chunks that still change then, as rows of unknown roles can pass differences on
#: without end, are stitched by what they do to each of the four states.
PASSES = 4

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FAR = 1 << 40
SPACES = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted row, or one of a new role, leads to.
FORCED = np.array([USER, USER, ASSISTANT, USER])
ROLE_AFTER = {USER: "user", ASSISTANT: "assistant"}
#: A row's code is a letter: 3 x (system, user, assistant, other) + (sound, truncated, to be deleted).
INITIALS = {"s": 0, "u": 1, "a": 2}
KEPT_TO = np.array([SYSTEM, USER, ASSISTANT, START])
_allowed = np.zeros((4, 4), bool)
_allowed[0, START] = _allowed[1, [START, SYSTEM, ASSISTANT]] = _allowed[2, USER] = True
_code = np.arange(12)
KEEP_COST = np.where(_allowed[_code // 3] & (_code % 3 < 2)[:, None], TRUNCATED * (_code % 3 == 1)[:, None], FAR)
REROLE_COST = np.where(_code % 3 < 2, REROLE + TRUNCATED * (_code % 3 == 1), FAR)
#: Costs after the last row, inserts included.
END = np.array([0, 2 * INSERT, INSERT, 0])
SPECULATED = np.zeros(4, np.int64)


def step(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cost vectors before rows of ``codes``, rows inserted ahead of them included, from those after them."""
    rows = np.arange(len(codes))
    kept = KEEP_COST[codes] + after[rows, KEPT_TO[codes // 3]][:, None]
    rerole = REROLE_COST[codes][:, None] + after[:, FORCED]
    before = np.minimum(np.minimum(after + DELETE, kept), rerole)
    user, assistant = before[:, USER].copy(), before[:, ASSISTANT].copy()
    before[:, USER] = np.minimum(user, assistant + INSERT)
    before[:, ASSISTANT] = np.minimum(assistant, user + INSERT)
    before[:, :USER] = np.minimum(before[:, :USER], before[:, USER, None] + INSERT)
    return before


class Chunks:
    """Codes of several chunks, the longest first, so that at each step from the end a prefix of them goes on."""

    def __init__(self, codes: list[str]):
        size = np.array([len(c) for c in codes], dtype=np.int64)
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.table = np.zeros((int(size.max(initial=0)), len(codes)), np.int8)
        for i, at in enumerate(self.order):
            self.table[: size[at], i] = np.frombuffer(codes[at].encode(), np.uint8)[::-1] - 65
        # how many chunks have a row at each distance from the end
        self.going = np.searchsorted(-self.size, -np.arange(len(self.table)), side="left")

    def run(self, ends: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Vectors at the starts from those at the ends; with ``keep`` also all between, by distance from the end."""
        now = ends[self.order].copy()
        between = [now.copy()] if keep else []
        for codes, n in zip(self.table, self.going):
            now[:n] = step(codes[:n], now[:n])
            if keep:
                between.append(now.copy())
        out = np.empty_like(now)
        out[self.order] = now
        return out, between

    def fixed(self, old: np.ndarray, old_starts: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts for the ends ``new``, known those for ``old``, and the rows walked until both differed by a constant."""
        a, b = old[self.order].copy(), new[self.order].copy()
        shift = np.zeros(len(a), np.int64)
        done = np.zeros(len(a), bool)
        walked = np.zeros(len(a), np.int64)
        for codes, n in zip([None, *self.table], [len(a), *self.going]):
            at = np.flatnonzero(~done[:n])
            if codes is not None:
                if not len(at):
                    break
                a[at], b[at] = step(codes[at], a[at]), step(codes[at], b[at])
                walked[at] += 1
            apart = b[at] - a[at]
            same = (apart == apart[:, :1]).all(axis=1)
            done[at[same]] = True
            shift[at[same]] = apart[same, 0]
        starts = np.where(done[:, None], old_starts[self.order] + shift[:, None], b)
        out, steps = np.empty_like(starts), np.empty_like(walked)
        out[self.order], steps[self.order] = starts, walked
        return out, steps


def choices(codes: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """For each row and state the least letter on a cheapest path; ``costs[i]`` holds before row i, the last after all."""
    rows = np.arange(len(codes))
    before, after = costs[:-1], costs[1:]
    options = [
        ("D", after + DELETE),
        ("I", before[:, FORCED] + INSERT),
        ("K", KEEP_COST[codes] + after[rows, KEPT_TO[codes // 3]][:, None]),
        ("R", REROLE_COST[codes][:, None] + after[:, FORCED]),
    ]
    letter = np.zeros(before.shape, "U1")
    for name, cost in options:
        letter = np.where((letter == "") & (cost == before), name, letter)
    return letter


def traced(codes: np.ndarray, letter: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """Audit and cost from a state before the first row."""
    audit, cost = [], 0
    lines, forced, kept = letter.tolist(), FORCED.tolist(), KEPT_TO.tolist()
    for code, line in zip(codes.tolist(), lines):
        while True:
            got = line[state]
            audit.append(got)
            if got == "I":
                cost += INSERT
                state = forced[state]
                continue
            if got == "D":
                cost += DELETE
            else:
                cost += TRUNCATED * (code % 3 == 1) + REROLE * (got == "R")
                state = forced[state] if got == "R" else kept[code // 3]
            break
    while last and state in (SYSTEM, USER):
        audit.append("I")
        cost += INSERT
        state = forced[state]
    return "".join(audit), cost


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), dtype=np.int64).reshape(batch.num_rows, -1)


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width, dtype=np.int32)), pa.array(rows.ravel()))


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns.values()], names=[*kept, *columns])


def _levelled(vectors: np.ndarray) -> np.ndarray:
    return vectors - vectors.min(axis=1, keepdims=True)


def _changed(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


CHUNK_SCHEMA = "conv string, chunk long, last boolean, codes string"


def _speculated(batch: pa.RecordBatch) -> pa.RecordBatch:
    last = np.asarray(batch.column("last").to_pylist(), dtype=bool)
    ends = np.where(last[:, None], END, SPECULATED)
    starts, _ = Chunks(batch.column("codes").to_pylist()).run(ends)
    return _with(batch, used=_lists(ends), start=_lists(_levelled(starts)))


def _refitted(batch: pa.RecordBatch) -> pa.RecordBatch:
    used, new = _longs(batch, "used"), _longs(batch, "next")
    starts, _ = Chunks(batch.column("codes").to_pylist()).fixed(used, _longs(batch, "start"), new)
    return _with(batch.select([c for c in batch.schema.names if c != "next"]), used=_lists(new), start=_lists(_levelled(starts)))


def _transfers(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Costs from every state at the start to every state at the end, 16 numbers a chunk."""
    chunks = Chunks(batch.column("codes").to_pylist())
    ends = np.where(np.eye(4, dtype=bool), 0, FAR)
    tables = [chunks.run(np.tile(ends[s], (batch.num_rows, 1)))[0] for s in range(4)]
    moved = np.stack(tables, axis=2).reshape(batch.num_rows, 16)
    return _with(batch.select(["conv", "chunk", "last"]), moved=_lists(moved))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """True vectors at the ends of chunks, read from the last chunk of a conversation to its first."""
    now = END
    for batch in batches:
        moved, last, out = _longs(batch, "moved").reshape(-1, 4, 4), batch.column("last").to_pylist(), []
        for table, final in zip(moved, last):
            now = END if final else now
            out.append(now - now.min())
            now = (table + now[None, :]).min(axis=1)
        yield _with(batch.select(["conv", "chunk"]), used=_lists(np.array(out).reshape(-1, 4)))


def stitched(chunks: DataFrame) -> DataFrame:
    """``chunks(conv, chunk, last, codes)`` with ``used``, the cost vector after each chunk's last row, up to a constant."""
    schema = f"{CHUNK_SCHEMA}, used array<long>, start array<long>"
    now = land(_changed(chunks.select("conv", "chunk", "last", "codes"), _speculated, schema), "speculated")
    for _ in range(PASSES):
        right = now.filter("chunk > 0").select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("next"))
        stale = land(now.filter("not last").join(right, ["conv", "chunk"]).filter("next <> used"), "stale")
        if stale.isEmpty():
            return now
        again = land(_changed(stale, _refitted, schema), "refitted")
        now = land(now.join(again.select("conv", "chunk"), ["conv", "chunk"], "left_anti").unionByName(again), "fixed")
    right = now.filter("chunk > 0").select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("next"))
    open_ = now.filter("not last").join(right, ["conv", "chunk"]).filter("next <> used").select("conv").distinct()
    rest = land(now.join(open_, "conv", "left_semi"), "unsettled")
    moves = _changed(rest.select("conv", "chunk", "last", "codes"), _transfers, "conv string, chunk long, last boolean, moved array<long>")
    ends = moves.repartition("conv").sortWithinPartitions("conv", F.desc("chunk")).mapInArrow(_swept, "conv string, chunk long, used array<long>")
    done = rest.drop("used").join(ends, ["conv", "chunk"])
    return land(now.join(open_, "conv", "left_anti").unionByName(done.select(now.columns)), "settled")


def _audits(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Audit, end state and cost of each chunk from each state it can be entered in; the first is entered in one only."""
    codes, last, number = (batch.column(c).to_pylist() for c in ("codes", "last", "chunk"))
    chunks = Chunks(codes)
    _, between = chunks.run(_longs(batch, "used"), keep=True)
    place = np.argsort(chunks.order)
    out = []
    for i, text in enumerate(codes):
        own = np.frombuffer(text.encode(), np.uint8).astype(np.int64) - 65
        costs = np.array([v[place[i]] for v in between[len(text) :: -1]])
        letter = choices(own, costs)
        out.append([traced(own, letter, s, last[i]) for s in ([START] if number[i] == 0 else range(4))])
    audits, costs = (pa.array([[t[k] for t in o] for o in out], pa.list_(kind)) for k, kind in ((0, pa.string()), (1, pa.int64())))
    return _with(batch.select(["conv", "chunk"]), audits=audits, costs=costs)


def _keyed(conv: str) -> Column:
    return F.when(F.col(conv).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(conv).cast("string")))


def placed_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, turn, role, text, pos, fault)``: rows in order with their first fault; nulls of role and text are one space."""
    text = F.coalesce(F.col(text_col), F.lit(" "))
    own = rows.select(
        _keyed(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text")
    )
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    own = own.withColumns({
        "same": F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.col("text")), 256)),
        "blank": ended == "",
        "cut": ~F.substring(ended, -1, 1).isin(".", "!", "?"),
    })
    placed = land(dense_index(land(own, "turns"), ["conv"], ["turn", "role", "text"], "pos", TASK_ROWS), "placed")
    first = placed.groupBy("conv", "same").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    )
    return placed.join(first, ["conv", "pos"], "left").select("conv", "turn", "role", "text", "pos", fault.alias("fault"))


def _edits(placed: DataFrame) -> DataFrame:
    """Per chunk its codes, stitched and traced."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    coded = placed.select("conv", "pos", F.expr(f"pos div {CHUNK_ROWS}").alias("chunk"), F.char(65 + 3 * kind + fault).alias("code"))
    chunks = coded.groupBy("conv", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda r: r["code"]), "").alias("codes")
    )
    ends = coded.groupBy("conv").agg(F.max("chunk").alias("_last"))
    return land(chunks.join(ends, "conv").withColumn("last", F.col("chunk") == F.col("_last")).drop("_last"), "chunks")


def _stream(placed: DataFrame, traces: DataFrame) -> DataFrame:
    """Each chunk's traces ahead of its rows, conversations in order: a text is read once and none is gathered."""
    own = placed.select("conv", F.expr(f"pos div {CHUNK_ROWS}").alias("chunk"), "pos", "role", "text")
    both = own.unionByName(traces.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "chunk", "pos")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, (audit, cost) where a chunk begins, edit, role, text, old place) along a stream."""
    conv, state, letters = None, START, iter("")

    def inserted(letter: str) -> tuple:
        nonlocal state
        state = int(FORCED[state])
        return conv, None, letter, ROLE_AFTER[state], ""

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "pos", "role", "text", "audits", "costs")]
        for mine, pos, role, text, audits, costs in zip(*columns):
            if pos < 0:  # behind the last row of a conversation only inserts are left
                yield from map(inserted, letters)
                conv, state = mine, state if mine == conv else START
                at = state if len(audits) > 1 else 0
                letters = iter(audits[at])
                yield conv, (audits[at], costs[at]), None, None, None
                continue
            for letter in letters:
                if letter == "I":
                    yield inserted(letter)
                    continue
                if letter == "R":
                    state = int(FORCED[state])
                    role = ROLE_AFTER[state]
                elif letter == "K":
                    state = int(KEPT_TO[INITIALS[role[:1]]])
                yield conv, None, letter, role, text
                break
    yield from map(inserted, letters)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, audit, cost, digest, lines = None, [], 0, None, 0
    names = ["conv", "cost", "audit", "repaired_sha256"]
    out: list[tuple] = []
    for mine, chunk, edit, role, text in _replayed(batches):
        if mine != conv:
            if conv is not None:
                out.append((conv, cost, "".join(audit), digest.hexdigest()))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])
                out = []
            conv, audit, cost, digest, lines = mine, [], 0, hashlib.sha256(), 0
        if chunk is not None:
            audit.append(chunk[0])
            cost += chunk[1]
        elif edit != "D":
            digest.update((("\n" if lines else "") + role + ":" + text).encode())
            lines += 1
    if conv is not None:
        out.append((conv, cost, "".join(audit), digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "place", "edit", "role", "text"]
    conv, place, size, out = None, 0, 0, []

    def made() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for mine, chunk, edit, role, text in _replayed(batches):
        conv, place = mine, place if mine == conv else 0
        if chunk is not None or edit == "D":
            continue
        out.append((conv, place, edit, role, text))
        place += 1
        size += len(text) + 64
        if size > 1 << 22:
            yield made()
            size, out = 0, []
    if out:
        yield made()


def _traced(rows: DataFrame, columns: tuple[str, str, str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    placed = land(placed_rows(rows, *columns), "faults")
    chunks = _edits(placed)
    traces = _changed(
        stitched(chunks), _audits, "conv string, chunk long, audits array<string>, costs array<long>"
    )
    return placed, chunks, _stream(placed, traces)


def repaired(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the rows of every repaired conversation, edit K, R or I, in places from 0.

    Conversations that end without rows have none here. See ``repairs`` for what a repair is.
    """
    _, _, stream = _traced(rows, (conv_col, turn_col, role_col, text_col))
    out = stream.mapInArrow(_rewritten, "conv string, place long, edit string, role string, text string")
    names = rows.select(F.col(conv_col).alias("conv_id"), _keyed(conv_col).alias("conv")).distinct()
    return out.join(names, "conv").select("conv_id", "place", "edit", "role", "text")


def repairs(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, null turns first; rows of a turn by role and text, so any input order gives the same result.
    A null conversation is one of its own; null roles and texts count as one space.
    A row is blank (nothing but white space), else duplicate (role and text seen before), else truncated (its last
    other sign is not ``.!?``). Blank and duplicate rows have to be deleted (2), others may be kept, be given the role user or
    assistant (1) or be deleted; empty rows of these roles may be inserted anywhere (5), and a truncated row that stays adds 5. ``audit``
    names the edits of the cheapest repair in order, of several the least in ASCII. ``gaps`` counts missing
    turns and ``illegal`` neighbouring rows other than system-user, user-assistant and assistant-user, both before the repair.
    Repeated rows are rows; other columns are ignored, whatever their names; an empty table gives an empty result.

    The digest of a conversation has to be taken in order, so its rows pass through one task, as a stream; an audit is a letter a row.
    """
    placed, chunks, stream = _traced(rows, (conv_col, turn_col, role_col, text_col))
    made = stream.mapInArrow(_digested, "conv string, cost long, audit string, repaired_sha256 string")

    def many(fault: str) -> Column:
        return F.count_if(F.col("fault") == fault).alias(fault)

    turns = placed.groupBy("conv", "turn").agg(many("blank"), many("duplicate"), many("truncated"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = turns.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    # codes are three letters an initial: sound, truncated, to be deleted
    initials = F.translate("codes", "ABCDEFGHIJKL", "sssuuuaaaooo")
    after = chunks.filter("chunk > 0").select("conv", (F.col("chunk") - 1).alias("chunk"), F.substring("codes", 1, 1).alias("_next"))
    linked = chunks.join(after, ["conv", "chunk"], "left").withColumn("codes", F.concat("codes", F.coalesce("_next", F.lit(""))))
    legal = F.length(F.regexp_replace(initials, "s(?=u)|u(?=a)|a(?=u)", "")) - 1  # what is left, but for the last row
    illegal = linked.groupBy("conv").agg(F.sum(legal).alias("illegal"))
    names = rows.select(F.col(conv_col).alias("conv_id"), _keyed(conv_col).alias("conv")).distinct()
    out = names.join(counts, "conv").join(illegal, "conv").join(made, "conv")
    return out.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", F.col("illegal").cast("long").alias("illegal"), "cost", "audit", "repaired_sha256"
    )
