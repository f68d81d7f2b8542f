"""Repeated strings, line chunks and benchmark windows against plain versions."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from scalefold.llm import decontaminate, lines, repeats
from scalefold.llm.text import mixed, steps, words_of
from tests.llm.samples import documents, frame, same_rows, words


def plain_cut(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [64, 1])
def test_repeated_strings(spark, monkeypatch, group):
    """Both where blocks of an anchor are sorted and where they are refined."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(8)
    rows = documents()
    line = words(rng, 60)
    rows += [(1000 + i, line[i : 150 + 7 * i] + words(rng, 20) + line[: 90 + 5 * i], None, None, 0, "", "", "", "") for i in range(25)]
    rows += [(1100, "abcdefg" * 150 + "x" + "abcdefg" * 40, None, None, 0, "", "", "", "")]
    want = plain_cut([(r[1] or "").encode() for r in rows])
    out = repeats.remove_repeats(frame(spark, rows))
    same_rows(out.drop("spans"), [(r[0], *w) for r, w in zip(rows, want)])
    assert out.filter("aggregate(spans, 0L, (n, s) -> n + s.end - s.start) <> n_removed").count() == 0
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_every_string_has_one_owner():
    texts = [(r[1] or "").encode() for r in documents()]
    p = repeats.parse(texts)
    owned = Counter((d, i) for d, a, b in zip(p.doc.tolist(), p.first.tolist(), p.last.tolist()) for i in range(a, b + 1))
    assert set(owned.values()) == {1}
    assert set(owned) == {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 199)}


def plain_chunks(text):
    """(start, body, lines) of the chunks of a text, line by line."""
    found, at = [], 0
    for line in text.split(b"\n"):
        if line:
            found.append((at, line, words_of([line], lines._NOT_NEWLINE).key[0]))
        at += len(line) + 1
    out, begin = [], 0
    for i, (start, line, key) in enumerate(found):
        before = found[i - 1][2] if i else np.uint64(0)
        with np.errstate(over="ignore"):
            roll = mixed(np.array([key * lines._BASE + before], np.uint64))[0]
        if i == len(found) - 1 or int(roll) % lines.SPREAD == 0:
            out.append((found[begin][0], text[found[begin][0] : start + len(line)], i - begin + 1))
            begin = i + 1
    return out


def plain_line_cut(rows):
    first = {}
    for doc, text in rows:
        for start, body, n in plain_chunks(text):
            if n >= 2:
                place = (doc is not None, doc, text, start)
                first[body] = min(first.get(body, place), place, key=lambda p: (p[0], p[1] or 0, p[3]))
    out = []
    for doc, text in rows:
        kept, at, gone, n_gone, removed = b"", 0, 0, 0, []
        for start, body, n in plain_chunks(text):
            if n >= 2 and first[body] != (doc is not None, doc, text, start):
                kept += text[at:start]
                at = start + len(body)
                at += text[at : at + 1] == b"\n"
                removed.append((start, at))
                gone, n_gone = gone + 1, n_gone + n
        kept += text[at:]
        out.append((doc, sum(1 for x in text.split(b"\n") if x), n_gone, gone, hashlib.sha256(kept).hexdigest(), removed))
    return out


def test_line_chunks(spark):
    rng = random.Random(4)
    common = [words(rng, 6) for _ in range(12)]
    rows = [r for r in documents() if r[0] is not None or r[1] is not None]
    for i in range(30):
        own = [words(rng, 5) for _ in range(rng.randrange(6))]
        text = "\n".join([*own, *common[i % 3 :], "", *own[:2]])
        rows.append((2000 + i, text, None, None, 0, "", "", "", ""))
    want = plain_line_cut([(r[0], (r[1] or "").encode()) for r in rows])
    assert sum(w[3] for w in want) > 20
    got = lines.remove_repeated_chunks(frame(spark, rows)).collect()
    got = [(*r[:5], [tuple(x) for x in r.removed]) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lines.remove_repeated_chunks(frame(spark, [])).count() == 0


def plain_passages(rows):
    """Brute force: every pair of neighbouring lines against every earlier one."""
    cuts, first = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        spans = [m.span() for m in re.finditer(rb"[^\n]+", text)]
        body = [text[s:e] for s, e in spans]
        gone = set()
        for i in range(len(body) - 1):
            there, k = first.setdefault((body[i], body[i + 1]), ((doc, text), i))
            if there != (doc, text) or i - k >= 2:
                gone |= {i, i + 1}
        removed = []
        for i in sorted(gone):
            if i - 1 in gone:
                removed[-1][1] = spans[i][1]
            else:
                removed.append(list(spans[i]))
        removed = [(s, e + (text[e : e + 1] == b"\n")) for s, e in removed]
        kept = b"".join(text[e:s] for (_, e), (s, _) in zip([(0, 0), *removed], [*removed, (len(text), 0)]))
        cuts[doc, text] = (len(body), len(gone), len(removed), hashlib.sha256(kept).hexdigest(), removed)
    return [(doc, *cuts[doc, text]) for doc, text in rows]


@pytest.mark.parametrize("bits", [64, 3])
def test_line_passages(spark, bits):
    """Every repeated run of two or more lines, also where unequal lines share a key."""
    rng = random.Random(4)
    common = [words(rng, 6) for _ in range(12)]
    rows = [r[:2] for r in documents() if r[0] is not None]
    for i in range(30):
        own = [words(rng, 5) for _ in range(rng.randrange(6))]
        begin = rng.randrange(10)
        rows.append((2000 + i, "\n".join([*own, *common[begin : begin + 2 + i % 5], "", *own[:2]])))
    rows += [(3000, "a\na\na"), (3001, "b\nb\nb\nb\nb"), (3002, "c\nd\nc\nd\n\nc\nd\n"), (3003, "x\n\n\ny\n"), (3004, "x\ny"), (3005, "y\nx"), (None, "p\nq"), (3006, "p\nq")]
    want = plain_passages([(doc, (text or "").encode()) for doc, text in rows])
    assert sum(w[3] for w in want) > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(*r[:5], [tuple(x) for x in r.removed]) for r in lines.remove_repeated_passages(docs, bits=bits).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lines.remove_repeated_passages(docs.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_matches(rows, items):
    windows = set()
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        k = min(10, len(w))
        windows |= {(None if item is None else str(item), tuple(w[i : i + k])) for i in range(len(w) - k + 1) if k}
    out = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    names.add(item)
        out.append((doc, len(w), len(hit), sorted(names, key=lambda n: (n is None, n or "")), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_benchmark_matches(spark, block_bytes):
    """Also where the benchmark takes several passes."""
    rng = random.Random(6)
    rows = documents()
    texts = [r[1] for r in rows if r[1] and len(r[1]) > 300]
    items = [(i, " ".join(t.split()[3 : 3 + 6 + 4 * i])) for i, t in enumerate(texts[:8])]
    items += [(20, "Two words"), (20, "one"), (21, ""), (22, None), (None, "one"), (23, words(rng, 12)), (24, texts[0].upper()), (25, "zzz qqq")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(frame(spark), bench, carry=["doc_id"], block_bytes=block_bytes)
    got = found.select("doc_id", "n_words", "n_hit", "items.item", "contaminated")
    same_rows(got, plain_matches([r[:2] for r in rows], items))
    assert decontaminate.matches(frame(spark, []), bench).count() == 0
    assert decontaminate.matches(frame(spark), bench.limit(0)).filter("contaminated").count() == 0


def test_longest_match_and_place(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"a{i}" for i in range(30)) + " y")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "q " + " ".join(f"a{i}" for i in range(4, 25)) + " z")], "item_id long, text string")
    row = decontaminate.matches(docs, bench).first()
    assert [tuple(x) for x in row["items"]] == [("5", 21, 5)] and [tuple(x) for x in row["spans"]] == [(5, 26)]


def test_suffix_array():
    rng = np.random.default_rng(1)
    codes = rng.integers(1, 4, 300)
    lengths = np.array([100, 1, 150, 49])
    room = np.concatenate([np.arange(n, 0, -1) for n in lengths])
    order = decontaminate.suffix_array(codes, room, 12)
    suffixes = [codes[i : i + min(12, room[i])].tolist() for i in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(300))


def test_items_without_an_id_and_clashing_columns(spark):
    docs = spark.createDataFrame([("alpha beta gamma delta", 1, 2, "x")], "text string, _text long, _row long, n_words string")
    bench = spark.createDataFrame([(None, "beta gamma"), (7, "delta"), (8, None)], "item_id long, text string")
    for block in (1 << 24, 3):
        row = decontaminate.matches(docs, bench, block_bytes=block).first()
        assert (row["n_hit"], row["contaminated"], [x["item"] for x in row["items"]]) == (3, True, ["7", None])
        assert (row["_text"], row["_row"]) == (1, 2)


def test_parsing_holds_little_at_once():
    rng = random.Random(12)
    texts = [rng.randbytes(40_000) for _ in range(100)]
    tracemalloc.start()
    for i, j in steps(texts, repeats._STEP):
        repeats.parse(texts[i:j])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20


def test_every_string_belongs_to_an_anchor_or_stands_alone():
    """Also texts that are empty, or as long as a string, beside others."""
    rng = random.Random(13)
    for _ in range(20):
        texts = [rng.choice([bytes(n), rng.randbytes(n), b"ab" * (n // 2)]) for n in rng.choices([0, 1, 64, 199, 200, 201, 900], k=5)]
        p = repeats.parse(texts)
        held = sorted((d, x) for d, a, b in zip(p.doc.tolist(), p.first.tolist(), p.last.tolist()) for x in range(a, b + 1))
        assert held == [(d, x) for d, t in enumerate(texts) for x in range(len(t) - repeats.LENGTH + 1)]
