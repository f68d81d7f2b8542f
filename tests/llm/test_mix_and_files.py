"""The mix, the token files and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from scalefold.llm import binary, mixing
from scalefold.llm import corpus_queries as cq
from tests.llm.samples import SCHEMA, documents, frame, same_rows, words
from tests.llm.test_pairs import near, plain_fingerprint, plain_roots
from tests.llm.test_repeats import plain_matches


def n_words(text):
    return len((text or "").encode().split())


def plain_targets(sizes, cycle, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > cap * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def sources(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += n_words(r[1])
    return sizes


def mixed_rows():
    rng = random.Random(11)
    rows = list(documents())
    for i in range(700):  # one source with most rows, many of one size
        rows.append((5000 + i, words(rng, 40 if i % 2 else rng.randrange(1, 90)), "en", "src0", 1, "", "", "", ""))
    return rows + [(9000, "", "en", "none", 0, "", "", "", ""), (9001, None, "en", "void", 0, "", "", "", "")]


def test_mix(spark):
    rows = mixed_rows()
    sizes = sources(rows)
    target = plain_targets(sizes, cq.MIX_CYCLE, 3)
    runs = []
    for parts in (5, 2):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        out = mixing.mix(docs, mixing.cycled_weights(docs, "source", cq.MIX_CYCLE), carry=["doc_id", "source"])
        runs.append(sorted((tuple(r) for r in out.drop("rate").collect()), key=str))
        got = out.collect()
    assert runs[0] == runs[1]
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], n_words(r[1])) for r in rows)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        assert 0 <= r.rate <= 3
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(longest[s] / 2, 1e-6 * target[s])


def test_rates_meet_the_targets(spark):
    docs = frame(spark, mixed_rows())
    out = mixing.mix(docs, mixing.cycled_weights(docs, "source", (1.0, 7.0)), carry=["source"]).collect()
    got, target = Counter(), {}
    for r in out:
        got[r.source] += r.rate * r["size"]
        target[r.source] = r.target
    assert all(got[s] == pytest.approx(t, rel=1e-5) for s, t in target.items())


def test_mix_of_nothing(spark):
    docs = frame(spark, [])
    assert mixing.mix(docs, mixing.cycled_weights(docs, "source", cq.MIX_CYCLE)).count() == 0


def test_whole_copies_track_the_rates():
    import pandas as pd

    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"_source": "a", "size": np.unique(rng.integers(1, 3000, 200)), "docs": 3, "rate": 0.7})
    out = mixing._whole_copies(rows, 3)
    assert abs((out["copies"] * out["size"]).sum() - (rows["size"] * 2.1).sum()) <= rows["size"].min()


def plain_ids(rows, end):
    model = Tokenizer.from_file(cq.tokenizer_file())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, start = [], 0
    for doc, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("frame_ids", [None, 500])
def test_token_files(spark, tmp_path, monkeypatch, frame_ids):
    if frame_ids:
        monkeypatch.setattr(binary, "FRAME_IDS", frame_ids)
    rows = documents() + [(7000, "<|endoftext|> Don't! ΟΔΟΣ, x?! 12a3 é ́x", None, None, 0, "", "", "", "")]
    binary.write_ids(frame(spark, rows), str(tmp_path / "ids"), cq.tokenizer_file(), 2)
    want = plain_ids([r[:2] for r in rows], 2)
    same_rows(binary.read_checksums(spark, str(tmp_path / "ids")), want)
    read = binary.read_ids(spark, str(tmp_path / "ids")).collect()
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in read]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_token_ids_of_marks_behind_other_signs():
    """Every sign and letter before every run of closing marks, against the encoding of the whole text."""
    last = [*"abz019)]}\"'%-*/+=_<>|~^&#@$§€…»”’²½éßñ日語٣İΣ", "e\u0301", "\u00a0", "'s", "<|endoftext|>", "<|"]
    marks = [".", ",", "!!", "?!", "...", ".,;:!?", ":'s", ".)", ""]
    texts = [f"Foo{x}{m} x{x}{m}\n{x}{m} y" for x in last for m in marks]
    texts += ['(see foo). He said "foo", 50%. The dogs\'. x-!', "!! foo!!! ). \". %. '."]
    model = Tokenizer.from_file(cq.tokenizer_file())
    got = binary._Tokens(cq.tokenizer_file())([t.encode() for t in texts], 2)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u2").tolist() == [*model.encode(text, add_special_tokens=False).ids, 2], text


def test_tokenizer_gets_many_words_as_one_text(monkeypatch):
    """Words of each way of encoding them, told from the ids of every word by itself."""
    rng = random.Random(5)
    signs = ["abcdefghij", "abcdefghijß\u00e9\u00ff\u00f7'", "abc019-'.,!*", "abcÀÉ日ñ\u0301\u00a0İΣ\x01\x85", "ab<|>"]
    made = ["".join(rng.choices(signs[i % 5], k=rng.randrange(1, 9))) for i in range(4000)]
    texts = [" ".join(made[k : k + 50]) for k in range(0, 4000, 50)]
    tokens, whole, given = binary._Tokens(cq.tokenizer_file()), Tokenizer.from_file(cq.tokenizer_file()), []
    ids = tokens._ids
    monkeypatch.setattr(tokens, "_ids", lambda tokenizer, texts: given.extend(texts) or ids(tokenizer, texts), raising=False)
    got = tokens([t.encode() for t in texts], 2)
    for text, own in zip(texts, got):
        assert np.frombuffer(own, "<u2").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], text
    plain = [w for w in made if not ("<|" in w or "\x01" in w)]
    assert 0 < len(given) < len(set(made)) - len(set(plain)) + len(set(plain)) / 16


def test_token_files_of_nothing(spark, tmp_path):
    binary.write_ids(frame(spark, []), str(tmp_path / "ids"), cq.tokenizer_file(), 2)
    assert binary.read_ids(spark, str(tmp_path / "ids")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 2047, 2048, 2049, 9000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 16, n), np.zeros(n, np.int64), rng.integers(0, 3, n) * 0x7FFF):
        assert (binary.decode(binary.encode(ids)) == ids).all()


def test_coder_round_trip_of_runs():
    """One id all over a block raises the same rows of counts each time, which must not overflow."""
    for id_ in (163, 164, 405, 4660, 49151):
        ids = np.full(binary.BLOCK_IDS, id_)
        assert (binary.decode(binary.encode(ids)) == ids).all()


def test_coder_learns_and_checks():
    ids = np.tile(np.arange(40) * 311, 200)
    blocks = binary.encode(ids)
    assert sum(len(b[2]) for b in blocks) < len(ids)  # half of two bytes an id
    n, crc, code = blocks[0]
    with pytest.raises(ValueError):
        binary.decode([(n, crc, code[:40] + bytes([code[40] ^ 1]) + code[41:])])


def test_coder_takes_what_the_counts_of_a_frame_allow():
    """Ids drawn one by one take their entropy; a few that repeat the ids before them take less."""
    rng = np.random.default_rng(3)
    chance = 1 / np.arange(1, 2401)
    chance /= chance.sum()
    ids = rng.choice(np.arange(2400) * 20, 1 << 16, p=chance)
    bits = -(chance * np.log2(chance)).sum()
    assert 8 * sum(len(b[2]) for b in binary.encode(ids)) < 1.15 * bits * len(ids)
    copied = np.concatenate([ids[:900], ids[:900]])
    assert sum(len(b[2]) for b in binary.encode(copied)) < 0.9 * sum(len(b[2]) for b in binary.encode(ids[:1800]))


def test_coder_of_several_frames(monkeypatch):
    monkeypatch.setattr(binary, "FRAME_IDS", 5000)
    ids = np.random.default_rng(4).integers(0, 1 << 16, 12000)
    blocks = binary.encode(ids)
    assert (binary.decode(blocks) == ids).all()
    with pytest.raises(ValueError):
        binary.decode(blocks[1:])
    n, crc, code = blocks[0]
    with pytest.raises(ValueError):
        binary.decode([(n, crc, code[:10] + bytes([code[10] ^ 1]) + code[11:]), *blocks[1:]])


def test_stages(spark):
    """Each stage against what its plain version keeps."""
    sf, cols = "/root/testdata/sf0.001", cp.COLUMNS
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(10**6, "123 456", "en", "src1", 7), (10**6 + 1, None, None, None, None)]
    docs = docs.select(cols).union(spark.createDataFrame(extra, docs.select(cols).schema))
    first = cp.language_id(spark, docs, sf)
    one = first.collect()
    assert first.columns == cols
    assert {r.doc_id for r in one} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    two = cp.simhash_near_dedup(spark, first, sf).collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in one}
    root, least = plain_roots(set(fps.values()), near(fps.values(), 4)), {}
    for doc, f in fps.items():
        least[root[f]] = min(least.get(root[f], doc), doc)
    assert sorted(r.doc_id for r in two) == sorted(least.values())
    kept = spark.createDataFrame(two, docs.schema)
    three = cp.benchmark_decontamination(spark, kept, sf).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {m[0] for m in plain_matches([(r.doc_id, r.text) for r in two], items) if not m[4]}
    assert {r.doc_id for r in three} == clean
    four = cp.source_mix(spark, spark.createDataFrame(three, docs.schema), sf)
    rows = four.collect()
    assert four.columns == cols and max(Counter(rows).values()) <= 3 and {r.doc_id for r in rows} <= clean
    five = cp.token_ids(spark, spark.createDataFrame(rows, docs.schema), sf)
    same_rows(five, plain_ids([(r.doc_id, r.text) for r in rows], cq.END_ID))


def test_mix_stage_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"w{i} b c" if i % 3 else f"w{i} b", "en", f"src{i % 3}", 5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = [Counter(cp.source_mix(spark, d, "").collect()) for d in (docs.coalesce(1), docs.repartition(6).orderBy(F.desc("doc_id")))]
    assert runs[0] == runs[1] and len(set(runs[0].values())) > 1


def test_language_stage_without_any_language(spark):
    rows = [(1, "abc 1", None, "s", 5), (2, "123 456", None, "s", 7), (3, None, None, None, None), (4, "日本", None, None, 2), (None, "x", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same_rows(cp.language_id(spark, docs, ""), [rows[0], rows[3], rows[4]])


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e", "en", "s", 1), (1, "a b c d e", "en", "s", 1), (2, "a b c d e", "en", "s", 1),
            (None, "q r s t", None, None, 0), (None, "x y z", None, None, 0), (1, "k l m n o p", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.simhash_near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "q r s t"), (0, "x y z"), (1, "a b c d e"), (1, "k l m n o p")]


def test_pipeline_runs(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_words_before_other_line_ends(spark):
    texts = ["foo \u2028", " a\u0085", "x \u2029", "y\n", "\u2028", " \t", "", None, "a b \r", " \u0085 "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(mixing.word_count("text")).collect()]
    assert got == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]


def test_ids_of_odd_pieces_equal_those_of_whole_texts():
    """Also when the word tables are thrown away all the time."""
    rng = random.Random(11)
    signs = list("abcXYZ019.,;:!?()\"'%-$ \n") + ["\u00e9", "\u0301", "<|", "|>", "\u65e5", "..", "ing", "the "]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 40))) for _ in range(3000)]
    whole = Tokenizer.from_file(cq.tokenizer_file())
    tokens = binary._Tokens(cq.tokenizer_file(), keep=50)
    for k in range(0, len(texts), 100):
        some = texts[k : k + 100]
        want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in some]
        assert [np.frombuffer(b, "<u2").tolist() for b in tokens([t.encode() for t in some], 2)] == want
