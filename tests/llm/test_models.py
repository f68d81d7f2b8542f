"""Language, toxicity and language-model scores: held-out quality and plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scalefold.llm import eliasfano, label_queries, language, lm, toxicity
from scalefold.llm import corpus_queries as cq
from tests.llm.samples import documents, frame, same_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return {r.doc_id: (r.text, r.lang, toxic.get(r.doc_id)) for r in docs}


def remainder(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def test_language_of_held_out_texts(spark, truth):
    rows = cq.op7_language(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id][1] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.98


def test_spans_of_a_mixed_text(spark):
    train = [("the cat sat on the mat with that other thing " * 5, "en"), ("der hund und die katze sind nicht zu hause " * 5, "de"),
             ("это просто русский текст для примера " * 5, "ru")]
    model = language.fit(spark.createDataFrame(train, "text string, lang string"))
    mixed = "the cat sat on the other mat und der hund ist nicht mehr zu hause это просто русский текст"
    row = language.identify(spark.createDataFrame([(mixed, 1)], "text string, lang_pred int"), model).first()
    assert row.lang_spans == "en:7 de:8 ru:4" and row.lang_pred == "de"


def test_language_of_awkward_texts(spark):
    model = language.fit(frame(spark))
    out = {(r.doc_id, r.text): r for r in language.identify(frame(spark), model).collect()}
    for (_, text), r in out.items():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert r._row in ("b", None)
    empty = language.fit(frame(spark, []))
    assert {r.lang_pred for r in language.identify(frame(spark), empty).collect()} == {"und"}
    assert language.identify(frame(spark, []), model).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    count = np.array([5, 1, 7, 3])
    start = np.cumsum(count) - count
    score = rng.normal(size=(16, 3)) * 12
    label = language._viterbi(score, start, count)
    for s, n in zip(start, count):
        def worth(path):
            return sum(score[s + i, p] for i, p in enumerate(path)) - language.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
        paths = np.stack(np.meshgrid(*[range(3)] * n), -1).reshape(-1, n)
        assert worth(label[s : s + n]) == pytest.approx(max(worth(p) for p in paths))


def test_toxicity_of_held_out_texts(spark):
    large = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    rows = label_queries.op5_toxicity(spark, large).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    assert sum(p == t for p, t in held) / len(held) > 0.98
    # some labels are noise: their texts hold no toxic word at all
    assert sum(p and t for p, t in held) >= 0.9 * sum(t for _, t in held)


def test_folding():
    assert toxicity.folded("An 1D10T, $tup1d МОRОN! 42".encode()) == " an idiot stupid moron ".encode()
    assert toxicity.folded(b"") == b"  "


def test_exception_phrases_do_not_count(spark):
    rows = [(f"you are such an idiot number {i}", 1) for i in range(30)] + [(f"a calm day number {i}", 0) for i in range(60)]
    rows += [("he read the novel idiot savant today", 0)] * 10 + [(None, 1), ("x", None)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    asked = [("the novel idiot savant",), ("what an idiot you are",), ("the novel idiot savant, you idiot",), (None,), ("",)]
    out = toxicity.score(spark.createDataFrame(asked, "text string"), lexicon)
    assert [r.toxicity > 0.5 for r in out.collect()] == [False, True, True, False, False]


def test_lexicon_without_one_kind(spark):
    lexicon = toxicity.learn(spark.createDataFrame([("a", 0), ("b", 0)], "text string, toxic int"))
    assert all(r.toxicity < 0.5 for r in toxicity.score(frame(spark), lexicon).collect())


def tokens(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*lower.encode().split(), None]


@pytest.fixture
def small_shards(monkeypatch):
    """Many shards, spread contexts and few broadcast counts, so every path is taken."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4000)
    monkeypatch.setattr(lm, "HOT", 60)
    monkeypatch.setattr(lm, "KNOWN_WORDS", 100)


TRAIN = "doc_id % 7 <> 2 or doc_id is null"


def learned():
    return [r for r in documents() if r[0] is None or r[0] % 7 != 2]


def scored(spark, rows=None, training=TRAIN):
    return lm.score(frame(spark, rows), F.expr(training), carry=["doc_id"]).collect()


def test_base_score_and_counts(spark, small_shards):
    c = Counter(t for r in learned() for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    got = scored(spark)
    assert len(got) == len(documents())
    want = {}
    for r in documents():
        t = tokens(r[1])
        want.setdefault((r[0], len(t)), []).append((sum(c[x] > 0 for x in t), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)))
    for r in got:
        assert r.train_tokens == n
        assert any(r.n_known == k and r.base_score == pytest.approx(b) for k, b in want[r.doc_id, r.n_tokens])


def histories(text):
    """Each token with up to two tokens before it; a text begins after one end mark."""
    t = [None, *tokens(text)]
    return [(tuple(t[max(0, i - 2) : i]), t[i]) for i in range(1, len(t))]


def plain_model(train):
    """The same smoothing with dictionaries over all words."""
    c = Counter(t for r in train for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    grams, total, kinds = Counter(), Counter(), Counter()
    for r in train:
        for h, w in histories(r[1]):
            for part in {h, h[-1:]}:
                grams[part, w] += 1
                total[part] += 1
    for h, _ in grams:
        kinds[h] += 1

    def p(h, w):
        if not h:
            return (c[w] + 1) / (n + v + 1)
        if h not in total:
            return p(h[1:], w)
        return max(grams[h, w] - lm.DISCOUNT, 0) / total[h] + lm.DISCOUNT * kinds[h] / total[h] * p(h[1:], w)

    return p, c, total


@pytest.mark.parametrize("hot", [20, 60, 1 << 20])
def test_score_is_the_interpolated_model(spark, small_shards, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    p, c, total = plain_model(learned())
    for h in list(total)[:40]:
        assert sum(p(h, w) for w in [*c, "no such word"]) == pytest.approx(1)
    want = {}
    for r in documents():
        value = sum(math.log10(p(h, w)) for h, w in histories(r[1]))
        want.setdefault((r[0], len(tokens(r[1]))), []).append(value)
    for r in scored(spark):
        assert any(abs(r.score - w) < 2e-4 * r.n_tokens for w in want[r.doc_id, r.n_tokens])


def test_score_without_broadcast_counts(spark, monkeypatch):
    plain = {(r.doc_id, r.n_tokens): r.score for r in scored(spark)}
    monkeypatch.setattr(lm, "KNOWN_WORDS", 0)
    for r in scored(spark):
        assert r.score == pytest.approx(plain[r.doc_id, r.n_tokens])


def test_model_of_no_words(spark):
    got = scored(spark, training="false")
    assert len(got) == len(documents()) and all(r.n_known == 0 and r.score == 0 for r in got)
    assert scored(spark, []) == []


def test_columns_named_like_internal_ones_pass(spark):
    rows = frame(spark).withColumns({c: F.lit(c) for c in ("_text", "_same", "number", "score", "word", "kept")})
    got = lm.score(rows, F.lit(True))
    assert got.count() == len(documents()) and {"_text", "_row", "_same", "number", "word", "kept"} <= set(got.columns)
    assert {(r._text, r._same, r.number, r.kept) for r in got.collect()} == {("_text", "_same", "number", "kept")}


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, universe in ((0, 10), (1, 1), (5, 6), (1000, 1000), (3000, 10**9), (400, 3)):
        values = np.sort(rng.integers(0, universe, n))
        ef = eliasfano.EliasFano.of(values, universe)
        ef = eliasfano.EliasFano.from_arrays(eliasfano.from_buffer(np.frombuffer(eliasfano.to_bytes(ef.arrays()), np.uint8)))
        at = rng.permutation(n)
        assert (ef[at] == values[at]).all()


def test_level_finds_successors():
    context, word = np.array([4, 4, 6]), np.array([1, 7, 0])
    level = eliasfano.Level(eliasfano.from_buffer(np.frombuffer(
        eliasfano.Level.build(4, 3, 8, context, word, np.array([0.5, 0.25, 0.1]), np.array([1.0, 0.2, 0.3])), np.uint8)))
    found, backoff = level.find(np.array([4, 4, 4, 5, 6, 6]), np.array([1, 7, 8, 1, 0, 1]))
    assert found[[0, 1, 4]] == pytest.approx(np.log10([0.5, 0.25, 0.1]), abs=1e-3) and np.isnan(found[[2, 3, 5]]).all()
    assert backoff == pytest.approx(np.log10([1, 1, 1, 0.2, 0.3, 0.3]), abs=1e-3)


def test_many_words_are_sought_in_one_pass(monkeypatch):
    """The same places as by search within each context, also for sequences without low bits, and nothing is fetched one by one."""
    rng = np.random.default_rng(5)
    for contexts, words, n in ((50, 400, 3000), (6, 5, 28), (3000, 1 << 20, 500)):
        codes = np.sort(rng.choice(contexts * words, n, replace=False))
        context, word = np.divmod(codes, words)
        level = eliasfano.Level(eliasfano.from_buffer(np.frombuffer(
            eliasfano.Level.build(0, contexts, words, context, word, np.ones(n), np.ones(contexts)), np.uint8)))
        asked = np.divmod(np.concatenate([codes, rng.integers(0, contexts * words, 2000), [0, contexts * words - 1]]), words)
        monkeypatch.setattr(eliasfano, "READ_WHOLE", 0)
        want = level.place(*asked)
        assert want[:n].tolist() == list(range(n))
        monkeypatch.undo()
        with monkeypatch.context() as m:
            m.setattr(eliasfano.EliasFano, "__getitem__", None)
            assert level.place(*asked).tolist() == want.tolist()
    level = eliasfano.Level(eliasfano.from_buffer(np.frombuffer(
        eliasfano.Level.build(0, 2, 8, np.array([0, 1]), np.array([3, 0]), np.ones(2), np.ones(2)), np.uint8)))
    assert level.place(np.array([0, 0, 1]), np.array([3, 8, 0])).tolist() == [0, -1, 1]  # no word of the next context
    assert eliasfano.EliasFano.of(np.zeros(0, np.int64), 1).values().tolist() == []


@pytest.mark.parametrize("n", [3, 1 << 21])
def test_tokens_are_ordered_and_equal_ones_stay_in_place(n):
    rng = np.random.default_rng(6)
    v, u, w = rng.integers(0, 3, (3, 500))
    order, fresh = lm._ordered(v, u, w, n)
    assert order.tolist() == np.lexsort((w, u, v)).tolist()
    rows = list(zip(v[order], u[order], w[order]))
    assert fresh.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))]
    assert [len(x) for x in lm._ordered(*np.zeros((3, 0), np.int64), n)] == [0, 0]
    for size, many in ((40, 30), (40, 2)):
        x = rng.integers(0, size, many)
        for got, want in zip(lm._used(x, size), np.unique(x, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_awkward_rows_pass_through(spark):
    lexicon = toxicity.Lexicon({" w1 ": 1.0}, set(), (-1.0, 1.0, 0.0))
    got = toxicity.score(frame(spark), lexicon, carry=["doc_id", "key"])
    same_rows(got.select("doc_id", "key"), [(r[0], r[8]) for r in documents()])
