"""Small tables that hold the awkward rows: nulls, empty and long texts, copies, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _row string, ref string, key string"


def words(rng: random.Random, n: int, kinds: int = 400) -> str:
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def documents() -> list[tuple]:
    rng = random.Random(5)
    texts: list[str | None] = [words(rng, rng.randrange(3, 220)) for _ in range(60)]
    passage = words(rng, 70)
    texts += [f"{words(rng, 9)}\n{passage}\n{words(rng, 9)}" for _ in range(12)]
    texts += [texts[0], texts[0], texts[1], (texts[2] or "") + " x", (texts[2] or "").replace("w1", "v1", 1)]
    texts += [None, None, "", "", " \t\n", "one", "Two WORDS", "\n\n", "aaaa" * 300, "ab" * 500, "ñ é ü " * 60, "日本語 テスト", "\x00\x01" * 150]
    texts += [words(rng, 4000), passage, passage.upper()]
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, len(t or ""), "a", "b", "c", "d") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)


def same_rows(df, want: list[tuple]) -> None:
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted(want, key=str)
