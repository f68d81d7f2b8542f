"""Toxicity by a weighted lexicon that is learned from labels.

Texts are folded first: look-alike letters of other scripts and digits or signs
put in place of letters go to one letter. Terms are whole words and word
beginnings; an Aho-Corasick automaton finds them, their log-odds are added up
and set against the length of the text. Where a phrase of a term and its
neighbour is known from clean texts alone, the term in it does not count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.llm.text import LETTERS_DIGITS, column_bytes, shipped
from scalefold.session import land

#: About so many labelled rows are learned from; above, a hash of the id picks them.
TRAIN_ROWS = 20_000
#: Lengths of the word beginnings that may become terms.
STEMS = (4, 5, 6, 7, 8)
#: A term is in this share of the toxic training texts at least, and in LEAST_TEXTS of them.
LEAST_SHARE = 0.004
LEAST_TEXTS = 3
#: A term is so much likelier in toxic texts, as a logarithm.
LEAST_WEIGHT = 2.0
#: Standard errors taken off the logarithm before that, so that rare words do not pass by chance.
DOUBT = 1.64
#: An exception phrase is in so many clean training texts and in no toxic one.
EXCEPTION_TEXTS = 3

# Look-alikes of Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
# Digits and signs written for letters; i, l, 1 and | are one letter.
_SUBSTITUTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ013457891l|", b"abcdefghijkimnopqrstuvwxyzoieastbgiii")
_SIGNS = {b"@": b"a", b"$": b"s", b"!": b"i"}
_SIGN = re.compile(rb"[@$!](?=[a-z\x80-\xff])")
_NUMBER = re.compile(rb"(?<![^\s])[0-9.,:%+()-]+(?![^\s])")
_FOREIGN = re.compile(rb"[\xc9\xca\xcd-\xd4\xe1\xe2\xef\xf0]")


def _lookalike_table() -> dict[int, str]:
    wide = {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    return wide | {ord(c): to for k, to in LOOKALIKES.items() for c in (k, k.upper()) if len(c) == 1 and ord(c) > 127}


_TABLE = _lookalike_table()


def folded(text: bytes) -> bytes:
    """The words of a text in folded letters, each between single blanks."""
    if _FOREIGN.search(text):
        text = text.decode("utf-8", "replace").translate(_TABLE).lower().encode()
    text = _NUMBER.sub(b" ", text).translate(_SUBSTITUTES)
    if b"@" in text or b"$" in text or b"!" in text:
        text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    return b" " + b" ".join(text.translate(_LETTERS_ONLY).split()) + b" "


_LETTERS_ONLY = bytes(c if LETTERS_DIGITS[c] and not 48 <= c < 58 else 32 for c in range(256))


def _terms(text: bytes) -> set[bytes]:
    """Candidate terms of a folded text: `` word `` and `` stem``."""
    words = set(text.split())
    return {b" " + w + b" " for w in words} | {b" " + w[:n] for w in words for n in STEMS if len(w) > n}


@dataclass
class Lexicon:
    """Weights of terms, exception phrases, and the logistic curve over the features of a text."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight))
        out.make_automaton()
        return out


def _hits(text: str, automaton: ahocorasick.Automaton | None) -> Iterator[tuple[str, str, float]]:
    """For each term found: the phrases of its word with the word before and after, and its weight."""
    for end, (length, weight) in automaton.iter(text) if automaton else ():
        begin = end - length + 2
        stop = text.index(" ", begin)
        before = text.rfind(" ", 0, max(begin - 1, 0)) + 1
        after = text.find(" ", stop + 1)
        yield text[before:stop], text[begin : after if after > 0 else stop], weight


def _features(text: str, automaton: ahocorasick.Automaton | None, exceptions: set[str]) -> tuple[float, float]:
    """Weight of the terms found, and that weight per thousand words, as logarithms."""
    total = sum(w for left, right, w in _hits(text, automaton) if left not in exceptions and right not in exceptions)
    words = text.count(" ") - 1
    return math.log1p(total), math.log1p(1000 * total / (words + 20))


def _fold_column(batch: pa.RecordBatch) -> list[str]:
    return [folded(t).decode("utf-8", "replace") for t in column_bytes(batch, "text")]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-regularised logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-9)) @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def sampled(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """Documents with their label; of more than ``rows`` labels a hash of the id picks about that many, before texts are shuffled."""
    some = labels.select(id_col, label).filter(F.col(label).isin(0, 1))
    n = some.count()
    if n > rows:
        share = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(id_col).cast("long")), F.lit(1_000_000)) < int(1e6 * rows / n)
        some, documents = some.filter(share), documents.filter(share)
    return documents.join(some, id_col)


def learn(labelled: DataFrame, text: str = "text", label: str = "toxic") -> Lexicon:
    """A lexicon from texts with labels 0 and 1; rows with a null text or another label teach nothing.

    ``sampled`` bounds the rows, and with them what reaches the driver: terms in at
    least LEAST_SHARE of the toxic texts, and two numbers a row for the curve. Without toxic or without clean texts the score is the share of toxic ones.
    """
    known = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    known = land(known.filter("label in (0, 1) and text is not null"), "labelled")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    if not bad or not good:
        share = (bad + 0.5) / (bad + good + 1)
        return Lexicon(curve=(math.log(share / (1 - share)), 0.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in column_bytes(batch, "text"):
                seen.update(_terms(folded(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    least = max(LEAST_TEXTS, int(LEAST_SHARE * bad))
    found = known.filter("label = 1").select("text").mapInArrow(count, "term binary, n long")
    toxic = {bytes(r.term): r.n for r in found.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()}
    held = shipped(known.sparkSession, frozenset(toxic))

    def count_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, terms = Counter(), held()
        for batch in batches:
            for t in column_bytes(batch, "text"):
                seen.update(_terms(folded(t)) & terms)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    rest = known.filter("label = 0").select("text").mapInArrow(count_known, "term binary, n long")
    clean = {bytes(r.term): r.n for r in rest.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    weights: dict[str, float] = {}
    for term in sorted(toxic, key=lambda t: (len(t), t)):
        k, m = toxic[term] + 0.5, clean.get(term, 0) + 0.5
        odds = math.log(k / (bad + 1)) - math.log(m / (good + 1))
        name = term.decode("utf-8", "ignore")
        # the shortest term says it all: longer ones that begin alike are found with it
        if odds - DOUBT * math.sqrt(1 / k + 1 / m) >= LEAST_WEIGHT and name.encode() == term and not any(name[:k] in weights for k in range(4, len(name))):
            weights[name] = odds
    lexicon = Lexicon(weights)
    lexicon.exceptions = _exceptions(known, lexicon)
    rows_seen = known.mapInArrow(_scorer(known, lexicon, ["label"], raw=True), "label int, a double, b double").toPandas()
    lexicon.curve = _logistic(rows_seen[["a", "b"]].to_numpy(), rows_seen["label"].to_numpy(dtype=float))
    return lexicon


def _exceptions(known: DataFrame, lexicon: Lexicon) -> set[str]:
    held = shipped(known.sparkSession, lexicon)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held().automaton()
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for t, label in zip(_fold_column(batch), batch.column("label").to_pylist()):
                for phrase in {p for left, right, _ in _hits(t, automaton) for p in (left, right) if " " in p}:
                    seen.setdefault(phrase, [0, 0])[label] += 1
        columns = [list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                                         names=["phrase", "clean", "toxic"])

    found = known.mapInArrow(phrases, "phrase string, clean long, toxic long").groupBy("phrase")
    found = found.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    return {r.phrase for r in found.filter((F.col("clean") >= EXCEPTION_TEXTS) & (F.col("toxic") == 0)).collect()}


def _scorer(df: DataFrame, lexicon: Lexicon, keep: list[str], raw: bool = False):
    held = shipped(df.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held()
        automaton = lexicon.automaton()
        for batch in batches:
            pairs = [_features(t, automaton, lexicon.exceptions) for t in _fold_column(batch)]
            a, b = np.array(pairs, float).reshape(-1, 2).T
            out, names = [pa.array(a), pa.array(b)], ["a", "b"]
            if not raw:
                c = lexicon.curve
                out, names = [pa.array(1 / (1 + np.exp(-np.clip(c[0] + c[1] * a + c[2] * b, -30, 30))))], ["toxicity"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out], names=[*keep, *names])

    return run


def score(documents: DataFrame, lexicon: Lexicon, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``toxicity`` between 0 and 1; above 0.5 toxic is likelier.

    Null, empty and word-free texts hold no term and get the score of a text
    without any. Texts are read whole; repeated rows score alike, other columns (or those in ``carry``) pass through.
    """
    keep = [c for c in (documents.columns if carry is None else carry) if c != "toxicity"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*keep).schema)
    if "text" in keep and text != "text":
        raise ValueError("name the text column apart from a column called text that is carried along")
    rows = documents.select(*[c for c in keep if c != "text"], F.col(text).alias("text"))
    return rows.mapInArrow(_scorer(documents, lexicon, keep), f"{kinds}toxicity double")
