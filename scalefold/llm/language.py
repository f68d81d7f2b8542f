"""Language of whole texts and of their spans.

Script ranges narrow the candidate languages of a word, character trigrams score
it under each candidate, and the Viterbi path over the words of a text, with a
penalty for every switch, labels its spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.llm.text import column_bytes, shipped, steps, tidied, unused

TRIGRAMS = 1 << 16
#: Log-likelihood given up for each change of language within a text.
SWITCH = 12.0
#: A language may use a script that holds this share of its training letters.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Text whose paths are searched side by side.
BATCH_BYTES = 4 << 20
_STEP = 1 << 20

# Script by the first byte of a letter: Latin, Greek, Cyrillic, Hebrew, Arabic, Indic and others, kana, Han, Hangul.
SCRIPTS = 9
_SCRIPT = np.zeros(256, np.int8)
_SCRIPT[0xCD:0xD0] = 1
_SCRIPT[0xD0:0xD6] = 2
_SCRIPT[0xD6:0xD8] = 3
_SCRIPT[0xD8:0xE0] = 4
_SCRIPT[0xE0:0xE3] = 5
_SCRIPT[0xE3] = 6
_SCRIPT[0xE4:0xEA] = 7
_SCRIPT[0xEA:0xF0] = 8

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


@dataclass
class Model:
    """Log-probabilities per language: trigrams (L x TRIGRAMS), allowed scripts (SCRIPTS x L)."""

    languages: list[str]
    trigram: np.ndarray
    script: np.ndarray


def _lowered(texts: list[bytes]) -> list[bytes]:
    return [t.decode("utf-8", "replace").lower().encode() for t in texts]


def _units(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For lower-cased texts: trigram of every letter byte, and word starts, lengths, letters, texts, scripts.

    A trigram is the byte with its neighbours; bytes that are no letters count as one blank.
    """
    data = np.frombuffer(b" " + b" ".join(texts) + b"  ", np.uint8)
    inside = _LETTER[data]
    data = np.where(inside, data, 32).astype(np.uint32)
    at = np.flatnonzero(inside)
    mix = data[at - 1] * np.uint32(0x9E3779B1) + data[at] * np.uint32(0x85EBCA6B) + data[at + 1] * np.uint32(0xC2B2AE35)
    trigram = (mix ^ (mix >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    fresh = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1])) if len(at) else np.zeros(0, np.int64)
    length = np.diff(np.append(fresh, len(at)))
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(first, at[fresh], side="right") - 1
    begins = np.concatenate([[0], np.cumsum((data[at] & 0xC0) != 0x80)])  # bytes that begin a letter
    letters = begins[fresh + length] - begins[fresh]
    return trigram, fresh, length, letters, doc, _SCRIPT[data[at[fresh]]]


def fit(documents: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count trigrams and scripts of every given text by its language.

    Rows whose text or language is null teach nothing. The tables that reach the
    driver hold at most TRIGRAMS + SCRIPTS counts per language. Without any
    labelled text the model has no language and predicts ``und``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = column_bytes(batch, "text"), np.array(batch.column("lang").to_pylist(), object)
            for i, j in steps(texts, _STEP):
                trigram, fresh, length, _, doc, script = _units(_lowered(texts[i:j]))
                names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
                letter, word = np.repeat(code[doc], length), code[doc]
                for k, name in enumerate(names):
                    into = total.setdefault(str(name), np.zeros(TRIGRAMS + SCRIPTS, np.int64))
                    into[:TRIGRAMS] += np.bincount(trigram[letter == k], minlength=TRIGRAMS)
                    mine = word == k
                    into[TRIGRAMS:] += np.bincount(script[mine], length[mine], minlength=SCRIPTS).astype(np.int64)
        for name, into in total.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(into[at])],
                names=["lang", "feature", "n"],
            )

    known = documents.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    parts = known.mapInArrow(tidied(count), "lang string, feature int, n long")
    rows = parts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows.lang.unique())
    counts = np.zeros((TRIGRAMS + SCRIPTS, len(languages)))
    counts[rows.feature, np.searchsorted(languages, rows.lang)] = rows.n
    trigram = counts[:TRIGRAMS] + 0.5
    share = counts[TRIGRAMS:] / np.maximum(counts[TRIGRAMS:].sum(axis=0), 1)
    allowed = share >= SCRIPT_SHARE
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return Model(
        languages,
        np.ascontiguousarray(np.log(trigram / trigram.sum(axis=0)).T, np.float32),
        np.where(allowed, 0.0, -1e6).astype(np.float32),
    )


def _viterbi(score: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Best language of every word; texts run side by side, word after word."""
    label = np.zeros(len(score), np.int16)
    came = np.zeros(score.shape, np.int8 if score.shape[1] < 128 else np.int16)
    order = np.argsort(-count, kind="stable")
    first, many = start[order], count[order]
    live = np.searchsorted(-many, -np.arange(1, int(many[0]) + 1 if len(many) else 1), side="right")
    own = np.arange(score.shape[1])
    best = np.zeros((len(order), score.shape[1]))
    for t, k in enumerate(live):
        if t:
            top = best[:k].argmax(axis=1)
            jump = best[np.arange(k), top][:, None] - SWITCH
            came[first[:k] + t] = np.where(best[:k] >= jump, own, top[:, None])
            best[:k] = np.maximum(best[:k], jump)
        best[:k] += score[first[:k] + t]
    now = best.argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        at = first[:k] + t
        label[at] = now[:k]
        if t:
            now[:k] = came[at, now[:k]]
    return label


def _labelled(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, letters and languages of all words of a batch."""
    scores, docs, counts = [], [], []
    for i, j in steps(texts, _STEP):
        trigram, fresh, _, letters, doc, script = _units(_lowered(texts[i:j]))
        if len(fresh):
            by = [np.add.reduceat(row[trigram], fresh) for row in model.trigram]
            scores.append(np.stack(by, axis=1) + model.script[script])
            docs.append(doc + i)
            counts.append(letters)
    if not scores:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
    score, doc, letters = map(np.concatenate, (scores, docs, counts))
    fresh = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc, letters, _viterbi(score, fresh, np.diff(np.append(fresh, len(doc))))


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def lettered(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter; ``identify`` gives all others ``und``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_has_letter(t) for t in column_bytes(batch, text)], pa.bool_()))

    return documents.mapInArrow(tidied(keep), documents.schema)


def identify(documents: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``lang_pred``, ``lang_score`` and ``lang_spans``.

    The prediction is the language that labels most letters, the score its share
    of them (ties: the language first in code-point order), the spans the runs
    of one language as ``language:words``. A null text, a text without any
    letter and a model without languages give ``und``, score 0 and no span.
    Repeated rows are judged alike; other columns (or those in ``carry`` alone) pass through untouched.
    """
    held = shipped(documents.sparkSession, model)  # at most TRIGRAMS + SCRIPTS numbers a language
    keep = documents.columns if carry is None else carry
    keep = [c for c in keep if c not in ("lang_pred", "lang_score", "lang_spans")]

    hidden = unused(documents, "_text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        n_lang = len(model.languages)
        for batch in batches:
            texts = column_bytes(batch, hidden)
            none = [not _has_letter(t) for t in texts]
            texts = [b"" if x else t for t, x in zip(texts, none)]
            pred, share, spans = [UNKNOWN] * len(texts), np.zeros(len(texts)), [""] * len(texts)
            for i, j in steps(texts, BATCH_BYTES) if n_lang else ():
                doc, letters, word = _labelled(model, texts[i:j])
                letters = np.bincount(doc * n_lang + word, letters, minlength=(j - i) * n_lang).reshape(-1, n_lang)
                total = letters.sum(axis=1)
                for k in np.flatnonzero(total):
                    pred[i + k] = model.languages[int(letters[k].argmax())]
                    share[i + k] = letters[k].max() / total[k]
                turn = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
                for at, many in zip(turn, np.diff(np.append(turn, len(doc)))):
                    name, k = f"{model.languages[word[at]]}:{many}", i + doc[at]
                    spans[k] += f" {name}" if spans[k] else name
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(share), pa.array(spans, pa.string())],
                names=[*keep, "lang_pred", "lang_score", "lang_spans"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return documents.select(*keep, F.col(text).alias(hidden)).mapInArrow(tidied(label), f"{kinds}, lang_pred string, lang_score double, lang_spans string")
