"""Repetition inside a single document.

``repeated_words`` measures it exactly: stretches of ``n`` consecutive words are hashed, each is compared with the first
one of its hash in the same document, and a word is repeated if it lies in a stretch that also starts earlier.

``screened_repetition`` finds the documents with at least a given share of repeated words by a log-likelihood ratio of two
multinomials over hashed n-grams. The raw corpus is all stretches of all documents; the trusted target is what it would be
without repetition, every stretch where it first occurs in its document. As repetition is meant inside a document, the hash
of a stretch covers its document, too. The score of a document is the sum over its stretches of log(raw count / target
count), divided by their number; the totals of both multinomials add the same constant to every score and are left out.

Every document is thresholded alike, at a score that none with the wanted share can miss: a word is repeated only in a
stretch that is not the first of its kind, n words at most in each, and such a stretch has a raw count of 2 or more, a
target count of 1. So a share s of w words takes at least s * w / n of them, and the sum is at least s * w / n * log 2.
Equal hashes of different stretches only raise it. What passes is then measured word by word, as by ``repeated_words``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a stretch; characters that a worker handles at once (longer documents are handled alone, whole).
STRETCH, BATCH_CHARS = 8, 300_000


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, case-folded code point) for every code point; folds that give several characters are left out."""
    import unicodedata

    size = sys.maxunicode + 1
    letter, fold = np.zeros(size, bool), np.arange(size, dtype=np.uint32)
    for c in range(size):
        s = chr(c)
        if unicodedata.category(s)[0] == "L":
            letter[c] = True
            f = s.casefold()
            f = f if len(f) == 1 else s.lower()
            if len(f) == 1:
                fold[c] = ord(f)
    return letter, fold


@lru_cache(maxsize=4)
def _coefficients(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, offset, length) of every word and the folded letters of all words; words are maximal runs of letters."""
    letter, fold = _letters()
    code = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    on = letter[code]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])) if texts else np.zeros(0, np.int64)
    doc = np.searchsorted(begins, start, "right") - 1
    length = end - start
    return doc, np.cumsum(length) - length, length, fold[code[on]]


def _word_ids(offset: np.ndarray, length: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words: by hash, then compared letter by letter with the first word of that hash."""
    if not length.size:
        return np.zeros(0, np.int64)
    place = np.arange(letters.size) - np.repeat(offset, length)
    power = _coefficients(1 << max(10, int(length.max()).bit_length()), 11)
    hashed = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * power[place], offset) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first, ids = np.unique(hashed, return_index=True, return_inverse=True)
    like = first[ids]
    same = (length == length[like]).all() and bool((letters == letters[np.repeat(offset[like], length) + place]).all())
    if not same:  # two words with one hash
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(letters[o : o + k].tobytes(), len(known)) for o, k in zip(offset.tolist(), length.tolist())])
    return ids


def _stretches(doc: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, first start of the same stretch in its document) of every stretch of ``n`` words within a document."""
    count = ids.size - n + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 3
    start = np.flatnonzero(doc[:count] == doc[n - 1 :])
    power = _coefficients(n + 1, 13)
    hashed = np.zeros(start.size, np.uint64)
    for k in range(n):
        hashed += ids[start + k].astype(np.uint64) * power[k]
    hashed ^= hashed >> np.uint64(29)
    keyed = hashed + doc[start].astype(np.uint64) * power[n]
    _, at, group = np.unique(keyed, return_index=True, return_inverse=True)
    first = start[at][group]
    again = np.flatnonzero(first != start)
    wrong = (doc[start[again]] != doc[first[again]]) if again.size else np.zeros(0, bool)
    for k in range(n):
        wrong = wrong | (ids[start[again] + k] != ids[first[again] + k])
    if wrong.any():  # two stretches with one hash
        known: dict[tuple, int] = {}
        first = np.array([known.setdefault((int(doc[s]), *ids[s : s + n].tolist()), int(s)) for s in start])
    return start, hashed, first


def measure(texts: list[str], n: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """(words, repeated words) of each text."""
    doc, offset, length, letters = _words(texts)
    words = np.bincount(doc, minlength=len(texts))
    start, _, first = _stretches(doc, _word_ids(offset, length, letters), n)
    again = start[first != start]
    cover = np.bincount(again, minlength=doc.size + n + 1) - np.bincount(again + n, minlength=doc.size + n + 1)
    repeated = np.cumsum(cover)[: doc.size] > 0
    return words, np.bincount(doc[repeated], minlength=len(texts))


def _parts(texts: list[str | None], chars: int) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about ``chars`` characters together; null is no text."""
    at, part, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > chars:
            yield at, part
            at, part, size = i, [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield at, part


def repeated_words(df: DataFrame, id_col: str, text_col: str, n: int = STRETCH) -> DataFrame:
    """(id, words, repeated, share): for every document its words, how many of them are repeated, and their share.

    Null, empty and short texts have no repeated words; without words the share is 0. Rows with the same id are measured
    each by itself. Whole texts are measured, whatever their length, and do not leave the worker that reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in _parts(texts, BATCH_CHARS):
                words, repeated = measure(part, n)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(words, pa.int64()), pa.array(repeated, pa.int64())], names=["id", "words", "repeated"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, words bigint, repeated bigint")
    share = F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).otherwise(F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "words", "repeated", share.alias("share"))


def llr_sums(texts: list[str], n: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, stretches, summed log ratio) of each text; the sum divided by the stretches is its score."""
    doc, offset, length, letters = _words(texts)
    words = np.bincount(doc, minlength=len(texts))
    count = max(doc.size - n + 1, 0)
    start = np.flatnonzero(doc[:count] == doc[n - 1 :]) if count else np.zeros(0, np.int64)
    if not start.size:
        return words, np.zeros(len(texts), np.int64), np.zeros(len(texts))
    power = _coefficients(1 << max(10, int(length.max()).bit_length()), 11)
    place = np.arange(letters.size) - np.repeat(offset, length)
    word = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * power[place], offset) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    word ^= word >> np.uint64(31)
    mix = _coefficients(n + 1, 13)
    hashed = doc[start].astype(np.uint64) * mix[n]
    for k in range(n):
        hashed += word[start + k] * mix[k]
    # The target count of each hash is 1, its first occurrence, so the ratio is the raw count.
    _, kind, raw = np.unique(hashed, return_inverse=True, return_counts=True)
    of = doc[start]
    return words, np.bincount(of, minlength=len(texts)), np.bincount(of, np.log(raw)[kind], len(texts))


def screened_repetition(df: DataFrame, id_col: str, text_col: str, share: float, n: int = STRETCH) -> DataFrame:
    """(id, words, stretches, score, flagged, repeated): the log-likelihood ratio of every document, whether it reaches the
    score that ``share`` of repeated words takes at least, and for flagged ones the exact number of repeated words.

    ``repeated`` is null for documents that are not flagged: their share is below ``share``. Without stretches the score is
    0, and nothing is flagged. Null texts have no words; rows with the same id are scored each by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in _parts(texts, BATCH_CHARS):
                words, stretches, total = llr_sums(part, n)
                flagged = (stretches > 0) & (total >= share * words / n * np.log(2) * (1 - 1e-9))
                repeated = np.zeros(len(part), np.int64)
                on = np.flatnonzero(flagged)
                if on.size:
                    repeated[on] = measure([part[i] for i in on], n)[1]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(words, pa.int64()), pa.array(stretches, pa.int64()), pa.array(total / np.maximum(stretches, 1)), pa.array(flagged), pa.array(repeated, pa.int64(), mask=~flagged)],
                    names=["id", "words", "stretches", "score", "flagged", "repeated"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, words bigint, stretches bigint, score double, flagged boolean, repeated bigint")
    return out.withColumnRenamed("id", id_col)
