"""Rank-order n-gram profiles: language by out-of-place distance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, widened
from .tokenizer import release

#: Code points fill 21 bits, so three of them fit a signed 64-bit n-gram exactly.
BITS = 21
UNKNOWN = "und"
#: Stands for a boundary; no letter has this code point, and it keeps n-grams of different length apart.
EDGE = 1


@cache
def letter_table() -> np.ndarray:
    """Per code point: itself if it is a letter, else EDGE."""
    table = np.fromiter((i if chr(i).isalpha() else EDGE for i in range(0x110000)), np.int64, 0x110000)
    return table


def tallied(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their counts (one each where there are none)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def grams(text: str, longest: int = 3, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (1 to ``longest`` of at most 3) of the whole text and their counts.

    The text is lower-cased; a run of other characters than letters, and either
    end, is one boundary.  Single boundaries are no n-gram, and no n-gram
    spans a boundary in its middle.  ``block`` characters are counted at a time and
    the last two are carried on, so beside the text memory holds one block and the
    distinct n-grams, whatever the text's length.
    """
    lowered, carried = text.lower(), np.array([EDGE], np.int64)
    held = waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for at in range(0, len(lowered), block):
        codes = letter_table()[np.frombuffer(lowered[at : at + block].encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate([carried, codes, [EDGE]] if at + block >= len(lowered) else [carried, codes])
        codes = codes[np.concatenate([[True], (codes[1:] != EDGE) | (codes[:-1] != EDGE)])]
        new = codes[len(carried) :]
        parts = [new[new != EDGE]]
        if longest >= 2:
            two = (codes[:-1] << BITS) | codes[1:]
            parts.append(two[len(carried) - 1 :])
        if longest >= 3 and len(codes) > 2:
            three = (codes[:-2] << 2 * BITS) | (codes[1:-1] << BITS) | codes[2:]
            parts.append(three[codes[1:-1] != EDGE])
        carried = codes[-2:]
        found = tallied(np.concatenate(parts))
        if at == 0 and block >= len(lowered):
            return found
        waiting = (np.concatenate([waiting[0], found[0]]), np.concatenate([waiting[1], found[1]]))
        if len(waiting[0]) > max(block, len(held[0])) or at + block >= len(lowered):
            held = tallied(np.concatenate([held[0], waiting[0]]), np.concatenate([held[1], waiting[1]]))
            waiting = (waiting[0][:0], waiting[1][:0])
    return held


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent keys; among equals the smaller key first."""
    if len(keys) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        near = counts >= least
        keys, counts = keys[near], counts[near]
    return keys[np.lexsort((keys, -counts))][:top]


def in_fold(doc_id: Column) -> Column:
    """True for documents that a model may learn from: crc32 of the id's text, mod 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit_profiles(docs: DataFrame, top: int = 300, longest: int = 3, per_language: int = 5000, languages: int = 1000) -> dict[str, np.ndarray]:
    """Each language's ``top`` n-grams in rank order, from labelled rows outside the held-out fold.

    The ``languages`` labels with the most rows are learned (ties by code point).
    A language with more than ``per_language`` labelled rows learns from a hash
    sample of about that many, whole texts; a rarer one from all of its rows.
    Rows with null text, lang or doc_id teach nothing; repeated rows teach again;
    an empty table gives no profile.  Of n-grams of one count the smaller key ranks
    first.  At most ``languages`` x ``top`` x 32 rows reach the driver.
    """
    small_batches(docs.sparkSession)
    slim = docs.select("doc_id", "lang", "text")
    labelled = slim.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_fold(F.col("doc_id")))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(sizes), "lang").filter(draw * F.col("n") < per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            totals: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                keys, counts = grams(text, longest)
                totals.setdefault(lang, Counter()).update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
            for lang, total in totals.items():
                arrays = [pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Two steps, so that a language's n-grams never meet in one task.
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(32)))
    near = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    best = salted.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= top).select("lang", "gram", "n").collect()
    by_lang: dict[str, list] = {}
    for lang, gram, n in best:
        by_lang.setdefault(lang, []).append((gram, n))
    return {lang: ranked(*np.array(rows, np.int64).T, top) for lang, rows in sorted(by_lang.items())}


def distance(own: np.ndarray, keys: np.ndarray, ranks: np.ndarray, top: int) -> float:
    """Out-of-place distance of a document's ranked n-grams to a profile, as a share of the worst; keys are sorted."""
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    there = keys[at] == own
    places = np.where(there, np.abs(ranks[at] - np.arange(len(own))), top)
    return float(places.sum()) / (top * len(own))


def guesser(profiles: dict[str, np.ndarray], top: int, longest: int) -> Callable[[list[str | None]], tuple[list[str], list[float]]]:
    """A function from texts to languages and scores."""
    sets = []
    for lang, keys in sorted(profiles.items()):
        order = np.argsort(keys)
        sets.append((lang, keys[order], order))

    def guess(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for text in texts:
            own = ranked(*grams(text or "", longest), top)
            if not len(own) or not sets:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            far = [distance(own, keys, ranks, top) for _, keys, ranks in sets]
            best = int(np.argmin(far))
            langs.append(sets[best][0])
            scores.append(1.0 - far[best])
        return langs, scores

    return guess


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = 300, longest: int = 3) -> DataFrame:
    """``docs`` with lang_pred and score.

    score is 1 minus the best language's normalised out-of-place distance.  Null
    texts, texts without letters, and any text if no language was learned get
    ``und`` and 0.  Ties go to the first language by code point.  Only the text
    is looked at, and all of it; the other columns pass through untouched, but
    for columns of the two output names, which are replaced.  Repeated rows are
    predicted alike; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    guess, kept = guesser(profiles, top, longest), docs.drop("lang_pred", "score")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            langs, scores = guess(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(label, widened(kept.schema, lang_pred="string", score="double"))


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score.

    A null doc_id is held out of learning and false in held_out.  Texts, ties,
    repeated rows and empty tables: see ``fit_profiles`` and ``predict``.
    """
    profiles = fit_profiles(docs, **options)
    held_out = F.coalesce(~in_fold(F.col("doc_id")), F.lit(False))
    said = predict(docs.select("doc_id", "text"), profiles, options.get("top", 300), options.get("longest", 3))
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.0, **options) -> DataFrame:
    """The documents whose language is recognised: not ``und`` and a score above ``least``.

    Rows and columns are as in ``docs``, whatever the columns are called; null
    texts and texts without letters go; an empty table gives an empty one.
    """
    guess = guesser(fit_profiles(docs, **options), options.get("top", 300), options.get("longest", 3))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            said = zip(*guess(batch.column("text").to_pylist()), strict=True)
            yield batch.filter(pa.array([lang != UNKNOWN and score > least for lang, score in said], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)
