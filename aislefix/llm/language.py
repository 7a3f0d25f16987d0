"""Language by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language by rank. A text
is ranked the same way, and its distance to a profile is the sum over its
n-grams of how far each is out of place; an n-gram the profile lacks counts as
out of place by the length of the profile. The nearest language wins.

Letters are lower-cased, and a run of anything else is one space, so words keep
their edges; one space stands before and after a text. N-grams across a space
are left out unless the space is at an end of the n-gram.

Profiles are fitted on a bounded sample: for each language about
``docs_per_language`` labelled documents, those whose ids have the smallest hashes.
Prediction ranks every whole text. Its only input is the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned. Equal counts rank by n-gram, equal
distances go to the language that is first by name. Repeated rows are judged one
by one, an empty table gives an empty result, other columns do not matter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislefix.llm.cells import release_memory

UNKNOWN = "und"
_SPACE = 32
_BITS = 21


@dataclass(frozen=True)
class ProfileSettings:
    profile_length: int = 400
    docs_per_language: int = 2000
    # Rows below this score are rejected by ``keep_known_languages``, besides those without a letter.
    least_score: float = 0.0


@dataclass(frozen=True)
class Profiles:
    """``grams`` in order, and the rank of each in every language, ``length`` where it has none."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    length: int


@cache
def _letters() -> np.ndarray:
    """For every code point, itself if it is a letter, else a space."""
    return np.fromiter((p if chr(p).isalpha() else _SPACE for p in range(sys.maxunicode + 1)), np.uint32)


def ranked_grams(text: str | None, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The most frequent n-grams of a text, as numbers, best first, and their counts; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[points]
    points = np.concatenate([[_SPACE], points, [_SPACE]]).astype(np.int64)
    gap = points == _SPACE
    points = points[np.concatenate([[True], ~(gap[1:] & gap[:-1])])]
    if len(points) < 2:
        return None
    gap = points == _SPACE
    two = (points[:-1] << _BITS) | points[1:]
    three = (two[:-1] << _BITS) | points[2:]
    keys = np.concatenate([points[~gap], two, three[~gap[1:-1]]])
    grams, counts = np.unique(keys, return_counts=True)
    if len(grams) > most:
        # All grams above the count of the place ``most``, so that ties are ranked and cut by n-gram.
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[counts >= least], counts[counts >= least]
    order = np.argsort(-counts, kind="stable")[:most]
    return grams[order], counts[order]


def distances(text: str | None, profiles: Profiles) -> np.ndarray | None:
    """Out-of-place distance to each language, from 0 to 1."""
    found = ranked_grams(text, profiles.length)
    if found is None or not profiles.languages:
        return None
    grams = found[0]
    at = np.minimum(np.searchsorted(profiles.grams, grams), len(profiles.grams) - 1)
    ranks = np.where((profiles.grams[at] == grams)[:, None], profiles.ranks[at], profiles.length)
    apart = np.abs(ranks - np.arange(len(grams))[:, None])
    apart[ranks == profiles.length] = profiles.length
    return apart.sum(axis=0) / (len(grams) * profiles.length)


def fit_profiles(
    df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", settings: ProfileSettings | None = None
) -> Profiles:
    """Profiles of the languages in ``df``; the sample, and so what reaches the driver, is bounded per language.

    Languages are labels given by people; their number does not grow with the rows.
    """
    settings = settings or ProfileSettings()
    ids = F.xxhash64(df[key].cast("string"))
    labelled = df.select(ids.alias("h"), df[text].alias("t"), df[lang].alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    # One row a language: its share of the range of hashes. The texts are found by a filter, without a join or a sort.
    within = F.lit(False)
    for row in labelled.groupBy("l").agg(F.count("*").alias("n")).collect():
        most = int(min(1.0, settings.docs_per_language / row.n) * 2**64) - 2**63 - 1
        within |= (F.col("l") == row.l) & (F.col("h") <= F.lit(most).cast("bigint"))
    sample = labelled.where(within).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, grams, counts = [], [], []
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = ranked_grams(value, sys.maxsize)
                if found is not None:
                    langs += [language] * len(found[0])
                    grams.append(found[0])
                    counts.append(found[1])
            if grams:
                arrays = [pa.array(langs, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))]
                yield pa.RecordBatch.from_arrays(arrays, names=["l", "g", "n"])

    summed = sample.mapInArrow(count, "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("l").orderBy(F.desc("n"), "g")
    rows = summed.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < settings.profile_length).collect()
    languages = tuple(sorted({r.l for r in rows}))
    grams = np.array(sorted({r.g for r in rows}), np.int64)
    ranks = np.full((len(grams), len(languages)), settings.profile_length, np.int64)
    for r in rows:
        ranks[np.searchsorted(grams, r.g), languages.index(r.l)] = r["rank"]
    return Profiles(languages, grams, ranks, settings.profile_length)


def _judged(column: pa.Array, profiles: Profiles) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for value in column:
        apart = distances(value.as_py(), profiles)
        if apart is None:
            langs.append(UNKNOWN)
            scores.append(0.0)
        else:
            best = int(np.argmin(apart))
            langs.append(profiles.languages[best])
            scores.append(float(1.0 - apart[best]))
    return langs, scores


def predict(df: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _judged(batch.column(1), profiles)
            arrays = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "lang_pred", "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key], df[text]).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: Column) -> Column:
    """The third of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_known_languages(
    df: DataFrame, profiles: Profiles, text: str = "text", settings: ProfileSettings | None = None
) -> DataFrame:
    """The rows of ``df`` whose text has a language, with all their columns."""
    settings = settings or ProfileSettings()
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _judged(batch.column(at), profiles)
            keep = [x != UNKNOWN and s >= settings.least_score for x, s in zip(langs, scores, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))
            batch = None
        release_memory()

    return df.mapInArrow(run, df.schema)
