"""Quality rules by repetition coverage.

Plain counts come first: words, symbols, repeated lines, words in repeated
three-word windows. The verdict of the method then measures which share of a
text's word characters lies inside duplicated word n-grams of several lengths,
found by rolling hashes, and inside duplicated lines.

Defined results: a null or empty text has no words and fails the base rule;
lines without a word are no lines; repeated rows are judged one by one; other
columns, whatever their names, do not matter. A text is judged whole, whatever
its length, and depends on no other row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aislefix.llm.cells import TextSlice, counts_within, release_memory, span_codes, text_slices, word_spans

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PACKED_CODES = 1 << 21


@dataclass(frozen=True)
class RepetitionRules:
    """Limits above which a text is rejected; shares are of its characters in words."""

    least_words: int = 50
    most_repeat_word_percent: int = 50
    most_line_share: float = 0.40
    # Word n-gram length: share of characters that may lie inside duplicated n-grams of that length.
    most_ngram_share: dict[int, float] = field(
        default_factory=lambda: {5: 0.45, 6: 0.44, 7: 0.43, 8: 0.42, 9: 0.41, 10: 0.40}
    )


COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(),
    "dup_line_share": pa.float64(), "dup_ngram_share": pa.float64(),
}
SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"
)


def _covered(keys: np.ndarray, length: int) -> np.ndarray | None:
    """Which of the words lie in a window that occurs twice or more; ``keys`` has one entry per window."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return None
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(keys) + length, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + length, -1)
    return np.cumsum(steps)[:-1] > 0


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _triples(codes: np.ndarray, kinds: int) -> np.ndarray:
    """A number for each three-word window, equal exactly for equal words."""
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    if kinds < _PACKED_CODES:
        return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    pairs = _dense(codes[:-1] * kinds + codes[1:])
    return _dense(pairs[:-1] * kinds + codes[2:])


def _line_counts(part: TextSlice, word_starts: np.ndarray, word_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeated lines of each text, and the word characters in lines that occur twice or more."""
    data, offsets = part.data, part.offsets
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    text = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = ends - (data[ends - 1] == 10)
    first, past = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    real = past > first
    starts, ends, text, first, past = starts[real], ends[real], text[real], first[real], past[real]
    repeated, chars = np.zeros(part.rows, np.int64), np.zeros(part.rows, np.int64)
    if len(starts):
        codes, values = span_codes(data, starts, ends)
        _, inverse, counts = np.unique(text * len(values) + codes, return_inverse=True, return_counts=True)
        lines = np.bincount(text, minlength=part.rows)
        kinds = np.bincount(text[np.unique(inverse, return_index=True)[1]], minlength=part.rows)
        repeated = lines - kinds
        total = np.concatenate([[0], np.cumsum(word_chars)])
        twice = counts[inverse] > 1
        chars = np.bincount(text[twice], (total[past] - total[first])[twice], part.rows).astype(np.int64)
    return repeated, chars


def measure(part: TextSlice, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """All counts and the verdict for each text of a slice."""
    starts, ends, first = word_spans(part.data, part.offsets)
    code_points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    word_chars = code_points[ends] - code_points[starts]
    total_chars = np.concatenate([[0], np.cumsum(word_chars)])
    codes, values = span_codes(part.data, starts, ends)
    triples = _triples(codes, len(values))
    n_words = np.diff(first)
    chars = total_chars[first[1:]] - total_chars[first[:-1]]
    dup_lines, line_chars = _line_counts(part, starts, word_chars)
    repeat_words = np.zeros(part.rows, np.int64)
    lengths = sorted(rules.most_ngram_share)
    limits = [rules.most_ngram_share[n] for n in lengths]
    # Rolling hashes over the whole slice: the hash of n words extends that of n - 1 words by one word.
    rolled, hashes, reach = {}, None, 0
    word_hash = codes.astype(np.uint64) * _MULTIPLIER + np.uint64(1)
    word_hash ^= word_hash >> np.uint64(29)
    hashes = word_hash.copy()
    for n in range(2, (lengths[-1] if lengths else 0) + 1):
        if len(word_hash) < n:
            break
        hashes = hashes[:-1] * _MULTIPLIER + word_hash[n - 1 :]
        hashes ^= hashes >> np.uint64(31)
        if n in rules.most_ngram_share:
            rolled[n] = hashes
    share, over = np.zeros(part.rows), np.zeros(part.rows, dtype=bool)
    for row in range(part.rows):
        a, b = int(first[row]), int(first[row + 1])
        if b - a < 4:
            continue
        inside = _covered(triples[a : b - 2], 3)
        if inside is None:
            continue
        repeat_words[row] = int(inside.sum())
        for n, limit in zip(lengths, limits, strict=True):
            if b - a <= n:
                break
            inside = _covered(rolled[n][a : b - n + 1], n)
            if inside is None:  # no repeated window of n words, so none that is longer
                break
            covered = float(word_chars[a:b][inside].sum()) / chars[row]
            share[row] = max(share[row], covered)
            over[row] |= covered > limit
    line_share = line_chars / np.maximum(chars, 1)
    base_failed = (n_words < rules.least_words) | (100 * repeat_words > rules.most_repeat_word_percent * n_words)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": counts_within(_SYMBOL[part.data], part.offsets),
        "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": base_failed,
        "kept": ~(base_failed | over | (line_share > rules.most_line_share)),
        "dup_line_share": line_share, "dup_ngram_share": share,
    }


def _measured(column: pa.Array, rules: RepetitionRules) -> dict[str, np.ndarray]:
    parts = [measure(part, rules) for part in text_slices(column)]
    return {name: np.concatenate([p[name] for p in parts]) for name in COLUMNS} if parts else {}


def repetition_report(
    df: DataFrame, key: str = "doc_id", text: str = "text", rules: RepetitionRules | None = None
) -> DataFrame:
    """``key`` and the counts, shares and verdict of every row."""
    rules = rules or RepetitionRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _measured(batch.column(1), rules)
                arrays = [batch.column(0), *(pa.array(found[name], kind) for name, kind in COLUMNS.items())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, *COLUMNS])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key], df[text]).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def keep_by_repetition(df: DataFrame, text: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The rows of ``df`` that pass, with all their columns."""
    rules = rules or RepetitionRules()
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_measured(batch.column(at), rules)["kept"]))
            batch = None
        release_memory()

    return df.mapInArrow(run, df.schema)
