"""Language profiles: ranks against plain counting, edges, and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest

from aislefix.llm import language


def plain_grams(text, most):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    words = " " + " ".join(low.split()) + " "
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            gram = words[i : i + n]
            if gram != " " and " " not in gram[1:-1]:
                counts[gram] += 1
    number = {g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) for g in counts}
    best = sorted(counts, key=lambda g: (-counts[g], number[g]))[:most]
    return [number[g] for g in best], [counts[g] for g in best]


@pytest.mark.parametrize("text", ["a", "The the THE", "é!é, x1y2", "  lead and trail  ", "one\ntwo three " * 50, "𝒳𝒴 日本語 ß"])
@pytest.mark.parametrize("most", [3, 20, 10_000])
def test_ranks(text, most):
    grams, counts = language.ranked_grams(text, most)
    assert (grams.tolist(), counts.tolist()) == plain_grams(text, most)


@pytest.mark.parametrize("text", [None, "", " ", "123 !? \n"])
def test_no_letter(text):
    assert language.ranked_grams(text, 10) is None


def test_distance():
    a, b = [language.ranked_grams(t, 4)[0] for t in ("aab", "ccd")]
    grams = np.unique(np.concatenate([a, b]))
    ranks = np.full((len(grams), 2), 4)
    for j, own in enumerate((a, b)):
        for i, g in enumerate(own):
            ranks[np.searchsorted(grams, g), j] = i
    profiles = language.Profiles(("x", "y"), grams, ranks, 4)
    assert language.distances("aab", profiles).tolist() == [0.0, 1.0]
    assert language.distances("zz", profiles).tolist() == [1.0, 1.0]


def test_frames(spark):
    rows = [(1, "the cat and the dog and the bird", "en", 0), (2, "der hund und die katze und der vogel", "de", 1), (2, "der hund und die katze und der vogel", "de", 1),
            (3, None, "de", 2), (4, "12 34", "en", 3), (None, "the dog", None, 4), (6, "and the hound " * 9000, None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    profiles = language.fit_profiles(df)
    assert profiles.languages == ("de", "en")
    found = sorted((r.doc_id or 0, r.lang_pred) for r in language.predict(df, profiles).collect())
    assert found == [(0, "en"), (1, "en"), (2, "de"), (2, "de"), (3, "und"), (4, "und"), (6, "en")]
    kept = language.keep_known_languages(df, profiles)
    assert kept.columns == df.columns and kept.count() == 5
    nothing = language.fit_profiles(df.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(df, nothing).collect()} == {("und", 0.0)}
    assert language.predict(df.limit(0), profiles).count() == 0


def test_sample_is_bounded(spark):
    df = spark.range(200).selectExpr("id AS doc_id", "concat(char(97 + id % 26), char(97 + id DIV 26), 'q') AS text", "'en' AS lang")
    few, all_of_them = (language.fit_profiles(df, settings=language.ProfileSettings(docs_per_language=n)) for n in (20, 200))
    assert 9 < len(few.grams) < 0.5 * len(all_of_them.grams)


def test_held_out_accuracy(spark):
    import __spark_entry__

    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = __spark_entry__.queries()["op2_language"](spark, folder).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held) > 100
