"""Order MinHash against a plain computation, its feel for order, and the chain of next documents."""

import hashlib
import random

import numpy as np
import pytest

from aislefix.llm import order_minhash as omh

SETTINGS = omh.SketchSettings()
MULTIPLIERS = omh._multipliers(SETTINGS.slots)


def plain(text, settings=SETTINGS):
    """The same sketch with sorted lists instead of bounds, from the same hash of each numbered k-mer."""
    numbered, seen = [], {}
    for i in range(max(1, len(text) - settings.kmer + 1) if text else 0):
        part = text[i : i + settings.kmer]
        numbered.append((part, seen.setdefault(part, 0)))
        seen[part] += 1
    hashes = {}
    for part, number in dict.fromkeys(numbered):
        first = omh.parts_of(omh._points(part), settings.kmer)[0]
        with np.errstate(over="ignore"):
            hashes[part, number] = omh._mixed(np.array([first]) + np.uint64(number) * omh._BASE)[0] if number else first
    parts = [int(hashes[x]) for x in numbered]
    rows = []
    for m in MULTIPLIERS.tolist():
        value = [(((p >> 32) ^ (p & 0xFFFFFFFF)) * m & 0xFFFFFFFF, i) for i, p in enumerate(parts)]
        rows.append([parts[i] for i in sorted(i for _, i in sorted(value)[: settings.keep])])
    folded = omh._fold(np.array(rows, np.uint64).reshape(len(rows), -1))
    return (omh._mixed(MULTIPLIERS + folded) >> np.uint64(32)).astype(">u4")


def sketch(text):
    return omh.sketch(omh._points(text), SETTINGS, MULTIPLIERS)


TEXTS = ["", "a", "ab", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaaaa", "abc " * 40, "é𝒳" * 30, " ".join(f"w{i % 17}" for i in range(900)), "x" * 50_000 + "y"]


@pytest.mark.parametrize("text", TEXTS)
def test_sketch(text):
    assert sketch(text).tolist() == plain(text).tolist()


def test_long_texts_go_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 701}" for i in range(2000))
    whole = sketch(text).tolist()
    monkeypatch.setattr(omh, "_BLOCK", 100)
    assert sketch(text).tolist() == whole


def test_feels_edits_and_order():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    text = " ".join(words)
    swapped = " ".join(words[200:] + words[:200])
    small = text.replace(words[50], "zz", 1)
    other = " ".join("".join(rng.choices("klmnopqrst", k=6)) for _ in range(400))
    of = lambda t: omh.likeness(sketch(text), sketch(t))
    assert of(text) == 1 and of(small) > 0.8 and of(other) == 0
    # The same parts in another order: pairs across the halves are turned round.
    assert 0.2 < of(swapped) < 0.8


def chain(rows):
    """(id, text, edited text, next text) in descending order of id."""
    ordered = sorted(rows, key=lambda r: -r[0])
    for i, (key, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1] or ""
        text = text or ""
        third = len(text) // 3
        yield key, text, text[: len(text) - third] + after[:third], after


def check(rows, got):
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for key, text, changed, after in chain(rows):
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (sketch(text).tobytes().hex(), sketch(changed).tobytes().hex())
        assert r.near_edited == omh.likeness(sketch(text), sketch(changed))
        assert r.near_next == omh.likeness(sketch(text), sketch(after))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_frames(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 3 - 20, "".join(rng.choices("ab é\n𝒳", k=rng.choice([0, 1, 2, 5, 40, 300])))) for i in range(60)] + [(999, None), (998, "z" * 30_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, k string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        check(rows, omh.fingerprint_with_edits(df).collect())
        assert omh.fingerprint_with_edits(df.limit(0)).count() == 0
        one = omh.fingerprint_with_edits(df.where("doc_id = 998")).collect()
        assert len(one) == 1 and one[0].near_next == 1
        odd = spark.createDataFrame([(1, "aa"), (1, "aa"), (1, "bb"), (None, "cc")], "doc_id bigint, text string")
        assert sorted((r.doc_id or 0, r.n_chars) for r in omh.fingerprint_with_edits(odd).collect()) == [(0, 2), (1, 2), (1, 2), (1, 2)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_query_on_the_tables(spark, sf_dir):
    import __spark_entry__

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, __spark_entry__.queries()["op7_order_minhash"](spark, sf_dir).collect())
