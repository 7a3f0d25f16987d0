"""Cuts against all ways to cut, and the pieces against plain encoding."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aislefix.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def cost_of(cuts, places, penalties, window):
    total = 0
    for a, b in itertools.pairwise(cuts):
        if places[b] - places[a] > window:
            return None
        total += packing.padding(int(places[b] - places[a]), window) + int(penalties[b])
    return total


@pytest.mark.parametrize("seed", range(30))
def test_cheapest_cuts(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 16, 20])
    places = np.cumsum([0] + [rng.randint(1, window) for _ in range(rng.randint(1, 9))])
    penalties = np.array([rng.choice([0, 1, 5]) for _ in places])
    inner = range(1, len(places) - 1)
    ways = [[0, *w, len(places) - 1] for n in range(len(places) - 1) for w in itertools.combinations(inner, n)]
    least = min(c for c in (cost_of(w, places, penalties, window) for w in ways) if c is not None)
    found = packing.best_cuts(places, penalties, window)
    assert cost_of(found, places, penalties, window) == least


def check(rows, got, window=2048):
    coder = Tokenizer.from_file(PATH)
    ids = [np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    crc = lambda x: zlib.crc32(x.tobytes())
    # Pieces of repeated keys are told apart by the whole: every id lies in exactly one piece.
    wanted = defaultdict(list)
    for (key, _), x in zip(rows, ids, strict=True):
        wanted[key, len(x)].append(x)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
    assert pieces.keys() == wanted.keys()
    for k, docs in wanted.items():
        covered = sorted((r.start, r.length) for r in pieces[k])
        assert sum(n for _, n in covered) == k[1] * len(docs)
        for r in pieces[k]:
            assert any(crc(x[r.start : r.start + r.length]) == r.ids_crc32 for x in docs)
        if len(docs) == 1:
            at = 0
            for start, length in covered:
                assert start == at
                at += length
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    filled = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        filled += packing.padding(at, window)
    return filled / sum(map(len, ids))


def test_frames(spark):
    rows = [(1, "A sentence. " * 300, 0), (2, None, 0), (3, "", 0), (None, "no key", 0), (4, "word " * 30_000, 0), (5, "é\n" * 500, 0), (5, "é\n" * 500, 0), (6, "x" * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, offset int").coalesce(2)
    assert check([r[:2] for r in rows], packing.pack(df, PATH).collect()) < 0.02
    assert packing.pack(df.limit(0), PATH).count() == 0
    named = packing.pack(df.selectExpr("CAST(doc_id AS string) AS doc_id", "text"), PATH)
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() > 8


def test_settles_as_it_goes():
    stream = packing._Stream(packing.PackingSettings(window=64), 5)
    rng, rows, lengths = np.random.default_rng(1), [], []
    for n in range(60):
        sizes = rng.integers(1, 150, 20)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        stream.add(list(range(20 * n, 20 * n + 20)), np.arange(offsets[-1], dtype=np.uint32), offsets, np.arange(7, offsets[-1], 9))
        lengths += sizes.tolist()
        assert len(stream.ids) < 32 * 64 + offsets[-1] + 10 * 64
        rows.append(stream.settle(final=n == 59))
    rows = [tuple(x[i].as_py() for x in r) for r in rows if r for i in range(len(r[0]))]
    whole = defaultdict(int)
    for key, start, length, _, doc_tokens, _, _ in rows:
        assert start == whole[key] and doc_tokens == lengths[key]
        whole[key] += length
    assert [whole[k] for k in range(1200)] == lengths
    sequences = defaultdict(int)
    for r in rows:
        assert r[6] == sequences[r[5]]
        sequences[r[5]] += r[2]
    assert sorted(sequences) == list(range(5, 5 + len(sequences))) and max(sequences.values()) <= 64


def test_query_on_the_tables(spark, sf_dir):
    import __spark_entry__

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check(rows, __spark_entry__.queries()["op6_packing"](spark, sf_dir).collect()) < 0.01
