"""Fingerprints and groups against plain computation over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from aislefix.llm import simhash
from aislefix.llm.cells import text_slices
from aislefix.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(pairs):
    """{id: smallest id reachable} over all pairs of (id, fingerprint)."""
    root = {}
    for i, _ in pairs:
        root.setdefault(i, i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, f) in enumerate(pairs):
        for j, g in pairs[:n]:
            if (f ^ g).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in pairs}


EDGES = [None, "", " \n", "One", "one two", "ONE two three", "one two three", "É é a b", "a b c a b c a b c", "x\x0by\x0cz w"]


def test_fingerprints():
    for most in (1, 30, 1 << 20):
        parts = text_slices(pa.array(EDGES, pa.string()), most)
        found = np.concatenate([simhash.fingerprints_of(p) for p in parts]).view(np.uint64)
        assert found.tolist() == [plain(t) for t in EDGES]


def frame_of(spark, values):
    return spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")


def test_all_values_within_two_bits_meet(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    near = {c ^ (1 << a) ^ (1 << b) for c in centres for a in range(0, 64, 3) for b in range(0, 64, 5)}
    values = sorted(near | set(centres))
    met = simhash.at_anchors(frame_of(spark, values))
    by_anchor = {}
    for r in met.collect():
        by_anchor.setdefault(r.anchor, set()).add(r.fp & ((1 << 64) - 1))
    together = {frozenset(p) for g in by_anchor.values() for p in [(a, b) for a in g for b in g if a < b]}
    wanted = {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2}
    assert wanted <= together and len(wanted) > 1000
    assert met.groupBy("fp").count().agg({"count": "max"}).first()[0] <= 33


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_connect_as_all_pairs_do(spark, bits):
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(30)}
    for _ in range(150):  # chains and dense clusters
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)))
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links_between(frame_of(spark, values), bits).collect()]
    assert all(0 < (a ^ b).bit_count() <= bits for a, b in links)

    def closed(pairs):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {v: find(v) for v in values}

    ordered = sorted(values)
    assert closed(links) == closed([(a, b) for i, a in enumerate(ordered) for b in ordered[:i] if (a ^ b).bit_count() <= bits])


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    links = chain + star + [(3, 3), (500, 501), (501, 500)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {n: r for n, r in root.items() if n != r}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_frames(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(5, long, 1), (2, long.replace("word7 ", "other "), 2), (9, None, 3), (8, "", 4), (8, "", 4), (3, "alone here now", 5), (None, "no id", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    want = groups_of([(i, plain(t)) for i, t, _ in rows if i is not None])
    assert all(r.component_id == want[r.doc_id] and r.fingerprint == f"{plain(dict((a, b) for a, b, _ in rows)[r.doc_id]):016x}" for r in found if r.doc_id is not None)
    kept = simhash.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted([-1, *set(want.values())])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_a_key_with_texts_in_two_groups_names_both(spark):
    one, two = ([" ".join(f"{w}{i}" for i in range(60))] for w in ("red", "blue"))
    rows = [(5, one[0]), (7, one[0]), (5, two[0]), (9, two[0]), (5, two[0])]
    kept = simhash.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(5, one[0]), (5, two[0])])


def test_query_on_the_tables(spark, sf_dir):
    import __spark_entry__

    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    pairs = [(r.doc_id, plain(r.text)) for r in texts]
    want = groups_of(pairs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in __spark_entry__.queries()["op9_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in pairs}
