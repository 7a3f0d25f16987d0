"""Linear grouping: whole results, few sequences, and the numbering across tasks."""

import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings as limits, strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as driver
from aislefix.llm import best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sequences_of(runs, window, counts):
    held = Counter()
    for number, lengths in runs:
        assert number > 0 and sum(length * n for length, n in lengths) <= window
        for length, n in lengths:
            held[length] += number * n
    assert held == Counter({k: v for k, v in counts.items() if v})
    return sum(number for number, _ in runs)


@limits(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40), st.integers(1, 12))
def test_a_plan_holds_everything_once(counts, groups):
    found = sequences_of(best_fit.plan_packing(counts, best_fit.BestFitSettings(64, groups)), 64, counts)
    assert found >= -(-sum(k * v for k, v in counts.items()) // 64)


def fewest(lengths, window):
    """By trying all ways to fill one sequence at a time."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for size in range(len(rest) + 1):
        for some in itertools.combinations(range(len(rest)), size):
            if first + sum(rest[i] for i in some) <= window:
                best = min(best, 1 + fewest([x for i, x in enumerate(rest) if i not in some], window))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_close_to_the_fewest(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 30, 8).tolist()
    got = sequences_of(best_fit.plan_packing(Counter(lengths), best_fit.BestFitSettings(32, 16)), 32, Counter(lengths))
    assert got <= fewest(lengths, 32) + 1


def test_many_documents_come_near_the_bound():
    rng = np.random.default_rng(3)
    counts = Counter(rng.integers(1, 1025, 40_000).tolist())
    got = sequences_of(best_fit.plan_packing(counts), 1024, counts)
    halves = sum(n for length, n in counts.items() if length > 512)  # no two of them share a sequence
    assert got <= 1.012 * max(halves, sum(k * v for k, v in counts.items()) / 1024)


def test_configurations_beat_best_fit_where_sizes_are_few():
    counts = {53: 300, 26: 300, 11: 300, 10: 300}
    assert sequences_of(best_fit.plan_packing(counts, best_fit.BestFitSettings(100, 16, 20)), 100, counts) <= 301


def test_groups_have_equal_cardinality():
    groups = best_fit.group_sizes([(10, 5), (20, 5), (30, 2), (31, 8)], 4)
    assert [(size, sum(n for _, n in members)) for size, members in groups] == [(10, 5), (20, 5), (31, 10)]
    assert list(groups[-1][1]) == [(31, 5), (31, 3), (30, 2)]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def check(rows, texts, window):
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    ids = [coder.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    for doc, own in enumerate(ids):
        pieces = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces[:-1])]).tolist()
        assert sum(r["length"] for r in pieces) == len(own)
        assert all(r["length"] == window for r in pieces[1:]) and (len(pieces) == 1) == (len(own) <= window)
        for r in pieces:
            part = own[r["start"] : r["start"] + r["length"]]
            assert bytes(r["ids"]) == np.array(part, "<u4").tobytes()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    return by_sequence


def test_pieces_ids_and_places(spark):
    texts = [None, "", "One.", "word " * 90, "word " * 64, "x", "ein Satz. " * 33, "Größe " * 500, *(f"{'abc ' * k}end" for k in range(60))]
    made = [(i, t, 7, 8) for i, t in enumerate(texts)]
    df = spark.createDataFrame(made, "doc_id bigint, text string, length int, task int").repartition(5)
    s = best_fit.BestFitSettings(64, 8)
    packed = best_fit.pack_best_fit(df, PATH, settings=s)
    by_sequence = check(rows_of(packed), texts, 64)
    whole = {r.sequence_id: len(r.ids) // 4 for r in best_fit.assemble(packed).collect()}
    assert whole == {k: sum(n for _, n in parts) for k, parts in by_sequence.items()}


def test_repeated_rows_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "same words"), (1, "same words"), (None, "no key")], "doc_id bigint, text string")
    rows = rows_of(best_fit.pack_best_fit(df, PATH))
    assert sorted((r["doc_id"] or 0, r["piece"]) for r in rows) == [(0, 0), (1, 0), (1, 0)]
    assert len({r["sequence_id"] for r in rows}) == 1 and len({r["offset"] for r in rows}) == 3
    assert rows_of(best_fit.pack_best_fit(df.limit(0), PATH)) == []


def test_query(spark, sf_dir):
    rows = rows_of(driver.queries()["op13_best_fit"](spark, sf_dir))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    assert {r["doc_id"] for r in rows} == set(texts)
    held = Counter()
    for r in rows:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 1024 and len(held) <= 1.02 * sum(held.values()) / 1024 + 1
    for doc in sorted(texts)[:40]:
        own = [*coder.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        for r in (r for r in rows if r["doc_id"] == doc):
            part = np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
