"""The mix against plain computation: targets by repeated resharing, blocks laid out in Python, and its limits."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from aislefix.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, most=2):
    """Reshare by weight until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, found = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not full:
            return found | {s: weight[s] * level for s in free}
        for s in full:
            found[s] = most * sizes[s]
            left -= found[s]
        free -= full
    return found


@pytest.mark.parametrize("count", [1, 2, 3, 4, 7, 10, 63, 64, 65, 1000])
def test_permutation(spark, count):
    found = mixing.permuted(spark.range(count), F.col("id"), F.lit(count), F.lit("key"), 3, "x").collect()
    assert sorted(r.x for r in found) == list(range(count))


def test_permutation_is_not_the_order(spark):
    df = spark.range(1000)
    for k in "ab":
        df = mixing.permuted(df, F.col("id"), F.lit(1000), F.lit(k), 3, k)
    rows = df.collect()
    assert sum(r.id == r.a for r in rows) < 20 and sum(r.a == r.b for r in rows) < 20
    assert sum(abs(rows[i].a - rows[i + 1].a) < 20 for i in range(999)) < 120


def frame(spark):
    rows = []
    for i in range(300):
        source = ["big", "big", "small", "é", None, "zero"][i % 6]
        size = 0 if source == "zero" else (i * 37) % 400
        rows.append((i, " ".join(f"w{i}x{j}" for j in range(size)) + "\n" * (i % 2), source, i))
    rows += [(1000, None, "big", 0), (1001, "", None, 0), (1002, "long " * 20_000, "big", 0), (5, rows[5][1], rows[5][2], 0), (6, rows[6][1], rows[6][2], 0), (None, "no key here", "big", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n bigint").repartition(7), rows


SETTINGS = mixing.MixSettings(block_words=16, shard_slots=100)


def test_report(spark):
    df, rows = frame(spark)
    got = mixing.mix_report(df, settings=SETTINGS).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((k or -1, len(WORD.findall(t or ""))) for k, t, _, _ in rows)
    of = {k: s for k, _, s, _ in rows}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(want[of[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[of[r.doc_id]] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.03 * target + 64, s
    again = mixing.mix_report(df.repartition(3), settings=SETTINGS).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_taken_words_are_those_of_the_chosen_blocks(spark):
    df, _ = frame(spark)
    sized = mixing._sized(df, "doc_id", "text", "source")
    sources = mixing.source_targets(sized, SETTINGS)
    placed = mixing.placed_documents(sized, sources).collect()
    lines = defaultdict(dict)
    for r in placed:
        for w in range(r.p, r.p + r.n):
            assert w not in lines[r.sk]
            lines[r.sk][w] = r.uid
    assert all(sorted(x) == list(range(len(x))) for x in lines.values())
    chosen = mixing.chosen_blocks(sources, SETTINGS).collect()
    assert max(Counter((r.sk, r.block, r.turn) for r in chosen).values()) == 1 and {r.turn for r in chosen} == {0, 1}
    want = Counter()
    for r in chosen:
        for w in range(r.block * 16, r.block * 16 + 16):
            if w in lines[r.sk]:
                want[lines[r.sk][w]] += 1
    got = Counter()
    ids = {r.uid: (r.k, r.n) for r in placed}
    for uid, n in want.items():
        got[ids[uid]] += n
    report = Counter()
    for r in mixing.mix_report(df, settings=SETTINGS).collect():
        report[r.doc_id, r.size] += r.taken
    assert +report == +got


def test_documents(spark):
    df, rows = frame(spark)
    report = defaultdict(int)
    unique = df.dropDuplicates(["doc_id", "text"])
    for r in mixing.mix_report(unique, settings=SETTINGS).collect():
        report[r.doc_id] += r.taken
    got = mixing.mix_documents(df, settings=SETTINGS)
    assert got.columns == df.columns
    words = defaultdict(int)
    texts = {k: WORD.findall(t or "") for k, t, _, _ in rows}
    for r in got.collect():
        own = WORD.findall(r.text)
        words[r.doc_id] += len(own)
        assert own and not r.text[0].isspace()
        at = 0
        for w in own:  # the words are the document's, in its order
            at = texts[r.doc_id].index(w, at)
            at += w != "long"
    assert {k: n for k, n in report.items() if n} == dict(words)


def test_sources_smaller_than_a_block_get_their_share(spark):
    rows = [(i, " ".join(f"w{j}" for j in range((5, 20, 33)[i // 3 % 3])), f"s{i:03}") for i in range(180)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for size in (5, 20, 33):
        own = [r for r in got if r.size == size]
        assert sum(r.taken for r in own) == pytest.approx(sum(r.target for r in own), rel=0.12)
    assert sum(r.taken for r in got) == pytest.approx(sum(r.target for r in got), rel=0.05)


def test_empty(spark):
    df, _ = frame(spark)
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0
    nothing = mixing.mix_report(df.where("doc_id in (1000, 1001)")).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_plan_is_native(spark, sf_dir):
    import __spark_entry__

    df = __spark_entry__.queries()["op8_mixing"](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    rows = df.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    taken = Counter()
    of = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()}
    for r in rows:
        assert r.taken <= 2 * r.size
        taken[of[r.doc_id], r.target] += r.taken
    assert all(abs(n - target) <= 0.02 * target + 200 for (_, target), n in taken.items())


def test_no_row_goes_on_over_words_that_are_not_taken(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(1500)), f"s{i % 2}") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_documents(df, settings=mixing.MixSettings(block_words=64, shard_slots=64)).collect()
    texts = {i: text for i, text, _ in rows}
    assert len(got) > 24 and all(r.text in texts[r.doc_id] for r in got)


INTERNAL = ["own", "k", "h", "runs", "words", "row", "uid", "sk", "n", "p", "block", "turn", "_mix_k", "_mix_h", "_mix_row", "_mix_parts", "_rank"]


def test_columns_of_any_name_are_carried(spark):
    from aislefix.llm import simhash

    rows = [(i, f"some words of document number {i % 20} that differ {i % 20} {i % 20 * 7}", f"s{i % 2}", *(f"{name}{i}" for name in INTERNAL)) for i in range(40)]
    more = ["_key", "_hash", "_text", "_chosen", "_chosen_hash", "fp", "root", "least", "key", "hash", "rank"]
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{name}` string" for name in INTERNAL)
    df = spark.createDataFrame(rows, schema)
    mixed = mixing.mix_documents(df, settings=mixing.MixSettings(block_words=4, shard_slots=64))
    assert mixed.columns == df.columns
    for r in mixed.collect():
        assert all(r[name] == f"{name}{r.doc_id}" for name in INTERNAL)
    schema = "doc_id bigint, text string, " + ", ".join(f"`{name}` string" for name in [*INTERNAL, *more])
    df = spark.createDataFrame([(i, rows[i][1], *(f"{name}{i}" for name in [*INTERNAL, *more])) for i in range(40)], schema)
    kept = simhash.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    found = kept.collect()
    assert 1 <= len(found) <= 20 and all(r[name] == f"{name}{r.doc_id}" for r in found for name in [*INTERNAL, *more])


def test_counts_of_a_shard_are_multinomial(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(1600)), f"s{i % 3}") for i in range(90)]
    settings = mixing.MixSettings(block_words=4, shard_slots=64)
    sized = mixing._sized(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source")
    sources = mixing.source_targets(sized, settings)
    info = {r.sk: r for r in sources.collect()}
    slots, units = next((r.slots, r.all_units) for r in info.values())
    counts = defaultdict(Counter)
    for r in mixing.drawn_counts(sources, settings).collect():
        counts[r.shard][r.sk] = r["count"]
    assert sum(r.quota for r in info.values()) == slots == sum(sum(c.values()) for c in counts.values())
    assert {sum(c.values()) for c in counts.values()} <= {63, 64} and len(counts) == -(-slots // 64)
    for sk, r in info.items():
        p = r.units / units
        own = [c[sk] for c in counts.values()]
        mean = sum(own) / len(own)
        spread = sum((x - mean) ** 2 for x in own) / (len(own) - 1)
        assert mean == pytest.approx(64 * p, rel=0.05) and spread == pytest.approx(64 * p * (1 - p), rel=0.25)
    settled = Counter(r.sk for r in mixing.chosen_blocks(sources, settings).collect())
    assert settled == {sk: r.quota for sk, r in info.items()}


def test_many_sources(spark):
    """More sources than the grid that is broadcast may have, one of them with a third of all words."""
    df = spark.range(40_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") == 0, F.repeat(F.lit("word "), 100_000)).otherwise(F.lit("a few words here now")).alias("text"),
        F.format_string("s%05d", "id").alias("source"),
    )
    assert 2 * 40_000 > mixing._BROADCAST_ROWS
    rows = mixing.mix_report(df, settings=mixing.MixSettings(block_words=5, shard_slots=1000)).collect()
    assert len(rows) == 40_000 and all(r.taken <= 2 * r.size for r in rows)
    hot = next(r for r in rows if r.doc_id == 0)
    assert hot.taken == pytest.approx(hot.target, rel=0.01)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), rel=0.01)
    by_target = Counter(), Counter()
    for r in rows:
        by_target[0][r.target] += r.taken
        by_target[1][r.target] += r.target
    assert all(by_target[0][t] == pytest.approx(n, rel=0.02) for t, n in by_target[1].items())
