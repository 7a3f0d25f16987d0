"""Source divergence beside plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from check_oracle import connect, difference

import __spark_entry__ as driver
from aislefix.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, s):
    """(lang, source, part, item, value, rank) by the definition."""
    uses, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = WORD.findall(lower)
        groups[lang].add(source)
        uses[lang, source].update(found)
        docs[lang].update(set(found))
    result = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= s.least_documents]
        p = {}
        for source in sources:
            total = sum(uses[lang, source][t] for t in kept) + s.smoothing * len(kept)
            p[source] = {t: 1 + s.unit * (uses[lang, source][t] + s.smoothing) // total for t in kept}
        whole = {t: sum(uses[lang, x][t] for x in sources) for t in kept}
        q = {t: 1 + s.unit * (whole[t] + s.smoothing) // (sum(whole.values()) + s.smoothing * len(kept)) for t in kept}
        for source in sources:
            pair = [(-sum(abs(p[source][t] - p[x][t]) for t in kept), x.encode()) for x in sources if x != source]
            term = [(q[t] - p[source][t], t.encode()) for t in kept if uses[lang, source][t] and p[source][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, s.terms)):
                for rank, (value, item) in enumerate(sorted(items)[:most], 1):
                    result.add((lang, source, part, item.decode(), -value, rank))
    return result


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_terms():
    assert divergence.split_terms("Über-Maß, ÄRGER_3x DON'T\x00a b".encode()) == ["Über".encode(), "maß".encode(), "ÄrgeR".lower().encode().replace("ä".encode(), "Ä".encode()), b"x", b"don", b"t", "a b".encode()]


def test_shares_are_exact():
    counts, total = np.array([[5, 10**15]]), np.array([[10**15 + 7, 10**15 + 1]])
    assert divergence.shares(counts, total).tolist() == [[1 + 10**9 * 5 // (10**15 + 7), 1 + 10**24 // (10**15 + 1)]]


def made_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        lang = [None, "en", "de", "xx"][rng.integers(0, 4)] if i else "lone"
        source = [None, "a", "b", "c", "Ä", "z"][rng.integers(0, 6)]
        words = [f"w{'abcdefghij'[k]}" for k in rng.integers(0, 10, rng.integers(0, 30))]
        text = None if i % 37 == 0 else "" if i % 41 == 0 else " ".join(words).title() + " Größe!"
        rows.append((text if lang != "xx" else "??", lang, source))
    return rows + rows[:5]


@pytest.mark.parametrize("cells, held", [(200_000, 200_000), (8, 10)])
def test_equals_plain_python(spark, monkeypatch, cells, held):
    monkeypatch.setattr(divergence, "_CELLS", cells)
    rows = made_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n int, term int").repartition(4)
    s = divergence.DivergenceSettings(least_documents=20, terms=4)
    assert got(divergence.source_divergence(df, settings=s)) == plain(rows, s)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert got(divergence.source_divergence(df)) == set()


def test_query_equals_its_sql_and_plain_python(spark, sf_dir):
    df = driver.queries()["op12_divergence"](spark, sf_dir)
    assert difference(df, connect(sf_dir), "op12_divergence") is None
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()]
    assert got(df) == plain(rows, divergence.DivergenceSettings())
