"""The stages in turn against plain computation on what each was given."""

from collections import Counter, defaultdict

import pytest
from test_mixing import targets
from test_packing import check
from test_repetition import WORD, plain
from test_simhash import groups_of, plain as fingerprint

import corpus_pipeline
from aislefix.sources.tables import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(-1, "1 2 3 " * 50, "en", "src0", 300), (-2, None, None, None, None), (-3, "", "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(junk)
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = materialize(out, "test-stage")
        found.append(docs.collect())
    return found


def test_language(stages):
    assert sorted(r.doc_id for r in stages[1]) == sorted(r.doc_id for r in stages[0] if any(c.isalpha() for c in r.text or ""))


def test_quality(stages):
    assert sorted(r.doc_id for r in stages[2]) == sorted(r.doc_id for r in stages[1] if plain(r.text)["kept"])


def test_near_copies(stages):
    want = groups_of([(r.doc_id, fingerprint(r.text)) for r in stages[2]])
    assert sorted(r.doc_id for r in stages[3]) == sorted(set(want.values()))


def test_mix(stages):
    before = {r.doc_id: r for r in stages[3]}
    sizes, taken, parts = defaultdict(int), Counter(), Counter()
    for r in stages[3]:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in stages[4]:
        own = WORD.findall(r.text)
        taken[r.source] += len(own)
        parts[r.doc_id] += len(own)
        assert r.n_chars == len(r.text) and r.source == before[r.doc_id].source
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= 0.1 * target + 4 * 256
    assert all(n <= 2 * len(WORD.findall(before[k].text)) for k, n in parts.items())


def test_packing(stages):
    assert check([(r.doc_id, r.text) for r in stages[4]], stages[5]) < 0.02


def test_run(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, sf_dir).count() > 0
