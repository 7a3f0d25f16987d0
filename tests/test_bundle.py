"""A bundle answers in another session, from the folder alone."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from aislefix.operators.model import BoostingSettings
from aislefix.plans.bundle import load_bundle, save_bundle
from aislefix.plans.pipeline import Positioning
from aislefix.settings import Settings
from aislefix.sources.adapter import load_tables

FEW = BoostingSettings(rounds=3, depth=3)


@pytest.fixture(scope="module")
def saved(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bundles"))
    method = Positioning(load_tables(spark, sf_dir, stored=True), Settings(train_width=11), stored=True)
    ranker = method.fit(FEW)
    save_bundle(method, ranker, folder, FEW, [0.5, 0.4, 0.3])
    answer = {r.row_id: r.shop_id for r in method.answer(ranker).collect()}
    method.tables.query_rows.write.parquet(f"{folder}/asked")
    method.tables.prior_answer.write.parquet(f"{folder}/prior")
    return folder, answer


OTHER = """
import json, sys
from aislefix.session import build_session
from aislefix.plans.bundle import load_bundle
folder = sys.argv[1]
spark = build_session("other", cores=4)
bundle = load_bundle(spark, folder)
found = bundle.answer(spark.read.parquet(folder + "/asked"), spark.read.parquet(folder + "/prior"))
print("ANSWER", json.dumps({r.row_id: r.shop_id for r in found.collect()}))
"""


def test_another_session_gives_equal_rows(saved):
    folder, answer = saved
    repo = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", OTHER, folder], capture_output=True, text=True, cwd=repo, timeout=240)
    line = next((x for x in run.stdout.splitlines() if x.startswith("ANSWER ")), None)
    assert line, run.stderr[-2000:]
    assert {int(k): v for k, v in json.loads(line[7:]).items()} == answer and len(answer) > 100


def test_what_a_bundle_says(spark, saved):
    bundle = load_bundle(spark, saved[0], version=1)
    assert bundle.settings == Settings(train_width=11) and bundle.boosting == FEW
    assert bundle.rounds == 3 and bundle.curve == [0.5, 0.4, 0.3]


def test_unknown_ids_are_missing_and_answered(spark, saved):
    folder, _ = saved
    asked = spark.read.parquet(f"{folder}/asked").limit(20)
    strange = asked.withColumn("mall_id", F.lit("m_999999")).withColumn(
        "hits", F.transform("hits", lambda hit: hit.withField("wifi_bssid", hit["wifi_bssid"] + 10**9))
    )
    prior = spark.read.parquet(f"{folder}/prior")
    bundle = load_bundle(spark, folder)
    scorer = bundle.scorer(strange, prior)
    assert scorer.encoded_query_rows.where("wifi1_bssid <> -999 AND wifi1_bssid_code IS NOT NULL").count() == 0
    assert bundle.answer(strange, prior).count() == 20


def test_a_lost_writer_leaves_no_bundle(spark, saved, tmp_path):
    folder, _ = saved
    (Path(folder) / "v2" / "ranker").mkdir(parents=True)
    assert load_bundle(spark, folder).path.endswith("/v1")
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, folder, version=2)
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, str(tmp_path))
