"""Every named query beside its SQL, invariants of the composed ones, and plans of unstored steps."""

import math

import pytest
from check_oracle import connect, difference

import __spark_entry__ as driver
from aislefix.operators import candidates, encode, model
from aislefix.plans import registry
from aislefix.plans.pipeline import Positioning
from aislefix.sources import schemas
from aislefix.sources.adapter import load_tables
from aislefix.sources.tables import (
    Tables, materialize, read_prior, read_query_rows, read_shops, read_table, read_visits, write_answer, write_table,
)

# Trained queries publish what SQL can state of them; they are run once each, without the plan checks below.
TRAINED = {"rank_gbt", "feature_importance", "answer_pipeline", "ranked_answer", "importance_values", "loss_curve"}
# Scores, importances and losses themselves cannot be said in SQL.
NO_SQL = {"ranked_answer", "importance_values", "loss_curve"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(registry.queries()) - NO_SQL <= set(driver.oracle_sql())


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


# Ends that may run in one task: a total after partial sums, and a running sum
# over the high bits of one column, of which there are at most 2**20.
SINGLE_TASK = {"candidate_recall", "row_ids"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - TRAINED))
def test_query_equals_its_sql_by_a_distributed_plan(spark, con, sf_dir, name):
    df = driver.queries()[name](spark, sf_dir)
    plan = plan_of(df)
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in SINGLE_TASK or "SinglePartition" not in plan
    assert difference(df, con, name) is None


def test_pairs_are_unique_with_one_positive_per_label_row(spark, sf_dir):
    method = Positioning(load_tables(spark, sf_dir, stored=True), stored=True)
    pairs = method.train_pairs
    assert pairs.count() == pairs.select("row_id", "shop_no").distinct().count()
    positives = {r.row_id: r["sum(label)"] for r in pairs.groupBy("row_id").sum("label").collect()}
    assert set(positives.values()) == {1} and len(positives) == method.label_rows.count()


@pytest.mark.parametrize("name", sorted(TRAINED))
def test_trained_query_equals_its_sql(spark, con, sf_dir, name):
    df = driver.queries()[name](spark, sf_dir)
    assert difference(df, con, name) is None
    if name == "loss_curve":
        losses = [r.loss for r in df.orderBy("round").collect()]
        assert len(losses) == model.BoostingSettings().rounds and losses[-1] < 0.2 * losses[0]
    if name == "ranked_answer":
        rows = df.collect()
        assert len(rows) == load_tables(spark, sf_dir).query_rows.count()
        assert all((r.shop_id is None) == (r.score is None) for r in rows) and len({r.score for r in rows}) > 20
    if name == "importance_values":
        weights = [r.importance for r in df.collect()]
        assert abs(sum(weights) - 1) < 1e-4 and sum(w > 0 for w in weights) > 5


def test_default_ranker_beats_a_constant_on_rows_it_never_saw(spark, sf_dir):
    method = Positioning(load_tables(spark, sf_dir, stored=True), stored=True)
    settings = model.BoostingSettings()
    features = materialize(method.train_features, "train-features")
    unseen = model.held_out(settings)
    ranker = model.fit_ranker(features.where(~unseen), settings)
    assert model.rounds_used(ranker) == settings.rounds
    kept = features.where(unseen)
    scored = model.score_pairs(ranker, kept).join(kept.select("row_id", "shop_no", "label"), ["row_id", "shop_no"]).collect()
    share = sum(r.label for r in scored) / len(scored)

    def loss(score):
        return -sum(math.log(max(1e-9, score(r) if r.label else 1 - score(r))) for r in scored) / len(scored)

    assert loss(lambda r: r.score) < 0.1 * loss(lambda r: share)


def test_sides_that_both_number_from_zero_keep_their_own_prior(spark):
    place = "0.0D AS longitude, 0.0D AS latitude, CAST(NULL AS string) AS wifi_infos"
    shops = spark.sql("SELECT concat('s_', id) AS shop_id, 'c_1' AS category_id, 0.0D AS longitude, 0.0D AS latitude, 1.0D AS price, 'm_1' AS mall_id FROM range(1, 9)")
    visits = spark.sql(f"SELECT 5L AS row_id, 'u_1' AS user_id, 's_1' AS shop_id, timestamp_ntz'2017-08-28 10:00:00' AS time_stamp, {place}")
    asked = spark.sql(f"SELECT 5L AS row_id, 'u_2' AS user_id, 'm_1' AS mall_id, timestamp_ntz'2017-09-01 10:00:00' AS time_stamp, {place}")
    train = spark.createDataFrame([(5, "s_2", 0, 0)], schemas.PRIOR_TRAIN)
    answer = spark.createDataFrame([(5, "s_3", 0)], schemas.PRIOR_ANSWER)
    method = Positioning(Tables(shops, visits, asked, train, answer))
    assert sorted(tuple(r) for r in method.train_pairs.collect()) == [(5, 1, 1), (5, 2, 0)]
    assert [tuple(r) for r in method.answer_pairs.collect()] == [(5, 3)]


def test_from_four_files_to_the_answer_file(spark, sf_dir, tmp_path):
    given = load_tables(spark, sf_dir)
    write_table(given.shops, f"{tmp_path}/shops", "csv")
    write_table(given.visits.drop("row_id"), f"{tmp_path}/visits", "csv")
    write_table(given.query_rows, f"{tmp_path}/asked", "csv")
    write_table(given.prior_answer, f"{tmp_path}/prior", "csv")
    visits = encode.numbered(read_visits(spark, f"{tmp_path}/visits"))
    none = spark.createDataFrame([], schemas.PRIOR_TRAIN)
    tables = Tables(
        read_shops(spark, f"{tmp_path}/shops"), visits, read_query_rows(spark, f"{tmp_path}/asked"), none,
        read_prior(spark, f"{tmp_path}/prior", labelled=False),
    )
    write_answer(Positioning(tables).answer_by_rule(), f"{tmp_path}/answer")
    got = {r.row_id: r.shop_id for r in read_table(spark, f"{tmp_path}/answer", schemas.ANSWER).collect()}
    want = {r.row_id: r.shop_id for r in driver.queries()["answer_rule"](spark, sf_dir).collect()}
    assert got == want and len(got) == given.query_rows.count()


@pytest.mark.parametrize("line", ["s_1,c_1,113.x,20.0,1.0,m_1", "s_1,c_1,113.0"])
def test_cells_that_do_not_parse_fail(spark, tmp_path, line):
    path = tmp_path / "shops.csv"
    path.write_text(f"shop_id,category_id,longitude,latitude,price,mall_id\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_shops(spark, str(path)).collect()


def test_another_header_fails(spark, tmp_path):
    path = tmp_path / "shops.csv"
    path.write_text("shop_id,category_id,latitude,longitude,price,mall_id\ns_1,c_1,1.0,2.0,3.0,m_1\n")
    with pytest.raises(Exception, match="header"):
        read_shops(spark, str(path)).collect()


def test_index_ranks_are_limited_before_the_shuffle(spark, sf_dir):
    method = Positioning(load_tables(spark, sf_dir))
    plan = plan_of(candidates.ap_popular_shops(candidates.ap_signal_pairs(method.all_hits)))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unmatched_access_points_go_no_further_and_pairs_stay_narrow(spark, sf_dir, no_broadcast):
    """On plans of steps that stored nothing."""
    method = Positioning(load_tables(spark, sf_dir))
    plan = plan_of(method.train_match)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    lookup = [x for x in plan.splitlines() if "Join" in x and "wifi_bssid" in x and "shop_no" in x]
    assert lookup and all("Inner" in x for x in lookup)
    pairs = method.train_pair_columns
    node = pairs._jdf.queryExecution().optimizedPlan().toString()
    widths = [len(method.train_pairs.columns) + len(method._shop_side(method.train_stats, 24).columns) + 3]
    assert widths[0] <= 25 and "RepartitionByExpression [row_id" in node


def test_window_steps_have_distributed_plans(spark, sf_dir):
    method = Positioning(load_tables(spark, sf_dir))
    for step in (method.train_pairs, method.answer_pairs, method.answer_match, method.answer_by_rule()):
        plan = plan_of(step)
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan


def test_scans_read_only_the_columns_they_need(spark, sf_dir):
    plan = plan_of(driver.queries()["shop_dim"](spark, sf_dir))
    assert "ReadSchema: struct<s_suppkey:bigint,s_nationkey:int,s_acctbal:double>" in plan


def test_windows_of_stored_rows_prune_files(spark, sf_dir):
    method = Positioning(load_tables(spark, sf_dir, stored=True), stored=True)
    for step in (method.feature_visits, method.label_rows, method.tables.query_rows):
        plan = step._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "o_orderstatus" in filters
        assert step is method.tables.query_rows or "transaction_day" in filters


def test_stored_scans_are_parsed_once_and_read_by_field(spark, sf_dir):
    method = Positioning(load_tables(spark, sf_dir, stored=True), stored=True)
    for step in (method.train_pairs, method.answer_match, method.train_features, method.answer_features):
        assert "split(" not in plan_of(step)
    probe = candidates._probe(method.tables.query_rows, method.answer_index)
    assert "hits:array<struct<wifi_bssid:bigint>>" in probe._jdf.queryExecution().executedPlan().toString()
