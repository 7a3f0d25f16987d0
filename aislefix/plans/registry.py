"""The named queries over the order-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from aislefix.functions.calendar import calendar_columns
from aislefix.functions.ids import id_number, with_prefix
from aislefix.functions.scans import scan_size
from aislefix.operators import candidates, daily, encode, enrich, hits, model, profiles
from aislefix.operators.ranking import best_candidate
from aislefix.plans.bundle import load_bundle, save_bundle
from aislefix.plans.pipeline import Positioning
from aislefix.settings import SLOTS
from aislefix.sources import schemas
from aislefix.sources.adapter import load_tables
from aislefix.sources.rejects import read_keeping_rejects
from aislefix.sources.tables import (
    materialize, read_prior, read_query_rows, read_shops, read_table, read_visits, shared_folder, with_shop_id, write_answer, write_table,
)

Query = Callable[[SparkSession, str], DataFrame]


def rounded(column: Column, digits: int) -> Column:
    """Half-up by plain double arithmetic; the built-in goes through decimals, at many times the cost."""
    scale = F.lit(float(10**digits))
    return F.floor(column * scale + 0.5) / scale


def published(df: DataFrame, **digits: int) -> DataFrame:
    """Plain comparable columns: bigint, text, and doubles rounded to 6 digits or as named."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = rounded(column, digits.get(field.name, 6))
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.TimestampNTZType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _all_scans(p: Positioning) -> DataFrame:
    visits, queries = p.tables.visits, p.tables.query_rows
    return visits.select("row_id", "wifi_infos").unionByName(queries.select("row_id", "wifi_infos"))


# Sources and sinks


def visits_scan(p: Positioning) -> DataFrame:
    return p.tables.visits


def shops_scan(p: Positioning) -> DataFrame:
    return p.tables.shops


def query_rows_scan(p: Positioning) -> DataFrame:
    return p.tables.query_rows


def prior_top1(p: Positioning) -> DataFrame:
    return with_shop_id(candidates.prior_top1(p.tables.prior_train))


def prior_top1_answer(p: Positioning) -> DataFrame:
    return with_shop_id(candidates.prior_top1(p.tables.prior_answer))


def _through_csv(df: DataFrame, name: str, schema: str, read: Callable[..., DataFrame]) -> DataFrame:
    """Written as CSV, with the columns in the order of the schema, and read back by its reader."""
    path = shared_folder(df.sparkSession, name)
    write_table(df.select([field.strip().split()[0] for field in schema.split(",")]), path, "csv")
    return read(df.sparkSession, path)


def csv_roundtrip(p: Positioning) -> DataFrame:
    return _through_csv(p.tables.query_rows, "query-rows", schemas.QUERY_ROWS, read_query_rows)


def csv_shops(p: Positioning) -> DataFrame:
    return _through_csv(p.tables.shops, "shops", schemas.SHOPS, read_shops)


def csv_visits(p: Positioning) -> DataFrame:
    return _through_csv(p.tables.visits, "visits", schemas.VISITS, read_visits)


def csv_prior_train(p: Positioning) -> DataFrame:
    return _through_csv(p.tables.prior_train, "prior", schemas.PRIOR_TRAIN, read_prior)


def csv_prior_answer(p: Positioning) -> DataFrame:
    read = partial(read_prior, labelled=False)
    return _through_csv(p.tables.prior_answer, "prior", schemas.PRIOR_ANSWER, read)


def _damaged_query_rows(p: Positioning):
    """Query rows as CSV with some cells spoiled, read with the bad lines kept aside."""
    row = F.col("row_id")
    spoiled = p.tables.query_rows.select(
        "row_id", "user_id", "mall_id",
        F.when(row % 107 == 0, F.lit("yesterday")).otherwise(F.date_format("time_stamp", "yyyy-MM-dd'T'HH:mm:ss")).alias("time_stamp"),
        F.when(row % 101 == 0, F.lit("x")).otherwise(F.col("longitude").cast("string")).alias("longitude"), "latitude",
        F.when(row % 103 == 0, F.concat_ws(";", "wifi_infos", F.lit("b_1|-5|maybe"))).otherwise(F.col("wifi_infos")).alias("wifi_infos"),
    )
    path = shared_folder(p.tables.shops.sparkSession, "spoiled")
    write_table(spoiled, path, "csv")
    return read_keeping_rejects(p.tables.shops.sparkSession, path, schemas.QUERY_ROWS, most=0.05, scan="wifi_infos")


def rejected_query_rows(p: Positioning) -> DataFrame:
    """Lines that cannot be read, by their row number, with the reasons."""
    return _damaged_query_rows(p).rejects.select("row_id", F.array_join("reasons", "; ").alias("reasons"))


def accepted_query_rows(p: Positioning) -> DataFrame:
    return _damaged_query_rows(p).good


# Projections and scalar functions


def visit_calendar(p: Positioning) -> DataFrame:
    times = p.tables.visits.select("row_id", "time_stamp").unionByName(p.tables.query_rows.select("row_id", "time_stamp"))
    return times.select("row_id", *(column.alias(name) for name, column in calendar_columns("time_stamp").items()))


def mall_distance(p: Positioning) -> DataFrame:
    visits, queries, shops = p.tables.visits, p.tables.query_rows, p.tables.shops
    names = ["row_id", "mall_id", "distance", "longitude1", "latitude1"]
    placed = enrich.visits_with_mall(visits, shops).select(names)
    return placed.unionByName(enrich.query_rows_with_mall(queries, p.mall_centres).select(names))


def shop_dim(p: Positioning) -> DataFrame:
    return enrich.shop_dimension(p.tables.shops).select(
        "*", id_number("shop_id").alias("shop_no"), id_number("mall_id").alias("mall_no")
    )


def pair_geo_features(p: Positioning) -> DataFrame:
    return _pair_columns(p, ["longitude_cha", "latitude_cha", "dist"])


def pair_signal_features(p: Positioning) -> DataFrame:
    return _pair_columns(p, ["wifi_bssid_maxsignal_cha", "wifi_signal_maxsignal_cha"])


def _pair_columns(p: Positioning, names: list[str]) -> DataFrame:
    return with_shop_id(p.train_pair_columns.select("row_id", "shop_no", *names))


def feature_window(p: Positioning) -> DataFrame:
    return p.feature_visits.select("row_id", "shop_id", F.dayofmonth("time_stamp").alias("transaction_day"))


def label_window(p: Positioning) -> DataFrame:
    return p.label_rows.select("row_id", "shop_id", F.dayofmonth("time_stamp").alias("transaction_day"))


# Scans


def scan_hits(p: Positioning) -> DataFrame:
    return hits.explode_hits(_all_scans(p), ["row_id"])


def scan_size_query(p: Positioning) -> DataFrame:
    return _all_scans(p).select("row_id", scan_size("wifi_infos").alias("wifi_infos_number"))


def scan_slots(p: Positioning) -> DataFrame:
    return enrich.with_slots(_all_scans(p)).select("row_id", *enrich.SLOT_COLUMNS)


def scan_overlap(p: Positioning) -> DataFrame:
    return with_shop_id(p.answer_match.select("row_id", "shop_no", "wifi_in_swifi"))


# Joins and profiles


def visit_shop_join(p: Positioning) -> DataFrame:
    joined = enrich.visit_shop_join(p.tables.visits, p.tables.shops)
    return joined.select("row_id", "shop_id", "mall_id", "slongitude", "slatitude", "price")


def slot_match_features(p: Positioning) -> DataFrame:
    slots = range(1, SLOTS + 1)
    names = [f"{head}{k}{tail}" for k in slots for head, tail in (("sw_wifi", "_signal"), ("sw_number", ""))]
    return with_shop_id(p.answer_match.select("row_id", "shop_no", *names))


def mall_profile(p: Positioning) -> DataFrame:
    return enrich.mall_profile(p.tables.visits, p.tables.shops)


def ap_hit_count(p: Positioning) -> DataFrame:
    return hits.ap_hit_count(p.feature_hits)


def ap_min_support(p: Positioning) -> DataFrame:
    kept = hits.with_min_support(p.feature_hits, p.settings.index_min_support)
    return with_shop_id(kept.select("row_id", "pos", "shop_no", "wifi_bssid", "wifi_signal", "wifi_counts"))


def ap_profile(p: Positioning) -> DataFrame:
    return with_shop_id(profiles.ap_profile(p.train_stats, p.settings.feature_days))


def shop_mean_signal(p: Positioning) -> DataFrame:
    return with_shop_id(profiles.shop_mean_signal(p.train_stats))


def shop_ap_list(p: Positioning) -> DataFrame:
    return with_shop_id(profiles.shop_ap_list(p.train_stats))


def shop_modal_ap_ties(p: Positioning) -> DataFrame:
    return with_shop_id(profiles.shop_modal_ap_ties(p.train_stats))


def shop_modal_ap(p: Positioning) -> DataFrame:
    return with_shop_id(profiles.shop_modal_ap(p.train_stats))


def shop_slot1_mean(p: Positioning) -> DataFrame:
    return with_shop_id(profiles.shop_slot1_mean(p.train_stats))


def shop_slot1_variety(p: Positioning) -> DataFrame:
    return with_shop_id(profiles.shop_slot1_variety(p.train_stats, p.settings.feature_days))


def shop_slot1_modal_ap(p: Positioning) -> DataFrame:
    return with_shop_id(profiles.shop_slot1_modal_ap(p.train_stats))


def shop_profile(p: Positioning) -> DataFrame:
    return with_shop_id(p.train_shop_profile)


def shop_profile_answer(p: Positioning) -> DataFrame:
    return with_shop_id(p.answer_shop_profile)


def shop_ap_list_answer(p: Positioning) -> DataFrame:
    return with_shop_id(profiles.shop_ap_list(p.answer_stats))


def _whole_profile(stats: DataFrame, days: int) -> DataFrame:
    """Each access point of a shop beside the shop's own profile."""
    own = profiles.shop_profile(stats, days)
    return with_shop_id(profiles.spread_join(profiles.ap_profile(stats, days), own, "shop_no"))


def profiles_train(p: Positioning) -> DataFrame:
    return _whole_profile(p.train_stats, p.settings.feature_days)


def profiles_query(p: Positioning) -> DataFrame:
    return _whole_profile(p.answer_stats, p.settings.answer_days)


# Profiles and index from the state by day


def _by_days(p: Positioning) -> Positioning:
    """The method over a state to which days were added in three steps, and one of them a second time."""
    s = p.settings
    state = daily.DayState(p.tables.shops.sparkSession, shared_folder(p.tables.shops.sparkSession, "days"))
    for days in (range(1, 11), range(11, s.cutoff_day + 1), range(s.cutoff_day + 1, s.answer_days + 1), [s.cutoff_day + 1]):
        state.add(p.tables.visits, days)
    return Positioning(p.tables, s, state=state)


def state_profiles_train(p: Positioning) -> DataFrame:
    return profiles_train(_by_days(p))


def state_profiles_query(p: Positioning) -> DataFrame:
    return profiles_query(_by_days(p))


def state_ap_index_train(p: Positioning) -> DataFrame:
    return ap_index_train(_by_days(p))


def state_ap_index_query(p: Positioning) -> DataFrame:
    return ap_index_query(_by_days(p))


# Index and candidates


def ap_signal_pairs(p: Positioning) -> DataFrame:
    return with_shop_id(candidates.ap_signal_pairs(p.feature_hits).drop("n"))


def ap_popular_shops(p: Positioning) -> DataFrame:
    return with_shop_id(candidates.ap_popular_shops(candidates.ap_signal_pairs(p.all_hits), p.settings.popular_width))


def ap_index_train(p: Positioning) -> DataFrame:
    return with_shop_id(p.train_index)


def ap_index_query(p: Positioning) -> DataFrame:
    return with_shop_id(p.answer_index)


def candidate_pairs_train(p: Positioning) -> DataFrame:
    return with_shop_id(candidates.candidate_pairs_train(p.label_rows, p.train_index))


def candidate_pairs_query(p: Positioning) -> DataFrame:
    return with_shop_id(candidates.candidate_pairs_query(p.tables.query_rows, p.answer_index))


def candidate_union_train(p: Positioning) -> DataFrame:
    return with_shop_id(p.train_pairs)


def candidate_union_query(p: Positioning) -> DataFrame:
    return with_shop_id(p.answer_pairs)


def candidate_recall(p: Positioning) -> DataFrame:
    return candidates.candidate_recall(p.label_rows, p.train_index)


def row_ids(p: Positioning) -> DataFrame:
    return encode.row_numbers(p.label_rows.select("row_id", "shop_id"), "row_id")


# Encoding, features, ranking


def ordinal_encode(p: Positioning) -> DataFrame:
    names = ["row_id", *(f"{name}_code" for name in encode.encoded_columns())]
    return p.encoded_label_rows.select(names).unionByName(p.encoded_query_rows.select(names))


def pair_features_train(p: Positioning) -> DataFrame:
    return p.train_features


def pair_features_query(p: Positioning) -> DataFrame:
    return p.answer_features


def best_by_overlap(p: Positioning) -> DataFrame:
    return best_candidate(p.answer_match, F.col("wifi_in_swifi"))


def enrich_visits(p: Positioning) -> DataFrame:
    return p.enriched_visits


def enrich_query_rows(p: Positioning) -> DataFrame:
    return p.enriched_query_rows


def answer_rule(p: Positioning) -> DataFrame:
    return p.answer_by_rule()


def rank_gbt(p: Positioning) -> DataFrame:
    """The query pairs, whether their scores are probabilities, and equal by the bundle saved and loaded again."""
    spark = p.tables.visits.sparkSession
    folder = shared_folder(spark, "bundles")
    ranker = p.fit()
    save_bundle(p, ranker, folder)
    bundle = load_bundle(spark, folder)
    scorer = bundle.scorer(p.tables.query_rows, p.tables.prior_answer, stored=True)
    first = p.scores(ranker)
    again = scorer.scores(bundle.ranker).withColumnRenamed("score", "loaded")
    return with_shop_id(
        first.join(again, ["row_id", "shop_no"]).select(
            "row_id", "shop_no", F.col("score").between(0, 1).alias("is_probability"),
            (F.col("score") == F.col("loaded")).alias("same_when_loaded"),
        )
    )


def feature_importance(p: Positioning) -> DataFrame:
    """Every feature, whether its importance is not negative, and the total of all."""
    found = model.feature_importance(p.fit(), p.tables.visits)
    total = F.sum("importance").over(Window.partitionBy(F.lit(1)))  # one row a feature
    return found.select("feature", (F.col("importance") >= 0).alias("not_negative"), total.alias("total"))


def ranked_answer(p: Positioning) -> DataFrame:
    """The chosen shop of every query row and its score."""
    scores = materialize(p.scores(p.fit()), "scores")
    best = scores.groupBy("row_id").agg(F.max("score").alias("score"))
    return p.answer_by_scores(scores).join(best, "row_id", "left")


def importance_values(p: Positioning) -> DataFrame:
    return model.feature_importance(p.fit(), p.tables.visits)


def loss_curve(p: Positioning) -> DataFrame:
    """The loss of labelled rows left out, after each round."""
    settings = model.BoostingSettings()
    features = materialize(p.train_features, "train-features")
    unseen = model.held_out(settings)
    curve = model.loss_curve(model.fit_ranker(features.where(~unseen), settings), features.where(unseen))
    return features.sparkSession.createDataFrame(list(enumerate(curve, 1)), "round bigint, loss double")


def answer_pipeline(p: Positioning) -> DataFrame:
    """The answer file, written as CSV and read back, held against the scores it follows from."""
    spark = p.tables.visits.sparkSession
    path = shared_folder(spark, "answer")
    scores = materialize(p.scores(p.fit()), "scores")
    write_answer(p.answer_by_scores(scores), path)
    answer = read_table(spark, path, schemas.ANSWER)
    chosen = answer.withColumn("chosen", id_number("shop_id")).join(scores, "row_id", "left")
    held = chosen.groupBy("row_id").agg(
        F.max("score").alias("best"), F.max(F.when(F.col("shop_no") == F.col("chosen"), F.col("score"))).alias("own")
    )
    return held.select(
        "row_id", F.col("best").isNotNull().alias("has_candidate"), F.col("own").isNotNull().alias("chose_candidate"),
        F.coalesce(F.col("best") > F.col("own"), F.lit(False)).alias("another_scores_higher"),
    )


STEPS: dict[str, Callable[[Positioning], DataFrame]] = {
    step.__name__: step
    for step in (
        visits_scan, shops_scan, query_rows_scan, prior_top1, prior_top1_answer,
        csv_roundtrip, csv_shops, csv_visits, csv_prior_train, csv_prior_answer,
        visit_calendar, mall_distance, shop_dim, pair_geo_features, pair_signal_features, feature_window, label_window,
        scan_hits, scan_slots, scan_overlap,
        visit_shop_join, slot_match_features, mall_profile, ap_hit_count, ap_min_support, ap_profile,
        shop_mean_signal, shop_ap_list, shop_modal_ap_ties, shop_modal_ap,
        shop_slot1_mean, shop_slot1_variety, shop_slot1_modal_ap, shop_profile,
        shop_profile_answer, shop_ap_list_answer, profiles_train, profiles_query,
        ap_signal_pairs, ap_popular_shops, ap_index_train, ap_index_query,
        candidate_pairs_train, candidate_pairs_query, candidate_union_train, candidate_union_query, candidate_recall,
        rejected_query_rows, accepted_query_rows,
        state_profiles_train, state_profiles_query, state_ap_index_train, state_ap_index_query,
        ranked_answer, importance_values, loss_curve,
        row_ids, ordinal_encode, pair_features_train, pair_features_query,
        enrich_visits, enrich_query_rows, answer_rule, rank_gbt, feature_importance, answer_pipeline,
    )
}
STEPS["scan_size"] = scan_size_query
STEPS["best_candidate"] = best_by_overlap

# Distances in metres carry more digits before the point, so fewer after it are comparable;
# squared differences of the tables' coordinate grid end at the eighth digit.
DIGITS = {"distance": 3, "longitude1": 3, "latitude1": 3, "dist": 9}


# Queries that read visits or pairs several times work on stored hand-offs.
STORED = {
    "candidate_union_train", "candidate_union_query", "scan_overlap", "slot_match_features", "best_candidate",
    "ordinal_encode", "pair_features_train", "pair_features_query", "pair_geo_features", "pair_signal_features",
    "answer_rule", "rank_gbt", "feature_importance", "answer_pipeline",
    "ranked_answer", "importance_values", "loss_curve",
    "state_profiles_train", "state_profiles_query", "state_ap_index_train", "state_ap_index_query",
}


def _query(name: str, step: Callable[[Positioning], DataFrame]) -> Query:
    stored = name in STORED

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = load_tables(spark, sf_dir, stored)
        return published(step(Positioning(tables, stored=stored)), **DIGITS)

    return run


def queries() -> dict[str, Query]:
    return {name: _query(name, step) for name, step in STEPS.items()}
