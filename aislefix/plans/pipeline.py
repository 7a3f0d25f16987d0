"""From raw tables to answers. Steps are lazy, but for the hand-offs that ``stored`` asks for and for training."""

from __future__ import annotations

from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from aislefix.functions.ids import id_number
from aislefix.operators import candidates, daily, encode, enrich, hits, known, model, pairs, profiles
from aislefix.operators.ranking import best_candidate
from aislefix.operators.spread import spread_join
from aislefix.settings import DEFAULTS, SLOTS, Settings
from aislefix.sources.tables import Tables, materialize


class Positioning:
    """The method over one set of input tables.

    With ``stored``, the tables handed from one stage to the next (candidate
    pairs, lookups, columns to encode) are written once to the shared folder, as several
    later steps read each of them; otherwise every step is one lazy plan. The size of a stored lookup is known, so that
    a small one is broadcast and of a larger one a filter of its keys (``known``). With a
    ``state`` by day, profiles and index are merged from it and no hit of a visit is read for them.
    """

    def __init__(
        self, tables: Tables, settings: Settings = DEFAULTS, stored: bool = False, state: daily.DayState | None = None,
        filters: known.KnownSettings = known.DEFAULTS,
    ) -> None:
        self.tables = tables
        self.settings = settings
        self.stored = stored
        self.state = state
        self.filters = filters

    def _hand_off(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if self.stored else df

    # Visits by window

    @cached_property
    def feature_visits(self) -> DataFrame:
        return self.tables.visits.where(hits.in_feature_window(self.tables.visits, self.settings.cutoff_day))

    @cached_property
    def label_rows(self) -> DataFrame:
        return self.tables.visits.where(~hits.in_feature_window(self.tables.visits, self.settings.cutoff_day))

    @cached_property
    def feature_hits(self) -> DataFrame:
        return hits.visit_hits(self.feature_visits)

    @cached_property
    def all_hits(self) -> DataFrame:
        return hits.visit_hits(self.tables.visits)

    # Enriched rows

    @cached_property
    def mall_centres(self) -> DataFrame:
        return self._hand_off(enrich.mall_centres(self.tables.visits, self.tables.shops), "mall-centres")

    @cached_property
    def enriched_visits(self) -> DataFrame:
        return enrich.enrich_visits(self.tables.visits, self.tables.shops)

    @cached_property
    def enriched_label_rows(self) -> DataFrame:
        """Label rows against malls profiled from all visits."""
        placed = enrich.visits_with_mall(self.tables.visits, self.tables.shops)
        late = placed.where(~hits.in_feature_window(placed, self.settings.cutoff_day))
        return enrich.with_slots(enrich.with_calendar(late)).drop("time_stamp")

    @cached_property
    def enriched_query_rows(self) -> DataFrame:
        return enrich.enrich_query_rows(self.tables.query_rows, self.mall_centres)

    # Profiles

    @cached_property
    def train_stats(self) -> DataFrame:
        if self.state:
            return daily.merged_stats(self.state.sums(self.settings.cutoff_day), self.settings.profile_min_support)
        return profiles.ap_stats(self.feature_hits, self.settings.profile_min_support)

    @cached_property
    def answer_stats(self) -> DataFrame:
        if self.state:
            return daily.merged_stats(self.state.sums(), self.settings.profile_min_support, self.settings.cutoff_day)
        return profiles.ap_stats(self.all_hits, self.settings.profile_min_support, self.settings.cutoff_day)

    @cached_property
    def train_shop_profile(self) -> DataFrame:
        return profiles.shop_profile(self.train_stats, self.settings.feature_days)

    @cached_property
    def answer_shop_profile(self) -> DataFrame:
        return profiles.shop_profile(self.answer_stats, self.settings.answer_days)

    # Candidates

    @cached_property
    def train_index(self) -> DataFrame:
        s = self.settings
        if self.state:
            found = daily.merged_pairs(self.state.best(s.train_width, s.cutoff_day))
            return candidates.ap_index_train(
                found, s.train_width, s.index_min_support, daily.merged_counts(self.state.sums(s.cutoff_day))
            )
        return candidates.ap_index_train(candidates.ap_signal_pairs(self.feature_hits), s.train_width, s.index_min_support)

    @cached_property
    def answer_index(self) -> DataFrame:
        s = self.settings
        if self.state:
            found = daily.merged_pairs(self.state.best(s.answer_width))
            return candidates.ap_index_query(found, s.answer_width, s.popular_width, daily.merged_counts(self.state.sums()))
        return candidates.ap_index_query(candidates.ap_signal_pairs(self.all_hits), s.answer_width, s.popular_width)

    @cached_property
    def train_pairs(self) -> DataFrame:
        found = candidates.candidate_union_train(self.label_rows, self.train_index, self.tables.prior_train)
        return self._hand_off(found, "train-pairs")

    @cached_property
    def answer_pairs(self) -> DataFrame:
        found = candidates.candidate_union_query(self.tables.query_rows, self.answer_index, self.tables.prior_answer)
        return self._hand_off(found, "answer-pairs")

    # Pair features

    def _shop_side(self, stats: DataFrame, days: int) -> DataFrame:
        shops = enrich.shop_dimension(self.tables.shops).drop("mall_id")
        numbered = shops.withColumn("shop_no", id_number("shop_id")).drop("shop_id")
        return numbered.join(profiles.shop_profile(stats, days), "shop_no", "left")

    @cached_property
    def train_shops(self) -> DataFrame:
        return self._hand_off(self._shop_side(self.train_stats, self.settings.feature_days), "train-shops")

    @cached_property
    def answer_shops(self) -> DataFrame:
        return self._hand_off(self._shop_side(self.answer_stats, self.settings.answer_days), "answer-shops")

    @cached_property
    def train_lookup(self) -> DataFrame:
        return self._hand_off(pairs.lookup_train(self.train_stats, self.settings.feature_days), "train-lookup")

    @cached_property
    def answer_lookup(self) -> DataFrame:
        s = self.settings
        found = pairs.lookup_query(self.answer_stats, s.feature_days, s.answer_days, s.answer_slot_window)
        return self._hand_off(found, "answer-lookup")

    def _wide(self, lookup: DataFrame, name: str) -> pairs.WidePoints | None:
        """The access points of a stored lookup that more shops know than an index keeps of one; None for a small lookup."""
        if not self.stored or lookup.count() < self.filters.direct_from:
            return None
        found = materialize(pairs.wide_points(lookup, self.settings.answer_width + self.settings.popular_width), name)
        return pairs.WidePoints(found, not found.isEmpty())

    @cached_property
    def train_wide(self) -> pairs.WidePoints | None:
        return self._wide(self.train_lookup, "train-wide")

    @cached_property
    def answer_wide(self) -> pairs.WidePoints | None:
        return self._wide(self.answer_lookup, "answer-wide")

    def _known(self, lookup: DataFrame, wide: pairs.WidePoints | None) -> known.KnownKeys | None:
        """A filter of the keys of a stored lookup that are asked for pair by pair, where their number allows one."""
        if not self.stored or (wide and not wide.found):
            return None
        return known.known_keys(wide.among(lookup) if wide else lookup, ["shop_no", "wifi_bssid"], self.filters)

    @cached_property
    def train_known(self) -> known.KnownKeys | None:
        return self._known(self.train_lookup, self.train_wide)

    @cached_property
    def answer_known(self) -> known.KnownKeys | None:
        return self._known(self.answer_lookup, self.answer_wide)

    def _tasks(self, found: DataFrame) -> int | None:
        """Parts for stored pairs, so that a task's share, and its memory, do not grow with the tables.

        None where the session's own number is enough: with fewer parts than that, the join by row would shuffle the folded pairs again.
        """
        if not self.stored:
            return None
        parts = 1 + found.count() // self.filters.pairs_per_task
        return parts if parts > int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None

    def _matched(self, side: str, found: DataFrame) -> DataFrame:
        if side == "train":
            stored, scans, lookup, keys, wide = self.train_pairs, self.label_rows, self.train_lookup, self.train_known, self.train_wide
        else:
            stored, scans, lookup, keys, wide = (
                self.answer_pairs, self.tables.query_rows, self.answer_lookup, self.answer_known, self.answer_wide
            )
        return pairs.pair_match(found, scans, lookup, known=keys, wide=wide, tasks=self._tasks(stored))

    @cached_property
    def train_match(self) -> DataFrame:
        return self._matched("train", self.train_pairs)

    @cached_property
    def answer_match(self) -> DataFrame:
        return self._matched("answer", self.answer_pairs)

    @staticmethod
    def _beside_shops(matched: DataFrame, shops: DataFrame) -> DataFrame:
        """Matched pairs with the columns of their shop, by a broadcast.

        A shop given twice counts the matches of its pairs twice, as it does where its columns go through the match.
        """
        columns = [F.max(name).alias(name) for name in shops.columns if name != "shop_no"]
        once = shops.groupBy("shop_no").agg(*columns, F.count("*").alias("_copies"))
        counted = F.col("wifi_in_swifi") * F.coalesce("_copies", F.lit(1))
        return matched.join(F.broadcast(once), "shop_no", "left").withColumn("wifi_in_swifi", counted).drop("_copies")

    def _with_shops(self, side: str, rows: DataFrame) -> DataFrame:
        """Pairs with the columns of their shop, of their match and of their row, and the differences.

        Where shops are few enough to be broadcast, the bare pairs are matched, and their shops meet them where the match left them.
        Else shop columns join the bare pairs before it; what leaves the match is already placed by row, so the widest
        table of the method is not shuffled again.
        """
        train = side == "train"
        found, shops = (self.train_pairs, self.train_shops) if train else (self.answer_pairs, self.answer_shops)
        if self.stored and shops.count() <= self.filters.most_shops:
            matched = self._beside_shops(self._matched(side, found), shops)
        else:
            matched = self._matched(side, spread_join(found, shops, "shop_no", "left"))
        joined = matched.join(rows, "row_id")
        return pairs.pair_signal(pairs.pair_geo(joined)).withColumns(pairs.slot_differences())

    @cached_property
    def train_pair_columns(self) -> DataFrame:
        return self._with_shops("train", self.enriched_label_rows.drop("shop_id"))

    @cached_property
    def answer_pair_columns(self) -> DataFrame:
        return self._with_shops("answer", self.enriched_query_rows)

    # Encoding

    @staticmethod
    def _narrow(rows: DataFrame) -> DataFrame:
        return rows.select("row_id", id_number("mall_id").alias("mall_no"), *(f"wifi{k}_bssid" for k in range(1, SLOTS + 1)))

    @cached_property
    def train_cells(self) -> DataFrame:
        """The columns to encode, of label rows."""
        return self._hand_off(self._narrow(self.enriched_label_rows), "train-cells")

    @cached_property
    def answer_cells(self) -> DataFrame:
        """The columns to encode, of query rows that have a candidate."""
        answerable = self.answer_pairs.select("row_id").distinct()
        return self._hand_off(self._narrow(self.enriched_query_rows).join(answerable, "row_id", "left_semi"), "answer-cells")

    @cached_property
    def codes(self) -> DataFrame:
        """One encoder for both sides, as labelled and query rows must get the same codes."""
        found = encode.ordinal_codes(self.train_cells.unionByName(self.answer_cells), encode.encoded_columns(), self._hand_off)
        return self._hand_off(found, "codes")

    @cached_property
    def encoded_label_rows(self) -> DataFrame:
        return encode.ordinal_encode(self.train_cells, self.codes, encode.encoded_columns())

    @cached_property
    def encoded_query_rows(self) -> DataFrame:
        return encode.ordinal_encode(self.answer_cells, self.codes, encode.encoded_columns())

    def _coded(self, rows: DataFrame, encoded: DataFrame, name: str) -> DataFrame:
        """Rows with their codes; joined here, as there are far fewer rows than pairs."""
        codes = encoded.select("row_id", *(f"{name}_code" for name in encode.encoded_columns()))
        return rows.join(self._hand_off(codes, name), "row_id")

    @staticmethod
    def _features(columns: DataFrame) -> DataFrame:
        """The differences are taken from the ids themselves; only then do codes take their place."""
        keys = [name for name in ("row_id", "label") if name in columns.columns]
        coded = {name: F.col(f"{name}_code").alias(name) for name in encode.encoded_columns()}
        return columns.withColumn("user_no", id_number("user_id")).select(
            *keys, *(coded.get(name, F.col(name)) for name in model.FEATURES)
        )

    @cached_property
    def train_features(self) -> DataFrame:
        """(row_id, label, 77 features) of the labelled pairs."""
        rows = self._coded(self.enriched_label_rows.drop("shop_id"), self.encoded_label_rows, "train-coded")
        return self._features(self._with_shops("train", rows))

    @cached_property
    def answer_features(self) -> DataFrame:
        """(row_id, 77 features) of the pairs to be ranked."""
        rows = self._coded(self.enriched_query_rows, self.encoded_query_rows, "answer-coded")
        return self._features(self._with_shops("answer", rows))

    # Answers

    def fit(self, boosting: model.BoostingSettings = model.BoostingSettings()) -> PipelineModel:
        """Train the ranker; the labelled pairs are stored first, as training reads them many times."""
        return model.fit_ranker(materialize(self.train_features, "train-features"), boosting)

    def fit_measured(self, boosting: model.BoostingSettings = model.BoostingSettings()) -> tuple[PipelineModel, list[float]]:
        """Train with the rounds that rows left out are served best by, up to ``boosting.rounds``; also the loss curve."""
        return model.fit_measured(materialize(self.train_features, "train-features"), boosting)

    def scores(self, ranker: PipelineModel) -> DataFrame:
        return model.score_pairs(ranker, self.answer_features)

    def answer(self, ranker: PipelineModel) -> DataFrame:
        """(row_id, shop_id) by the trained ranker, one row per query row."""
        return self.answer_by_scores(self.scores(ranker))

    def answer_by_scores(self, scores: DataFrame) -> DataFrame:
        """(row_id, shop_id) by given scores of the pairs, one row per query row."""
        return self._for_all_rows(best_candidate(scores, F.col("score")))

    def _for_all_rows(self, best: DataFrame) -> DataFrame:
        return self.tables.query_rows.select("row_id").join(best, "row_id", "left")

    def answer_by_rule(self) -> DataFrame:
        """(row_id, shop_id) without training, one row per query row: largest overlap, then nearest shop."""
        rows = self.tables.query_rows.select("row_id", "longitude", "latitude")
        places = self.tables.shops.select(
            id_number("shop_id").alias("shop_no"),
            F.col("longitude").alias("slongitude"),
            F.col("latitude").alias("slatitude"),
        )
        placed = spread_join(self.answer_match.join(rows, "row_id"), places, "shop_no", "left")
        nearest = -F.coalesce("dist", F.lit(float("inf")))
        return self._for_all_rows(best_candidate(pairs.pair_geo(placed), F.col("wifi_in_swifi"), nearest))
