"""A trained ranker with all that scoring needs, in one folder: a later session answers new rows from it alone.

A bundle holds the ranker, the codes it was trained with, the settings, the loss curve, shops, mall centres, and the
profiles and index of the answer window. Versions stand side by side under one folder. The settings are written last and mark a
whole bundle; one without them (a writer that was lost) is passed over.

Ids that the codes do not know get no code; the ranker sees them as missing.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from aislefix.operators.model import BoostingSettings, load_model, rounds_used, save_model
from aislefix.plans.pipeline import Positioning
from aislefix.settings import Settings
from aislefix.sources.tables import Tables

FORMAT = 1
TABLES = ("shops", "centres", "stats", "index", "codes")


@dataclass(frozen=True)
class Bundle:
    path: str
    settings: Settings
    boosting: BoostingSettings
    rounds: int
    curve: list[float]
    ranker: PipelineModel
    tables: dict[str, DataFrame]

    def scorer(self, query_rows: DataFrame, prior: DataFrame, stored: bool = False) -> Scorer:
        return Scorer(self, query_rows, prior, stored)

    def answer(self, query_rows: DataFrame, prior: DataFrame, stored: bool = False) -> DataFrame:
        """(row_id, shop_id), one row per query row."""
        return self.scorer(query_rows, prior, stored).answer(self.ranker)


class Scorer(Positioning):
    """The answer side of the method, with a bundle in place of visits."""

    def __init__(self, bundle: Bundle, query_rows: DataFrame, prior: DataFrame, stored: bool = False) -> None:
        nothing = None  # no step of the answer side reads visits or their prior
        super().__init__(Tables(bundle.tables["shops"], nothing, query_rows, nothing, prior), bundle.settings, stored)
        self.bundle = bundle

    @cached_property
    def mall_centres(self) -> DataFrame:
        return self.bundle.tables["centres"]

    @cached_property
    def answer_stats(self) -> DataFrame:
        return self.bundle.tables["stats"]

    @cached_property
    def answer_index(self) -> DataFrame:
        return self.bundle.tables["index"]

    @cached_property
    def codes(self) -> DataFrame:
        return self.bundle.tables["codes"]


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions under a folder, whole or not."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(int(name[1:]) for name in names if re.fullmatch(r"v\d+", name))


def _is_whole(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/settings/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def save_bundle(
    method: Positioning, ranker: PipelineModel, folder: str, boosting: BoostingSettings = BoostingSettings(), curve: list[float] = ()
) -> str:
    """Write the next version under ``folder``; returns its path."""
    spark = method.tables.shops.sparkSession
    path = f"{folder.rstrip('/')}/v{max(_versions(spark, folder), default=0) + 1}"
    save_model(ranker, f"{path}/ranker")
    held = (method.tables.shops, method.mall_centres, method.answer_stats, method.answer_index, method.codes)
    for name, table in zip(TABLES, held, strict=True):
        table.write.parquet(f"{path}/{name}")
    said = {
        "format": FORMAT, "settings": asdict(method.settings), "boosting": asdict(boosting), "rounds": rounds_used(ranker),
        "curve": [float(x) for x in curve],
    }
    spark.createDataFrame([(json.dumps(said),)], "settings string").coalesce(1).write.text(f"{path}/settings")
    return path


def load_bundle(spark: SparkSession, folder: str, version: int | None = None) -> Bundle:
    """The version asked for, or the latest whole one."""
    whole = [v for v in _versions(spark, folder) if version in (None, v) and _is_whole(spark, f"{folder.rstrip('/')}/v{v}")]
    if not whole:
        raise FileNotFoundError(f"no whole bundle {'' if version is None else f'v{version} '}in {folder}")
    path = f"{folder.rstrip('/')}/v{whole[-1]}"
    said = json.loads(spark.read.text(f"{path}/settings").head()[0])
    if said["format"] != FORMAT:
        raise ValueError(f"{path} has format {said['format']}; this library reads {FORMAT}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return Bundle(
        path, Settings(**said["settings"]), BoostingSettings(**said["boosting"]), said["rounds"], said["curve"],
        load_model(f"{path}/ranker"), tables,
    )
