"""How the sources of a language differ in their words.

Tokenizer: one ``bytes.translate`` lowers A to Z and blanks every other ASCII
character, ``bytes.split`` gives the terms, a Counter a document their
frequencies. A task adds documents up by group (language and source) and hands on a row for each
term of a group: its occurrences and the documents that have it.

A language keeps the terms that at least ``least_documents`` of its documents have. Each group, and
the language as a whole, then gives every kept term a smoothed share in parts of
``unit``; shares are whole numbers, and so are their differences.

- ``term`` rows: the terms that a group uses more than its language does.
- ``pair`` rows: the sum of all differences to each other source.

Terms that a group lacks have a share too, so sums over pairs need all groups of a
term at once: the terms of a language are dealt into stretches, each a small
matrix of terms by groups, and only the matrix of sums leaves a task.

Defined results: null text, language and source are ''; a group without
terms has its rows; a language without kept terms has ``pair`` rows of value 0;
repeated rows count each; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislefix.llm.cells import text_slices
from aislefix.operators.spread import spread_join
from aislefix.sources.tables import materialize

_LETTERS = bytes(range(ord("A"), ord("Z") + 1))
_BLANKS = bytes(b for b in range(128) if not chr(b).isalpha())
_TABLE = bytes.maketrans(_LETTERS + _BLANKS, _LETTERS.lower() + b" " * len(_BLANKS))
#: Terms a task holds before it hands them on, and cells of a matrix of terms by groups.
_HELD = 200_000
_CELLS = 200_000
#: Cells of the matrices of sums a task holds.
_SUMS = 1 << 22


@dataclass(frozen=True)
class DivergenceSettings:
    least_documents: int = 30
    smoothing: int = 5
    unit: int = 1_000_000_000
    terms: int = 50


def split_terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class _Tally:
    """Occurrences and documents by group and term."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        seen = Counter(split_terms(text))
        if group not in self.groups:
            self.groups[group] = Counter(), Counter()
        uses, documents = self.groups[group]
        before = len(uses)
        uses.update(seen)
        documents.update(seen.keys())
        self.held += len(uses) - before

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, documents) in self.groups.items():
            terms = list(uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array([uses[t] for t in terms], pa.int64()),
                 pa.array([documents[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        self.groups, self.held = {}, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in text_slices(batch.column(2)):
            raw, offsets = part.data.tobytes(), part.offsets.tolist()
            for i in range(part.rows):
                row = part.first_row + i
                tally.add((langs[row], sources[row]), raw[offsets[i] : offsets[i + 1]])
            if tally.held > _HELD:
                yield from tally.rows()
    yield from tally.rows()


def shares(counts: np.ndarray, total: np.ndarray, unit: int = 1_000_000_000) -> np.ndarray:
    """1 + floor(unit * counts / total), for counts up to total, without leaving 64 bits."""
    steps = 1
    while unit > 1000**steps:
        steps += 1
    if unit != 1000**steps:
        raise ValueError("unit must be a power of 1000")
    whole, rest = np.zeros(np.broadcast(counts, total).shape, np.int64), counts
    for _ in range(steps):
        rest = rest * 1000
        whole = whole * 1000 + rest // total
        rest = rest % total
    return whole + 1


def _pair_sums(settings: DivergenceSettings):
    """Rows (lang, sources, totals, v, uses of each term) -> (lang, source, item, value), source before item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (sources, value) in sums.items():
                for i in range(len(sources) - 1):
                    rest = sources[i + 1 :]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(rest), pa.string()), pa.array([sources[i]] * len(rest), pa.string()),
                         pa.array(rest, pa.string()), pa.array(value[i, i + 1 :])], names=["lang", "source", "item", "value"])
            sums.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                lang, v = batch.column("lang")[r].as_py(), batch.column("v")[r].as_py()
                sources = batch.column("sources")[r].values
                totals = batch.column("totals")[r].values.to_numpy()
                uses = batch.column("uses")[r].values
                cells = uses.flatten()
                counts = np.zeros((len(uses), len(sources)), np.int64)
                term = np.repeat(np.arange(len(uses)), uses.value_lengths().to_numpy())
                place = pc.index_in(cells.field("source"), value_set=sources).to_numpy(zero_copy_only=False).astype(np.int64)
                counts[term, place] = cells.field("n").to_numpy()
                p = shares(counts + settings.smoothing, totals[None, :] + settings.smoothing * v, settings.unit)
                if lang not in sums:
                    if sum(x.size for _, x in sums.values()) + len(sources) ** 2 > _SUMS:
                        yield from out()
                    sums[lang] = sources.to_pylist(), np.zeros((len(sources), len(sources)), np.int64)
                value = sums[lang][1]
                for i in range(len(sources) - 1):
                    value[i, i + 1 :] += np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(axis=0)
        yield from out()

    return run


def _share(count: str, total: str, s: DivergenceSettings) -> Column:
    """The same share as ``shares``, of columns; ``v`` is the number of kept terms."""
    return F.expr(
        f"1 + (CAST({s.unit} AS DECIMAL(38, 0)) * ({count} + {s.smoothing})) div CAST({total} + {s.smoothing} * v AS DECIMAL(38, 0))"
    )


def source_divergence(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", settings: DivergenceSettings | None = None
) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    s = settings or DivergenceSettings()
    read = df.select(
        F.coalesce(df[lang].cast("string"), F.lit("")).alias("lang"),
        F.coalesce(df[source].cast("string"), F.lit("")).alias("source"),
        df[text].alias("text"),
    )
    counted = read.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    # Placed by term once: the sums by source and then by term follow without another shuffle.
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("uses")
    )
    kept = materialize(by_term.where(F.col("docs") >= s.least_documents).drop("docs"), "terms")

    uses = kept.select("lang", "term", "lang_n", F.inline("uses"))
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    occurring = read.select("lang", "source").distinct()
    groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in ("total", "v", "lang_total"))
    )
    groups = materialize(groups, "groups")

    cells = spread_join(uses, groups, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", s).alias("p"), _share("lang_n", "lang_total", s).alias("q")
    )
    more = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_group = more.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= s.terms)

    sides = groups.where("v > 0").groupBy("lang", "v").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("of"))
    sides = sides.select("lang", "v", F.col("of.source").alias("sources"), F.col("of.total").alias("totals"))
    stretches = F.ceil(F.col("v") * F.size("sources") / F.lit(_CELLS)).cast("bigint")
    placed = kept.join(sides.select("lang", stretches.alias("stretches")), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "stretches").alias("stretch"), "uses"
    )
    stretched = placed.groupBy("lang", "stretch").agg(F.collect_list("uses").alias("uses")).join(sides, "lang")
    summed = stretched.select("lang", "v", "sources", "totals", "uses").mapInArrow(
        _pair_sums(s), "lang string, source string, item string, value bigint"
    )
    once = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    idle = groups.where("v = 0").select("lang", "source")
    pairs = (
        once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        .unionByName(
            idle.join(idle.withColumnRenamed("source", "item"), "lang").where("source <> item")
            .select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
        )
        .withColumn("rank", F.row_number().over(best_first))
    )
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(names).unionByName(by_group.withColumn("part", F.lit("term")).select(names))
