"""Reading CSV with bad lines kept aside: good rows on one side, lines with their reasons on the other.

``tables.read_table`` is strict and ends a job at the first bad cell. Here a line is rejected if it has not as many
fields as the schema has columns, if a cell does not parse as its column's type, or if a scan holds something that is not a hit. More
rejects than the stated share fail the read, after the rejects are stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from aislefix.functions.scans import wrong_hits
from aislefix.sources.tables import materialize

_LINE = "_line"


class TooManyRejects(ValueError):
    pass


@dataclass(frozen=True)
class Split:
    good: DataFrame
    #: (the columns that could be read, line, reasons); a line whose cells all parse is written anew
    rejects: DataFrame
    rejected: int
    lines: int


def _reasons(schema: T.StructType, scan: str | None) -> Column:
    """What is wrong with a row, in the order of the columns; empty for a good one."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("_rest", T.StringType())])
    cells = F.from_csv(F.col(_LINE), as_text.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"columnNameOfCorruptRecord": "_rest"})
    cells = F.when(F.col(_LINE).isNotNull(), cells)
    found = []
    for field in schema.fields:
        unread = cells[field.name].isNotNull() & F.col(field.name).isNull()
        found.append(F.when(unread, F.lit(f"{field.name}: not a {field.dataType.simpleString()}")))
        if field.name == scan:
            found.append(F.when(F.size(wrong_hits(scan)) > 0, F.lit(f"{scan}: not a hit")))
    found.append(F.when(cells["_rest"].isNotNull(), F.lit(f"not {len(schema.fields)} fields")))
    named = F.filter(F.array(*found), lambda reason: reason.isNotNull())
    return F.when(F.col(_LINE).isNotNull() & (F.size(named) == 0), F.array(F.lit("not a line of this table"))).otherwise(named)


def read_keeping_rejects(
    spark: SparkSession, path: str, schema: str, most: float = 0.001, scan: str | None = None
) -> Split:
    """Good rows and rejects of a CSV table; ``most`` is the share of lines that may be rejected.

    ``scan`` names the column of scan texts. Both sides are stored, as the input is read once.
    """
    wanted = T.StructType.fromDDL(schema)
    # All columns are parsed whatever a query reads, or a bad cell in an unread column would go unseen.
    reader = spark.read.schema(f"{schema}, {_LINE} string").option("columnNameOfCorruptRecord", _LINE).option("columnPruning", False)
    raw = reader.csv(path, header=True, mode="PERMISSIVE", enforceSchema=False)
    names = [field.name for field in wanted.fields]
    told = raw.withColumn("reasons", _reasons(wanted, scan))
    whole = F.coalesce(F.col(_LINE), F.to_csv(F.struct(*names)))
    split = materialize(told.select(*names, F.when(F.size("reasons") > 0, whole).alias("line"), "reasons"), "read")
    good, rejects = split.where(F.size("reasons") == 0).select(*names), split.where(F.size("reasons") > 0)
    lines, rejected = split.agg(F.count("*"), F.count("line")).head()
    if rejected > most * lines:
        raise TooManyRejects(f"{rejected} of {lines} lines of {path} rejected, more than {most:.3%}")
    return Split(good, rejects, rejected, lines)
