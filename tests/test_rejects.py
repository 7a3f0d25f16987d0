"""Bad lines kept aside, with reasons and a limit."""

import pytest

from aislefix.sources import schemas
from aislefix.sources.rejects import TooManyRejects, read_keeping_rejects

HEADER = "row_id,user_id,mall_id,time_stamp,longitude,latitude,wifi_infos"
GOOD = "1,u_1,m_1,2017-09-01T10:00:00,113.5,20.25,b_1|-50|true;b_2|-60|false"
LINES = {
    GOOD: None,
    "2,u_1,m_1,2017-09-01T10:00:00,,20.25,": None,  # empty cells are nulls, not errors
    "3,u_1,m_1,2017-09-01T10:00:00,1.0,2.0,b_-999|-5|true": None,
    "x,u_1,m_1,2017-09-01T10:00:00,1.0,2.0,": ["row_id: not a bigint"],
    "5,u_1,m_1,soon,1.0.0,2.0,": ["time_stamp: not a timestamp_ntz", "longitude: not a double"],
    "6,u_1,m_1,2017-09-01T10:00:00,1.0,2.0,b_1|-50|perhaps": ["wifi_infos: not a hit"],
    "7,u_1,m_1,2017-09-01T10:00:00,1.0,2.0,b_1|-50|true;b_2|-60": ["wifi_infos: not a hit"],
    "8,u_1,m_1,2017-09-01T10:00:00,1.0": ["not 7 fields"],
    "9,u_1,m_1,2017-09-01T10:00:00,1.0,2.0,,more": ["not 7 fields"],
}


def read(spark, path, lines, **settings):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return read_keeping_rejects(spark, str(path), schemas.QUERY_ROWS, scan="wifi_infos", **settings)


def test_rejects_and_reasons(spark, tmp_path):
    split = read(spark, tmp_path / "rows.csv", LINES, most=1.0)
    # A line whose cells all parse is written anew.
    assert {r.line.replace("00.000", "00"): r.reasons for r in split.rejects.collect()} == {k: v for k, v in LINES.items() if v}
    assert sorted(r.row_id for r in split.good.collect()) == [1, 2, 3]
    assert (split.rejected, split.lines) == (6, 9)
    # A query of one column sees the same rows.
    assert split.good.select("row_id").count() == 3 and split.good.columns == HEADER.split(",")


def test_limit(spark, tmp_path):
    lines = [GOOD] * 99 + ["8,u_1"]
    assert read(spark, tmp_path / "rows.csv", lines, most=0.01).rejected == 1
    with pytest.raises(TooManyRejects, match="1 of 100"):
        read(spark, tmp_path / "rows.csv", lines, most=0.005)


def test_empty_file_and_other_header(spark, tmp_path):
    split = read(spark, tmp_path / "none.csv", [])
    assert split.lines == 0 and split.good.count() == 0
    path = tmp_path / "other.csv"
    path.write_text(GOOD.replace("1", "z") + "\n" + GOOD + "\n")
    with pytest.raises(Exception, match="header"):
        read_keeping_rejects(spark, str(path), schemas.QUERY_ROWS)
