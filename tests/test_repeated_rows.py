"""Queries against their SQL where stamps and ids occur more than once."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from checks import evaluation
from tools.check import connect, normal
from wayfold.operators.ordered import Chunks

SF = "/root/testdata/sf0.001"


def agree(spark, folder, name):
    got, want = normal(entry.queries()[name](spark, folder).toPandas()), normal(connect(folder).execute(entry.oracle_sql()[name]).df())
    assert len(got) and got.equals(want)


@pytest.mark.parametrize("name", ["deskew", "accumulate_in_view"])
def test_returns_that_share_an_idx(spark, tmp_path, name):
    duckdb.execute(f"COPY (SELECT l.* FROM '{SF}/lineitem.parquet' l, range(2)) TO '{tmp_path}/lineitem.parquet'")
    agree(spark, str(tmp_path), name)


def test_rows_that_share_a_stamp(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT e.* REPLACE (event_id + k * 100000 AS event_id) FROM '{SF}/events.parquet' e, range(3) r(k)) TO '{tmp_path}/events.parquet'")
    agree(spark, str(tmp_path), "section_overlap")


def test_sections_that_start_at_one_stamp_or_within_a_millisecond(spark, monkeypatch):
    """Two sections at 10.0 are one row of the SQL, those at 20.0 and 20.0004 are two."""
    stamps = [10.0] * 5 + [15.0] + [20.0] * 2 + [20.0002] + [20.0004] * 2 + [30.0 + i for i in range(8)]
    high = [True, True, False, True, True, False, True, True, False, True, True] + [False] * 8
    rows = [
        {"drive": 1, "estimator": name, "stamp": t, "idx": i, "est_idx": i, "horiz": 50.0 + k if h else 0.5 + i, "vert": 0.1 * i, "yaw_deg": 1.0 + k, "distance": 10.0 * i}
        for k, name in enumerate((evaluation.ODOM, evaluation.FILTER)) for i, (t, h) in enumerate(zip(stamps, high, strict=True))
    ]
    er = pd.DataFrame(rows)
    monkeypatch.setattr(evaluation, "two_estimators", lambda *_: (Chunks(), spark.createDataFrame(er)))
    sql = entry.oracle_sql()["section_summary"]
    con = duckdb.connect()
    con.register("er", er.rename(columns={"idx": "gt_idx"}))
    want = con.execute("WITH " + sql[sql.index("th AS (SELECT"):]).df()
    got = entry.queries()["section_summary"](spark, "").toPandas()
    assert len(want) == 6 and normal(got).equals(normal(want))
