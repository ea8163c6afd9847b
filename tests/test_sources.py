from __future__ import annotations

import os
import tempfile

from boxlens.operators.ols import ols_fit
from boxlens.sources.csv import read_csv
from boxlens.sources.tables import SCHEMAS, Tables
from tests.fixtures import box


def test_csv_regression_input(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="boxlens-csv-"), "result.csv")
    with open(path, "w") as fh:
        fh.write("box_size,error_rate\n1,2.0\n2,4.0\n3,5.0\n4,4.0\n5,5.0\n")
    typed = read_csv(spark, path)
    assert [f.dataType.simpleString() for f in typed.schema.fields] == ["int", "double"]
    inferred = read_csv(spark, path, schema=None)
    assert inferred.count() == 5
    fit = ols_fit(typed, "box_size", "error_rate").first()
    assert abs(fit.slope - 0.6) < 1e-12 and fit.n == 5


def test_catalog_tables(spark):
    frames = Tables.from_dataframes(spark, boxes=[box("c1", "b1", "2023-W01")])
    for name in SCHEMAS:
        getattr(frames, name).createOrReplaceTempView(f"src_{name}")
    t = Tables.from_catalog(spark, {name: f"src_{name}" for name in SCHEMAS})
    assert t.boxes.columns == SCHEMAS["boxes"].fieldNames()
    assert t.boxes.count() == 1 and t.errors.count() == 0


def test_catalog_column_mapping(spark):
    src = spark.createDataFrame(
        [("c1", "b1", "2023-W01", "2", "Auckland", "AU", "A")],
        "cust string, box string, wk string, size string, site string, grp string, shift string",
    )
    src.createOrReplaceTempView("src_boxes_raw")
    empty = Tables.from_dataframes(spark)
    for name in ("errors", "picks", "date_dim"):
        getattr(empty, name).createOrReplaceTempView(f"src2_{name}")
    t = Tables.from_catalog(
        spark,
        {"boxes": "src_boxes_raw", "errors": "src2_errors", "picks": "src2_picks", "date_dim": "src2_date_dim"},
        columns={"boxes": {"customer_id": "cust", "box_id": "box", "week": "wk", "box_size": "size",
                           "dc": "site", "market": "grp"}},
    )
    row = t.boxes.first()
    assert t.boxes.schema == SCHEMAS["boxes"]
    assert (row.customer_id, row.box_size, row.dc) == ("c1", 2, "Auckland")


def test_malformed_weeks(spark, tpch_tables):
    row = tpch_tables.malformed_weeks().first()
    assert (row.boxes, row.errors, row.picks, row.date_dim) == (0, 0, 0, 0)
    bad = Tables.from_dataframes(spark, boxes=[box("c1", "b1", "2023-W1"), box("c1", "b2", "2023-W54"),
                                               box("c1", "b3", "2023-W05"), box("c1", "b4", None)])
    assert bad.malformed_weeks().first().boxes == 2


def test_register_views(spark, tpch_tables):
    tpch_tables.register_views(prefix="bl_")
    n = spark.sql("SELECT count(*) FROM bl_boxes WHERE week LIKE '1996%'").first()[0]
    assert n == tpch_tables.boxes.filter("week LIKE '1996%'").count() > 0
