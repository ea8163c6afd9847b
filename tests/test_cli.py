from __future__ import annotations

import os
import tempfile

from boxlens.__main__ import main


def test_cli_runs_a_report_and_writes_parquet(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="boxlens-cli-"), "q14")
    assert main(["q14", "--tpch", "/root/testdata/sf0.001", "--year", "1996", "--out", out]) == 0
    df = spark.read.parquet(out)
    assert df.columns == ["dc", "errors", "total_comp", "production", "procurement", "logistics", "others"]
    assert df.count() > 0


def test_cli_parameter_override(spark, capsys):
    assert main(["q17", "--tpch", "/root/testdata/sf0.001", "--year", "1995",
                 "--set", "high_error_threshold=0", "--set", "min_high_error_weeks=1", "--show", "3"]) == 0
    assert "sku_name" in capsys.readouterr().out


def test_cli_lists_reports(capsys):
    assert main(["--list"]) == 0
    assert "q19" in capsys.readouterr().out


def test_cli_catalog_with_column_mapping(spark, capsys):
    from boxlens.sources.tables import Tables

    src = Tables.from_tpch(spark, "/root/testdata/sf0.001")
    src.boxes.withColumnRenamed("customer_id", "customer_fk").createOrReplaceTempView("cli_boxes")
    for name in ("errors", "picks", "date_dim"):
        getattr(src, name).createOrReplaceTempView(f"cli_{name}")
    catalog = ",".join(f"{n}=cli_{n}" for n in ("boxes", "errors", "picks", "date_dim"))
    assert main(["q09", "--catalog", catalog, "--columns", '{"boxes": {"customer_id": "customer_fk"}}',
                 "--year", "1996", "--show", "3"]) == 0
    assert "customer_count" in capsys.readouterr().out
