"""distributed_row_number against a brute-force rank on arbitrary inputs."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxlens.operators.ranking import distributed_row_number

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 5)),
    min_size=1, max_size=60,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, parts=st.integers(1, 7))
def test_rank_equals_brute_force(spark, rows, parts):
    data = [(g, s, f"id{i:03d}") for i, (g, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, s int, cid string")
    got = {
        r.cid: r.rn
        for r in distributed_row_number(
            df, ["g"], [F.col("s").desc(), F.col("cid").asc()], "rn", num_partitions=parts
        ).collect()
    }
    want = {}
    for g in {r[0] for r in data}:
        members = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        want.update({r[2]: i + 1 for i, r in enumerate(members)})
    assert got == want
