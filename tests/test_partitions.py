"""Shuffles are dealt by the size of what they carry, not by a number the session fixes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orgpulse import staging
from orgpulse.config import ScoringConfig
from orgpulse.functions import ranking
from orgpulse.operators import scoring


@pytest.fixture
def files(spark, tmp_path):
    """An input of three files, all in all above 3,000 bytes."""
    at = str(tmp_path / "rows.parquet")
    spark.range(3_000).repartition(3).write.parquet(at)
    return at


def test_staged_tables_get_partitions_by_size_of_their_input(spark, files, monkeypatch):
    seen = []

    def build():
        seen.append(int(spark.conf.get(staging.PARTITIONS)))
        return spark.read.parquet(files)

    former = spark.conf.get(staging.PARTITIONS)
    monkeypatch.setattr(staging, "BYTES_PER_PARTITION", 100)
    staging.staged_once(spark, files, "many", build, [files])
    assert seen[0] >= 30
    assert spark.conf.get(staging.PARTITIONS) == former


def test_partitions_never_fall_below_the_session_and_come_back_after_an_error(spark, files, monkeypatch):
    former = spark.conf.get(staging.PARTITIONS)
    with staging.partitions_by_size(spark, [files]):
        assert spark.conf.get(staging.PARTITIONS) == former
    monkeypatch.setattr(staging, "BYTES_PER_PARTITION", 100)
    with pytest.raises(ValueError), staging.partitions_by_size(spark, [files]):
        raise ValueError
    assert spark.conf.get(staging.PARTITIONS) == former


def test_ranks_are_dealt_by_number_of_rows(spark, monkeypatch):
    """One task held all ranges that the session's number of partitions gave it."""
    monkeypatch.setattr(ranking, "RANKED_ROWS", 100)
    rows = spark.range(3_000).select("id", F.pmod(F.col("id") * 7919, F.lit(1_009)).cast("double").alias("v"))
    columns = {"v": F.col("v"), "w": F.when(F.col("id") % 3 > 0, F.col("v"))}
    found = ranking.average_rank_percentile(rows, ["id"], columns, range_rows=50)
    assert ", 50), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    whole = ranking.average_rank_percentile(rows, ["id"], columns, range_rows=10_000)
    assert sorted(found.collect()) == sorted(whole.collect())


def test_looked_up_rows_are_dealt_by_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LOOKED_UP_ROWS", 50)
    rows = spark.range(1_000).select("id", (F.col("id") % 10).alias("value"))
    table = spark.range(10).select(F.col("id").alias("value"), (F.col("id") * 2).alias("c"))
    found = ranking.lookup_by_value(rows, table, ["value"], F.col("c") >= 16, True, 1_000)
    assert ", 20), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select("id", "value", "c").collect())) == [(i, i % 10, i % 10 * 2) for i in range(1_000)]


def test_scores_meet_the_report_before_it_grows(spark):
    """The derived columns, most of a row's bytes, were shuffled for the join of the scores."""
    df = spark.range(40).select(
        F.col("id").alias("org_id"), F.concat(F.lit("o"), "id").alias("org_name"), (F.col("id") % 7 * 3.0).alias("staff_avg")
    )
    cfg = ScoringConfig()
    stats = scoring.fit(df, cfg)
    out = scoring.enrich(df, cfg, stats)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    above, _, below = plan.partition("Join LeftOuter")
    assert "AS data_quality_flags" in above and "AS data_quality_flags" not in below
    names = [f"{d.key}_load_score" for d in cfg.directions]
    plain = scoring.enrich(df, cfg, stats, scores=False).columns
    assert out.columns == ["org_id", *[c for c in plain if c != "org_id"], *names]
