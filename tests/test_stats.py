import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orgpulse.functions.ranking import average_rank_percentile
from orgpulse.functions.stats import percentile_cuts, quantiles


def values(kind: str, n: int = 3000) -> np.ndarray:
    rng = np.random.default_rng(3)
    v = {
        "continuous": rng.lognormal(3, 2, n),
        "ties": rng.integers(0, 12, n).astype(float),
        # a third of all rows share one value
        "hot": np.where(np.arange(n) % 3 == 0, 7.0, rng.lognormal(2, 1, n)),
        "zeros": np.where(np.arange(n) % 2 == 0, 0.0, rng.normal(0, 5, n)),
        "same": np.full(n, 4.0),
    }[kind]
    return v


@pytest.fixture(scope="module")
def frame(spark):
    kinds = ["continuous", "ties", "hot", "zeros", "same"]
    pdf = pd.DataFrame({k: values(k) for k in kinds})
    pdf["with_null"] = pdf["continuous"].where(pdf.index % 5 > 0)
    pdf["id"] = range(len(pdf))
    pdf["empty"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    return pdf, df.repartition(4).cache()


@pytest.mark.parametrize("bracket_rows", [2_000_000, 40])
def test_quantiles_equal_pandas(frame, bracket_rows):
    pdf, df = frame
    qs = [0.0, 0.005, 0.5, 0.75, 0.99, 1.0]
    names = [c for c in pdf.columns if c != "id"]
    got = quantiles(df, {c: (F.col(c), qs) for c in names}, bracket_rows)
    for c in names:
        for q in qs:
            want = pdf[c].quantile(q)
            if np.isnan(want):
                assert got[(c, q)] is None
            else:
                assert got[(c, q)] == want, (c, q)


@pytest.mark.parametrize("bracket_rows", [2_000_000, 40])
def test_cuts_give_the_level_of_the_percentile(frame, bracket_rows):
    pdf, df = frame
    shares = (0.75, 0.90, 0.95)
    names = ["continuous", "ties", "hot", "zeros", "same", "empty"]
    cuts = percentile_cuts(df, {c: F.when(F.col(c) > 0, F.col(c)) for c in names}, shares, bracket_rows)
    for c in names:
        v = pdf[c][pdf[c] > 0]
        rank = v.rank(method="average", pct=True)
        for s, cut in zip(shares, cuts[c]):
            assert ((v <= cut) == (rank <= s)).all(), (c, s)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 19, 20, 21])
def test_cuts_of_few_values(spark, n):
    v = pd.Series(range(1, n + 1), dtype=float)
    df = spark.createDataFrame([(x,) for x in v], "v double")
    cuts = percentile_cuts(df, {"v": F.col("v")}, (0.75, 0.90, 0.95))["v"]
    rank = v.rank(pct=True)
    for s, cut in zip((0.75, 0.90, 0.95), cuts):
        assert ((v <= cut) == (rank <= s)).all()


@pytest.mark.parametrize("range_rows", [2_000_000, 100])
def test_average_rank_equals_pandas(frame, range_rows):
    pdf, df = frame
    names = ["continuous", "ties", "hot", "zeros", "with_null", "empty"]
    got = average_rank_percentile(df, ["id"], {c: F.col(c) for c in names}, range_rows).toPandas()
    assert len(got) == int(pdf[names].notna().sum().sum())
    for c in names:
        mine = got[got["name"] == c].set_index("id")["pct"].sort_index()
        want = pdf.set_index("id")[c].dropna().rank(method="average", pct=True)
        assert (mine == want).all() and len(mine) == len(want), c
