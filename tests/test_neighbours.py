import numpy as np
import pandas as pd
import pytest

from orgpulse.config import AXES, ScoringConfig
from orgpulse.functions import boxes
from orgpulse.operators import neighbours


SIZES = {
    "default": {},
    "small": dict(box_rows=25, range_rows=50, fan=1),
    "nested": dict(box_rows=4, range_rows=50, fan=2, cells=4),  # three levels and more, boxes below k + 1
}


def cloud(kind: str, n: int = 400) -> pd.DataFrame:
    rng = np.random.default_rng(5)
    x = rng.lognormal(6, 1.5, (n, 3)).round(2)
    if kind == "copies":  # a third of all organisations share one point, others come in pairs
        x[::3] = 0.0
        x[1::6][: len(x[4::6])] = x[4::6]
    if kind == "clusters":  # one dense cluster holds most rows, a few outliers are far away
        x = 1000 + rng.random((n, 3))
        x[:5] *= [[10], [100], [1000], [0], [50]]
    if kind == "grid":  # many equal distances
        g = np.expm1(np.arange(8) / 4)
        x = np.array([(a, b, 0.0) for a in g for b in g for _ in range(3)])[:n]
    pdf = pd.DataFrame(x, columns=list(AXES))
    pdf["org_id"] = rng.permutation(len(pdf)) + 10
    pdf["org_name"] = "org " + pdf["org_id"].astype(str)
    pdf["svk_form_level"] = rng.integers(0, 5, len(pdf))
    pdf["is_report_filled"] = pdf["org_id"] % 17 != 0
    return pdf


def brute(pdf: pd.DataFrame, k: int) -> dict:
    pdf = pdf[pdf["is_report_filled"]].reset_index(drop=True)
    at = np.log1p(pdf[list(AXES)].to_numpy())
    ids = pdf["org_id"].to_numpy()
    out = {}
    for i in range(len(pdf)):
        sq = np.zeros(len(pdf))
        for a in range(3):
            sq += (at[i, a] - at[:, a]) ** 2
        d = np.sqrt(sq)
        d[i] = np.inf
        out[ids[i]] = [(int(ids[j]), d[j], i, j) for j in np.lexsort((ids, d))[:k]]
    return out


@pytest.mark.parametrize(
    "kind, sizes",
    [(k, s) for k in ("plain", "copies", "clusters", "grid") for s in ("default", "small")]
    + [("copies", "nested"), ("clusters", "nested")],
)
def test_equal_to_brute_force(spark, kind, sizes):
    pdf = cloud(kind)
    cfg = ScoringConfig(min_group_size=5)
    options = SIZES[sizes]
    got = neighbours.cloud_peers(spark.createDataFrame(pdf), cfg, **options).toPandas()
    want = brute(pdf, 5)
    assert set(got["org_id"]) == set(want) and len(got) == len(want)
    filled = pdf[pdf["is_report_filled"]].reset_index(drop=True)
    form = filled["svk_form_level"].to_numpy()
    at = np.log1p(filled[list(AXES)].to_numpy())
    got = got.set_index("org_id")
    for org, near in want.items():
        row = got.loc[org]
        mine = [(n["id"], n["dist"]) for n in row["neighbors"]]
        if kind == "grid":  # log1p may differ in the last bit, so equal distances may swap
            assert np.allclose([d for _, d in mine], [n[1] for n in near], atol=1e-12)
            continue
        assert [i for i, _ in mine] == [n[0] for n in near]
        assert np.allclose([d for _, d in mine], [n[1] for n in near], atol=1e-12)
        i, js = near[0][2], [n[3] for n in near]
        assert row["peer_3d_form_median"] == int(np.round(np.median(form[js])))
        skew = np.abs(at[i] - np.median(at[js], axis=0))
        assert row["profile_skew_3d"] == pytest.approx(round(skew.max(), 3), abs=1.1e-3)
        assert row["profile_skew_3d_axis"] == AXES[int(np.argmax(skew))]
        assert row["peer_3d_neighbors"] == "; ".join(f"org {n[0]}" for n in near)
    rank = got["peer_3d_mean_distance"].rank(pct=True)
    assert np.allclose(got["peer_3d_confidence"], (1 - rank).round(2), atol=0.011)


def test_string_keys_and_even_group_size(spark):
    pdf = cloud("copies", 60)
    pdf["org_id"] = "k" + pdf["org_id"].astype(str).str.zfill(4)
    pdf["is_report_filled"] = True
    got = neighbours.cloud_peers(spark.createDataFrame(pdf), ScoringConfig(min_group_size=4), box_rows=10).toPandas()
    ids = {"k" + str(i).zfill(4): i for i in range(10, 70)}
    number = cloud("copies", 60)
    number["is_report_filled"] = True
    want = brute(number, 4)
    for row in got.itertuples():
        assert [ids[n["id"]] for n in row.neighbors] == [n[0] for n in want[ids[row.org_id]]]


def test_boxes_of_several_levels(spark):
    at = np.log1p(cloud("clusters")[list(AXES)].to_numpy())
    points = pd.DataFrame(at, columns=["x", "y", "z"]).assign(loc=np.arange(len(at)))
    boxed, levels = boxes.nested_boxes(spark.createDataFrame(points), 4, 6, cells=4)
    tables = [t.toPandas().set_index("box").sort_index() for t in levels]
    boxed = boxed.toPandas()
    assert len(levels) >= 4 and tables[0].index.tolist() == [0] and tables[0]["n"].iloc[0] == len(at)
    assert sorted(boxed["loc"]) == list(range(len(at)))
    for upper, lower in zip(tables, tables[1:]):
        assert set(lower["parent"]) == set(upper.index[upper["split"]])
        assert (lower.groupby("parent")["n"].sum() == upper["n"][upper["split"]]).all()
    leaves = pd.concat([t[~t["split"]] for t in tables])
    assert leaves["n"].max() <= 8 and (boxed.groupby("box").size() == leaves["n"].sort_index()).all()
    assert np.allclose(boxed.groupby("box")["x"].max(), leaves["high_x"].sort_index(), atol=0)


def test_repeated_keys_are_refused(spark):
    pdf = cloud("lognormal", 12)
    pdf["is_report_filled"] = True
    pdf["org_id"] = [0, 0, 0, 0, *range(1, 9)]
    with pytest.raises(ValueError, match="org_id=0"):
        neighbours.cloud_peers(spark.createDataFrame(pdf), ScoringConfig())


def test_too_few_organisations(spark):
    five = spark.createDataFrame(cloud("plain", 5).assign(is_report_filled=True))
    assert neighbours.cloud_peers(five, ScoringConfig()).count() == 0
    six = spark.createDataFrame(cloud("plain", 6).assign(is_report_filled=True))
    out = neighbours.cloud_peers(six, ScoringConfig())
    assert out.count() == 6 and {r["peer_3d_group_size"] for r in out.collect()} == {5}


def test_uses_of_the_benchmark(spark):
    peers = neighbours.cloud_peers(spark.createDataFrame(cloud("plain", 80)), ScoringConfig()).cache()
    pdf = peers.toPandas()
    below = pdf[(pdf["form_vs_peer_3d"] <= -1) & (pdf["peer_3d_confidence"] >= 0.5)]
    table = neighbours.priority(peers).toPandas()
    assert set(table["org_id"]) == set(below["org_id"])
    assert table["form_vs_peer_3d"].is_monotonic_increasing
    total = neighbours.peers_overview(peers).first()
    assert (total["orgs"], total["below_peers"]) == (len(pdf), len(below))
    org = int(pdf["org_id"].iloc[0])
    near = [n["id"] for n in pdf["neighbors"].iloc[0]]
    assert [r["id"] for r in neighbours.neighbours_of(peers, org).orderBy("rank").collect()] == near
    tags = neighbours.highlight(peers, org).toPandas().set_index("org_id")["tag"]
    assert tags[org] == neighbours.SELECTED and (tags[near] == neighbours.NEIGHBOUR).all()
    assert (tags == neighbours.OTHER).sum() == len(pdf) - 6


def test_neighbours_by_name(spark):
    schema = "org_id long, org_name string, neighbors array<struct<id: long, name: string, dist: double>>"
    near = [(7, "b", 0.5), (9, "c", 1.5)]
    df = spark.createDataFrame([(1, "a", near), (2, "a", near[:1]), (7, "b", []), (9, None, None)], schema)
    got = [tuple(r) for r in neighbours.neighbours_of_named(df, "a").orderBy("org_id", "rank").collect()]
    assert got == [(1, 1, 7, "b", 0.5), (1, 2, 9, "c", 1.5), (2, 1, 7, "b", 0.5)]
    assert neighbours.neighbours_of_named(df, "x").count() == 0
