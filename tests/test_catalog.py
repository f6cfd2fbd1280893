import math
from pathlib import Path

import duckdb
import pytest

from pointloom.operators import kernels
from pointloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_its_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=key)


def test_cloth_takes_every_frame(spark):
    points = catalog.frames(spark, SF).toPandas()
    assert points.frame.nunique() > 5
    want = {}
    for _, p in points.groupby("frame"):
        want |= zip(zip(p.frame, p.idx), kernels.cloth(p[["x", "y", "z"]].to_numpy("float64"), 2.0).tolist())
    assert {(r.frame, r.idx): r.ground for r in catalog.QUERIES["cloth_ground_points"](spark, SF).collect()} == want
