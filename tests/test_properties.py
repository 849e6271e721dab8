"""Property tests: the custom plans against brute force / pandas / numpy on random small inputs."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from outagelens.operators.asof import asof_nearest
from outagelens.operators.fill import gap_fill
from outagelens.operators.quantiles import exact_percentiles

BASE = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def brute_asof(left, right, tol):
    """pandas merge_asof(direction='nearest') semantics, spelled out."""
    out = {}
    for g, t in left:
        cands = [(rt, s, b) for (rg, rt, s, b) in right if rg == g and abs(rt - t) <= tol]
        back = [c for c in cands if c[0] <= t]
        fwd = [c for c in cands if c[0] > t]
        b = max(back, key=lambda c: (c[0], c[1])) if back else None
        f = min(fwd, key=lambda c: (c[0], c[1])) if fwd else None
        if b and (not f or t - b[0] <= f[0] - t):
            out[(g, t)] = b[2]
        elif f:
            out[(g, t)] = f[2]
        else:
            out[(g, t)] = None
    return out


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 60)), min_size=1, max_size=15, unique=True),
       st.lists(st.tuples(st.integers(0, 1), st.integers(0, 60)), min_size=0, max_size=20),
       st.integers(1, 6), st.integers(7, 20))
def test_asof_matches_brute_force(spark, left, right, tol, bucket):
    r = [(g, t, i, 100 * i + t) for i, (g, t) in enumerate(right)]
    ldf = spark.createDataFrame([(g, BASE + dt.timedelta(seconds=t)) for g, t in left], "g long, t timestamp_ntz")
    rdf = spark.createDataFrame([(g, BASE + dt.timedelta(seconds=t), s, b) for g, t, s, b in r] or None,
                                "g long, t timestamp_ntz, seq long, b long") if r else \
        spark.createDataFrame([], "g long, t timestamp_ntz, seq long, b long")
    got = {(row.g, int((row.t - BASE).total_seconds())): row.b for row in
           asof_nearest(ldf, rdf, on="t", by=["g"], tolerance_us=tol * 1_000_000, right_cols=["b"],
                        right_order="seq", bucket_us=bucket * 1_000_000).collect()}
    assert got == brute_asof(left, r, tol)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=40), st.integers(2, 9))
def test_gap_fill_matches_pandas(spark, vals, block):
    s = pd.Series([None if v is None else float(v) for v in vals], dtype="float64")
    expected = s.interpolate(method="linear").ffill().bfill()
    df = spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(vals)],
                               "k long, i long, v double")
    got = [r.v for r in gap_fill(df, ["k"], "i", linear=["v"], block=block).orderBy("i").collect()]
    if s.isna().all():
        assert all(v is None for v in got)
    else:
        assert np.allclose(got, expected.to_numpy(), rtol=0, atol=1e-9)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 20)), min_size=1, max_size=60),
       st.sampled_from([0.0, 0.2, 0.5, 0.9, 0.95, 1.0]), st.integers(1, 8))
def test_exact_percentile_matches_numpy(spark, rows, q, parts):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g long, x double").repartition(parts)
    got = {r.g: r.q0 for r in exact_percentiles(df, ["g"], "x", [q]).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for g, grp in pdf.groupby("g"):
        assert abs(got[g] - np.percentile(grp.x.to_numpy(float), q * 100)) < 1e-9
