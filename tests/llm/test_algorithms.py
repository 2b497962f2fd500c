"""Heavy values, percentiles and survivors against brute force, with their edge cases."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.llm import heavy, survivors
from readloom.llm.percentiles import merge_runs, percentiles, percentiles_of_runs, value_runs


def _skewed(n, seed):
    rng = random.Random(seed)
    return [(f"h{rng.randrange(4)}" if rng.random() < 0.5 else None if rng.random() < 0.05 else f"v{rng.randrange(5000)}", rng.random() < 0.3 and "z" or f"w{rng.randrange(99999)}") for _ in range(n)]


@pytest.mark.parametrize("width", [16, 64, 2048])
def test_heavy_bounds(spark, width):
    rows = _skewed(20_000, width)
    df = spark.createDataFrame(rows, "a string, b string").repartition(5)
    fields = {"a": F.col("a"), "b": F.col("b")}
    true = {"a": Counter(r[0] for r in rows), "b": Counter(r[1] for r in rows)}
    got = heavy.heavy_values(df, fields, 0.02, width=width, tally_rows=700).collect()
    found = {(r.field, r.value): r for r in got}
    want = {(f, v) for f in true for v, n in true[f].items() if v is not None and n >= 0.02 * len(rows)}
    for r in got:
        if r.value is not None:
            assert r.lower <= true[r.field][r.value] <= r.upper
    for f, v in want - set(found):  # what is missing is owned up to
        assert true[f][v] <= found[f, None].upper
    exact = heavy.frequent_values(df, fields, 0.02, width=width, tally_rows=700).collect()
    assert {(r.field, r.value) for r in exact} == want and len(exact) == len(want)


@pytest.mark.parametrize("width", [2, 16, 32, 64, 2048])
def test_no_frequent_value_is_missed(spark, width):
    """36 values of equal weight, more than some widths have cells to hold."""
    rows = [(f"h{i % 60}" if i % 10 < 6 else f"v{i}",) for i in range(12_000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a string").repartition(4)
    true = Counter(r[0] for r in rows)
    want = {v for v, n in true.items() if n >= 0.009 * len(rows)}
    assert len(want) == 36
    exact = heavy.frequent_values(df, {"a": F.col("a")}, 0.009, width=width, tally_rows=900).collect()
    assert sorted(r.value for r in exact) == sorted(want) and all(r.lower <= true[r.value] <= r.upper for r in exact)


def test_heavy_merges_like_one(spark):
    rows = _skewed(6000, 1)
    df = spark.createDataFrame(rows, "a string, b string")
    one, two = (heavy.vote_sketch(df.where(f"pmod(hash(a, b), 2) = {i}"), {"a": F.col("a")}, width=256) for i in (0, 1))
    merged = {(r.row, r.cell): r for r in heavy.merge_cells(one.unionByName(two)).collect()}
    whole = {(r.row, r.cell): r for r in heavy.vote_sketch(df, {"a": F.col("a")}, width=256).collect()}
    assert {k: r.total for k, r in merged.items()} == {k: r.total for k, r in whole.items()}
    true = Counter(r[0] for r in rows if r[0] is not None)
    for r in merged.values():
        if r.candidate:
            assert r.surplus <= true[r.candidate] <= (r.total + r.surplus) // 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=20), max_size=6))
def test_sketch_cells_keep_their_bounds(batches):
    s = heavy.Sketch(1, 2)
    true: Counter = Counter()
    for b in batches:
        c = Counter(b)
        if c:
            values = np.array([f"v{k}" for k in c], object)
            s.add(values, np.array(list(c), "int64"), np.array(list(c.values()), "int64"))
            true += c
    for cell in (0, 1):
        here = {k: n for k, n in true.items() if k % 2 == cell}
        assert s.total[0, cell] == sum(here.values())
        for k, n in here.items():
            mine = s.candidate[0, cell] == f"v{k}"
            c = s.surplus[0, cell] if mine else -s.surplus[0, cell]
            assert n <= (s.total[0, cell] + c) / 2
            if mine:
                assert s.surplus[0, cell] <= n


def test_heavy_edges(spark):
    schema = "field string, row string, candidate string"
    empty = spark.createDataFrame([], schema)
    assert heavy.frequent_values(empty, {"x": F.col("field")}, 0.1).collect() == []
    nulls = spark.createDataFrame([(None, "", "x" * 100_000)] * 9, schema)
    got = heavy.frequent_values(nulls, {"x": F.col("field"), "y": F.col("candidate"), "z": F.col("row")}, 0.5).collect()
    assert {(r.field, len(r.value), r.lower) for r in got} == {("y", 100_000, 9), ("z", 0, 9)}
    with pytest.raises(ValueError, match="width"):
        heavy.vote_sketch(empty, {"x": F.col("field")}, width=100)


def _nearest(vs, p):
    vs = sorted(vs)
    return vs[max(1, math.ceil(len(vs) * p / 100)) - 1]


def test_percentiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([1, 2]), rng.choice([None, rng.randrange(12), rng.random() * 9, 3.0])) for _ in range(4000)]
    df = spark.createDataFrame([(a, b, None if c is None else float(c)) for a, b, c in rows], "k string, m int, v double").repartition(6)
    groups: dict = defaultdict(list)
    for a, b, c in rows:
        if c is not None:
            groups[a, b].append(float(c))
    keys = {"k": F.col("k"), "m": F.col("m")}
    pcts = [0, 10, 33.3, 50, 90, 100]
    got = percentiles(df, keys, F.col("v"), pcts).collect()
    assert len(got) == len(groups) * len(pcts)
    for r in got:
        assert r.percentile == _nearest(groups[r.k, r.m], r.pct) and r.n_values == len(groups[r.k, r.m])
    for r in percentiles(df, keys, F.col("v"), pcts, method="linear").collect():
        assert r.percentile == pytest.approx(np.percentile(groups[r.k, r.m], r.pct))


def test_percentiles_combine(spark):
    df = spark.createDataFrame([("a", i % 7, i % 3) for i in range(500)], "k string, v int, day int")
    whole = value_runs(df, {"k": F.col("k")}, F.col("v"))
    parts = merge_runs(*[value_runs(df.where(f"day = {d}"), {"k": F.col("k")}, F.col("v")) for d in range(3)])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    assert percentiles_of_runs(parts, ["k"], [50]).first().percentile == 3


def test_percentiles_edges(spark):
    schema = "k string, part int, run double"
    keys = {"k": F.col("k")}
    assert percentiles(spark.createDataFrame([], schema), keys, F.col("run"), [50]).collect() == []
    df = spark.createDataFrame([("a", 1, None), ("a", 1, float("nan")), ("b", 1, 2.0), ("b", 1, 2.0), (None, 1, 1.0)], schema)
    got = {r.k: r.percentile for r in percentiles(df, keys, F.col("run"), [50]).collect()}
    assert got == {"b": 2.0, None: 1.0}
    assert percentiles(df, keys, F.col("run"), [50], least=2).count() == 1
    with pytest.raises(ValueError, match="taken"):
        value_runs(df, {"part": F.col("part")}, F.col("run"))
    with pytest.raises(ValueError, match="method"):
        percentiles(df, keys, F.col("run"), [50], method="x")


def test_quality_sums():
    texts = ["!!", None, "", "II", "é!", "~" * 1000]
    assert survivors.quality_sums(pa.array(texts)).to_pylist() == [0, 0, 0, 80, 200, 93_000]
    assert survivors.quality_sums(pa.array(["x", *texts])[1:4]).to_pylist() == [0, 0, 0]
    assert survivors.quality_sums(pa.array([], pa.string())).to_pylist() == []


def _day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_latest_values(spark):
    rows = [(1, _day(1), "a", 1), (1, _day(3), None, 2), (1, _day(2), "b", None), (2, None, "x", None), (2, _day(0), "y", None), (3, _day(1), "p", 1), (3, _day(1), "q", 1), (None, _day(1), "z", 1)]
    df = spark.createDataFrame(rows, "i long, t timestamp, a string, b int")
    got = {r.id: (r.a, r.b) for r in survivors.latest_values(df, F.col("i"), F.col("t"), {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {1: ("b", 2), 2: ("y", None), 3: ("q", 1)}
    assert survivors.latest_values(df.limit(0), F.col("i"), F.col("t"), {"a": F.col("a")}).collect() == []


def _layers(recs):
    """(complete, recent, trust) -> layer of each by peeling."""
    left, out, d = dict(enumerate(recs)), {}, 1
    while left:
        top = [i for i, x in left.items() if not any(j != i and all(p >= q for p, q in zip(y, x, strict=True)) and y != x for j, y in left.items())]
        for i in top:
            out[i] = d
            del left[i]
        d += 1
    return out


@pytest.mark.parametrize("salts", [1, 5])
def test_survivors_against_peeling(spark, salts):
    rng = random.Random(salts)
    rows = []
    for i in range(400):
        rows.append((rng.choice(["hot", "hot", "a", "b", "c", None]), i, _day(rng.randrange(30)), rng.randrange(40), rng.choice([None, "p", "q"]), rng.choice([None, None, 5])))
    df = spark.createDataFrame(rows, "k string, i long, t timestamp, q int, a string, b int")
    got = survivors.skyline_survivors(df, ["k"], recent="t", trust=[F.col("q"), -F.col("i")], fields=["a", "b"], fill=["a", "b"], depth=3, salts=salts).collect()
    groups = defaultdict(list)
    for r in rows:
        if r[0]:
            groups[r[0]].append(r)
    assert {r.k for r in got} == set(groups)
    for r in got:
        g = groups[r.k]
        layer = _layers([((x[4] is not None) + (x[5] is not None), x[2], (x[3], -x[1])) for x in g])
        best = max((x for j, x in enumerate(g) if layer[j] == 1), key=lambda x: (x[3], -x[1]))
        assert (r.i, r.n_records, r.n_skyline) == (best[1], len(g), sum(v == 1 for v in layer.values()))
        for c, name in ((4, "a"), (5, "b")):
            have = [(min(layer[j], 4), -x[3], x[1], x[c]) for j, x in enumerate(g) if x[c] is not None]
            assert r[name] == (best[c] if best[c] is not None else min(have)[3] if have else None)


def test_survivors_edges(spark):
    schema = "k string, t timestamp, q int, a string"
    options = {"recent": "t", "trust": [F.col("q")], "fields": ["a"]}
    assert survivors.skyline_survivors(spark.createDataFrame([], schema), ["k"], **options).collect() == []
    df = spark.createDataFrame([("x", None, 1, None)] * 3 + [("y", _day(1), None, "v" * 100_000), (None, _day(1), 1, "w")], schema)
    got = {r.k: r for r in survivors.skyline_survivors(df, ["k"], fill=["a"], **options).collect()}
    assert set(got) == {"x", "y"} and got["x"].n_records == 3 and len(got["y"].a) == 100_000
    assert survivors.skyline_survivors(df, ["k"], least=2, **options).count() == 1
    clash = df.withColumn("layer_", F.lit(1)).withColumn("n_records", F.lit(7)).withColumn("k0", F.lit(2))
    got = survivors.skyline_survivors(clash, ["k"], **options)
    assert {(r.k, r.n_records_, r.n_records, r.layer_, r.k0) for r in got.collect()} == {("x", 3, 7, 1, 2), ("y", 1, 7, 1, 2)}
