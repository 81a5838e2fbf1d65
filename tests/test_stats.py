"""Exact rounding and the ranking of models against plain Python; exports whose values begin with a hash."""

import random

from pyspark.sql import functions as F

from gleanworks.functions.stats import exact_round
from gleanworks.operators import ranking
from gleanworks.sources import exports


def test_rounding_equals_python(spark):
    rng = random.Random(4)
    values = [(1000 + s) / (800 + p) for s in range(700) for p in range(3)] + [0.125, 0.375, 2.675, 1.005, -1.005, -0.125, 1588 / 800, 0.0, 1e15 + 0.5, 1e22, float("inf"), 5e-324]
    values += [rng.uniform(-1000, 1000) for _ in range(2000)] + [k / 1000 for k in range(-5005, 5005, 10)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 4):
        got = rows.select("v", exact_round(F.col("v"), digits).alias("r")).collect()
        assert [(r.v, r.r) for r in got] == [(v, round(v, digits)) for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(exact_round(F.col("v"), 2).alias("r")).collect()
    assert odd[0].r is None and odd[1].r != odd[1].r


def peeled(models):
    left, done = sorted(models, key=lambda m: (-m[1], m[0])), []
    while left:
        lead = left[0]
        tied = [m for m in left if m is lead or m[2] <= lead[3] and m[3] >= lead[2]]
        rank = len(done) + 1
        done += [(m, rank) for m in tied]
        left = [m for m in left if m not in tied]
    return done


def test_ranks_equal_peeling(spark):
    rng = random.Random(7)
    rows = []
    for g in range(60):
        for k in range(rng.randrange(1, 25)):
            macro = rng.choice([rng.random(), round(rng.random(), 1)])
            rows.append((g, f"m{k:02d}", macro, macro - rng.random() * 0.2, macro + rng.random() * 0.2))
    ranked = ranking.rank_models(spark.createDataFrame(rows, "g int, model string, macro double, macro_low double, macro_high double"), ["g"])
    expected = [(g, *m, rank) for g in {r[0] for r in rows} for m, rank in peeled([r[1:] for r in rows if r[0] == g])]
    assert sorted(map(tuple, ranked.collect())) == sorted(expected)
    assert "Python" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_exports_keep_values_that_look_like_their_head(spark, tmp_path):
    rows = [("#A", "blocking", "1", "", ""), ("B", "x", "", "", "#"), ("code", "severity", "key", "line_no", "detail"), ("# internal", "", "", "", "a\n# b"), ("# ctx", "", "", "", "")]
    df = spark.createDataFrame(rows, "code string, severity string, key string, line_no string, detail string").repartition(3)
    exports.export("findings", df, f"{tmp_path}/parts", "internal", "ctx; more")
    exports.gather(spark, f"{tmp_path}/parts", f"{tmp_path}/one.csv")
    for path in ("parts", "one.csv"):
        assert sorted(map(tuple, exports.read_csv(spark, "findings", f"{tmp_path}/{path}").collect())) == sorted(rows)
