"""Read models over stored scores: matrices, breakdowns, presence, ranking of models and what separates them.

Scores are stored unsuppressed; floors are applied here, on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import MIN_COUNT, macro_interval, mark_ties, suppress


def with_floor(scores: DataFrame, floor: int = MIN_COUNT, point: str = "f1") -> DataFrame:
    """``scores`` with suppressed, and the point null where it is."""
    return scores.withColumns({"suppressed": F.col("n") < floor, point: suppress(F.col(point), F.col("n"), floor)})


def extraction_tab(scores: DataFrame, models: list[str], floor: int = MIN_COUNT, sort: str = "feature", descending: bool = False) -> DataFrame:
    """Features by models: f1 and mark per model, n the most of any model. Features without cases go; suppressed ones are
    last in both directions; ties of a numeric key go by name."""
    per_feature = Window.partitionBy("feature")
    rows = scores.where("n > 0").withColumn("n_max", F.max("n").over(per_feature))
    shown = rows.withColumn("suppressed", F.col("n_max") < floor).withColumn("point", F.when(~F.col("suppressed"), F.col("f1")))
    marked = mark_ties(shown.withColumns({"low": F.col("f1_low"), "high": F.col("f1_high")}))
    wide = marked.groupBy("feature", F.col("n_max").alias("n"), "suppressed").pivot("model", models).agg(F.first("point").alias("f1"), F.first("mark").alias("mark"))
    key = F.col(sort if sort in wide.columns else "feature")
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last()] + ([] if sort == "feature" else [F.col("feature").asc()])
    return wide.orderBy(F.col("suppressed").asc(), *order)


def breakdown(scores: DataFrame, feature: str) -> DataFrame:
    """Per model of one feature: precision, recall, f1 and the counts."""
    return scores.where(F.col("feature") == feature).select("model", "precision", "recall", "f1", "hit", "wrong", "missing", "n").orderBy("model")


def by_language(scores: DataFrame, floor: int = MIN_COUNT) -> DataFrame:
    return with_floor(scores.where("language <> '*'"), floor).select("feature", "model", "language", "n", "f1", "suppressed")


def presence_rates(goal1: DataFrame, goal2: DataFrame, keys: list[str]) -> DataFrame:
    """Presence with its goal 1 companions; without them it is withheld."""
    return goal2.join(goal1.select(*keys, "language", "precision", "recall", "f1"), [*keys, "language"])


def cross_tab(goal2: DataFrame, keys: list[str]) -> DataFrame:
    """The six cells as rows: keys, outcome, flag, n."""
    cells = [f"{o}_{p}" for o in ("hit", "wrong", "missing") for p in ("present", "absent")]
    long = goal2.where("language = '*'").unpivot(keys, cells, "cell", "n")
    return long.select(*keys, F.split("cell", "_")[0].alias("outcome"), F.split("cell", "_")[1].alias("flag"), "n")


def flag_inconsistency(goal2: DataFrame) -> DataFrame:
    """Per model, of its first labelled feature only."""
    return goal2.where("language = '*'").groupBy("model").agg(F.min_by(F.struct("feature", "inconsistency", "hit_absent", "flagged"), "feature").alias("x")).select("model", "x.*")


def presence_records(rows: DataFrame, key: str = "record_id") -> DataFrame:
    """Cases with a value where the model said absent, by record."""
    return rows.where("NOT present").orderBy(key)


def macro_scores(scores: DataFrame, floor: int = MIN_COUNT) -> DataFrame:
    """Per model over features with enough cases: macro, its interval, n, n_features. A model without one has no row."""
    return macro_interval(scores.where(F.col("n") >= floor), point="f1", low="f1_low", high="f1_high")


def rank_models(macros: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``macros`` with rank: from the best, all that overlap the leader of the rest share a rank, which is one more than
    the models ranked before. Overlap is not transitive, so groups are peeled off one after another.

    A group holds the models of one evaluation. In order of macro a model joins the first leader that it overlaps, or leads
    itself, so one fold over the group finds all leaders.
    """
    by = by or []
    each = F.struct((-F.col("macro")).alias("down"), "model", "macro", "macro_low", "macro_high")
    groups = macros.groupBy(*by).agg(F.array_sort(F.collect_list(each)).alias("models"))
    models = F.col("models")
    overlaps = lambda x, lead: (x["macro_low"] <= lead["macro_high"]) & (x["macro_high"] >= lead["macro_low"])
    interval = lambda x: F.struct(x["macro_low"].alias("macro_low"), x["macro_high"].alias("macro_high"))
    leads = F.aggregate(models, F.array().cast("array<struct<macro_low:double,macro_high:double>>"), lambda leads, x: F.when(F.exists(leads, lambda lead: overlaps(x, lead)), leads).otherwise(F.concat(leads, F.array(interval(x)))))
    joined = lambda x: F.array_position(F.transform("leads", lambda lead: overlaps(x, lead)), True)
    rows = groups.withColumn("leads", leads).select(*by, F.explode(F.transform(models, lambda x: F.struct(x["model"].alias("model"), x["macro"].alias("macro"), x["macro_low"].alias("macro_low"), x["macro_high"].alias("macro_high"), joined(x).alias("turn")))).alias("m"))
    rank = F.rank().over(Window.partitionBy(*by).orderBy("m.turn")) if by else F.rank().over(Window.partitionBy(F.lit(0)).orderBy("m.turn"))
    return rows.select(*by, "m.model", "m.macro", "m.macro_low", "m.macro_high", rank.cast("long").alias("rank"))


def separating_features(scores: DataFrame, macros: DataFrame, floor: int = MIN_COUNT) -> DataFrame:
    """Features whose intervals of the two best models do not meet: feature, delta, better model; largest delta first."""
    top = macros.orderBy(F.desc("macro"), "model").limit(2).select("model", F.col("macro").alias("m"))
    cells = scores.where(F.col("n") >= floor).join(F.broadcast(top), "model")  # two rows
    pair = cells.groupBy("feature").agg(F.count("*").alias("k"), F.max_by(F.struct("model", "f1", "f1_low", "f1_high"), F.struct("m", F.lit(1))).alias("a"), F.min_by(F.struct("model", "f1", "f1_low", "f1_high"), F.struct("m", F.lit(1))).alias("b"))
    apart = (F.col("a.f1_low") > F.col("b.f1_high")) | (F.col("b.f1_low") > F.col("a.f1_high"))
    delta = F.abs(F.col("a.f1") - F.col("b.f1"))
    better = F.when(F.col("a.f1") >= F.col("b.f1"), F.col("a.model")).otherwise(F.col("b.model"))
    return pair.where("k = 2").where(apart).select("feature", F.round(delta, 9).alias("delta"), better.alias("better")).orderBy(F.desc("delta"), "feature")


def reported_metrics(goal2: DataFrame) -> DataFrame:
    """Per model the mean of its features' presence rates."""
    return goal2.where("language = '*'").groupBy("model").agg(F.round(F.avg("presence_rate"), 9).alias("macro_presence"))


def latency(extractions: DataFrame, by: str, millis: str, parallel: Column | None = None) -> DataFrame:
    """Per model the interpolated median latency, and the mean per record over parallel calls."""
    mean = F.avg(millis) if parallel is None else F.avg(F.col(millis) / parallel)
    return extractions.groupBy(by).agg(F.median(millis).alias("median_ms"), mean.alias("per_record_ms"))


def ranking_tab(runs: DataFrame, ranked: DataFrame, synthetic: Column) -> DataFrame:
    """Every run with its rank (null without a scored cell) and a verdict."""
    n_first = ranked.agg(F.count_if(F.col("rank") == 1).alias("n_first"))
    verdict = F.when(synthetic, "synthetic corpus, no verdict").when(F.col("rank").isNull(), "nothing scoreable").when((F.col("rank") == 1) & (F.col("n_first") == 1), "best").when(F.col("rank") == 1, "tied for best").otherwise("behind")
    return runs.join(ranked, "model", "left").join(n_first).withColumn("verdict", verdict).drop("n_first")
