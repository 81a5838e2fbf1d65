"""Queries on matching, scoring, statistics, ranking, review and runs.

Four pseudo-models answer three pseudo-features (order states) for every order; the truth is the priority's code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, read, scratch_dir
from ..functions import stats, text
from ..operators import ranking, review, runs, scoring

MODELS = ["m0", "m1", "m2", "m3"]

# --- cases ---------------------------------------------------------------------------------------------------------

_TRUTH = "CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE substr(o_orderpriority, 1, 1) END"
_ANSWER = "CASE WHEN (o_orderkey * 7 + r * 13) % 19 = 0 THEN NULL WHEN (o_orderkey * 3 + r * 5 + length(o_orderstatus) + CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 4 ELSE 0 END) % 10 < 5 + r THEN concat(' ', substr(o_orderpriority, 1, 1)) ELSE '9' END"
_PRESENT = "CASE WHEN o_orderkey % 23 = 0 THEN CAST(NULL AS BOOLEAN) ELSE (o_orderkey + r) % 9 <> 0 END"
_LANG = "CASE WHEN o_custkey % 11 = 0 THEN 'mixed' WHEN o_custkey % 3 = 0 THEN 'de' WHEN o_custkey % 3 = 1 THEN 'fr' ELSE 'it' END"

_CASES = f"""(SELECT concat('m', CAST(r AS VARCHAR)) AS model, o_orderstatus AS feature, o_orderkey AS record_id, lang AS language, truth AS record_value, answer AS model_value, present,
 CASE WHEN answer IS NULL THEN 'missing' WHEN trim(answer) = truth THEN 'hit' ELSE 'wrong' END AS outcome
 FROM (SELECT o_orderkey, o_orderstatus, r, {_LANG} AS lang, {_TRUTH} AS truth, {_ANSWER} AS answer, {_PRESENT} AS present FROM orders, (VALUES (0), (1), (2), (3)) t(r)) WHERE trim(truth) <> '')"""


def _answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = read(spark, sf, "orders")
    truth = o.select(F.col("o_orderstatus").alias("feature_id"), F.col("o_orderkey").alias("record_id"), F.expr(_TRUTH).alias("record_value"), F.lit("enum").alias("value_type"))
    per_run = o.withColumn("r", F.explode(F.array(*map(F.lit, range(4)))))
    answers = per_run.select(F.concat(F.lit("m"), F.col("r").cast("string")).alias("run_id"), F.col("o_orderstatus").alias("feature_id"), F.col("o_orderkey").alias("record_id"), F.expr(_ANSWER).alias("model_value"), F.expr(_PRESENT.replace("VARCHAR", "STRING")).alias("present"))
    records = o.select(F.col("o_orderkey").alias("record_id"), F.expr(_LANG).alias("language"))
    return truth, answers, records


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.cases(*_answers(spark, sf))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"run_id": "model", "feature_id": "feature"})


@query("score_join", f"SELECT model, feature, record_id, language, record_value, model_value, present, outcome FROM {_CASES}")
def score_join(spark, sf):
    return _named(_cases(spark, sf)).select("model", "feature", "record_id", "language", "record_value", "model_value", "present", "outcome")


@query("classify", """SELECT d.doc_id, CASE WHEN quality IS NULL THEN NULL WHEN n_chars < 50 THEN 'missing' WHEN (n_chars > 600) = (quality = 1) THEN 'hit' ELSE 'wrong' END AS outcome FROM documents d JOIN labels USING (doc_id)""")
def classify(spark, sf):
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    answer = F.when(F.col("n_chars") >= 50, (F.col("n_chars") > 600).cast("int").cast("string"))
    truth = F.col("quality").cast("string")
    hit = text.matches(truth, answer, F.lit("integer"), free_text=False)
    return rows.select("doc_id", text.classify(truth, answer, hit).alias("outcome"))


def _wilson_sql(k: str, n: str, which: str) -> str:
    z = stats.Z
    k, n = f"({k})::DOUBLE", f"({n})::DOUBLE"
    p = f"({k} / {n})"
    centre = f"({p} + {z * z} / (2 * {n})) / (1 + {z * z} / {n})"
    half = f"{z} / (1 + {z * z} / {n}) * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n} * {n}))"
    return f"CASE WHEN {n} <= 0 THEN 0.0 ELSE greatest(0.0, {centre} - {half}) END" if which == "low" else f"CASE WHEN {n} <= 0 THEN 1.0 ELSE least(1.0, {centre} + {half}) END"


def _share_sql(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"


def _lang_sets(select: str) -> str:
    return f"SELECT model, feature, coalesce(language, '*') AS language, {select} FROM {_CASES} GROUP BY GROUPING SETS ((model, feature), (model, feature, language))"


_COUNTS = _lang_sets("count(*) FILTER (WHERE outcome = 'hit')::BIGINT AS hit, count(*) FILTER (WHERE outcome = 'wrong')::BIGINT AS wrong, count(*) FILTER (WHERE outcome = 'missing')::BIGINT AS missing")
_F1 = _share_sql("2 * hit", "hit + wrong + n")
_F1N = f"round_even({_F1} * n, 0)"
_GOAL1 = f"""SELECT model, feature, language, hit, wrong, missing, n, round({_share_sql('hit', 'hit + wrong')}, 9) AS "precision", round({_share_sql('hit', 'n')}, 9) AS recall, round({_F1}, 9) AS f1,
 round({_wilson_sql('hit', 'hit + wrong', 'low')}, 9) AS precision_low, round({_wilson_sql('hit', 'hit + wrong', 'high')}, 9) AS precision_high, round({_wilson_sql('hit', 'n', 'low')}, 9) AS recall_low, round({_wilson_sql('hit', 'n', 'high')}, 9) AS recall_high,
 round({_wilson_sql(_F1N, 'n', 'low')}, 9) AS f1_low, round({_wilson_sql(_F1N, 'n', 'high')}, 9) AS f1_high FROM (SELECT *, hit + wrong + missing AS n FROM ({_COUNTS}))"""
_CELLS = ["hit_present", "hit_absent", "wrong_present", "wrong_absent", "missing_present", "missing_absent"]
_GOAL2 = f"""SELECT *, round({_share_sql('n_present', 'n')}, 9) AS presence_rate, round({_wilson_sql('n_present', 'n', 'low')}, 9) AS presence_low, round({_wilson_sql('n_present', 'n', 'high')}, 9) AS presence_high,
 round({_share_sql('hit_absent', 'flagged')}, 9) AS inconsistency, round({_wilson_sql('hit_absent', 'flagged', 'low')}, 9) AS inconsistency_low, round({_wilson_sql('hit_absent', 'flagged', 'high')}, 9) AS inconsistency_high FROM (""" + _lang_sets(
    "count(*)::BIGINT AS n, count(present)::BIGINT AS flagged, count(*) FILTER (WHERE present)::BIGINT AS n_present, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{c.split('_')[0]}' AND {'' if c.endswith('present') else 'NOT '}present)::BIGINT AS {c}" for c in _CELLS)
) + ")"


def _goal1(spark, sf):
    return scoring.goal1(_named(_cases(spark, sf)), ["model", "feature"])


def _goal2(spark, sf):
    return scoring.goal2(_named(_cases(spark, sf)), ["model", "feature"])


@query("goal1", _GOAL1)
def goal1(spark, sf):
    return _goal1(spark, sf)


@query("goal2", _GOAL2)
def goal2(spark, sf):
    return _goal2(spark, sf)


@query("goal3", f"""SELECT *, round({_share_sql('reported', 'n')}, 9) AS reported_rate FROM (SELECT model, feature, coalesce(language, '*') AS language, count(*)::BIGINT AS n, count(model_value)::BIGINT AS reported, count(*) FILTER (WHERE evidence IS NOT NULL AND trim(evidence) <> '')::BIGINT AS spans
 FROM (SELECT *, CASE WHEN record_id % 6 = 0 THEN ' ' WHEN record_id % 6 = 1 THEN NULL ELSE record_value END AS evidence FROM {_CASES}) GROUP BY GROUPING SETS ((model, feature), (model, feature, language)))""")
def goal3(spark, sf):
    rows = _named(_cases(spark, sf)).withColumn("evidence", F.when(F.col("record_id") % 6 == 0, " ").when(F.col("record_id") % 6 != 1, F.col("record_value")))
    return scoring.goal3(rows, ["model", "feature"])


@query("per_language", f"SELECT model, feature, language, n FROM ({_GOAL1})")
def per_language(spark, sf):
    return _goal1(spark, sf).select("model", "feature", "language", "n")


@query("score_rows", " UNION ALL ".join(f"SELECT model, feature, language, '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS value FROM ({_GOAL1})" for m in ("precision", "recall", "f1", "hit")))
def score_rows(spark, sf):
    return scoring.long_scores(_goal1(spark, sf), ["model", "feature"], ["precision", "recall", "f1", "hit"])


_WILSON_CASES = "(SELECT o_orderkey AS id, o_custkey % 30 AS k, o_custkey % 30 + o_orderkey % 40 AS n FROM orders)"


@query("wilson", f"SELECT id, k, n, round({_wilson_sql('k', 'n', 'low')}, 9) AS low, round({_wilson_sql('k', 'n', 'high')}, 9) AS high FROM {_WILSON_CASES}")
def wilson(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).alias("k"), (F.col("o_custkey") % 30 + F.col("o_orderkey") % 40).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("id", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("suppress", f"SELECT model, feature, language, n, CASE WHEN n >= 300 THEN f1 END AS f1, n < 300 AS suppressed FROM ({_GOAL1})")
def suppress(spark, sf):
    return ranking.with_floor(_goal1(spark, sf), 300).select("model", "feature", "language", "n", "f1", "suppressed")


_ALL = f"(SELECT * FROM ({_GOAL1}) WHERE language = '*')"
_MARKED = f"""(SELECT a.*, CASE WHEN a.model = l.m AND k = 0 THEN 'best' WHEN a.model = l.m OR (a.f1_low <= l.hi AND a.f1_high >= l.lo) THEN 'tied' ELSE 'none' END AS mark FROM {_ALL} a JOIN (
 SELECT x.feature, x.model AS m, x.f1_low AS lo, x.f1_high AS hi, (SELECT count(*) FROM {_ALL} y WHERE y.feature = x.feature AND y.model <> x.model AND y.f1_low <= x.f1_high AND y.f1_high >= x.f1_low) AS k
 FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY f1 DESC, model) AS rn FROM {_ALL}) x WHERE rn = 1) l USING (feature))"""


def _overall(spark, sf):
    return _goal1(spark, sf).where("language = '*'")


@query("mark_ties", f"SELECT model, feature, f1, mark FROM {_MARKED}")
def mark_ties(spark, sf):
    return stats.mark_ties(_overall(spark, sf), point="f1", low="f1_low", high="f1_high").select("model", "feature", "f1", "mark")


_MACRO = f"""(SELECT model, round(avg(f1), 9) AS macro, round(greatest(0.0, avg((f1_low + f1_high) / 2) - {stats.Z} * sqrt(sum(pow((f1_high - f1_low) / 2 / {stats.Z}, 2))) / count(*)), 9) AS macro_low,
 round(least(1.0, avg((f1_low + f1_high) / 2) + {stats.Z} * sqrt(sum(pow((f1_high - f1_low) / 2 / {stats.Z}, 2))) / count(*)), 9) AS macro_high, sum(n)::BIGINT AS n, count(*)::BIGINT AS n_features FROM {_ALL} WHERE n >= 20 GROUP BY 1)"""


def _macro(spark, sf):
    m = ranking.macro_scores(_overall(spark, sf))
    return m.withColumns({c: F.round(c, 9) for c in ("macro", "macro_low", "macro_high")})


@query("macro_interval", f"SELECT * FROM {_MACRO}")
def macro_interval(spark, sf):
    return _macro(spark, sf)


@query("macro", f"SELECT model, macro FROM {_MACRO}")
def macro(spark, sf):
    return _macro(spark, sf).select("model", "macro")


@query("rank_models_first_group", f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY macro DESC, model) AS p FROM {_MACRO})
 SELECT b.model, b.macro, b.macro_low, b.macro_high, CASE WHEN b.macro_low <= a.macro_high AND b.macro_high >= a.macro_low THEN 1 END::BIGINT AS first_group FROM o a, o b WHERE a.p = 1""")
def rank_models_first_group(spark, sf):
    ranked = ranking.rank_models(_macro(spark, sf))
    return ranked.select("model", "macro", "macro_low", "macro_high", F.when(F.col("rank") == 1, F.col("rank")).alias("first_group"))


# Groups are peeled off one after another: those that overlap the leader of the rest, its rank one more than those before.
_RANKED = f"""WITH RECURSIVE m AS (SELECT model, macro, macro_low, macro_high, 1 << (row_number() OVER (ORDER BY macro DESC, model) - 1)::INT AS bit FROM {_MACRO}),
 step AS (SELECT 0 AS gone, CAST(NULL AS INT) AS ids, 0::BIGINT AS rank UNION ALL
  SELECT gone | g.ids, g.ids, bit_count(gone)::BIGINT + 1 FROM step, LATERAL (SELECT bit_or(m.bit)::INT AS ids FROM m, (SELECT * FROM m WHERE (m.bit & gone) = 0 ORDER BY m.bit LIMIT 1) lead
   WHERE (m.bit & gone) = 0 AND (m.bit = lead.bit OR m.macro_low <= lead.macro_high AND m.macro_high >= lead.macro_low)) g WHERE g.ids IS NOT NULL),
 ranked AS (SELECT model, macro, macro_low, macro_high, rank FROM m JOIN step ON ids IS NOT NULL AND (m.bit & ids) > 0)"""


@query("rank_models", f"{_RANKED} SELECT * FROM ranked")
def rank_models(spark, sf):
    return ranking.rank_models(_macro(spark, sf))


@query("ranking_tab", f"""{_RANKED} SELECT r.model, macro, macro_low, macro_high, rank, CASE WHEN rank IS NULL THEN 'nothing scoreable' WHEN rank = 1 AND (SELECT count(*) FROM ranked WHERE rank = 1) = 1 THEN 'best' WHEN rank = 1 THEN 'tied for best' ELSE 'behind' END AS verdict
 FROM (VALUES ('m0'), ('m1'), ('m2'), ('m3'), ('m9')) r(model) LEFT JOIN ranked USING (model)""")
def ranking_tab(spark, sf):
    models = spark.createDataFrame([(m,) for m in [*MODELS, "m9"]], "model string")
    return ranking.ranking_tab(models, ranking.rank_models(_macro(spark, sf)), F.lit(False))


@query("separating_features", f"""WITH t AS (SELECT model, row_number() OVER (ORDER BY macro DESC, model) AS p FROM {_MACRO}), a AS (SELECT c.* FROM {_ALL} c JOIN t USING (model) WHERE p = 1), b AS (SELECT c.* FROM {_ALL} c JOIN t USING (model) WHERE p = 2)
 SELECT a.feature, round(abs(a.f1 - b.f1), 9) AS delta, CASE WHEN a.f1 >= b.f1 THEN a.model ELSE b.model END AS better FROM a JOIN b USING (feature) WHERE a.f1_low > b.f1_high OR b.f1_low > a.f1_high""")
def separating_features(spark, sf):
    return ranking.separating_features(_overall(spark, sf), _macro(spark, sf))


@query("extraction_tab", "SELECT feature, n, suppressed, " + ", ".join(f"max(CASE WHEN model = '{m}' AND NOT suppressed THEN f1 END) AS {m}_f1, max(CASE WHEN model = '{m}' THEN CASE WHEN suppressed THEN 'none' ELSE mark END END) AS {m}_mark" for m in MODELS) + f" FROM (SELECT *, n < 20 AS suppressed FROM (SELECT m.* REPLACE (max(n) OVER (PARTITION BY feature) AS n) FROM {_MARKED} m)) GROUP BY ALL")
def extraction_tab(spark, sf):
    return ranking.extraction_tab(_overall(spark, sf), MODELS)


@query("breakdown", f"SELECT model, \"precision\", recall, f1, hit, wrong, missing, n FROM {_ALL} WHERE feature = 'F'")
def breakdown(spark, sf):
    return ranking.breakdown(_overall(spark, sf), "F")


@query("by_language", f"SELECT feature, model, language, n, CASE WHEN n >= 20 THEN f1 END AS f1, n < 20 AS suppressed FROM ({_GOAL1}) WHERE language <> '*'")
def by_language(spark, sf):
    return ranking.by_language(_goal1(spark, sf))


@query("presence_rates", f"SELECT model, feature, language, presence_rate, \"precision\", recall, f1 FROM ({_GOAL2}) JOIN (SELECT model, feature, language, \"precision\", recall, f1 FROM ({_GOAL1})) USING (model, feature, language)")
def presence_rates(spark, sf):
    return ranking.presence_rates(_goal1(spark, sf), _goal2(spark, sf), ["model", "feature"]).select("model", "feature", "language", "presence_rate", "precision", "recall", "f1")


@query("cross_tab", " UNION ALL ".join(f"SELECT model, feature, '{c.split('_')[0]}' AS outcome, '{c.split('_')[1]}' AS flag, {c} AS n FROM ({_GOAL2}) WHERE language = '*'" for c in _CELLS))
def cross_tab(spark, sf):
    return ranking.cross_tab(_goal2(spark, sf), ["model", "feature"])


@query("flag_inconsistency", f"SELECT model, feature, inconsistency, hit_absent, flagged FROM ({_GOAL2}) WHERE language = '*' AND feature = 'F'")
def flag_inconsistency(spark, sf):
    return ranking.flag_inconsistency(_goal2(spark, sf))


@query("presence_records", f"SELECT model, feature, record_id, record_value FROM {_CASES} WHERE NOT present")
def presence_records(spark, sf):
    return ranking.presence_records(_named(_cases(spark, sf))).select("model", "feature", "record_id", "record_value")


@query("reported_metrics", f"SELECT model, round(avg(presence_rate), 9) AS macro_presence FROM ({_GOAL2}) WHERE language = '*' GROUP BY 1")
def reported_metrics(spark, sf):
    return ranking.reported_metrics(_goal2(spark, sf))


@query("cells_by_model", f"SELECT model, feature, n, CASE WHEN n >= 20 THEN f1 END AS f1, mark FROM {_MARKED}")
def cells_by_model(spark, sf):
    marked = stats.mark_ties(_overall(spark, sf), point="f1", low="f1_low", high="f1_high")
    return ranking.with_floor(marked).select("model", "feature", "n", "f1", "mark")


@query("scored_features", f"SELECT 'm' || r AS run_id, feature_id FROM (VALUES ('0'), ('1'), ('2'), ('3'), ('4')) t(r), (VALUES ('F'), ('O'), ('P'), ('X')) f(feature_id) WHERE r = '4' OR feature_id = 'X'")
def scored_features(spark, sf):
    wanted = spark.createDataFrame([(f"m{r}", f) for r in range(5) for f in "FOPX"], "run_id string, feature_id string")
    done = _overall(spark, sf).select(F.col("model").alias("run_id"), F.col("feature").alias("feature_id"))
    return scoring.unscored(wanted, done)


@query("scoreable_count", "SELECT 2::BIGINT AS scoreable")
def scoreable_count(spark, sf):
    features = spark.createDataFrame([("a", "o_orderstatus", None), ("b", None, "{}"), ("c", "gone", None), ("d", None, None)], "feature_id string, source_column string, derivation string")
    populated = read(spark, sf, "orders").where("o_orderstatus <> ''").select(F.lit("o_orderstatus").alias("source_column"))
    return scoring.scoreable_count(features, populated)


@query("scoring_status", f"SELECT model AS run_id, count(DISTINCT feature)::BIGINT + 1 AS scoreable, count(DISTINCT feature)::BIGINT AS scored FROM {_CASES} GROUP BY 1")
def scoring_status(spark, sf):
    done = _overall(spark, sf).select(F.col("model").alias("run_id"), F.col("feature").alias("feature_id"))
    wanted = spark.createDataFrame([(m, f) for m in MODELS for f in "FOPX"], "run_id string, feature_id string")
    return scoring.scoring_status(wanted, done)


@query("record_languages", f"SELECT o_orderkey AS record_id, {_LANG} AS language FROM orders")
def record_languages(spark, sf):
    return _answers(spark, sf)[2]


@query("model_answers", f"SELECT o_orderkey AS record_id, trim({_ANSWER}) AS value_normalised, {_PRESENT} AS present FROM orders, (VALUES (2)) t(r) WHERE o_orderstatus = 'O'")
def model_answers(spark, sf):
    a = _answers(spark, sf)[1].where("run_id = 'm2' AND feature_id = 'O'")
    return a.select("record_id", text.normalise_enum(F.col("model_value")).alias("value_normalised"), "present")


# --- normalising ---------------------------------------------------------------------------------------------------


@query("is_empty", "SELECT o_orderkey, v IS NULL OR trim(v) = '' AS empty FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' ELSE o_orderstatus END AS v FROM orders)")
def is_empty(spark, sf):
    k = F.col("o_orderkey") % 4
    v = F.when(k == 1, "").when(k == 2, "   ").when(k == 3, F.col("o_orderstatus"))
    return read(spark, sf, "orders").select("o_orderkey", text.is_empty(v).alias("empty"))


@query("normalise_enum", "SELECT o_orderkey, trim(concat('  ', o_orderpriority, ' ')) AS v FROM orders")
def normalise_enum(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.normalise_enum(F.concat(F.lit("  "), "o_orderpriority", F.lit("\t "))).alias("v"))


_INT = "CASE o_orderkey % 5 WHEN 0 THEN concat('+00', CAST(o_custkey AS {t})) WHEN 1 THEN concat(' ', CAST(o_custkey + 1000 AS {t}), '''', '000 ') WHEN 2 THEN 'n/a' WHEN 3 THEN '-0' ELSE concat('-', CAST(o_custkey AS {t})) END"


@query("normalise_integer", "SELECT o_orderkey, CASE WHEN regexp_full_match(b, '[+-]?[0-9]+') THEN CAST(CAST(b AS BIGINT) AS VARCHAR) ELSE trim(v) END AS v FROM (SELECT o_orderkey, v, replace(replace(trim(v), '''', ''), ' ', '') AS b FROM (SELECT o_orderkey, " + _INT.format(t="VARCHAR") + " AS v FROM orders))")
def normalise_integer(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.normalise_integer(F.expr(_INT.format(t="STRING").replace("''''", "'\\''"))).alias("v"))


_DEC = "CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_custkey AS {t}), ',50') WHEN 1 THEN concat(CAST(o_custkey AS {t}), '.125') WHEN 2 THEN 'unknown' ELSE concat(CAST(o_custkey AS {t}), '.375') END"


@query("normalise_decimal", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_custkey AS VARCHAR), '.5') WHEN 1 THEN concat(CAST(o_custkey AS VARCHAR), '.12') WHEN 2 THEN 'unknown' ELSE concat(CAST(o_custkey AS VARCHAR), '.38') END AS v FROM orders")
def normalise_decimal(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.normalise_decimal(F.expr(_DEC.format(t="STRING"))).alias("v"))


@query("normalise_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '20240230' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'May' END AS v FROM orders")
def normalise_date(spark, sf):
    k = F.col("o_orderkey") % 3
    v = F.when(k == 0, "20240230").when(k == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(" May")
    return read(spark, sf, "orders").select("o_orderkey", text.normalise_date(v).alias("v"))


@query("normalise_time", "SELECT o_orderkey, CASE WHEN h < 24 THEN CAST(h * 60 + 5 AS VARCHAR) ELSE concat(CAST(h AS VARCHAR), ':05') END AS v FROM (SELECT o_orderkey, o_orderkey % 26 AS h FROM orders)")
def normalise_time(spark, sf):
    h = F.col("o_orderkey") % 26
    v = F.when((h < 24) & (h % 2 == 0), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit("05"))).otherwise(F.concat(h.cast("string"), F.lit(":05")))
    return read(spark, sf, "orders").select("o_orderkey", text.normalise_time(v).alias("v"))


@query("normalise_boolean", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'maybe' ELSE 'true' END AS v FROM orders")
def normalise_boolean(spark, sf):
    v = F.get(F.array(F.lit(" Ja"), F.lit("NON"), F.lit("maybe "), F.lit("1")), (F.col("o_orderkey") % 4).cast("int"))
    return read(spark, sf, "orders").select("o_orderkey", text.normalise_boolean(v).alias("v"))


# k, a fraction of a half at two places and up to nine more digits, which decide the rounding.
_LONG = "o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.005' WHEN 1 THEN '.015' ELSE '.995' END || CASE WHEN o_custkey % 2 = 0 THEN '000000000000' ELSE lpad(o_custkey, 12, '0') END"


@query("normalise_decimal_long", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN CAST(o_orderkey + 1 AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN o_orderkey || '.02' WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || '.01' END AS v, '0.' || repeat('0', 20) || '1' AS tiny FROM orders")
def normalise_decimal_long(spark, sf):
    """Halves that digits far behind decide, and a number far below one unrounded."""
    number = F.expr(_LONG.replace("o_orderkey ||", "CAST(o_orderkey AS STRING) ||").replace("lpad(o_custkey,", "lpad(CAST(o_custkey AS STRING),"))
    return read(spark, sf, "orders").select("o_orderkey", text.normalise_decimal(number).alias("v"), text.normalise_decimal(F.lit("1e-21"), None).alias("tiny"))


_EDGES = text.EDGES.replace("'", "''")


@query("normalise_text", f"SELECT doc_id, CASE WHEN trim(f, '{_EDGES}') = '' THEN f ELSE trim(f, '{_EDGES}') END AS v FROM (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS f FROM documents)")
def normalise_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.normalise_text("text").alias("v"))


@query("matches", "SELECT o_orderkey, abs(o_custkey % 1440 - o_orderkey % 1440) <= 90 AS within FROM orders")
def matches(spark, sf):
    clock = lambda c: F.concat((F.expr(f"({c} % 1440) div 60")).cast("string"), F.lit(":"), F.lpad((F.col(c) % 60).cast("string"), 2, "0"))
    return read(spark, sf, "orders").select("o_orderkey", text.matches(clock("o_custkey"), clock("o_orderkey"), F.lit("time"), F.lit(90), free_text=False).alias("within"))


# --- review --------------------------------------------------------------------------------------------------------

_TAG = "CASE record_id % 5 WHEN 0 THEN 'hallucination' WHEN 1 THEN 'structured_data_error' WHEN 2 THEN 'odd' END"
_MIS = f"(SELECT model AS run_id, record_id, feature AS feature_id, record_value, model_value, CASE WHEN record_id % 2 = 0 THEN {_TAG} END AS tag FROM {_CASES} WHERE outcome = 'wrong')"


def _stored(spark, rows: DataFrame, what: str) -> DataFrame:
    """A table as a service keeps it: written once, then read."""
    path = scratch_dir(spark, what)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _reviewed(spark, sf):
    wrong = _stored(spark, scoring.mismatches(_cases(spark, sf)), "mismatches")
    first = wrong.where("record_id % 2 = 0").select(*review.KEY, F.lit("unclear").alias("tag"), F.lit("n").alias("note"), F.lit("r").alias("reviewer"), F.lit(1).alias("reviewed_at"))
    second = first.withColumns({"tag": F.expr(_TAG), "reviewed_at": F.lit(2)})
    return review.with_reviews(wrong, review.set_tag(first, second))


@query("upsert_mismatches", f"SELECT * FROM {_MIS}")
def upsert_mismatches(spark, sf):
    return _reviewed(spark, sf).select("run_id", "record_id", "feature_id", "record_value", "model_value", "tag")


@query("mismatch_list", f"SELECT *, count(*) OVER ()::BIGINT AS total FROM {_MIS} WHERE feature_id = 'O' AND tag IS NOT NULL ORDER BY tag DESC, run_id, record_id LIMIT 40 OFFSET 20")
def mismatch_list(spark, sf):
    return review.mismatch_list(_reviewed(spark, sf), "O", state="tagged", sort="tag", descending=True, offset=20, limit=40).select("run_id", "record_id", "feature_id", "record_value", "model_value", "tag", "total")


@query("mismatch_tally", f"SELECT feature_id, count(*)::BIGINT AS total, count(tag)::BIGINT AS reviewed, count(*) FILTER (WHERE tag IS NULL)::BIGINT AS untagged, count(*) FILTER (WHERE tag = 'hallucination')::BIGINT AS hallucination, count(*) FILTER (WHERE tag = 'structured_data_error')::BIGINT AS structured_data_error, count(*) FILTER (WHERE tag = 'unclear')::BIGINT AS unclear, count(*) FILTER (WHERE tag = 'odd')::BIGINT AS other FROM {_MIS} GROUP BY 1")
def mismatch_tally(spark, sf):
    return review.mismatch_tally(_reviewed(spark, sf))


@query("set_tag", f"SELECT run_id, record_id, feature_id, tag FROM {_MIS} WHERE record_id % 2 = 0")
def set_tag(spark, sf):
    return _reviewed(spark, sf).where("record_id % 2 = 0").select(*review.KEY, "tag")


@query("locate_span", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents WHERE contains(text, 'the')")
def locate_span(spark, sf):
    rows = read(spark, sf, "documents").where(F.contains("text", F.lit("the")))
    return rows.select("doc_id", F.size(review.locate_span("text", F.lit("the"))).cast("long").alias("n"))


@query("mismatch_detail", "SELECT d.doc_id AS record_id, strpos(text, ' ')::BIGINT - 1 AS first_end FROM documents d JOIN labels l USING (doc_id) WHERE strpos(text, ' ') > 1 AND quality = 0")
def mismatch_detail(spark, sf):
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").where("instr(text, ' ') > 1 AND quality = 0")
    rows = docs.select(F.col("doc_id").alias("record_id"), F.substring_index("text", " ", 1).alias("evidence"))
    found = review.mismatch_detail(rows, docs.select(F.col("doc_id").alias("record_id"), F.col("text").alias("narrative")))
    return found.select("record_id", F.col("places")[0]["end"].cast("long").alias("first_end"))


@query("anonymisation_marking", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'anonymised_column' WHEN c_nationkey % 3 = 0 THEN 'anonymised' WHEN c_nationkey % 3 = 1 THEN 'not_anonymised' ELSE 'unknown' END AS marking FROM customer")
def anonymisation_marking(spark, sf):
    said = F.when(F.col("c_nationkey") % 3 == 0, "yes").when(F.col("c_nationkey") % 3 == 1, "no")
    rows = read(spark, sf, "customer").withColumns({"flag": F.col("c_custkey") % 2 == 0, "said": said})
    return review.anonymisation_marking(rows, "flag", "said").select("c_custkey", "marking")


@query("discard_preview", f"SELECT (SELECT count(*) FROM {_CASES} WHERE model = 'm1')::BIGINT AS records, (SELECT count(*) FROM {_ALL} WHERE model = 'm1')::BIGINT AS scores, count(*)::BIGINT AS mismatches, count(tag)::BIGINT AS tagged FROM {_MIS} WHERE run_id = 'm1'")
def discard_preview(spark, sf):
    return review.discard_preview("m1", _cases(spark, sf), _overall(spark, sf).withColumnRenamed("model", "run_id"), _reviewed(spark, sf))


@query("run_export", f"SELECT run_id, record_id, 'key_' || feature_id AS feature_key, model_value FROM {_MIS} WHERE run_id = 'm3'")
def run_export(spark, sf):
    keys = spark.createDataFrame([(f, f"key_{f}") for f in "FOP"], "feature_id string, feature_key string")
    return review.run_export(scoring.mismatches(_cases(spark, sf)).where("run_id = 'm3'"), keys).select("run_id", "record_id", "feature_key", "model_value")


# --- runs ----------------------------------------------------------------------------------------------------------


@query("pending_records", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_records(spark, sf):
    return runs.pending_records(read(spark, sf, "documents"), read(spark, sf, "labels"), "doc_id", 100)


@query("record_scope", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def record_scope(spark, sf):
    return runs.record_scope(read(spark, sf, "documents"), "doc_id", dev=True)


@query("is_dev", "SELECT c_mktsegment, count(*) < 300 AS dev FROM customer GROUP BY 1")
def is_dev(spark, sf):
    return read(spark, sf, "customer").groupBy("c_mktsegment").agg(runs.is_dev(F.count("*"), 300).alias("dev"))


@query("run_progress", """SELECT event_type, count(*)::BIGINT AS done, count(*) FILTER (WHERE event_id % 50 = 0)::BIGINT AS parse_failures, sum(event_id % 3)::BIGINT AS retries, quantile_disc(CAST(value AS DECIMAL(18,2)), 0.5)::DOUBLE AS median_latency, sum(user_id)::BIGINT AS prompt_tokens FROM events GROUP BY 1""")
def run_progress(spark, sf):
    out = runs.run_progress(read(spark, sf, "events"), "event_type", "value", F.lit(100_000), F.col("event_id") % 50 == 0, F.col("event_id") % 3, F.col("user_id"))
    return out.select("event_type", "done", "parse_failures", "retries", F.col("median_latency").cast("double").alias("median_latency"), "prompt_tokens")


@query("median_latency_avg", "SELECT event_type, round(median(value), 9) AS median_ms FROM events GROUP BY 1")
def median_latency_avg(spark, sf):
    return ranking.latency(read(spark, sf, "events"), "event_type", "value").select("event_type", F.round("median_ms", 9).alias("median_ms"))


@query("per_record_ms", "SELECT event_type, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE / 4 / count(*), 6) AS per_record_ms FROM events GROUP BY 1")
def per_record_ms(spark, sf):
    return ranking.latency(read(spark, sf, "events"), "event_type", "value", F.lit(4)).select("event_type", F.round("per_record_ms", 6).alias("per_record_ms"))


@query("run_list", "SELECT o_custkey, o_orderkey, started_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS ordinal FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS started_at FROM orders)")
def run_list(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("evaluation_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("started_at"))
    return runs.run_list(rows).select(F.col("evaluation_id").alias("o_custkey"), F.col("run_id").alias("o_orderkey"), "started_at", F.col("ordinal").cast("long").alias("ordinal"))


@query("reading_quality", "SELECT event_type, count(*)::BIGINT AS extractions, count(*) FILTER (WHERE event_id % 50 = 0)::BIGINT AS parse_failures, CASE WHEN event_type <> 'click' THEN count(*) FILTER (WHERE user_id >= 95) END::BIGINT AS at_limit FROM events GROUP BY 1")
def reading_quality(spark, sf):
    context = F.when(F.col("event_type") != "click", F.lit(100))
    return runs.reading_quality(read(spark, sf, "events"), "event_type", F.col("event_id") % 50 == 0, F.col("user_id"), context)


@query("noise_floor", "SELECT o_orderkey, greatest(o_custkey % 50, ceil(o_orderkey * 2 / 48.0))::BIGINT AS band FROM orders")
def noise_floor(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", runs.noise_band(F.col("o_custkey") % 50, F.col("o_orderkey")).cast("long").alias("band"))


@query("differ_count", f"SELECT count(*)::BIGINT AS differ FROM (SELECT o_orderkey, max(CASE WHEN r = 1 THEN {_ANSWER} END) AS a, max(CASE WHEN r = 2 THEN {_ANSWER} END) AS b FROM orders, (VALUES (1), (2)) t(r) GROUP BY o_orderkey) WHERE a IS DISTINCT FROM b")
def differ_count(spark, sf):
    a = _answers(spark, sf)[1]
    return runs.differ_count(a.where("run_id = 'm1'"), a.where("run_id = 'm2'"), "record_id", "model_value").select(F.col("differ").cast("long").alias("differ"))


@query("noise_band", "SELECT o_orderkey, greatest(o_custkey % 50, ceil(o_orderkey * 2 / 48.0))::BIGINT AS band, ceil(o_orderkey * 2 / 48.0)::BIGINT AS floor FROM orders")
def noise_band(spark, sf):
    n = F.col("o_orderkey")
    return read(spark, sf, "orders").select(n, runs.noise_band(F.col("o_custkey") % 50, n).cast("long").alias("band"), runs.noise_floor(n).cast("long").alias("floor"))


# The exact rest of s / p * 100 decides where the product looks like a tie: halves of doubles by 2^27 + 1.
@query("gate_result", """SELECT o_orderkey, (CASE WHEN t > 0.5 OR t = 0.5 AND (e > 0 OR e = 0 AND d % 2 <> 0) THEN d + 1 ELSE d END) / 100 AS speedup, CASE WHEN a AND b THEN 'passes' WHEN b THEN 'fails_parallel' WHEN a THEN 'fails_server' ELSE 'fails_both' END AS verdict
 FROM (SELECT *, floor(m) AS d, m - floor(m) AS t, (h * 100::DOUBLE - m) + (x - h) * 100::DOUBLE AS e FROM (SELECT *, x * 100::DOUBLE AS m, x * 134217729::DOUBLE - (x * 134217729::DOUBLE - x) AS h
  FROM (SELECT o_orderkey, s / p AS x, o_custkey % 9 <= 5 AND s / p >= 1.3 AS a, o_custkey % 7 <= 5 AS b FROM (SELECT *, (1000 + o_orderkey % 700)::DOUBLE AS s, (800 + o_custkey % 3)::DOUBLE AS p FROM orders))))""")
def gate_result(spark, sf):
    """Speedups that rounding lifts to the limit, and the verdict on what is not rounded."""
    passes = read(spark, sf, "orders").select("o_orderkey", F.lit(5).alias("band"), (F.col("o_custkey") % 7).alias("serial_differ"), (F.col("o_custkey") % 9).alias("parallel_differ"), (1000 + F.col("o_orderkey") % 700).alias("serial_ms"), (800 + F.col("o_custkey") % 3).alias("parallel_ms"))
    return runs.gate_result(passes).select("o_orderkey", "speedup", "verdict")


@query("gate_verdict", "SELECT o_orderkey, round((100 + o_orderkey % 80)::DOUBLE / 100, 2) AS speedup, CASE WHEN p AND s THEN 'passes' WHEN s THEN 'fails_parallel' WHEN p THEN 'fails_server' ELSE 'fails_both' END AS verdict FROM (SELECT o_orderkey, o_custkey % 9 <= 5 AND o_orderkey % 80 >= 30 AS p, o_custkey % 7 <= 5 AS s FROM orders)")
def gate_verdict(spark, sf):
    passes = read(spark, sf, "orders").select("o_orderkey", F.lit(5).alias("band"), (F.col("o_custkey") % 7).alias("serial_differ"), (F.col("o_custkey") % 9).alias("parallel_differ"), (100 + F.col("o_orderkey") % 80).alias("serial_ms"), F.lit(100).alias("parallel_ms"))
    return runs.gate_result(passes).select("o_orderkey", "speedup", "verdict")


@query("parallel_decision", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <= 1 THEN 'not_mapped' WHEN o_custkey % 5 = 0 THEN 'missing' WHEN o_custkey % 3 = 0 THEN 'digest' WHEN o_custkey % 7 = 0 THEN 'ollama_version' WHEN o_orderkey % 4 > o_custkey % 5 THEN 'failed' ELSE 'gated' END AS reason FROM orders")
def parallel_decision(spark, sf):
    passing = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 5)
    _, reason = runs.parallel_decision(F.col("o_orderkey") % 4, passing, F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 7 != 0)
    return read(spark, sf, "orders").select("o_orderkey", reason.alias("reason"))


@query("context_fit", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN ceil(length(text) / 4.0) + 1024 <= 0.9 * 2048 END AS fits FROM documents")
def context_fit(spark, sf):
    return read(spark, sf, "documents").select("doc_id", runs.context_fit(runs.estimate_tokens(F.col("text")), F.when(F.col("doc_id") % 4 != 0, 2048)).alias("fits"))


@query("strongest_context", "SELECT o_orderstatus AS tag, coalesce(max_by(o_custkey, o_orderkey) FILTER (WHERE o_custkey % 2 = 0), 4096)::BIGINT AS context FROM orders GROUP BY 1")
def strongest_context(spark, sf):
    o = read(spark, sf, "orders")
    measured = o.select(F.col("o_orderstatus").alias("tag"), F.lit("d").alias("digest"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("context"), F.col("o_orderkey").alias("started_at"), F.col("o_orderkey").alias("run_id"))
    models = o.select(F.col("o_orderstatus").alias("tag"), F.lit("d").alias("digest"), F.lit(4096).alias("declared")).distinct()
    return runs.strongest_context(measured, models).select("tag", F.col("context").cast("long").alias("context"))


@query("at_context_limit", "SELECT event_id, coalesce(user_id >= 0.95 * CASE WHEN event_id % 3 <> 0 THEN 90 END, false) AS at_limit FROM events")
def at_context_limit(spark, sf):
    return read(spark, sf, "events").select("event_id", runs.at_context_limit(F.col("user_id"), F.when(F.col("event_id") % 3 != 0, 90)).alias("at_limit"))


@query("vram_fit", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey <= 12 END AS fits FROM customer")
def vram_fit(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", runs.vram_fit(F.col("c_nationkey"), F.when(F.col("c_custkey") % 3 != 0, 12)).alias("fits"))


@query("launch_estimate", "SELECT o_orderkey, round_even((o_custkey * 1.0 / CASE WHEN o_orderkey % 2 = 0 THEN 2.0 ELSE 1.0 END) * (o_orderkey % 9), 0)::BIGINT AS ms FROM orders")
def launch_estimate(spark, sf):
    speedup = F.when(F.col("o_orderkey") % 2 == 0, 2.0)
    return read(spark, sf, "orders").select("o_orderkey", runs.launch_estimate(F.col("o_custkey"), speedup, F.col("o_orderkey") % 9).alias("ms"))


@query("qualification_quality", f"SELECT model, language, round(avg(f1), 4) AS macro_f1 FROM ({_GOAL1}) GROUP BY ALL")
def qualification_quality(spark, sf):
    return runs.qualification_quality(_goal1(spark, sf))


@query("qualification_summary", """SELECT 'm' || (event_id % 4) AS model, count(*)::BIGINT AS records, count(*) FILTER (WHERE event_id % 50 = 0)::BIGINT AS parse_failures, floor(median(user_id) FILTER (WHERE event_id % 50 <> 0))::BIGINT AS median_tokens,
 round(count(*) FILTER (WHERE event_id % 3 = 0)::DOUBLE / count(*), 4) AS entity_fill FROM events GROUP BY 1""")
def qualification_summary(spark, sf):
    e = read(spark, sf, "events")
    failed = F.col("event_id") % 50 == 0
    rows = e.select(F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model"), failed.alias("failed"), F.when(~failed, F.col("user_id")).alias("tokens"), F.when(F.col("event_id") % 3 == 0, 2).otherwise(0).alias("n_entities"))
    return runs.qualification_summary(rows, "model", F.col("failed"), F.col("tokens"), F.col("n_entities"))


@query("run_facts", """SELECT n_nationkey AS run_id, n::BIGINT AS record_count, f.fp AS config_fingerprint, n_regionkey % 2 = 0 AS is_synthetic, n_regionkey < 3 AS scrubbed, CASE WHEN n_regionkey < 2 THEN n_regionkey + 10 END::INT AS scrub_version FROM nation
 JOIN (SELECT c_custkey % 5 AS k, count(*) AS n FROM customer GROUP BY 1) ON k = n_regionkey JOIN (SELECT s_nationkey, sha256(string_agg(sha256(CAST(s_suppkey AS VARCHAR)), chr(10) ORDER BY sha256(CAST(s_suppkey AS VARCHAR)))) AS fp FROM supplier GROUP BY 1) f ON s_nationkey = n_nationkey""")
def run_facts(spark, sf):
    k = F.col("r_regionkey")
    run = read(spark, sf, "nation").select(F.col("n_nationkey").alias("run_id"), F.col("n_regionkey").alias("corpus_id"))
    corpora = read(spark, sf, "region").select(k.alias("corpus_id"), F.col("r_name").alias("name"), (k % 2 == 0).alias("is_synthetic"), F.when(k < 3, "f").alias("scrub_fingerprint"), F.when(k < 2, k).alias("scrub_ruleset_id"))
    records = read(spark, sf, "customer").select((F.col("c_custkey") % 5).cast("int").alias("corpus_id"))
    features = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("run_id"), F.sha2(F.col("s_suppkey").cast("string"), 256).alias("fingerprint"))
    rulesets = read(spark, sf, "region").select(k.alias("scrub_ruleset_id"), (k + 10).cast("int").alias("version"))
    found = runs.run_facts(run, corpora, records, features, rulesets).where("config_fingerprint IS NOT NULL")
    return found.select("run_id", "record_count", "config_fingerprint", "is_synthetic", "scrubbed", "scrub_version")


@query("write_scores", "SELECT o_orderstatus AS run_id, o_orderpriority AS feature_id, (count(*) * CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END)::BIGINT AS value FROM orders GROUP BY o_orderstatus, o_orderpriority")
def write_scores(spark, sf):
    """Scores written twice for one run: its partitions are replaced, the others stay."""
    path = scratch_dir(spark, "scores")
    rows = read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("run_id"), F.col("o_orderpriority").alias("feature_id")).agg(F.count("*").alias("value"))
    scoring.write_scores(rows, path)
    scoring.write_scores(rows.where("run_id = 'F'").withColumn("value", F.col("value") * 2), path)
    return spark.read.parquet(path).select("run_id", "feature_id", "value")


@query("latest_qualification", "SELECT tag, digest, verdict FROM (SELECT o_orderstatus AS tag, o_orderpriority AS digest, o_custkey AS verdict, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_qualification(spark, sf):
    log = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("tag"), F.col("o_orderpriority").alias("digest"), F.col("o_custkey").alias("verdict"), F.col("o_orderkey").alias("qualified_at"))
    return runs.latest_qualification(log)


@query("latest_settings", "SELECT event_type AS key, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_settings(spark, sf):
    return runs.latest_settings(read(spark, sf, "events").select(F.col("event_type").alias("key"), "value", F.col("event_id").alias("changed_at")))


@query("descriptor", "SELECT n_nationkey AS run_id, n_regionkey AS corpus_id, n::BIGINT AS record_count, n < 300 AS is_dev FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey % 5 AS k, count(*) AS n FROM customer GROUP BY 1) ON k = n_regionkey")
def descriptor(spark, sf):
    run = read(spark, sf, "nation").select(F.col("n_nationkey").alias("run_id"), F.col("n_regionkey").cast("long").alias("corpus_id"))
    corpora = read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("corpus_id"), "r_name")
    records = read(spark, sf, "customer").select((F.col("c_nationkey") % 5).cast("long").alias("corpus_id"))
    found = runs.descriptor(run, corpora, records).withColumn("is_dev", runs.is_dev(F.col("record_count"), 300))
    return found.select("run_id", F.col("corpus_id").cast("int").alias("corpus_id"), "record_count", "is_dev")
