"""Runs and model qualification: pending records, progress, context limits, gates and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_round


DEV_RECORDS, RECORD_MIN = 50, 20
#: Tokens kept free for an answer, and shares of the context.
ANSWER_TOKENS, FIT_SHARE, LIMIT_SHARE = 1024, 0.90, 0.95
SPEEDUP_MIN, NOISE_PER = 1.3, (2, 48)


def pending_records(records: DataFrame, done: DataFrame, key: str, first: int | None = None) -> DataFrame:
    """Records in scope (the first ones by key, or all) that have no extraction: the limit comes before the anti-join."""
    scope = records.select(key).orderBy(key).limit(first) if first is not None else records.select(key)
    return scope.join(done.select(key), key, "left_anti")


def record_scope(records: DataFrame, key: str, dev: bool, size: int = DEV_RECORDS) -> DataFrame:
    return records.select(key).orderBy(key).limit(size) if dev else records.select(key)


def is_dev(n: Column, minimum: int = RECORD_MIN) -> Column:
    return n < minimum


def run_progress(extractions: DataFrame, by: str, latency: str, total: Column, failed: Column, retries: Column, tokens: Column) -> DataFrame:
    """Per run: done, parse_failures, retries, lower median latency, prompt tokens, and the linear time left."""
    out = extractions.groupBy(by).agg(
        F.count("*").alias("done"), F.count_if(failed).alias("parse_failures"), F.coalesce(F.sum(retries), F.lit(0)).alias("retries"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {latency})").alias("median_latency"), F.coalesce(F.sum(tokens), F.lit(0)).alias("prompt_tokens"), F.sum(latency).alias("spent")
    )
    return out.withColumn("eta", F.round(F.col("spent") / F.col("done") * F.greatest(total - F.col("done"), F.lit(0)), 6)).drop("spent")


def run_list(runs: DataFrame, sort: str = "started_at", descending: bool = True) -> DataFrame:
    """Runs numbered by id, in order of start; those not started are last either way."""
    from pyspark.sql import Window

    numbered = runs.withColumn("ordinal", F.row_number().over(Window.partitionBy("evaluation_id").orderBy("run_id")))
    c = F.col(sort)
    return numbered.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "run_id")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def resolve_template(template: str, slots: dict[str, Column]) -> Column:
    """The template with its ``{{slot}}`` places filled in one pass: a value that holds a slot's name stays as it is."""
    import re

    parts: list[Column] = []
    for i, part in enumerate(re.split(r"\{\{\s*(\w+)\s*\}\}", template)):
        parts.append(slots[part] if i % 2 else F.lit(part))
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def validate_template(template: str, known: set[str], required: set[str]) -> list[tuple[str, str, int]]:
    """(problem, slot, offset): unknown, empty, malformed and missing slots."""
    import re

    out, seen = [], set()
    for m in re.finditer(r"\{\{(.*?)\}\}|\{\{|\}\}", template, re.S):
        name = (m[1] or "").strip()
        if m[1] is None:
            out.append(("malformed", m[0], m.start()))
        elif not name:
            out.append(("empty", "", m.start()))
        elif not re.fullmatch(r"\w+", name):
            out.append(("malformed", name, m.start()))
        elif name not in known:
            out.append(("unknown", name, m.start()))
        else:
            seen.add(name)
    return out + [("missing", name, -1) for name in sorted(required - seen)]


def feature_block(features: list[dict], language: str) -> str:
    """The prompt's list of features, codes in snapshot order, a visible mark where a label is missing."""
    lines = []
    for f in features:
        lines.append(f"- {f['key']} ({f['value_type']}): {f.get('description', '')}".rstrip())
        for code in f.get("codes", ()):
            lines.append(f"    {code['code']} = {code.get('labels', {}).get(language) or '[no label]'}")
    return "\n".join(lines)


def longest_prompt(records: DataFrame, key: str, text: str) -> DataFrame:
    """The longest narrative, of equals the smallest key: key, n_chars, tokens."""
    longest = records.orderBy(F.length(text).desc_nulls_last(), key).limit(1)
    return longest.select(key, F.length(text).alias("n_chars"), estimate_tokens(F.col(text)).alias("tokens"))


def context_fit(tokens: Column, context: Column) -> Column:
    """Whether a prompt and its answer fit; null where the context is unknown."""
    return F.when(context.isNotNull(), tokens + ANSWER_TOKENS <= FIT_SHARE * context)


def strongest_context(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Per (tag, digest): the context that the latest run measured, else the declared one."""
    measured = runs.where("context IS NOT NULL").groupBy("tag", "digest").agg(F.max_by("context", F.struct("started_at", "run_id")).alias("measured"))
    return models.join(measured, ["tag", "digest"], "left").select("tag", "digest", F.coalesce("measured", "declared").alias("context"))


def at_context_limit(tokens: Column, context: Column) -> Column:
    return F.coalesce((context > 0) & (tokens >= LIMIT_SHARE * context), F.lit(False))


def vram_fit(size: Column, vram: Column) -> Column:
    return F.when(vram.isNotNull(), size <= vram)


def launch_estimate(per_record_ms: Column, speedup: Column, records: Column) -> Column:
    """Milliseconds for all records at the measured speedup, rounded half-even."""
    return F.rint(per_record_ms / F.coalesce(speedup, F.lit(1.0)) * records).cast("long")


def reading_quality(extractions: DataFrame, by: str, failed: Column, tokens: Column, context: Column) -> DataFrame:
    """Per run: extractions, parse failures, and prompts at the context limit (null where the context is unknown)."""
    known = F.max(context).isNotNull()
    return extractions.groupBy(by).agg(F.count("*").alias("extractions"), F.count_if(failed).alias("parse_failures"), F.when(known, F.count_if(at_context_limit(tokens, context))).alias("at_limit"))


def noise_floor(records: Column) -> Column:
    return F.ceil(records * NOISE_PER[0] / NOISE_PER[1])


def noise_band(differs: Column, records: Column) -> Column:
    return F.greatest(differs, noise_floor(records))


def differ_count(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys whose answers differ between two passes; a key that one pass lacks raises."""
    a, b = first.select(key, F.col(value).alias("a"), F.lit(1).alias("ia")), second.select(key, F.col(value).alias("b"), F.lit(1).alias("ib"))
    both = a.join(b, key, "full_outer")
    same_keys = F.when(F.col("ia").isNull() | F.col("ib").isNull(), F.raise_error(F.lit("the passes have different records")).cast("int")).otherwise(1)
    return both.agg(F.coalesce(F.sum(same_keys * (~F.col("a").eqNullSafe(F.col("b"))).cast("int")), F.lit(0)).alias("differ"))


def gate_verdict(band: Column, serial_differ: Column, parallel_differ: Column, speedup: Column) -> Column:
    """Whether parallel calls, and the server setting they need, keep answers within the noise band and are worth it."""
    parallel, server = (parallel_differ <= band) & (speedup >= SPEEDUP_MIN), serial_differ <= band
    return F.when(parallel & server, "passes").when(server, "fails_parallel").when(parallel, "fails_server").otherwise("fails_both")


def gate_result(passes: DataFrame) -> DataFrame:
    """``passes(n, band, serial_differ, parallel_differ, serial_ms, parallel_ms)`` with speedup (its exact value rounded to 2) and verdict
    (judged unrounded)."""
    speedup = F.col("serial_ms") / F.col("parallel_ms")
    return passes.withColumns({"verdict": gate_verdict(F.col("band"), F.col("serial_differ"), F.col("parallel_differ"), speedup), "speedup": exact_round(speedup, 2)})


def parallel_decision(mapped: Column, passing_n: Column, same_digest: Column, same_version: Column, measuring: Column | None = None) -> tuple[Column, Column]:
    """(calls, reason), the first rule that holds; ``passing_n`` is null without a gate. A refusal is one call."""
    measuring = F.lit(False) if measuring is None else measuring
    reason = (
        F.when(mapped.isNull() | (mapped <= 1), "not_mapped").when(measuring, "measuring").when(passing_n.isNull(), "missing").when(~same_digest, "digest")
        .when(~F.coalesce(same_version, F.lit(False)), "ollama_version").when(mapped > passing_n, "failed").otherwise("gated")
    )
    return F.when(reason.isin("measuring", "gated"), mapped).otherwise(1), reason


def latest_qualification(log: DataFrame) -> DataFrame:
    from .review import latest

    return latest(log, ["tag", "digest"], [c for c in log.columns if c not in ("tag", "digest", "qualified_at")], "qualified_at")


def latest_settings(log: DataFrame, at: str = "changed_at") -> DataFrame:
    from .review import latest

    return latest(log, ["key"], ["value"], at)


def qualification_quality(scores: DataFrame, floor: int = 0) -> DataFrame:
    """Per model: macro f1 over features and per language, rounded to 4."""
    kept = scores.where(F.col("n") >= floor)
    return kept.groupBy("model", "language").agg(F.round(F.avg("f1"), 4).alias("macro_f1"))


def qualification_summary(extractions: DataFrame, by: str, failed: Column, tokens: Column, entities: Column) -> DataFrame:
    """Per model what its answers cost and hold: records, parse_failures, median_tokens (cut to a whole number; null without
    any), and entity_fill, the share of records with an entity, rounded to 4."""
    out = extractions.groupBy(by).agg(F.count("*").alias("records"), F.count_if(failed).alias("parse_failures"), F.floor(F.median(tokens)).alias("median_tokens"), F.count_if(entities > 0).alias("_filled"))
    return out.withColumn("entity_fill", F.round(F.col("_filled") / F.col("records"), 4)).drop("_filled")


def run_facts(run: DataFrame, corpora: DataFrame, records: DataFrame, features: DataFrame, rulesets: DataFrame) -> DataFrame:
    """The header of each run: ``descriptor`` with the fingerprint of its own features, whether its corpus is synthetic and
    was scrubbed, and the version of the rules; a corpus that is gone has its label and no records."""
    from .derive import set_fingerprint

    n = records.groupBy("corpus_id").agg(F.count("*").alias("record_count"))
    config = set_fingerprint(features, "run_id", "fingerprint").withColumnRenamed("set_fingerprint", "config_fingerprint")
    known = corpora.join(n, "corpus_id", "left").join(rulesets.withColumnRenamed("version", "scrub_version"), "scrub_ruleset_id", "left")
    out = run.join(known, "corpus_id", "left").join(config, "run_id", "left").fillna(0, ["record_count"])
    return out.select(
        *run.columns, F.coalesce("name", F.lit("(corpus removed)")).alias("corpus_label"), "record_count", "config_fingerprint", is_dev(F.col("record_count")).alias("is_dev"),
        F.coalesce("is_synthetic", F.lit(False)).alias("is_synthetic"), F.col("scrub_fingerprint").isNotNull().alias("scrubbed"), "scrub_version",
    )


def descriptor(run: DataFrame, corpus: DataFrame, records: DataFrame) -> DataFrame:
    """One row per run: its corpus, the record count and whether it is of development size."""
    n = records.groupBy("corpus_id").agg(F.count("*").alias("record_count"))
    return run.join(corpus, "corpus_id").join(n, "corpus_id", "left").fillna(0, ["record_count"]).withColumn("is_dev", is_dev(F.col("record_count")))
