"""Freezing a validated delivery: narratives, hierarchy, language counts, the encoding canary, versions, and the write."""

from __future__ import annotations

import functools
import json
import operator
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import census, integrity, scrub
from .scrub import Rules

#: Fixed value: characters that only Windows-1252 text has, whose absence in French shows a wrong decoding.
CANARY = "œŒ‘’“”–—…€™šžŠŽŸ‚„†‡‰‹›ˆ˜•"


def narratives(records: DataFrame, texts: DataFrame, key: str, text: str, sequence: str, fallback: str) -> DataFrame:
    """Records with narrative and from_anonymised: the last text of a key, else the record's anonymised column."""
    last = texts.groupBy(F.col(key)).agg(F.max_by(text, sequence).alias("_text"))
    joined = records.join(last, key, "left")
    own = F.when(F.col("_text") != "", F.col("_text"))
    return joined.withColumns({"narrative": F.coalesce(own, F.col(fallback)), "from_anonymised": own.isNull() & F.coalesce(F.col(fallback) != "", F.lit(False))}).drop("_text")


def hierarchy(records: DataFrame, objects: DataFrame, persons: DataFrame, record_key: str, object_key: str, object_fk: str, person_fk: str) -> DataFrame:
    """Per record: n_objects and n_persons, persons by way of their object; rows with an empty key are skipped."""
    o = objects.where(F.coalesce(F.col(object_key).cast("string"), F.lit("")) != "").select(F.col(object_key).alias("_o"), F.col(object_fk).alias(record_key))
    per_object = persons.groupBy(F.col(person_fk).alias("_o")).agg(F.count("*").alias("_p"))
    per = o.join(per_object, "_o", "left").groupBy(record_key).agg(F.count("*").alias("n_objects"), F.coalesce(F.sum("_p"), F.lit(0)).alias("n_persons"))
    return records.join(per, record_key, "left").fillna(0, ["n_objects", "n_persons"])


def language_counts(records: DataFrame, language: str = "language") -> DataFrame:
    return records.groupBy(F.col(language).alias("language")).agg(F.count("*").alias("n"))


def mixed_language(language: Column, confidence: Column, text: Column, floor: float = 0.5) -> tuple[Column, Column]:
    """(language, confidence) of a detector's answer: blank text is und at 0, an unsure answer is mixed."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(blank, "und").when(confidence < floor, "mixed").otherwise(language), F.when(blank, 0.0).otherwise(confidence)


#: Takes a text column, returns struct<language, confidence>: any detector that Spark can run.
Detector = Callable[[Column], Column]
#: Function words that tell German, French, Italian and English from each other.
FUNCTION_WORDS = {
    "de": "auf bei dem den der die ein eine einem einen einer fuhr ich ist mit nach nicht sich und von wurde zu zum zur".split(),
    "en": "and are as at be by for from had he it of on she that the this to was were which with".split(),
    "fr": "a au avec ce dans des du elle est et il je le les lui ne pas pour qui sur un une vers".split(),
    "it": "al alla che con da dal del della di gli ha il la nel nella non per si sono sul sulla un una".split(),
}


def by_function_words(text: Column) -> Column:
    """A detector of built-in expressions: the language with most function words, of equals the first in order; confidence
    is its share of all function words, 0 without any."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    said = lambda ws: F.size(F.filter(words, lambda w: w.isin(ws)))
    counts = [F.struct(said(ws).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("language")) for i, (code, ws) in enumerate(sorted(FUNCTION_WORDS.items()))]
    total = functools.reduce(operator.add, (c["n"] for c in counts))
    best = F.greatest(*counts)
    return F.struct(best["language"].alias("language"), F.coalesce(F.try_divide(best["n"], total), F.lit(0.0)).alias("confidence"))


def detect_language(texts: DataFrame, text: str, detector: Detector = by_function_words, floor: float = 0.5) -> DataFrame:
    """``texts`` with language and confidence of each narrative: blank is und at 0, an unsure answer is mixed."""
    found = texts.withColumn("_detected", detector(F.col(text)))
    language, confidence = mixed_language(F.col("_detected.language"), F.col("_detected.confidence"), F.col(text), floor)
    return found.withColumns({"language": language, "confidence": confidence}).drop("_detected")


def canary_count(texts: DataFrame, text: str, chars: str = CANARY) -> DataFrame:
    """One row: how many of the characters all texts hold."""
    return texts.agg(F.coalesce(F.sum(F.length(text) - F.length(F.translate(F.col(text), chars, ""))), F.lit(0)).alias("n"))


def canary_by_char(texts: DataFrame, text: str, chars: str = CANARY) -> DataFrame:
    """Per character: char, n; zeros kept. One pass of length differences, without a row per character."""
    counts = texts.agg(*(F.coalesce(F.sum(F.length(text) - F.length(F.translate(F.col(text), c, ""))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(chars)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("char"), F.col(f"c{i}").alias("n")) for i, c in enumerate(chars)))).alias("x")).select("x.char", "x.n")


def canary_finding(texts: DataFrame, text: str, language: str, chars: str = CANARY) -> DataFrame:
    """One row CP1252_CANARY_ZERO where there is French and no such character; else none."""
    return canary_of(texts.select((F.length(text) - F.length(F.translate(F.col(text), chars, ""))).alias("canary"), F.col(language).alias("language")))


def next_version(versions: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """Per name the version after the highest."""
    return versions.groupBy(name).agg((F.max(version) + 1).alias("next_version"))


def blocked_by(findings: DataFrame) -> None:
    """Raises where a finding blocks, naming the codes."""
    blocked = integrity.blocking(findings).select("code").distinct().limit(20).collect()
    if blocked:
        raise ValueError("blocking findings: " + ", ".join(sorted(r.code for r in blocked)))


def freeze_delivery(
    spark: SparkSession, records: DataFrame, cells: DataFrame, findings: DataFrame, out_dir: str, manifest: dict, key: str = "record_key", rules: Rules = Rules(), detector: Detector = by_function_words, anonymised: tuple[str, ...] = (), min_records: int = 20,
) -> dict:
    """Freeze a validated delivery in one step, all or nothing; the manifest entry.

    ``records(key, narrative, from_anonymised, ...)`` and ``cells(table_name, key, column_name, value_raw, seq)``. Language
    and canary are read from the original narratives; narratives and the cells of ``anonymised`` columns are written
    masked, the original texts never. A blocking finding, or a rule that takes too long, raises, and no corpus exists.
    Besides records and cells the corpus holds its import report, the tally of the rules and its census.
    """
    blocked_by(findings)
    attempt = f"{out_dir}/data-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{attempt}/{name}")
        return spark.read.schema(df.schema).parquet(f"{attempt}/{name}")

    canary = F.coalesce(F.length("narrative") - F.length(F.translate(F.col("narrative"), CANARY, "")), F.lit(0)).alias("canary")
    read = detect_language(records, "narrative", detector).select("*", canary).withColumn("s", scrub.scrubbed(spark, "narrative", rules))
    hits = F.transform("s.hits", lambda h: h.dropFields("value", "entry")).alias("hits")  # what was matched is not kept
    masked = written(read.select(*(c for c in read.columns if c not in ("s", "narrative")), F.col("s.text").alias("narrative"), hits, "s.timed_out"), "record")
    named = F.col("column_name").isin(*anonymised)
    secret = written(cells.where(named & (F.coalesce("value_raw", F.lit("")) != "")).withColumn("s", scrub.scrubbed(spark, "value_raw", rules)).select(*cells.drop("value_raw").columns, F.col("s.text").alias("value_raw"), hits, "s.timed_out"), "masked-cell")
    results = masked.select(key, "narrative", "hits", "timed_out").union(secret.select(key, "value_raw", "hits", "timed_out"))
    blocked_by(scrub.scrub_timeouts(results, key).select("code"))

    plain = cells.where(~named | (F.coalesce("value_raw", F.lit("")) == ""))
    whole = written(plain.unionByName(secret.drop("hits", "timed_out")), "cell")
    tally = written(scrub.scrub_tally(results, rules, key), "scrub-tally")
    warned = canary_of(masked)
    detail = lambda df: df.select("code", F.to_json("detail").alias("detail") if "detail" in df.columns else F.lit(None).cast("string").alias("detail"))
    written(detail(findings).union(detail(scrub.scrub_findings(tally))).union(detail(warned)), "report")
    values = census.value_table(whole.where(F.coalesce("value_raw", F.lit("")) != ""), F.col("seq"))
    headers = whole.select("table_name", "column_name").distinct().join(masked.agg(F.count("*").alias("_records")))
    written(census.census_columns(values, headers, F.col("_records")).drop("_records"), "census")

    total = masked.agg(F.count("*").alias("n"), F.coalesce(F.sum("canary"), F.lit(0)).alias("canary"), F.coalesce(F.bool_and(F.col(key).rlike(integrity.SYNTHETIC_KEY)), F.lit(False)).alias("synthetic")).first()
    languages = {r.language: r.n for r in language_counts(masked).collect()}  # one row a language
    facts = {"record_count": total.n, "cp1252_canary_count": total.canary, "language_counts": languages, "is_dev_sized": total.n < min_records, "is_synthetic": bool(manifest.get("is_synthetic")) or total.synthetic, "scrub_fingerprint": rules.fingerprint()}
    return commit(spark, out_dir, manifest | facts, attempt, ["record", "cell", "scrub-tally", "report", "census"])


def canary_of(records: DataFrame) -> DataFrame:
    """One row CP1252_CANARY_ZERO, from (canary, language), where there is French and no such character; else none."""
    both = records.agg(F.coalesce(F.sum("canary"), F.lit(0)).alias("n"), F.count_if(F.col("language") == "fr").alias("fr"))
    return both.where("n = 0 AND fr > 0").select(F.lit("CP1252_CANARY_ZERO").alias("code"))


#: Folders where taking a name that is free is a hard link; elsewhere it is a rename.
LINKED = ("file",)


def _versions(spark: SparkSession, out_dir: str) -> list[int]:
    """The versions of a corpus in order; none where there is no corpus."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _claimed(spark: SparkSession, out_dir: str, version: int, entry: str) -> bool:
    """Make the version's manifest, whole, unless another writer has; whether it was made.

    The text is written under a name of its own first. Taking the version's name is one step that fails where the name is
    taken: a hard link in a local folder, a rename without overwriting elsewhere.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/manifest")
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f"_draft-{uuid.uuid4().hex}")
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{version:08d}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(f"{entry}\n".encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() in LINKED:
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
        else:
            no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            no_overwrite[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, target, no_overwrite)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    finally:
        fs.delete(draft, False)


def commit_next(spark: SparkSession, out_dir: str, following: Callable[[dict | None], dict | None]) -> dict | None:
    """Claim the next version of what ``out_dir`` holds; its entry, which names the version.

    ``following`` takes the last version's entry (None where there is none) and returns the next one's, or None to leave
    things as they are. Of writers at once, whoever finds the number taken is asked again, for the version after that one;
    so none is lost. A version exists when its one-row manifest does, and is never changed.
    """
    while True:
        known = _versions(spark, out_dir)
        entry = following(snapshot(spark, out_dir, known[-1]) if known else None)
        if entry is None:
            return None
        version = known[-1] + 1 if known else 1
        entry = entry | {"version": version}
        if _claimed(spark, out_dir, version, json.dumps(entry, sort_keys=True, ensure_ascii=False)):
            return entry


def commit(spark: SparkSession, out_dir: str, manifest: dict, attempt: str, tables: list[str]) -> dict:
    """Claim the corpus's next version for the tables of an attempt; the entry."""
    return commit_next(spark, out_dir, lambda _: manifest | {"data": attempt, "tables": sorted(tables)})


def freeze(spark: SparkSession, tables: dict[str, DataFrame], findings: DataFrame, out_dir: str, manifest: dict) -> dict:
    """Write the tables of a corpus as its next version, all or nothing.

    A blocking finding raises before anything is written. Tables go to a folder of this attempt; the version exists when
    its one-row manifest does, which is written last and names that folder, so a failed attempt leaves nothing visible.
    """
    blocked_by(findings)
    attempt = f"{out_dir}/data-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{attempt}/{name}")
    return commit(spark, out_dir, manifest, attempt, list(tables))


def manifests(spark: SparkSession, out_dir: str) -> DataFrame:
    """version, manifest (JSON) of every version of a corpus; without a corpus there are no rows."""
    if not _versions(spark, out_dir):
        return spark.createDataFrame([], "version long, manifest string")
    rows = spark.read.text(f"{out_dir}/manifest", pathGlobFilter="*.json")
    return rows.select(F.get_json_object("value", "$.version").cast("long").alias("version"), F.col("value").alias("manifest"))


def snapshot(spark: SparkSession, out_dir: str, version: int | None = None) -> dict:
    """The manifest of a version, the last by default. Tables read by one snapshot belong together, whoever freezes
    meanwhile; an unknown version raises LookupError."""
    known = _versions(spark, out_dir)
    if not known or (version is not None and version not in known):
        raise LookupError(f"{out_dir} has no version {version or 1}")
    return json.loads(spark.read.text(f"{out_dir}/manifest/{version or known[-1]:08d}.json").first().value)


def read_corpus(spark: SparkSession, out_dir: str, table: str, version: int | dict | None = None) -> DataFrame:
    """A table of a version (a number, or a snapshot), the last by default."""
    entry = version if isinstance(version, dict) else snapshot(spark, out_dir, version)
    return spark.read.parquet(f"{entry['data']}/{table}")


def citing_counts(items: DataFrame, citing: DataFrame, key: str, fk: str) -> DataFrame:
    """How many rows cite each item, zero included."""
    n = citing.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias(key)).agg(F.count("*").alias("n_citing"))
    return items.select(key).join(n, key, "left").fillna(0, ["n_citing"])


def corpus_summary(corpora: DataFrame, evaluations: DataFrame, key: str, fk: str) -> DataFrame:
    """One row: total, and how many an evaluation cites."""
    cited = evaluations.select(F.col(fk).alias(key)).distinct().withColumn("c", F.lit(1))
    return corpora.select(key).distinct().join(cited, key, "left").agg(F.count("*").alias("total"), F.count("c").alias("cited"))


def first_record(records: DataFrame, corpus: str, key: str) -> DataFrame:
    return records.groupBy(corpus).agg(F.min(key).alias("first_record"))


def ruleset_counts(corpora: DataFrame, version: str) -> DataFrame:
    """Corpora per rule set version; those without one are left out."""
    return corpora.where(F.col(version).isNotNull()).groupBy(version).agg(F.count("*").alias("n"))


def page(rows: DataFrame, sort: str, key: str, descending: bool = False, offset: int = 0, limit: int = 50, nulls_last: bool | None = None) -> DataFrame:
    """A page in sort order, ties by key, with ``total``."""
    c = F.col(sort)
    order = {(False, None): c.asc(), (True, None): c.desc(), (False, True): c.asc_nulls_last(), (True, True): c.desc_nulls_last()}[descending, nulls_last]
    return rows.join(rows.agg(F.count("*").alias("total"))).orderBy(order, key).offset(offset).limit(limit)
