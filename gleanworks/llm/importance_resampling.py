"""Operator 11: resampling towards a target distribution by hashed n-gram importance weights.

Features are counted by bucket in the corpus and in the target. The log ratios of all buckets, whose number is a parameter,
are one array, and a document's weight is a fold of its features over that array: no join and no shuffle of texts. Scores
are integers, so the draw is exact without a sort of the table: a histogram of scores, summed from the top, gives the rank at
which each score begins and the score at the cutoff; only documents at or above it are ranked, by doc_id within a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Letters of both cases, digits, and everything beyond ASCII make words; words are lower-cased after the split.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BUCKETS, MAX_N, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024


def features(text: Column, max_n: int = MAX_N) -> Column:
    """The runs of 1 to ``max_n`` words of a text, repeats included; A-Z are not lower-cased yet."""
    words = F.array_remove(F.split(text, SEPARATORS), "")
    if max_n == 1:
        return words

    def runs(w: Column, n: int) -> Column:
        last = F.size(w) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, n), " "))

    return F.element_at(F.transform(F.array(words), lambda w: F.concat(*(w if n == 1 else runs(w, n) for n in range(1, max_n + 1)))), 1)


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    """crc32 of the UTF-8 bytes modulo ``buckets``, A-Z lower-cased and no other letter."""
    ascii_only = F.octet_length(feature) == F.length(feature)
    lower = F.when(ascii_only, F.lower(feature)).otherwise(F.translate(feature, UPPER, UPPER.lower()))
    return (F.crc32(lower.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, buckets: int, max_n: int) -> DataFrame:
    """(b, n) of the features of ``texts(text)``; counted in the map tasks first, so at most ``buckets`` rows leave each."""
    each = texts.where("text IS NOT NULL").select(F.explode(features(F.col("text"), max_n)).alias("f"))
    return each.groupBy(bucket(F.col("f"), buckets).alias("b")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int, max_n: int) -> Column:
    """An array literal with the gain of every bucket."""
    spark: SparkSession = docs.sparkSession
    s, t = (bucket_counts(x, buckets, max_n).withColumnRenamed("n", n) for x, n in ((docs, "s"), (target, "t")))
    both = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(s, "b", "left").join(t, "b", "left").fillna(0, ["s", "t"])
    both = Scratch(spark, "importance").write(both, "buckets")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    d = lambda x: F.lit(x).cast("double") if isinstance(x, int) else x.cast("double")
    ratio = (d(F.col("t") + 1) * d(all_s + buckets)) / (d(F.col("s") + 1) * d(all_t + buckets))
    listed = both.select("b", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("b").collect()  # ``buckets`` rows
    return F.split(F.lit(",".join(str(r.gain) for r in listed)), ",").cast("array<bigint>")


def noise(doc_id: Column, seed: int) -> Column:
    """The Gumbel term of a document, in thousandths, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_features, weight, score, rank (null: not drawn).

    ``target(text, ...)`` is the wanted distribution. Of the N rows with ``min_words`` words or more the
    floor(percent * N / 100) with the highest scores are drawn; ties go to the smaller doc_id, then to fewer features, and a
    null doc_id comes last (its noise is that of an empty id). Rows that are alike altogether are drawn one by one. A null
    or empty text has no features and weight 0; whole texts count, however long. Empty tables on either side are fine, other
    columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    gain = gains(docs, target, buckets, max_n)
    found = F.coalesce(features(F.coalesce("text", F.lit("")), max_n), F.array().cast("array<string>"))
    zero = F.lit(0).cast("long")

    def of(f: Column) -> Column:
        n, total = F.size(f).cast("long"), F.aggregate(f, zero, lambda acc, w: acc + F.get(gain, bucket(w, buckets)))
        return F.struct(n.alias("n"), total.alias("total"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.element_at(F.transform(F.array(found), of), 1).alias("f"))
    n, total = F.col("f.n"), F.col("f.total")
    # n features come from w words by w + (w - 1) + ... over max_n lengths; floors go down
    weight = F.when(n > 0, F.expr("(f.total - pmod(f.total, f.n)) div f.n")).otherwise(zero)
    least = sum(max(min_words - k, 0) for k in range(max_n))
    scored = rows.select("doc_id", n.alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = Scratch(spark, "importance").write(scored, "scored")
    eligible = F.col("n_features") >= least
    # Scores lie within some 100 000 integers whatever the table holds: a gain is the logarithm of a ratio of counts.
    histogram = sorted(((r.score, r.n) for r in scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn, above, offsets = percent * sum(n for _, n in histogram) // 100, 0, []
    for score, n_here in histogram:
        if above >= drawn:
            break
        offsets.append((score, above))
        above += n_here
    table = spark.createDataFrame(offsets, "score long, above long")
    marked = scored.join(F.broadcast(table), "score", "left")
    inside = eligible & F.col("above").isNotNull()
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    place = F.col("above") + F.row_number().over(order)
    columns = ("doc_id", "n_features", "weight", "score")
    ranked = marked.where(inside).select(*columns, place.cast("long").alias("place")).select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return ranked.unionByName(marked.where(~inside).select(*columns, F.lit(None).cast("long").alias("rank")))


def oracle_sql() -> str:
    """DuckDB SQL for the same rows; crc32 is spelt out over the distinct words."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    return rf"""
    WITH crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS tab FROM range(0, 256) r(n)),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({lower}, '{word}'), []) AS ws FROM documents),
    b AS (SELECT unnest(regexp_extract_all({lower}, '{word}')) AS w FROM benchmark),
    dw AS (SELECT r, unnest(ws) AS w FROM d),
    words AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM b)),
    hexed AS (SELECT w, list_transform(range(0, length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS bytes FROM words),
    key AS (SELECT w, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]), 4294967295), 4294967295) % {BUCKETS} AS k FROM hexed, crc),
    s AS (SELECT k, count(*) AS s FROM dw JOIN key USING (w) GROUP BY k),
    t AS (SELECT k, count(*) AS t FROM b JOIN key USING (w) GROUP BY k),
    g AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE)
          / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM range(0, {BUCKETS}) x(k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
    sums AS (SELECT r, sum(gain)::BIGINT AS total FROM dw JOIN key USING (w) JOIN g USING (k) GROUP BY r),
    h AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(total, 0) AS total, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (r)),
    w AS (SELECT r, doc_id, n_features, CASE WHEN n_features = 0 THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END::BIGINT AS weight, h FROM h),
    sc AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM w),
    ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM sc WHERE n_features >= {MIN_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END::BIGINT AS rank FROM sc LEFT JOIN ranked USING (r)
    """
