"""Operator 8: language identification by compression with per-language zstandard dictionaries.

A raw-content dictionary per language is cut from a bounded sample of labelled training documents. A text is compressed
whole and in lower case, in pieces that a dictionary can serve, with each of them; the language whose dictionary gives the fewest bytes is
predicted, and a narrow margin to the next one marks the prediction as rejected. Prediction is a map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The bound of the training sample: so many documents a language, a stretch of so many characters of each, so large a
#: dictionary; and the bytes of all dictionaries, which languages share evenly where they are many.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, ALL_BYTES = 800, 320, 262_144, 67_108_864
#: Up to so many languages their counts, a row each, are broadcast.
FEW_LANGS = 10_000
#: Bytes of text compressed at once: each piece can refer to the whole dictionary.
PIECE = 8192
LEVEL = 9
#: A prediction whose margin, as a share of the second best size, is lower is rejected.
MIN_MARGIN = 0.004


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language, from non-null text and lang of documents that are not held out.

    The sample is fixed by a hash of the id and text: the same table gives the same dictionaries. A language with little
    text has a short dictionary; without labelled text there is none, and every prediction is ``und``.
    """
    usable = docs.where(F.col("text").isNotNull() & (F.trim("text") != "") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # A uniform hash thins each language to a few times the sample before ranks are given, so that no task ranks many rows.
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = counts.count()
    if not n_langs:
        return {}
    if n_langs <= FEW_LANGS:  # else Spark joins by language; texts stay where they are so
        counts = F.broadcast(counts)
    docs_each = max(1, min(SAMPLE_DOCS, ALL_BYTES // (n_langs * SAMPLE_CHARS)))
    bytes_each = min(DICTIONARY_BYTES, ALL_BYTES // n_langs)
    h = F.xxhash64("doc_id", "text")
    bound = F.least(F.lit(float(2**63)), F.lit(4.0 * docs_each * 2**63) / F.col("n"))
    hashed = usable.join(counts, "lang").withColumn("h", h).where(F.col("h").bitwiseAND(F.lit(2**63 - 1)).cast("double") <= bound)
    # A stretch from anywhere in the text, where the hash says.
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    stretch = hashed.select("lang", "doc_id", "h", F.substr("text", start, F.lit(SAMPLE_CHARS)).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    sample = stretch.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_each)
    found: dict[str, list[str]] = {}
    for r in sample.select("lang", "text").orderBy("lang", "k").toLocalIterator():  # at most ALL_BYTES characters
        found.setdefault(r.lang, []).append(r.text.lower())
    return {lang: "\n".join(dict.fromkeys(texts)).encode()[:bytes_each] for lang, texts in found.items()}


def _predictor(dictionaries):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = dictionaries.value
        langs = sorted(contents)
        press = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            press.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            out_lang, score, margin = [], [], []
            for text in batch.column("row").field("text").to_pylist():
                if not text or not langs or not any(map(str.isalpha, text)):
                    out_lang.append("und"), score.append(0.0), margin.append(0.0)
                    continue
                raw = text.lower().encode()
                sizes = [0] * len(langs)
                for a in range(0, len(raw), PIECE):
                    piece = raw[a : a + PIECE]
                    for k, c in enumerate(press):
                        sizes[k] += len(c.compress(piece))
                best = min(range(len(langs)), key=lambda k: (sizes[k], langs[k]))
                second = min((s for k, s in enumerate(sizes) if k != best), default=None)
                gap = 1.0 if second is None else (second - sizes[best]) / second
                out_lang.append(langs[best]), score.append(gap), margin.append(gap)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out_lang, pa.string()), pa.array(score, pa.float64()), pa.array([m < MIN_MARGIN for m in margin], pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    return predict


def predict_language(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(row, lang_pred, score, rejected): row is a struct of all columns of ``docs``; its ``text`` alone decides, and score
    is the margin, 0 to 1. Whole texts are compressed, however long.

    A text that is null or has no letter is ``und`` with score 0 and rejected. Equal sizes go to the first language in
    order, with score 0, rejected. Columns of any name pass in the struct.
    """
    dictionaries = docs.sparkSession.sparkContext.broadcast(learn(train))  # at most ALL_BYTES
    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(_predictor(dictionaries), schema)


def language_id(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, ...)``: doc_id, held_out, lang_pred, score, rejected.

    lang is used of training documents only, and never of the document that is predicted. A null doc_id is neither held
    out nor learned from; repeated rows are predicted alike; an empty table gives an empty result.
    """
    found = predict_language(docs.select("doc_id", "text"), docs)
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
