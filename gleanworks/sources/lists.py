"""Code lists (JSON), scrub rules (TOML) and name lists: small configuration files, checked whole."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scrub import MIN_LETTERS, check_rules, entry_key

CODES = "attribute string, chapter string, name map<string,string>, code string, labels map<string,string>"


def check_codelist(raw: str) -> tuple[list[tuple], list[str]]:
    """(rows of CODES, errors): {attribute: {chapter?, name, codes: {code: {language: label}}}}. One error fails the whole
    import, and all errors are reported."""
    try:
        data = json.loads(raw)
    except ValueError as e:
        return [], [f"not JSON: {e}"]
    if not isinstance(data, dict):
        return [], ["not an object of attributes"]
    rows, errors = [], []
    labels_ok = lambda x: isinstance(x, dict) and all(k in ("de", "fr", "it") and isinstance(v, (str, type(None))) for k, v in x.items())
    for attribute, body in data.items():
        if not isinstance(body, dict):
            errors.append(f"{attribute}: not an object")
            continue
        errors += [f"{attribute}: unknown field {k}" for k in sorted(set(body) - {"chapter", "name", "codes"})]
        if not labels_ok(body.get("name", {})):
            errors.append(f"{attribute}: name")
        if not isinstance(body.get("codes"), dict):
            errors.append(f"{attribute}: codes missing")
            continue
        for code, labels in body["codes"].items():
            if labels_ok(labels):
                rows.append((attribute, body.get("chapter"), body.get("name", {}), code, labels))
            else:
                errors.append(f"{attribute}.{code}: labels")
    return ([], errors) if errors else (rows, [])


def read_codelist(spark: SparkSession, raw: str) -> DataFrame:
    rows, errors = check_codelist(raw)
    if errors:
        raise ValueError("; ".join(errors))
    return spark.createDataFrame(rows, CODES)


def read_rules(data: bytes) -> tuple[list[dict], list[str]]:
    """(rules, protected strings) of a TOML file; raises with every problem found."""
    try:
        parsed = tomllib.loads(data.decode())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ValueError(f"not TOML: {e}") from e
    problems = [f"unknown field {k}" for k in sorted(set(parsed) - {"version", "protected", "rule"})]
    rules, protected = parsed.get("rule", []), parsed.get("protected", [])
    known = {"id", "tag", "description", "pattern", "must_match", "must_not_match"}
    problems += [f"{r.get('id', '?')}: unknown field {k}" for r in rules for k in sorted(set(r) - known)]
    problems += [f"{i}: {p}" for i, p in check_rules(rules, protected)]
    if problems:
        raise ValueError("; ".join(problems))
    return rules, protected


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(entry, key) of a list with one name a line, # comments, repeats by key and names of few letters left out."""

    @F.pandas_udf("string")
    def key(entries: pd.Series) -> pd.Series:
        return entries.map(entry_key)

    lines = spark.read.text(path).select(F.trim(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "#.*$", "")).alias("entry")).where("entry <> ''")
    keyed = lines.withColumn("key", key("entry")).where(F.length(F.replace("key", F.lit(" "), F.lit(""))) >= MIN_LETTERS)
    return keyed.groupBy("key").agg(F.min("entry").alias("entry")).select("entry", "key")
