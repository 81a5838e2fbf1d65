"""Derived ground truth: row filters with two-valued logic and the seven aggregates of a record's child rows.

``records`` gives every record a value, also without child rows; children are aggregated before they meet records.
"""

from __future__ import annotations

import functools
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_empty

OPERATORS = ("eq", "ne", "in", "not_in", "is_empty", "is_not_empty")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: str | tuple[str, ...] | None = None


def row_filter(rule: Filter, columns: list[str]) -> Column:
    """True or false, never null; a column that is missing or null satisfies is_empty alone."""
    if rule.operator not in OPERATORS:
        raise ValueError(f"unknown operator {rule.operator!r}")
    c = F.col(rule.column).cast("string") if rule.column in columns else F.lit(None).cast("string")
    many = rule.value if isinstance(rule.value, tuple) else () if rule.value is None else (rule.value,)
    test = {
        "is_empty": lambda: is_empty(c),
        "is_not_empty": lambda: ~is_empty(c),
        "eq": lambda: c == F.lit(rule.value),
        "ne": lambda: c != F.lit(rule.value),
        "in": lambda: c.isin(*many),
        "not_in": lambda: c.isNotNull() & ~c.isin(*many),
    }[rule.operator]()
    return F.coalesce(test, F.lit(False))


def _attach(records: DataFrame, per: DataFrame, key: str, value: Column) -> DataFrame:
    return records.select(key).join(per, key, "left").select(key, value.alias("value"))


def derive_count(records: DataFrame, children: DataFrame, key: str, rule: Filter | None = None) -> DataFrame:
    """Matching child rows as text; a record without any has "0"."""
    rows = children.where(row_filter(rule, children.columns)) if rule else children
    return _attach(records, rows.groupBy(key).agg(F.count("*").alias("n")), key, F.coalesce("n", F.lit(0)).cast("string"))


def derive_any(records: DataFrame, children: DataFrame, key: str, rule: Filter) -> DataFrame:
    """"true" where a child row matches, else "false"."""
    hit = children.where(row_filter(rule, children.columns)).select(key).distinct().withColumn("hit", F.lit("true"))
    return _attach(records, hit, key, F.coalesce("hit", F.lit("false")))


def derive_ordinal(records: DataFrame, children: DataFrame, key: str, column: str, order: list[str], highest: bool = True) -> DataFrame:
    """The extreme code by the declared order; null without one. A code that was not declared raises."""
    c = F.col(column).cast("string")
    place = {code: i for i, code in reversed(list(enumerate(order)))}
    position = F.create_map(*(F.lit(x) for pair in place.items() for x in pair))[c]
    checked = F.when(position.isNotNull(), position).otherwise(F.raise_error(F.concat(F.lit(f"code absent from the declared order of {column}: "), c)).cast("int"))
    per = children.where(~is_empty(c)).groupBy(key).agg((F.max if highest else F.min)(checked).alias("p"))
    return _attach(records, per, key, F.get(F.array(*map(F.lit, order)), F.col("p")))


def derive_distinct(records: DataFrame, children: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct non-blank values as text."""
    per = children.where(~is_empty(F.col(column).cast("string"))).groupBy(key).agg(F.countDistinct(column).alias("n"))
    return _attach(records, per, key, F.coalesce("n", F.lit(0)).cast("string"))


def ground_truth(parts: dict[str, DataFrame]) -> DataFrame:
    """(feature_id, record_id, record_value) of all features from tables (record_id, value); empties stay."""
    tables = [df.select(F.lit(f).alias("feature_id"), F.col(df.columns[0]).alias("record_id"), F.col("value").cast("string").alias("record_value")) for f, df in sorted(parts.items())]
    return functools.reduce(DataFrame.unionByName, tables)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


#: The seven derivations and the fields of each.
DERIVATIONS = {
    "count_objects": ("filter",), "count_persons": ("filter",), "any_object_matches": ("filter",), "any_person_matches": ("filter",),
    "max_ordinal": ("table", "column", "ordered_codes"), "min_ordinal": ("table", "column", "ordered_codes"), "distinct_count": ("table", "column"),
}


@dataclass(frozen=True)
class Derivation:
    """One of the seven: which, with its filter, or its table, column and declared order."""

    type: str
    filter: Filter | None = None
    table: str | None = None
    column: str | None = None
    ordered_codes: tuple[str, ...] = ()

    def problems(self) -> list[str]:
        """What makes it unusable; none for a sound one."""
        if self.type not in DERIVATIONS:
            return [f"unknown derivation {self.type!r}"]
        fields, out = DERIVATIONS[self.type], []
        if self.type.startswith("any_") and self.filter is None:
            out.append("a filter is needed")
        if self.filter is not None and self.filter.operator not in OPERATORS:
            out.append(f"unknown operator {self.filter.operator!r}")
        if self.filter is not None and self.filter.operator in ("in", "not_in") and not isinstance(self.filter.value, tuple):
            out.append(f"{self.filter.operator} needs a list of values")
        if "column" in fields and not self.column:
            out.append("a column is needed")
        if "table" in fields and self.table not in ("objekt", "person"):
            out.append(f"unknown table {self.table!r}")
        if "ordered_codes" in fields and not self.ordered_codes:
            out.append("an order of codes is needed")
        if len(set(self.ordered_codes)) < len(self.ordered_codes):
            out.append("a code is declared twice")
        return out

    def to_json(self) -> str:
        """The canonical form, from which ``derivation_from_json`` gives the same derivation."""
        rule = None if self.filter is None else {"column": self.filter.column, "operator": self.filter.operator, "value": self.filter.value}
        every = {"filter": rule, "table": self.table, "column": self.column, "ordered_codes": self.ordered_codes}
        return canonical_json({"type": self.type, **{f: every[f] for f in DERIVATIONS[self.type]}})


def derivation_from_json(text: str) -> Derivation:
    """The derivation of a catalogue entry; an entry that is none, or lacks a field, raises ValueError."""
    data = json.loads(text)
    if not isinstance(data, dict) or data.get("type") not in DERIVATIONS:
        raise ValueError(f"no derivation: {text}")
    fields = DERIVATIONS[data["type"]]
    missing = [f for f in fields if f not in data]
    if missing:
        raise ValueError(f"{data['type']} lacks {', '.join(missing)}")
    rule = data["filter"] if "filter" in fields else None
    if rule is not None:
        value = rule["value"]
        rule = Filter(str(rule["column"]), str(rule["operator"]), tuple(map(str, value)) if isinstance(value, list) else None if value is None else str(value))
    found = Derivation(data["type"], rule, *(str(data[f]) if f in fields else None for f in ("table", "column")), tuple(map(str, data["ordered_codes"])) if "ordered_codes" in fields else ())
    if found.problems():
        raise ValueError("; ".join(found.problems()))
    return found


def derive(spec: Derivation, records: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """(key, value) by a derivation of the catalogue over the child rows that it is about."""
    kind = spec.type
    if kind.startswith("count_"):
        return derive_count(records, children, key, spec.filter)
    if kind.startswith("any_"):
        return derive_any(records, children, key, spec.filter)
    if kind == "distinct_count":
        return derive_distinct(records, children, key, spec.column)
    return derive_ordinal(records, children, key, spec.column, list(spec.ordered_codes), kind == "max_ordinal")


def feature_fingerprint(feature: dict) -> str:
    """sha256 over a feature's eight defining fields; fields that do not change scoring are left out."""
    fields = ("kind", "grain", "source_column", "derivation_json", "value_type", "matching_rule_json", "enum_codelist_json", "description")
    return hashlib.sha256(json.dumps({f: feature.get(f) for f in fields}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def set_fingerprint(features: DataFrame, by: str, fingerprint: str) -> DataFrame:
    """Per group the sha256 of its sorted fingerprints, repeats kept, one a line."""
    return features.groupBy(by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(fingerprint)), "\n"), 256).alias("set_fingerprint"))


def validate_features(features: list[dict], exploratory_cap: int = 20) -> list[tuple[str, str]]:
    """(feature key, problem): labelled features need a scalar grain, coded ones a code list, and only so many explore."""
    out, exploring = [], 0
    for f in features:
        if f["kind"] == "labelled" and f.get("grain", "record") != "record":
            out.append((f["key"], "labelled feature at a grain without one value a record"))
        if f["value_type"] == "enum" and not f.get("codelist"):
            out.append((f["key"], "coded feature without a code list"))
        if f["kind"] == "exploratory":
            exploring += 1
            if exploring > exploratory_cap:
                out.append((f["key"], f"more than {exploratory_cap} exploratory features"))
    return out
