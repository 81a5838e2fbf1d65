"""Deliveries and exports as formats of Spark."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gleanworks.sources import delivery, exports, formats

VOCABULARIES = {"text": [("one", ["UID", "HERGANG"])], "unfall": [("a", ["UnfallUid", "KantonAusw", "Datum"])]}
KEYS = {"text": "UID", "unfall": "UnfallUid"}
ROWS = [("#A", "blocking", "1", "", ""), ("B", "x;y", "", "", 'say "no"'), ("code", "severity", "key", "line_no", "detail"), ("# internal", "", "", "", "a\r\n# b"), ("Zürich", "", "", "", "")]
SCHEMA = "code string, severity string, key string, line_no string, detail string"


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def files_below(folder):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs)


def test_deliveries(known, tmp_path):
    texts = {"a.csv": 'UID;HERGANG\r\n1;"two\r\nlines"\r\n2;x\r\n', "b.csv": "UnfallUid|KantonAusw|Datum\n7|ZH|x\n", "c.csv": "foo;bar\n1;2\n", "wide.csv": "\x00", "none.csv": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    read = known.read.format("gleanworks_delivery").option("vocabularies", json.dumps(VOCABULARIES)).option("keys", json.dumps(KEYS))
    rows = read.load(str(tmp_path))
    plain = lambda df: sorted((r.path.rsplit("/", 1)[-1], *r[1:]) for r in df.collect())
    assert plain(rows) == plain(delivery.raw_rows(delivery.scan_bytes(known, str(tmp_path)), VOCABULARIES, KEYS))
    assert [r.fields for r in rows.where("kind = 'unfall'").collect()] == [["7", "ZH", "x"]]


def test_files_of_other_kinds_are_not_read(known, tmp_path):
    (tmp_path / "a.csv").write_text("UID;HERGANG\n1;2\n")
    (tmp_path / "b.csv").write_text("UnfallUid|KantonAusw|Datum\n7|ZH|x\n")
    reader = formats.DeliveryReader({"path": str(tmp_path), "vocabularies": json.dumps(VOCABULARIES)})
    list(reader.pushFilters([formats.EqualTo(("kind",), "text")]))
    assert [p.path.rsplit("/", 1)[-1] for p in reader.partitions()] == ["a.csv"]
    plan = known.read.format("gleanworks_delivery").option("vocabularies", json.dumps(VOCABULARIES)).load(str(tmp_path)).where("kind = 'text'")
    assert plan.count() == 1 and plan.rdd.getNumPartitions() == 1


def test_exports_round_trip(known, tmp_path):
    df = known.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = f"{tmp_path}/findings"
    df.write.format("gleanworks_export").option("kind", "findings").option("classification", "secret").option("context", "corpus x; y").mode("append").save(path)
    back = known.read.format("gleanworks_export").option("kind", "findings").load(path)
    assert back.columns == exports.HEADERS["findings"] and sorted(map(tuple, back.collect())) == sorted(ROWS)
    assert all("_writing" not in f for f in files_below(tmp_path))
    whole = b"".join(open(f, "rb").read() for f in files_below(path))
    assert whole.startswith("﻿# secret\r\n# corpus x; y\r\ncode;severity;key;line_no;detail\r\n".encode())
    # one file that a person made of the parts is read alike, and so is an export of the other writer
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "all.csv").write_bytes(whole)
    exports.export("findings", df, f"{tmp_path}/other", "internal", "z")
    for other in ("one", "other"):
        assert sorted(map(tuple, known.read.format("gleanworks_export").option("kind", "findings").load(f"{tmp_path}/{other}").collect())) == sorted(ROWS)


def test_exports_of_all_kinds(known, tmp_path):
    df = known.createDataFrame(ROWS, SCHEMA)
    scores = known.createDataFrame([("f", "*", "f1", "0.5", "20", "", "")], ", ".join(f"{c} string" for c in exports.HEADERS["run_scores"]))
    for kind, rows in (("findings", df), ("run_scores", scores)):
        rows.write.format("gleanworks_export").option("kind", kind).mode("overwrite").save(f"{tmp_path}/{kind}")
    every = known.read.format("gleanworks_export").load(str(tmp_path))
    assert {r.kind: r.n for r in every.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"findings": 5, "run_scores": 1}
    assert [r.v for r in every.where("kind = 'run_scores'").select(F.col("values")["metric"].alias("v")).collect()] == ["f1"]


def test_a_failed_write_leaves_nothing(known, tmp_path):
    path = f"{tmp_path}/findings"
    write = lambda df, mode="append": df.write.format("gleanworks_export").option("kind", "findings").mode(mode).save(path)
    good = known.createDataFrame(ROWS, SCHEMA)
    bad = known.range(40).repartition(4).select(F.when(F.col("id") == 17, F.raise_error(F.lit("no"))).otherwise("x").cast("string").alias("code"), *(F.lit("").alias(c) for c in exports.HEADERS["findings"][1:]))
    with pytest.raises(Exception, match="no"):
        write(bad)
    assert files_below(tmp_path) == []
    write(good)
    before = files_below(tmp_path)
    with pytest.raises(Exception, match="no"):
        write(bad, "overwrite")
    with pytest.raises(Exception, match="already"):
        write(good)
    assert files_below(tmp_path) == before
    write(good.limit(2), "overwrite")
    assert known.read.format("gleanworks_export").option("kind", "findings").load(path).count() == 2
    with pytest.raises(Exception, match="has the columns"):
        write(good.select("code"))
