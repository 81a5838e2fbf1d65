"""One file as the work of many tasks: the rows of ranges against the rows of the whole file."""

import random

import pytest
from pyspark.sql import functions as F

from gleanworks.sources import delivery, ranges

VOCABULARIES = {"text": [("one", ["UID", "HERGANG"])], "unfall": [("a", ["UnfallUid", "KantonAusw", "Datum"])]}
KEYS = {"text": "UID", "unfall": "UnfallUid"}


def content(rng, n, end, delimiter=";", broken=True):
    """Rows with quoted line ends, doubled quotes, delimiters in quotes, blank lines, and rows that the parser refuses."""
    out = [f"UID{delimiter}HERGANG{end}"]
    for k in range(n):
        kind = rng.randrange(9 if broken else 6)
        text = "".join(rng.choice(["a", "Zürich ", "€", "日", "ß ", "x" * 30, " "]) for _ in range(rng.randrange(9)))
        inner = text + rng.choice(["", '""', delimiter, "\n", "\r\n", "\r", '"";""', '"" \n', "\n\n"]) + text
        out.append(f"{k:032x}{delimiter}" + {0: text, 1: f'"{inner}"', 2: f'"{inner}"', 3: 'in "quotes" here', 4: f'"{text}"{delimiter}""', 5: "", 6: f'"{inner}"junk{delimiter}"x', 7: f'"a{end}b" {text}', 8: f'{text}"'}[kind] + rng.choice([end, end, end + end]))
    return "".join(out)


def write(tmp_path, files):
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def both(spark, folder, size, overrides=None):
    """(files, rows) by ranges of about ``size`` bytes, and of whole files."""
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        d = ranges.Delivery(spark, folder, VOCABULARIES, KEYS, overrides)
        got = sorted(map(tuple, d.files.collect()), key=repr), sorted(map(tuple, d.rows(chunk=5).collect()), key=repr), d
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    whole = delivery.scan_bytes(spark, folder)
    expected = (sorted(map(tuple, x.collect()), key=repr) for x in (delivery.analyse_files(whole, VOCABULARIES, KEYS, overrides), delivery.raw_rows(whole, VOCABULARIES, KEYS, overrides)))
    return got, tuple(expected)


@pytest.mark.parametrize(("size", "n"), [(23, 4), (61, 12), (151, 30), (700, 150)])
def test_ranges_give_the_rows_of_whole_files(spark, tmp_path, size, n):
    """Some 30 ranges of each file, which end anywhere: within line ends, quotes, characters."""
    rng = random.Random(size)
    files = {}
    for k, (end, encoding) in enumerate([("\r\n", "utf-8"), ("\n", "utf-8"), ("\n", "cp1252"), ("\r", "utf-8"), ("\r\n", "utf-8-sig")]):
        text = content(rng, n, end, rng.choice(";|,\t"))
        files[f"{k}.csv"] = text.replace("日", "").encode(encoding) if encoding == "cp1252" else text.encode(encoding)
    files["open.csv"] = files["0.csv"] + b'x;"never closed\r\nz\r\n' * 3
    files["no-end.csv"] = files["1.csv"].rstrip() + b"\nlast;line"
    got, expected = both(spark, write(tmp_path, files), size)
    assert got[0] == expected[0]
    assert got[1] == expected[1] and len(got[1]) > 5 * n
    assert sum(len(f.ranges) for f in got[2]._files.values()) > 30


def test_states_at_two_hundred_cuts():
    """Where the lines before a cut lead is where the parser of the whole text stands: at a row's start, or in a field."""
    rng, cuts = random.Random(9), 0
    while cuts < 200:
        d = rng.choice(";|,\t")
        text = content(rng, 25, rng.choice(["\n", "\r\n"]), d)
        lines = delivery.physical_lines(text)
        starts = {line for line, *_ in delivery.read_rows(text, d)}
        ends = [0, *sorted(rng.sample([k for k, x in enumerate(lines) if k and lines[k - 1].endswith("\n")], 6)), len(lines)]
        is_open = False
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            assert is_open == (a + 1 not in starts)
            data = "".join(lines[a:b]).encode()
            was, (is_open, first, *_) = is_open, ranges.Quoting(d).lead(data, is_open)
            begins = [k for k in range(a + 1, b + 1) if k in starts]
            assert (first in (-1, len(data))) == (not begins) if was else first == 0
            if begins:
                assert data[:first].decode() == "".join(lines[a : begins[0] - 1])
            cuts += 1


def test_refused_and_odd_files(spark, tmp_path):
    rng = random.Random(1)
    text = content(rng, 40, "\n")
    plain, cp = text.encode(), text.replace("日", "").encode("cp1252")
    files = {
        "nul.csv": plain + b"a\x00b\n", "wide.csv": b"\xff\xfe" + plain, "wider.csv": b"\x00\x00\xfe\xff" + plain, "bad.csv": cp + b"\x9d\n" + cp, "empty.csv": b"", "mark.csv": b"\xef\xbb\xbf", "marked-nul.csv": b"\xef\xbb\xbfUID;x\n\x00",
        "mixed.csv": cp + "Zürich\n".encode() + cp, "blank.csv": b"\n\n\nUID;HERGANG\n1;2\n", "one.csv": b"UID;HERGANG", "quote.csv": b'"UID;HERGANG\n' * 30, "head.csv": b'"x"y\n' * 7 + b"UID;HERGANG\n1;2\n",
        "late.csv": b'"x"y\n' * 300 + b"UID;HERGANG\n1;2\n3;4\n",
    }
    got, expected = both(spark, write(tmp_path, files), 90)
    names = [f.split()[0] for f in delivery.FILES.split(", ")]
    shown = lambda rows: {r[0].rsplit("/", 1)[-1]: dict(zip(names, r, strict=True)) for r in rows}
    a, b = shown(got[0]), shown(expected[0])
    late = a.pop("late.csv"), b.pop("late.csv")
    assert a == b and late[0]["delimiter"] == late[1]["delimiter"]
    assert got[1] == expected[1]


def test_fields_beyond_the_limit(spark, tmp_path):
    """The parser gives up inside a long field and goes on with the next line, wherever that is."""
    long = "UID;HERGANG\n1;2\n" + 'k;"' + "a b c d e f\n" * 14_000 + 'end"\nx;y\n' + 'k;"' + "a" * 140_000 + '"\nz;w\n'
    got, expected = both(spark, write(tmp_path, {"long.csv": long.encode(), "short.csv": b'UID;HERGANG\na;"b\nc"\n' * 50}), 4000)
    assert got == (*expected, got[2]) and {p.rsplit("/")[-1]: f.serial for p, f in got[2]._files.items()} == {"long.csv": True, "short.csv": False}


def test_overrides(spark, tmp_path):
    folder = write(tmp_path, {"a.csv": content(random.Random(2), 30, "\n").replace("日", "").encode("cp1252"), "b.csv": b"UID|HERGANG\n1|2;3\n"})
    overrides = {f"file:{folder}/a.csv": {"encoding": "latin-1"}, f"file:{folder}/b.csv": {"delimiter": ";", "kind": "text"}}
    got, expected = both(spark, folder, 64, overrides)
    assert got[:2] == expected
    with pytest.raises(ValueError, match="read whole"):
        ranges.Delivery(spark, folder, VOCABULARIES, KEYS, {"x": {"encoding": "utf-16"}})


def test_a_large_file_is_the_work_of_many_tasks(spark, tmp_path):
    """Some 18 MB in ranges of a megabyte, each parsed by a task of its own."""
    block = content(random.Random(3), 3000, "\r\n", broken=False).partition("\r\n")[2]
    (tmp_path / "large.csv").write_bytes(("UID;HERGANG\r\n" + block * 90).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        d = ranges.Delivery(spark, str(tmp_path), VOCABULARIES, KEYS)
        rows = d.rows()
        n_ranges = len(next(iter(d._files.values())).ranges)
        per_task = rows.groupBy(F.spark_partition_id()).count().collect()
        expected = len(list(delivery.read_rows("UID;HERGANG\r\n" + block, ";"))) - 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert n_ranges >= 15 and len(per_task) >= 15
    assert sum(r["count"] for r in per_task) == 90 * expected


def test_another_cut_is_refused(spark, tmp_path):
    """Rows are never lost to settings that changed after the analysis."""
    (tmp_path / "a.csv").write_text("UID;HERGANG\n" + 'k;"a\nb"\n' * 300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = ranges.Delivery(spark, str(tmp_path), VOCABULARIES, KEYS).rows()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        with pytest.raises(Exception, match="cut elsewhere"):
            rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
