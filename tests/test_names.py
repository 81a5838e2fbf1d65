"""Lists of names: the automaton against dictionaries of whole names, the file, the filter before Python, and speed."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gleanworks.operators import names, scrub
from gleanworks.plans.texts import long_lists

FIRST = ("Martin", "Anna", "Jean-Luc", "Zoë", "Mary Ann", "Özgür", "Groß", "Ab", "Élise")
LAST = ("Simon", "Martin", "Müller", "Nord", "von der Au", "von", "De la Cruz", "Groß", "Nuñez", "Meyer", "Meyer Nord", "Özgür", "Zürcher", "Zurcher", "Zuercher", "Ïle")
WHITE = ("Nord", "von", "Anna Martin", "Meyer")


def plain_lists(entries):
    out = {}
    for e in entries:
        spelt = [names.spellings(t) for t in names.TOKEN.findall(e)]
        if sum(len(a) for a, _ in spelt) >= names.MIN_LETTERS:
            key = " ".join(b for _, b in spelt)
            out.setdefault(" ".join(a for a, _ in spelt), key)
            out.setdefault(key, key)
    return out


def plain_matches(text, lists):
    """Every window of every width looked up in dictionaries, the widest first."""
    first, last, white = lists
    tokens = [(m.start(), m.end(), *names.spellings(m[0])) for m in names.TOKEN.finditer(text)]
    found, i = [], 0
    while i < len(tokens):
        for n in range(len(tokens) - i, 0, -1):
            window = tokens[i : i + n]
            forms = [" ".join(t[k] for t in window) for k in (3, 2)]
            look = lambda d: next((d[f] for f in forms if f in d), None)
            glued = all(names.JOIN.fullmatch(text[a[1] : b[0]]) for a, b in zip(window[:-1], window[1:], strict=True))
            if glued and (look(first) or look(last)) and not (look(white) and not names.is_addressed(text, window[0][0])):
                found.append(names.Match(i, n, look(first), look(last)))
                i += n
                break
        else:
            i += 1
    return found


def texts(n, seed=3):
    rng = random.Random(seed)
    words = [w for e in FIRST + LAST for w in e.split()] + ["MUELLER", "Muller", "nunez", "Zürcher", "ÉLISE", "gross", "Grosz", "Herr", "(frau", "Mme.", "x.herr", "und", "Haus", "Ab", "日本", "ﬁn", "42"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", "-", "'", ", ", "  \n", "    ", ". "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_matches_equal_dictionaries():
    index, lists = names.NameIndex.build(FIRST, LAST, WHITE), [plain_lists(x) for x in (FIRST, LAST, WHITE)]
    met = 0
    for text in texts(1500):
        found = index.matches(text)[0]
        assert found == plain_matches(text, lists), text
        met += len(found)
    assert met > 3000


def test_the_file_gives_the_same(tmp_path):
    index = names.NameIndex.build(FIRST, LAST, WHITE)
    (tmp_path / "lists").write_bytes(index.to_bytes())
    opened = names.NameIndex.open(str(tmp_path / "lists"))
    assert all(opened.matches(t) == index.matches(t) for t in texts(200)) and opened.first_tokens() == index.first_tokens()
    (tmp_path / "none").write_bytes(names.NameIndex.build((), ("ab", "", "1 2"), ()).to_bytes())
    assert names.NameIndex.open(str(tmp_path / "none")).longest == 0


@pytest.mark.parametrize(("before", "after", "tags"), [
    ("Martin", "Simon", ["Firstname", "Lastname"]), ("Martin", ", Simon", ["Name", "Lastname"]), ("Martin", "Martin", ["Firstname", "Lastname"]), ("Anna", "Martin", ["Firstname", "Lastname"]),
    ("Martin Simon und", "Martin", ["Firstname", "Lastname", "Firstname"]), ("Martin und", "Martin Simon", ["Name", "Firstname", "Lastname"]), ("Groß", "und Groß", ["Name", "Name"]),
])
def test_tags(before, after, tags):
    s = scrub.Scrubber(scrub.Rules(firstnames=FIRST, lastnames=LAST))
    assert [h["tag"] for h in s.scrub(f"{before} {after}")[1]] == tags


@pytest.mark.parametrize(("text", "addressed"), [("Herr Nord", True), ("herr\n Nord", True), ("(Mme. Nord", True), ("Oberherr Nord", False), ("x.m. Nord", False), ("Herr, Nord", False), ("Herr" + " " * 21 + "Nord", False), ("Herr" + " " * 20 + "Nord", True), ("Nord", False), ("sig.ra Nord", True)])
def test_honorifics(text, addressed):
    assert names.is_addressed(text, text.index("Nord")) is addressed


def test_the_filter_loses_no_text(spark):
    rules = scrub.Rules(firstnames=FIRST, lastnames=LAST, whitelist=WHITE)
    s = scrub.Scrubber(rules)
    rows = [*texts(600), "", None, "nothing to see", "079 123 45 67", "SG 123", "a@b.ch", "Haus und Hof " * 5000, "Müller " * 3000, "̈Anna", "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, text string").repartition(3)
    got = {r.k: r for r in df.select("k", scrub.scrubbed(spark, "text", rules).alias("s"), scrub.may_match(F.col("text"), rules, rules.index()).alias("suspect")).collect()}
    for k, text in enumerate(rows):
        masked, hits = s.scrub(text) if text is not None else (None, None)
        assert got[k].s.text == masked and (got[k].s.hits is None if text is None else [h.asDict() for h in got[k].s.hits] == hits)
    assert [got[k].suspect for k in range(600, 610)] == [False, None, False, True, True, True, False, True, True, False]


def test_the_filter_is_below_python(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(scrub.scrubbed(spark, "t", scrub.Rules(lastnames=LAST)).alias("s"))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert plan.count("ArrowEvalPython") == 1 and any("exists(" in x for x in lines[next(k for k, x in enumerate(lines) if "ArrowEvalPython" in x) :])


def test_lists_of_seventy_thousand_names(spark, sf):
    """Some 0.3 s for a million characters on an idle core, words that were not met before included; a busy one gets more."""
    rules = long_lists()
    assert len(set(rules.firstnames)) == 20_000 and len(set(rules.lastnames)) == 50_000
    index = rules.index()
    assert len(index.to_bytes()) < 16_000_000
    s = scrub.Scrubber(rules, index)
    rows = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    began = time.process_time()
    for t in rows:
        s.scrub(t)
    assert (time.process_time() - began) / sum(map(len, rows)) * 1e6 < 1.5
