"""Quality rules, language, licences, secrets, pages and vectors against brute force, accuracy and planted cases."""

import collections
import html as html_module
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.llm import embedding_dedup, html_extract, language_id, license_scan, quality_rules, secret_scan

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [None, "", "  \n", "one", "a b c d e f g h i j", "the cat sat on the mat and the dog " * 3, "x y z w v " * 40, "line one\nline one\n\nline one\nother", "### $$$ %%% &&& " * 5, "the cat is in the house of my friend and it is not on the table\n" * 2, "é " * 30 + "und die der", "word " * 30_000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)] + [(None, "the end of a text without an id is here now", "s", 0)], "doc_id long, text string, score string, n_words int").repartition(3)


# --- quality -------------------------------------------------------------------------------------------------------


def test_quality_counts(spark):
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected, i
        assert not (r.kept and r.base_failed)


def test_quality_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = con.sql(quality_rules.oracle_sql())
    df = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))
    assert df.columns == result.columns
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())


def test_clean_documents_are_kept(spark, sf):
    con = duckdb.connect()
    good = {d for (d,) in con.sql(f"SELECT doc_id FROM '{sf}/labels.parquet' WHERE quality = 1").fetchall()}
    rows = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).where("NOT base_failed").collect()
    assert sum(r.kept for r in rows if r.doc_id in good) >= 0.99 * sum(r.doc_id in good for r in rows)


def test_quality_plan_has_no_shuffle_and_no_python(spark):
    plan = quality_rules.quality_rules(frame(spark, TEXTS).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- language ------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(i, t, lang) for i in range(60) for t, lang in (("the cat is on the mat with a dog", "en"), ("die Katze ist auf der Matte mit Hund", "de"))], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "123 456 !", "en"), (None, "the dog is on the mat", "de"), (5, "die Matte ist mit Hund", None)], "doc_id long, text string, lang string")
    got = {r.row.doc_id: r for r in language_id.predict_language(docs, train).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, None, 5)] == ["und", "und", "und", "en", "de"]
    assert got[1].rejected and got[1].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    empty = docs.where("false")
    assert language_id.language_id(empty).collect() == [] and language_id.language_id(docs.where("doc_id = 1")).first().lang_pred == "und"


def test_prediction_sees_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    run = lambda df: sorted((r.row.doc_id, r.lang_pred, r.score) for r in language_id.predict_language(df, train).collect())
    assert run(docs) == run(other)


# --- licences ------------------------------------------------------------------------------------------------------


def test_licences(spark):
    texts = ["Words here. Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\nmore", "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-NC 4.0.", "licensed under CC BY 4.0", "We renewed the driving licence of a friend last summer.", None, "", "Permission is hereby granted, free of charge, to any individual obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"]
    got = collections.defaultdict(list)
    for r in license_scan.license_scan(frame(spark, texts)).collect():
        got[r.doc_id].append((r.license, r.n_different))
        assert texts[r.doc_id][r.start : r.end] == r.block
    assert dict(got) == {0: [("MIT", 0)], 1: [("Apache-2.0", 0)], 2: [("GPL-3.0", 0)], 3: [("GPL-2.0", 0)], 4: [("CC-BY-NC-4.0", 0)], 5: [("CC-BY-4.0", 0)], 9: [("MIT", 2)]}


def test_blocks_cover_long_texts():
    text = "word " * 100_000 + ". \nReleased under the MIT License.\n" + "word " * 100_000
    (a, b), = license_scan.blocks(text)
    assert text[a:b] == "Released under the MIT License."


# --- secrets -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scanned(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(40)]
    mixed = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32)) for _ in range(40)]
    texts = [f'some words token = "{h}" and more' for h in hexes] + [f"api_key: {m}\nnext" for m in mixed] + [f"the sha256 checksum {h} was fine" for h in hexes] + ["password = changeme_example_value", "secret: ${SECRET_TOKEN_VALUE}", "token = get_token_from_config()", "plain words only", "", None]
    rows = secret_scan.scan(frame(spark, texts)).collect()
    return texts, {r.doc_id: r.findings for r in rows}


def test_secrets_are_told_from_look_alikes(scanned):
    texts, found = scanned
    verdict = [any(f.secret for f in found[i]) for i in range(len(texts))]
    assert np.mean(verdict[:80]) > 0.95 and np.mean(verdict[80:]) < 0.1


def test_offsets_are_exact(scanned):
    texts, found = scanned
    for i, t in enumerate(texts):
        for f in found[i]:
            assert t[f.start : f.end] == f.value


def test_redaction(spark):
    h = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'é token = "{h}" x token = "{h}"', "nothing", None, ""]
    docs = secret_scan.scan(frame(spark, texts))
    got = {r.doc_id: r.t for r in docs.select("doc_id", secret_scan.redacted(F.col("text"), F.col("findings")).alias("t")).collect()}
    assert [got[i] for i in range(4)] == ['é token = "[SECRET]" x token = "[SECRET]"', "nothing", None, ""]


def test_scan_is_native(spark):
    plan = secret_scan.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- pages ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.Trees(spark)


def test_pages_hold_their_articles(spark, sf):
    got = {r.page_id: r for r in html_extract.extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = (re.sub(r"\s+", " ", html_module.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|article)\b[^>]*>", article))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_unseen_layouts(trees):
    page = """<html><head><title>t</title></head><body><header><a href=/>Home</a><ul class="menu"><li><a href=/a>A</a><li><a href=/b>B</a></ul></header>
    <div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div><main><article class="post"><h1>Head &amp; line</h1><p>First   paragraph,
    with <b>bold</b> text and a <a href=x>link</a> inside it.<p>Second one. It has two sentences.</p><div class="ad">Buy now!</div><ul><li>Point one</li><li>Point two</li></ul></article></main>
    <div id="comments" class="comments"><div><p>Nice article, I liked it a lot.</p></div></div><aside class="sidebar"><h3>Related</h3><ul><li><a href=1>One</a></ul></aside><footer>&copy; 2020</footer></body></html>"""
    assert html_extract.extract(page, trees) == "Head & line\nFirst paragraph, with bold text and a link inside it.\nSecond one. It has two sentences.\nPoint one\nPoint two"


def test_page_accuracy_on_other_seeds(trees):
    rng, right = random.Random(991), []
    for _ in range(120):
        nodes = html_extract.ordered(html_extract.parse(html_extract.training_page(rng)))
        kept = html_extract.decode(nodes, trees.score(html_extract.matrix(nodes)))
        right += [(id(n) in kept) == y for n, y in zip(nodes, html_extract.marks(nodes), strict=True)]
        assert all(n.parent is None or id(n) not in kept or id(n.parent) in kept for n in nodes)
    assert np.mean(right) > 0.96


SENTENCES = [
    "The harbour was quiet when the first boats came in that morning, and nobody had expected so many of them.",
    "By noon the market was full. People from the villages had brought apples, cheese and wool, and they stayed until dark.",
    "An old captain told us how the lighthouse had been built, stone by stone, over eleven winters.",
    "Nothing of this is written down, but most families know someone who was there.",
]


def neutral_page():
    """No tag and no name says what is content."""
    body = "".join(f"<p>{x}</p>" for x in SENTENCES)
    remarks = "".join(f'<div class="x8"><p>{who}, 12.03.2021 10:1{k}</p><p>{said}</p><a href="#">Reply</a></div>' for k, (who, said) in enumerate([("mara", "Lovely story."), ("tom", "I was there too."), ("ida", "Thank you for this.")]))
    return f'''<html><body><div class="x1"><a href="/">Start</a> <a href="/n">News</a> <a href="/s">Sport</a> <a href="/w">Weather</a></div>
<div class="x2"><div class="x3"><h1>Boats in the harbour</h1>{body}</div></div><div class="x7"><h3>3 Comments</h3>{remarks}</div><div class="x9">&copy; 2021 Harbour News. All rights reserved.</div></body></html>'''


def table_page():
    body = "".join(f"<p>{x}</p>" for x in SENTENCES)
    return f'''<html><body><table><tr><td><a href="/">Start</a><br><a href="/n">News</a><br><a href="/s">Sport</a><br><a href="/w">Weather</a></td>
<td><h1>Boats in the harbour</h1>{body}</td></tr><tr><td colspan=2>Copyright &copy; 2021 Harbour News</td></tr></table></body></html>'''


def list_page():
    """A list of links of a kind that the generator does not make, and comments as a list."""
    body = "".join(f"<p>{x}</p>" for x in SENTENCES)
    return f'''<html><body><div id="q0"><dl><dt><a href=1>Start</a></dt><dd><a href=2>News</a></dd><dt><a href=3>Sport</a></dt><dd><a href=4>Weather</a></dd></dl></div>
<div id="q1"><h1>Boats in the harbour</h1>{body}</div><div id="q2"><h4>Kommentare</h4><ol><li><b>mara</b> schrieb am 12.03.2021: <p>Sehr schön.</p></li><li><b>tom</b> schrieb am 13.03.2021: <p>Ich war da.</p></li></ol></div>
<div id="q3"><p>© Harbour News | Impressum | Datenschutz</p></div></body></html>'''


@pytest.mark.parametrize("page", [neutral_page(), table_page(), list_page()], ids=["neutral", "table", "list"])
def test_pages_whose_names_say_nothing(trees, page):
    assert html_extract.extract(page, trees).split("\n") == ["Boats in the harbour", *SENTENCES]


@pytest.mark.parametrize("unit", ["<a ", "<a \">\" ", "<![CDATA[", "<a<a", "<", "<!-", "</x>", "<a href='", "&amp;<b"])
def test_malformed_pages_take_time_in_proportion(unit):
    began = time.perf_counter()
    for page in (unit * (1_000_000 // len(unit)), unit * (1_000_000 // len(unit)) + ">", unit * (1_000_000 // len(unit)) + "\">"):
        html_extract.parse(page)
    assert time.perf_counter() - began < 6


def test_deep_and_unclosed_pages(trees):
    began = time.perf_counter()
    assert html_extract.extract("<div>" * 20_000 + "deep" + "</x>" * 20_000, trees) in ("", "deep")
    assert html_extract.extract("<p>one two" * 20_000, trees).count("\n") < 20_000
    assert time.perf_counter() - began < 30


def naive_text(page, keep):
    """Text of the wanted elements of well-formed markup, by regular expressions."""
    found = re.findall("|".join(f"<{t}>(.*?)</{t}>" for t in keep), page, re.S)
    blocks = (re.sub(r"\s+", " ", html_module.unescape(re.sub("<[^>]*>", "", "".join(x)))).strip() for x in found)
    return "\n".join(b for b in blocks if b)


def test_text_equals_a_plain_reading(trees):
    """Character references, white space and inline markup of the kept blocks, against a reading by regular expressions."""
    rng = random.Random(17)
    for _ in range(40):
        parts = ["".join(rng.choice(["word ", "&eacute;t&eacute; ", "<b>bold</b>", "<a href=x>link</a> ", "\n\t ", "&nbsp;x&#160;", "5 &lt; 6 ", "a.", "<i>it</i>alic "]) for _ in range(rng.randint(6, 30))) for _ in range(rng.randint(2, 6))]
        page = f"<html><body><nav><ul><li><a href=1>Home</a></li></ul></nav><article><h1>A head line for it</h1>{''.join(f'<p>A sentence, and more of it. {x}</p>' for x in parts)}</article><footer>&copy; x</footer></body></html>"
        assert html_extract.extract(page, trees) == naive_text(page, ["h1", "p"])


def test_clashing_columns_and_ties(spark, trees):
    rows = spark.createDataFrame([(1, "u", neutral_page(), "a", 5, "t")] * 2, "page_id long, url string, html string, text string, n_chars int, tag string")
    got = html_extract.extract_pages(rows).collect()
    assert got[0] == got[1] and got[0].n_chars == len(got[0].text) > 0


def test_page_edge_cases(spark, trees):
    assert [html_extract.extract(x, trees) for x in (None, "", "<", "<script>var x='<p>no</p>'", "<!-- open")] == ["", "", "<", "", ""]
    rows = spark.createDataFrame([(1, None, None, 3), (None, "u", "", 3), (3, "u", "<p>" * 3000 + "deep", 3)], "page_id long, url string, html string, text int")
    got = html_extract.extract_pages(rows).collect()
    assert len(got) == 3 and html_extract.extract_pages(rows.where("false")).collect() == []


# --- vectors -------------------------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.93):
    links = collections.Counter()
    ok = [(i, np.array(v, float), label) for i, (_, v, label) in enumerate(rows) if rows[i][0] is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for a in range(len(ok)):
        for b in range(a):
            (i, x, p), (j, y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
    return links


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for _ in range(60):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 7)):
            rows.append((n, (base + rng.normal(size=24) * rng.choice([0, 0.02, 0.1, 0.6])).tolist(), int(n % 3 == 0)))
            n += 1
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, None, 1), (n + 2, [0.0] * 24, 1), (n + 3, [1.0, None] * 12, 1), (n + 4, [float("nan")] * 24, 1), (n + 5, [1.0] * 8, 1), (n + 6, [2.0] * 8, 1), (n + 7, [1.0] * 24, None), (None, [1.0] * 24, 1), (n + 8, [], 0)]
    df = spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "vec_id long, embedding array<double>, label int, rep int").repartition(3)
    got = embedding_dedup.near_vectors(df).collect()
    assert len(got) == len(rows)
    links = brute_links(rows)
    found = {r.vec_id: r.n_links for r in got if r.vec_id is not None}
    expected = {d: links[i] for i, (d, _, _) in enumerate(rows) if d is not None}
    assert all(found[d] <= n for d, n in expected.items())
    assert sum(found.values()) >= 0.99 * sum(expected.values())
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
