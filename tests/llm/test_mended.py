"""Cases that earlier versions of the operators got wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.llm import embedding_dedup, html_extract, language_id, secret_scan


def test_open_comments_take_the_rest_and_no_more(spark, sf):
    """An unclosed comment after every kind of content: the text up to it stays, and nothing of the page comes back."""
    trees = html_extract.Trees(spark)
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    for k, page in enumerate(pages):
        whole = html_extract.extract(page, trees)
        assert html_extract.extract(page + "<!-- end", trees) == whole
        assert html_extract.extract(page + "<!-- a > b", trees) == whole
        if k < 40:
            for at in range(0, len(page), max(1, len(page) // 10)):
                cut = page[: page.rfind(">", 0, at) + 1]
                found = html_extract.extract(cut + "<!-- <p>hidden words</p>", trees)
                assert found == html_extract.extract(cut, trees) and "hidden words" not in found


def test_letters_are_letters(spark):
    docs = spark.createDataFrame([(k, t, "de") for k, t in enumerate(["the text to learn from here"] * 30 + ["½", "²", "Ⅷ 12", "x"])], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id.language_id(docs).collect()}
    assert [found[k] for k in range(30, 34)] == ["und", "und", "und", "de"]


def test_quoted_values_of_any_length(spark):
    long = 'a1\\"B' * 20_000 + "Zx9"
    texts = [f'password = "{long}" then', "k='it\\'s' secret: 'a\\'b9!Qz' y", 'x \\"password\\": \\"hunter22\\"', " password = \"hunter22\""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(c.start, c.end, c.value, c.secret) for c in r.findings] for r in secret_scan.scan(docs).collect()}
    assert found[0][0][2] == long and texts[0][found[0][0][0] : found[0][0][1]] == long
    assert [c[2] for c in found[1]] == ["a\\'b9!Qz"] and [c[2] for c in found[3]] == ["hunter22"]
    masked = {r.doc_id: r.t for r in secret_scan.scan(docs).select("doc_id", secret_scan.redacted(F.col("text"), F.col("findings")).alias("t")).collect()}
    assert masked[1] == "k='it\\'s' secret: '[SECRET]' y"


def test_empty_tables_and_clashing_columns_of_secrets(spark):
    none = spark.createDataFrame([], "doc_id long, text string, findings string, score int")
    assert secret_scan.secret_findings(none).collect() == []
    docs = spark.createDataFrame([(None, "password = 'hunter22!x'", "f", 1)] * 2 + [(1, None, "f", 1)], "doc_id long, text string, findings string, score int")
    assert [(r.doc_id, r.n_chars) for r in secret_scan.secret_findings(docs).collect()] == [(None, 10)] * 2


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-324, 1e308])
def test_vectors_of_extreme_components(spark, size):
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(rng.normal(size=(40, 6)))]
    big = [[size, 0.0, size, 0.0, 0.0, 0.0], [size, 0.0, size, 0.0, 0.0, size * 1e-3], [0.0, size, 0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]]
    rows += [(100 + k, v, 1) for k, v in enumerate(big)] + [(200, [size, 1.0], 1), (201, [size, 1.0], 1), (202, [], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows) and got[100] == got[101] == got[103] == (2, 100) and got[102][1] == 102 and got[200] == got[201] == (1, 200) and got[202] == (0, 202)
