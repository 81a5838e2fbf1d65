"""Secrets in addresses, headers, key blocks, quotes and short values, and what only looks like them."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from gleanworks.llm import secret_scan

RNG = random.Random(12)
KEY = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(base64.b64encode(RNG.randbytes(48)).decode() for _ in range(12)) + "\nqQ==\n-----END RSA PRIVATE KEY-----"
#: Text and the secret in it, all of which goes.
SECRETS = [
    ("postgres://admin:S3cr3tPass9@host/db", "S3cr3tPass9"),
    ("Authorization: Basic dXNlcjpwYXNzMTIz", "dXNlcjpwYXNzMTIz"),
    ("Authorization: Bearer 9fA3kd82LmQ0xZ7", "9fA3kd82LmQ0xZ7"),
    ("curl -H 'x: Bearer 9fA3kd82LmQ0xZ7'", "9fA3kd82LmQ0xZ7"),
    ('password = "hunter2"', "hunter2"),
    ("pwd=tiger77", "tiger77"),
    ('password        =        "Kd82LmQ0xZ7w"', "Kd82LmQ0xZ7w"),
    ('password = "aB3,x;9Kq2"', "aB3,x;9Kq2"),
    ('secret: token = "Kd82LmQ0xZ7wKd82"', "Kd82LmQ0xZ7wKd82"),
    (f"key:\n{KEY}\nend", KEY),
    (f'private_key = "{KEY}"', KEY),
]
OTHERS = ["the basic understanding of it", "Author: Maria", "tokens: 512", "auth: yes", "password: required", 'password = "changeme"', "http://user:${DB_PASS}@host/db", "http://host:8080/a@b", "Authorization: Bearer <token>", 'secret = ""']


@pytest.fixture(scope="module")
def rows(spark):
    texts = [f"some words {t} and more" for t, _ in SECRETS] + [f"some words {t} and more" for t in OTHERS]
    docs = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [(texts[r.doc_id], r.findings, r.t) for r in docs.withColumn("t", secret_scan.redacted(F.col("text"), F.col("findings"))).orderBy("doc_id").collect()]


@pytest.mark.parametrize("k", range(len(SECRETS)))
def test_whole_secrets_go(rows, k):
    text, findings, masked = rows[k]
    assert all(text[f.start : f.end] == f.value for f in findings)
    assert masked == text.replace(SECRETS[k][1], secret_scan.MASK), [(f.value, f.score) for f in findings]


@pytest.mark.parametrize("k", range(len(OTHERS)))
def test_look_alikes_stay(rows, k):
    text, findings, masked = rows[len(SECRETS) + k]
    assert masked == text, [(f.value, f.score) for f in findings]
