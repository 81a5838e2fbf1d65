"""Resampling, filter audit and language-model scores against plain Python."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import pytest

from gleanworks.llm import filter_audit, importance_resampling, ngram_lm

ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(spark, rows, extra=True):
    """Rows (doc_id, text, lang), with columns that operators use as names of their own."""
    names = ["doc_id", "text", "lang"] + (["score", "rank", "mask", "block", "n", "fp", "part"] if extra else [])
    kinds = ["long", "string", "string"] + ["string"] * 7 * extra
    return spark.createDataFrame([(*r, *["x"] * 7 * extra) for r in rows], ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))).repartition(5)


# --- importance resampling ----------------------------------------------------------------------------------------


def plain_resampling(rows, target, percent, min_words, max_n, buckets, seed=2024):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
        return w, [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    key = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(key(f) for x in texts for f in grams(x)[1]) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    found = []
    for d, text, _ in rows:
        w, f = grams(text)
        weight = sum(gain[key(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        found.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((x for x in found if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in found), key=repr)


RESAMPLED = [(k, " ".join(f"w{(k * j) % 37}" for j in range(k % 50)), "de") for k in range(300)]
RESAMPLED += [(None, None, None), (None, "Wörter ÄÖ été 42 " * 9, "fr"), (7, "", "de"), (8, "again and again " * 9, None), (8, "again and again " * 9, None), (9, "x" * 60_000 + " y\x00z-Z " * 30_000, "de"), (10, "日本 語 " * 20, "ja"), (11, "!?.,;", "de")]
TARGET = ["w1 w2 w3 w4 again", None, "", "Y Z z été"]


@pytest.mark.parametrize(("max_n", "buckets", "percent"), [(1, 10_000, 10), (2, 97, 33), (3, 1000, 100), (1, 5, 0)])
def test_resampling_equals_plain_python(spark, max_n, buckets, percent):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = importance_resampling.importance_resample(documents(spark, RESAMPLED), target, percent, 20, max_n, buckets)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_resampling(RESAMPLED, TARGET, percent, 20, max_n, buckets)


def test_resampling_of_empty_tables(spark):
    none = documents(spark, [])
    assert importance_resampling.importance_resample(none, none.select("text")).count() == 0
    rows = importance_resampling.importance_resample(documents(spark, RESAMPLED), none.select("text")).collect()
    assert len(rows) == len(RESAMPLED) and sum(r.rank is not None for r in rows) == sum(r.n_features >= 20 for r in rows) // 10


def test_ranks_of_ties_go_to_smaller_ids(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(importance_resampling, "noise", lambda doc_id, seed: F.lit(0).cast("long"))
    rows = [(k, "same words " * 12, "de") for k in range(50)]
    found = importance_resampling.importance_resample(documents(spark, rows), documents(spark, rows).select("text")).collect()
    assert {r.doc_id: r.rank for r in found if r.rank} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5}


# --- filter audit -------------------------------------------------------------------------------------------------


def plain_masks(rows):
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    out = []
    for d, text, lang in rows:
        t, w = text or "", words_of(text)
        upper = len(re.findall("[A-Z]", t))
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * upper > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > first[t])
        out.append((d, lang or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def plain_audit(rows, labels):
    good, bad = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    docs = plain_masks(rows)
    out, shares = {}, collections.Counter()
    for part in {p for _, p, _ in docs}:
        mine = [(d, m) for d, p, m in docs if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                failing = sum(1 for _, m in mine if m & bit)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(1 for _, m in mine if m == bit), sum(d in good for d, _ in gone), sum(d in bad for d, _ in gone)]
                shares[part, name] += len(gone)
    return sorted((*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items())


LONG = " ".join(f"word{k}" for k in range(220))
AUDITED = [(k, f"{LONG} {k % 7}", "de") for k in range(60)] + [(100 + k, "hot copy", ("de", "fr", None, "")[k % 4]) for k in range(400)]
AUDITED += [(None, None, None), (None, "hot copy", "de"), (3, "hot copy", "de"), (3, "hot copy", "de"), (5, None, "fr"), (6, "", "fr"), (700, "A#b " * 300, "it"), (701, "ABC " + LONG, "it"), (702, LONG * 3000, "it"), (703, LONG * 3000, "it")]
AUDITED += [(800 + k, f"tail {k}", "it") for k in range(40)]
LABELS = [(100, 1, 0), (100, 0, 1), (3, 1, 1), (702, 1, None), (703, None, 1), (None, 1, 1), (9999, 1, 1), (6, 0, 0)]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_masks_equal_plain_python(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = filter_audit.failure_masks(documents(spark, AUDITED)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r) for r in found), key=repr) == sorted(plain_masks(AUDITED), key=repr)


def test_equal_fingerprints_of_other_texts(spark, monkeypatch):
    """All texts have one fingerprint: the full text decides, also over the ends of ranges."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = [(k, f"text {k % 3}", "de") for k in range(90)]
    assert sorted(tuple(r) for r in filter_audit.failure_masks(documents(spark, rows)).collect()) == sorted(plain_masks(rows))


def test_audit_equals_plain_python(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.filter_audit(documents(spark, AUDITED), labels)
    assert found.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(AUDITED, LABELS)


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(documents(spark, []), labels).count() == 0
    found = filter_audit.filter_audit(documents(spark, AUDITED[:5]), labels).collect()
    assert len(found) == 600 and {r.good_lost for r in found} == {0}


# --- language-model scores ----------------------------------------------------------------------------------------


class PlainModel:
    """Deleted interpolation by dictionaries of tuples."""

    def __init__(self, rows, order, folds):
        self.order, crc = order, lambda d: zlib.crc32(str(d).encode())
        train = [(crc(d), t) for d, t, _ in rows if d is not None and crc(d) % 7 != 2]
        deleted = [t for c, t in train if (c // 7) % folds == 0]
        self.counts, self.contexts = self.gather([t for c, t in train if (c // 7) % folds])
        held = collections.Counter()
        for t in deleted:
            for h, w in self.events(t):
                held[self.bucket(h), tuple(self.estimates(h, w))] += 1
        self.weights, last = {}, -math.inf
        for _ in range(ngram_lm.ROUNDS):
            sums, fit = collections.defaultdict(lambda: [1.0] + [0.0] * order), 0.0
            for (b, p), n in held.items():
                part = [x * y for x, y in zip(self.weights_of(b), p, strict=True)]
                fit += n * math.log(sum(part))
                for j, x in enumerate(part):
                    sums[b][j] += n * x / sum(part)
            self.weights = {b: [x / sum(s) for x in s] for b, s in sums.items()}
            if not held or fit - last <= ngram_lm.TOLERANCE * abs(fit):
                break
            last = fit
        for b in {(m, k) for m in range(order + 1) for k in range(64)} - set(self.weights):
            near = [x for x in self.weights if x[0] == b[0] and len(self.weights[x]) and x in sums]
            if near:
                self.weights[b] = self.weights[min(near, key=lambda x: (abs(x[1] - b[1]), x))]
        self.counts, self.contexts = self.gather([t for _, t in train])

    def tokens(self, text):
        return [*words_of((text or "").translate(ASCII_LOWER)), None]

    def events(self, text):
        t = [0] * (self.order - 1) + self.tokens(text)
        return [(tuple(t[i - self.order + 1 : i]), t[i]) for i in range(self.order - 1, len(t))]

    def gather(self, texts):
        counts, contexts = collections.Counter(), collections.Counter()
        for text in texts:
            for h, w in self.events(text):
                for k in range(self.order):
                    counts[h[len(h) - k :], w] += 1
                    contexts[h[len(h) - k :]] += 1
        return counts, contexts

    def estimates(self, h, w):
        n, v, c = self.contexts[()], sum(1 for x in self.counts if x[0] == ()), self.counts[(), w]
        p = [(c + 1) / (n + v + 1)]
        for k in range(self.order):
            g = h[len(h) - k :]
            p.append(self.counts[g, w] / self.contexts[g] if self.contexts[g] else 0.0)
        return p

    def bucket(self, h):
        longest = [k for k in range(self.order) if self.contexts[h[len(h) - k :]]]
        if not longest:
            return 0, 0
        k = longest[-1]
        return k + 1, int(math.log2(self.contexts[h[len(h) - k :]])) if k else 0

    def weights_of(self, b):
        return self.weights.get(b) or [1 / (b[0] + 1)] * (b[0] + 1) + [0.0] * (self.order - b[0])

    def probability(self, h, w):
        return sum(x * y for x, y in zip(self.weights_of(self.bucket(h)), self.estimates(h, w), strict=True))

    def row(self, d, text):
        events = self.events(text)
        return (
            d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(events), sum(self.counts[(), w] > 0 for _, w in events), self.contexts[()],
            sum(math.log10(self.estimates(h, w)[0]) for h, w in events), sum(math.log10(self.probability(h, w)) for h, w in events),
        )


SCORED = [(k, " ".join(f"W{(k * j * j) % 11}" if j % 3 else f"v{(k + j) % 5}" for j in range(k % 23)), "de") for k in range(120)]
SCORED += [(None, None, None), (None, "v1 W1 v2", "de"), (5, "", "de"), (6, "unseen ÄÖ words", "de"), (7, "v1 v2 " * 9000, "de"), (7, "v1 v2 " * 9000, "de"), (8, " \t\n", None)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_python(spark, order, monkeypatch):
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 300)
    model = PlainModel(SCORED, order, 3)
    found = ngram_lm.score_texts(documents(spark, SCORED), order, 3)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows, expected = sorted((tuple(r) for r in found.collect()), key=repr), sorted((model.row(d, t) for d, t, _ in SCORED), key=repr)
    assert [r[:5] for r in rows] == [r[:5] for r in expected]
    for a, b in zip(rows, expected, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_add_up(order):
    model = PlainModel(SCORED, order, 3)
    vocabulary = [w for h, w in model.counts if h == ()]
    for h in [(0,) * (order - 1), ("v1",) * (order - 1), ("never",) * (order - 1), ("never", "v1")[-order + 1 :]]:
        assert sum(model.probability(h, w) for w in vocabulary) + model.probability(h, "unknown") == pytest.approx(1)


def test_scores_without_training_or_rows(spark):
    assert ngram_lm.score_texts(documents(spark, [])).count() == 0
    only = ngram_lm.score_texts(documents(spark, [(None, "no model here", "de")])).collect()
    assert [tuple(r) for r in only] == [(None, False, 4, 0, 0, 0.0, 0.0)]


def test_held_out_texts_are_better_than_unigrams(spark, sf):
    rows = ngram_lm.score_texts(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 1.05 * sum(r.base_score for r in rows)


def test_a_chunk_of_n_grams_is_narrow():
    """What a task holds of a chunk of a million tokens while it scores, numpy's arrays at their most."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from gleanworks.llm import ngram_lm as lm

    rng = np.random.default_rng(1)
    n = 1_000_000
    vocabulary = np.sort(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    ids = rng.integers(0, len(vocabulary), n).astype(np.uint64)
    sizes = np.full(n // 100, 100, np.uint64)
    row = {"vocabulary": lm.packed(vocabulary), "ids": lm.packed(ids), "sizes": lm.packed(sizes)}
    grams = lm._opened(row, 2)
    asked = len(grams.every)
    del grams
    many = len(sizes)
    chunk = pa.table({"doc_ids": [list(range(many))], "held_out": [[False] * many]} | {k: [v] for k, v in row.items()})
    answers = pa.table({"range": [0], "total": [lm.packed(np.ones(asked, np.uint64))]})
    tracemalloc.start()
    scored = lm._scores(chunk, answers, 2, n, len(vocabulary), lm.start_weights(2))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored.num_rows == many
    assert most < 90 * n


def test_a_task_holds_little_beside_its_batch(monkeypatch):
    """What a task holds while it makes chunks of a batch of 20 MB of text, and while it lists a chunk's n-grams; numpy's and Python's share."""
    import tracemalloc
    import types

    import numpy as np
    import pyarrow as pa

    from gleanworks.llm import ngram_lm as lm

    monkeypatch.setattr(lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(2)
    many = 5000
    texts = [b" ".join(b"%x" % x for x in rng.integers(0, 2**18, 700)) for _ in range(many)]
    deleted = [k % 8 == 0 for k in range(many)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(many), pa.int64()), pa.array([False] * many), pa.array([True] * many), pa.array(texts, pa.binary()), pa.array(deleted)], names=["doc_id", "held_out", "learn", "text", "is_deleted"])
    del texts
    tracemalloc.start()
    chunks = list(lm._chunked(iter([batch])))
    made = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    runs = list(lm._runs(iter(chunks), 2, 24))
    listed = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(d for c in chunks for d in c.column("doc_ids")[0].as_py()) == list(range(many)) and len(chunks) > 2
    assert sum(c.column("kept_tokens")[0].as_py() + c.column("deleted_tokens")[0].as_py() for c in chunks) == 701 * many
    assert sum(r.num_rows for r in runs) >= 24
    assert made < 60e6 and listed < 150e6


def test_n_grams_of_short_chunks():
    """A chunk of fewer tokens than the order; start marks stand before each text, whatever stands before it in the chunk."""
    import numpy as np

    from gleanworks.llm import ngram_lm as lm

    vocabulary = np.array([5, 9], np.uint64)
    one = lm.NGrams(vocabulary, np.array([0], np.int32), np.array([1]), 5)
    both = lm.NGrams(vocabulary, np.array([0, 1, 0], np.int32), np.array([1, 2]), 5)
    after = lm.NGrams(vocabulary, np.array([1, 0], np.int32), np.array([2]), 5)
    for k in range(1, 5):
        assert both.keys[k][both.at[k]].tolist() == one.keys[k][one.at[k]].tolist() + after.keys[k][after.at[k]].tolist()
