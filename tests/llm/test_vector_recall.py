"""Recall of near-duplicate vectors against brute force, on sets that differ in where the links are."""

import numpy as np
import pytest

from gleanworks.llm import embedding_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def partners(base, rng, lowest=0.93):
    """A vector at a cosine of ``lowest`` to 0.99 for each row."""
    u = rng.normal(size=base.shape)
    u = unit(u - (u * base).sum(axis=1, keepdims=True) * base)
    c = rng.uniform(lowest + 1e-4, 0.99, size=(len(base), 1))
    return c * base + np.sqrt(1 - c**2) * u


def isotropic(rng):
    base = unit(rng.normal(size=(4000, 48)))
    return np.concatenate([base, partners(base, rng), partners(base, rng)]), 3


def anisotropic(rng):
    base = unit(rng.normal(size=(3000, 48)) * np.geomspace(1, 0.05, 48))
    near = unit(base + rng.normal(size=base.shape) * np.geomspace(1, 0.05, 48) * 0.06)
    return np.concatenate([base, near, partners(base, rng)]), 2


def common_mean(rng):
    mean = unit(rng.normal(size=(1, 64)))
    return unit(mean + rng.normal(size=(1500, 64)) * 0.0325), 1


def wide_common_mean(rng):
    base = unit(unit(rng.normal(size=(1, 64))) + rng.normal(size=(3000, 64)) * 0.09)
    return np.concatenate([base, partners(base, rng)]), 1


def clusters(rng):
    centres = unit(rng.normal(size=(40, 48)))
    return unit(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 48)) * 0.045), 3


def mixed(rng):
    spread, _ = isotropic(rng)
    dense, _ = common_mean(rng)
    tight = unit(unit(rng.normal(size=(1, 48))) + rng.normal(size=(800, 48)) * 0.02)
    return np.concatenate([spread[:6000], tight, dense[:1200, :48]]), 1


def brute(x, labels, threshold=0.93):
    n = np.zeros(len(x), np.int64)
    root = np.arange(len(x))
    u = unit(x)
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        near = u[at] @ u[at].T >= threshold
        np.fill_diagonal(near, False)
        n[at] = near.sum(axis=1)
        root[at] = at[embedding_dedup.forest(near)]
    return n, root


@pytest.mark.parametrize("kind", [isotropic, anisotropic, common_mean, wide_common_mean, clusters, mixed], ids=lambda k: k.__name__)
def test_recall(spark, kind):
    rng = np.random.default_rng(12)
    x, n_labels = kind(rng)
    labels = rng.integers(0, n_labels, len(x)) if kind is not isotropic else np.arange(len(x)) % 4000 % n_labels
    n, root = brute(x, labels)
    assert n.sum() > 2000
    df = spark.createDataFrame([(i, v, int(label)) for i, (v, label) in enumerate(zip(x.tolist(), labels, strict=True))], "vec_id long, embedding array<double>, label int").repartition(4)
    got = sorted(embedding_dedup.near_vectors(df).collect())
    found = np.array([r.n_links for r in got])
    assert (found <= n).all()
    assert found.sum() >= 0.995 * n.sum()
    assert np.mean(root == [r.component_id for r in got]) >= 0.99


def test_recall_on_the_table(spark):
    """The rows of the table link with nothing, so every fifth gets a partner."""
    rng = np.random.default_rng(4)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("label IS NOT NULL").orderBy("vec_id").collect()
    x, labels = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    x, labels = np.concatenate([x, partners(unit(x[::5]), rng)]), np.concatenate([labels, labels[::5]])
    n, root = brute(x, labels)
    assert n.sum() >= 2 * len(rows) // 5
    df = spark.createDataFrame([(i, v, str(label)) for i, (v, label) in enumerate(zip(x.tolist(), labels, strict=True))], "vec_id long, embedding array<double>, label string")
    got = sorted(embedding_dedup.near_vectors(df).collect())
    assert [r.n_links for r in got] == n.tolist() and [r.component_id for r in got] == root.tolist()


def test_groups_larger_than_a_block(spark, monkeypatch):
    """Blocks of 64 vectors: each link is counted once, whatever blocks and buckets its ends lie in."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_NUMBERS", 64)
    rng = np.random.default_rng(5)
    x = np.concatenate([unit(c + rng.normal(size=(150, 32)) * s) for c, s in zip(unit(rng.normal(size=(3, 32))), (0.02, 0.05, 0.06), strict=True)])
    n, root = brute(x, np.zeros(len(x), int))
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = sorted(embedding_dedup.near_vectors(df).collect())
    assert n.max() > 100 and [r.n_links for r in got] == n.tolist() and [r.component_id for r in got] == root.tolist()


def test_vec_ids_may_repeat(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(3, a), (5, [1.0, 0.05, 0.0]), (5, b), (9, [0.0, 1.0, 0.05])]
    df = spark.createDataFrame([(i, v, "x", "clash") for i, v in rows], "vec_id long, embedding array<double>, label string, rep string")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()) == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 5, True), (9, 1, 5, False)]


def test_tiles_of_a_block(spark, monkeypatch):
    """Blocks of many tiles give what blocks of one do: counts, and components that only several tiles hold together."""
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(6)
    chain = np.array([[np.cos(a), np.sin(a)] + [0.0] * 14 for a in np.arange(0, 1.2, 0.02)])
    x = np.concatenate([chain, unit(unit(rng.normal(size=(1, 16))) + rng.normal(size=(300, 16)) * 0.09)])[rng.permutation(len(chain) + 300)]
    n, root = brute(x, np.zeros(len(x), int))
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = sorted(embedding_dedup.near_vectors(df).collect())
    assert n.max() > 100 and [r.n_links for r in got] == n.tolist() and [r.component_id for r in got] == root.tolist()


def labels_with_means(rng, n_labels=12, each=500, noise=0.1):
    """Each label is a cone of its own, and half of its vectors have a partner."""
    bases = [unit(unit(rng.normal(size=(1, 64))) + rng.normal(size=(each, 64)) * noise) for _ in range(n_labels)]
    x = np.concatenate([np.concatenate([b, partners(b[: each // 2], rng)]) for b in bases])
    return x, np.repeat(np.arange(n_labels), each + each // 2)


def test_labels_have_centres_of_their_own():
    """Seen from its label's centre a cone is spread over the codes; seen from the centre of all it is a heap."""
    x, labels = labels_with_means(np.random.default_rng(7))
    sample = np.random.default_rng(8).permutation(len(x))[: embedding_dedup.SAMPLE]

    def work(labs):
        """Comparisons that a label's codes ask for, as a share of all its pairs."""
        codes = embedding_dedup.Codes(x[sample], labs[sample], 0.93, 750)
        _, strings, inner = codes.encode(x, labs)
        first = np.flatnonzero(labels == 0)
        sizes = [np.unique(strings[first, t], return_counts=True)[1] for t in range(codes.tables)]
        return sum(int((s**2).sum()) for s in sizes) / len(first) ** 2, inner.mean()

    own, inner = work(labels)
    shared, _ = work(np.zeros_like(labels))
    assert own < shared / 3, (own, shared)
    assert inner < 0.5


def test_recall_of_labels_with_means(spark):
    x, labels = labels_with_means(np.random.default_rng(9))
    n, root = brute(x, labels)
    df = spark.createDataFrame([(i, v, int(label)) for i, (v, label) in enumerate(zip(x.tolist(), labels, strict=True))], "vec_id long, embedding array<double>, label int").repartition(4)
    got = sorted(embedding_dedup.near_vectors(df).collect())
    found = np.array([r.n_links for r in got])
    assert n.sum() > 2000 and (found <= n).all() and found.sum() >= 0.995 * n.sum()
    assert np.mean(root == [r.component_id for r in got]) >= 0.99


def test_a_label_without_centre_takes_that_of_all():
    rng = np.random.default_rng(10)
    x, labs = rng.normal(size=(200, 32)), np.repeat([5, -7, 9], [100, 90, 10])
    codes = embedding_dedup.Codes(x, labs, 0.93, 100)
    assert codes.known.tolist() == [-7, 5]
    assert codes._place(np.array([9, 5, -7, 11, -9])).tolist() == [2, 1, 0, 2, 2]
    assert embedding_dedup.Codes(x, np.arange(200), 0.93, 1)._place(labs).tolist() == [0] * 200
