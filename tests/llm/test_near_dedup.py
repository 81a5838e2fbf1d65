"""Near duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from gleanworks.llm import near_dedup
from gleanworks.llm.common import Scratch, connected_components, shingle_sets

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d) if d is not None else d
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 9, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5, 14])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 6, 15])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy) if rng.random() < 0.7 else "\t".join(copy).upper())
    out += [None, "", " \n ", "Ünï cödé", "ÜNÏ CÖDÉ", "a", "A", "x " * 3000, "x " * 2999]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(out)]
    return rows + [(None, out[0]), rows[0]]


def found(spark, rows):
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, rep string").repartition(3)
    return [r.asDict() for r in near_dedup.near_duplicates(df).collect()]


def test_equals_brute_force(spark):
    rows = corpus()
    got = found(spark, rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_large_bands_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(90)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found(spark, rows)), key=repr) == brute(rows)


def family(n, rng, shared=60, own=30, start=0):
    """Documents of one long passage and of words of their own: all meet in bands, none is linked."""
    base = [f"s{i}" for i in range(shared)]
    return [(start + i, " ".join(base + [f"o{rng.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


@pytest.mark.parametrize("block", [12, 60, 1024])
def test_strangers_and_copies_in_one_band(spark, monkeypatch, block):
    """Bands with one component and others are dealt to blocks, or split by a second band, and lose no link."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(4)
    rows = family(60, rng)
    base = rows[0][1].split()
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(copy)))
    for i in range(0, 40, 2):
        rows.append((200 + i, rows[i][1] + " end"))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found(spark, rows)), key=repr) == brute(rows)


def test_unlinked_bands_are_dealt_in_proportion(spark, monkeypatch):
    """Unlinked documents that share nearly half of their text send a few rows each to blocks, not one for each block."""
    sent = []
    real = near_dedup._dealt

    def counted(rows):
        found = real(rows)
        sent.append(found.count())
        return found

    monkeypatch.setattr(near_dedup, "_dealt", counted)
    monkeypatch.setattr(near_dedup, "BLOCK", 256)
    assert all(r["component_id"] == r["doc_id"] for r in found(spark, family(4000, random.Random(6), shared=40, own=50)))
    assert sent[0] <= 4000, sent


def test_linked_texts_share_a_rare_shingle(spark):
    """What takes the place of a band with many strangers: every linked pair shares a key, and strangers share few."""
    rng = random.Random(5)
    rows = family(300, rng, shared=40, own=50)
    rows += [(1000 + i, text + " " + " ".join(f"n{i}x{k}" for k in range(i % 28))) for i, (_, text) in enumerate(rows[:200])]
    sets = {d: shingles(t) for d, t in rows}
    members = spark.createDataFrame(rows, "rep long, text string")
    held = spark.createDataFrame([(1, d, len(s), d) for d, s in sets.items()] * 2, "key long, rep long, size long, comp long")
    keys = {}
    for r in near_dedup._rarest(held, members, 75, Scratch(spark, "t")).collect():
        keys.setdefault(r.rep, set()).add(r.key)
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(linked) > 100 and all(keys.get(a, set()) & keys.get(b, set()) for a, b in linked)
    assert sum(map(len, keys.values())) < 30 * len(rows)


def test_texts_go_where_links_may_be(spark, monkeypatch):
    """Of strangers that share a third of their text sketches alone are dealt to blocks."""
    sent = []
    real = near_dedup._block_linker

    def counted(percent, on_texts):
        sent.append(on_texts)
        return real(percent, on_texts)

    monkeypatch.setattr(near_dedup, "_block_linker", counted)
    monkeypatch.setattr(near_dedup, "BLOCK", 128)
    assert all(r["component_id"] == r["doc_id"] for r in found(spark, family(1200, random.Random(7), shared=60, own=30)))
    assert sent == [False, True]


def test_links_at_the_threshold_are_confirmed(spark):
    """Pairs at exactly 0.75: sets of 7 and of 70 shingles with 6 and 60 in common."""
    rng = random.Random(8)
    rows = []
    for k in range(600):
        n = 7 if k % 2 else 70
        text = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        other = text[n // 7 :] + [f"w{rng.randrange(10**6)}" for _ in range(n // 7)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in found(spark, rows)}
    assert all(got[d] == d - d % 2 for d in got)


def test_one_id_on_two_texts(spark):
    """Texts are linked by themselves: the texts of one id do not join their groups."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, a), (5, a + " more"), (5, b), (9, b + " more"), (5, b)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"], r["stays"]) for r in found(spark, rows))
    assert got == [(3, 3, True, True), (5, 3, False, False), (5, 5, True, True), (5, 5, True, True), (9, 5, False, False)]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_shingle_sets_count_as_plain_python():
    texts = [t or "" for _, t in corpus(5)]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(1)
    for n in (8, 60, 2000):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            shared = int(n * 0.8)
            a, b = pool[:n], np.concatenate([pool[:shared], pool[n : 2 * n - shared]])
            r = near_dedup.registers([np.sort(a), np.sort(b)])
            errors.append(near_dedup.estimate(r[:1], r[1:])[0] - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.03


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 3), (5, 4), (9, 9)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(29, 30)], []])
def test_components(spark, pairs):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {n: n for p in pairs for n in p if p[0] != p[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {n: root(n) for n in parent}
