import random
import re

import numpy as np
import pytest

from loomgraph.llm import components, neardup
from loomgraph.llm.components import connected_components

from .fixtures import documents, frame, prose, write_tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, width):
    sets = [shingles(t, width) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        least = min(ids) if ids else None
        out += [(rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in g]
    return sorted(out, key=str)


def near_copies(rng, n, words=60, edits=1, start=1000):
    """Copies of one text with a few words replaced each."""
    base = prose(rng, words).split()
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**9)}"
        out.append((start + i, " ".join(own), "hot"))
    return out


def test_equals_brute_force(spark, tmp_path):
    extra, rng = True, random.Random(4)
    rows = documents(4, 40) + near_copies(rng, 25, edits=2) + [(2000, None, None)] * 2 + [(2001, "THE same", "a"), (2002, "the  same", "a"), (None, "alone without id", "a")]
    folder = write_tables(spark, tmp_path, documents=frame(spark, rows, extra))
    got = [tuple(r) for r in neardup.op5_near_duplicates(spark, folder).collect()]
    assert sorted(got, key=str) == brute(rows, 4)


@pytest.mark.parametrize(("small", "outside", "rounds"), [(8, 3, 1), (8, 1000, 0), (8, 0, 2), (12, 3, 0)])
def test_large_nodes(spark, monkeypatch, small, outside, rounds):
    for name, value in {"SMALL": small, "ROUNDS": rounds, "OUTSIDE": outside, "HELD": 5, "STREAMED": 7, "PARTNERS": 3, "FIRST_PART": 9}.items():
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(8)
    rows = near_copies(rng, 40, words=80, edits=6)
    got = neardup.near_duplicates(frame(spark, rows), 4).collect()
    assert sorted(((r.did, r.n, r.component, r.did == r.component) for r in got), key=str) == brute(rows, 4)


def test_recall_of_large_nodes(spark, monkeypatch):
    """Planted pairs just above the threshold among thousands of documents that are 0.6 alike."""
    for name, value in {"SMALL": 64, "OUTSIDE": 256}.items():
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows, planted = [], []
    for i in range(700):
        own = list(base)
        for j in rng.sample(range(30), 8):
            own[5 * j] = f"e{i}x{j}"
        rows.append((i, " ".join(own), "hot"))
    for i in range(0, 200, 2):
        words = rows[i][1].split()
        free = [j for j in range(4, 146) if j % 9 == 0]
        for j in rng.sample(free, 4):
            words[j] = f"p{i}x{j}"
        rows[i + 1] = (i + 1, " ".join(words), "hot")
        planted.append((i, i + 1))
    sets = {i: shingles(t, 4) for i, t, _ in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    links = [(a, b) for a, b in planted if alike(a, b) >= 0.8]
    assert len(links) > 30 and 0.4 < alike(500, 501) < 0.75
    got = {r.did: r.component for r in neardup.near_duplicates(frame(spark, rows), 4).collect()}
    assert [p for p in links if got[p[0]] != got[p[1]]] == []
    assert sorted(got.items()) == sorted((r[0], r[2]) for r in brute(rows, 4))


def test_one_of_each(spark):
    rows = [*documents(6, 30), (301, "", None), (301, "", None), (None, None, "x"), (None, None, "x")]
    docs = frame(spark, rows, True).selectExpr("*", "1 as _did", "2 as _tid", "3 as row", "4 as `odd.name`", "5 as alone", "6 as place")
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    # One row for each component, and every row without words.
    want = {c for _, n, c, _ in brute(rows, 5) if n and c is not None}
    got = [(r.doc_id, bool((r.text or "").split())) for r in kept.collect()]
    assert {i for i, words in got if words and i is not None} == want
    assert sorted(str(i) for i, words in got if not words) == sorted(map(str, [300, 301, 301, 301, 302, None, None]))
    assert len([i for i, words in got if words and i is not None]) == len(want) + 1  # 21 stands for two texts


def test_empty(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    assert neardup.one_of_each(frame(spark, [])).collect() == []


@pytest.mark.parametrize("held", [200_000, 7])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD_EDGES", held)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    least = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {k: v for k, v in least.items() if v != k}


def test_recall_of_trees():
    """Pairs at similarity 0.8 share a leaf and are near."""
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(200):
        common, own = rng.integers(1 << 63, size=160, dtype=np.uint64) * np.uint64(2), rng.integers(1 << 63, size=40, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(np.concatenate((common, own[:20]))), np.sort(np.concatenate((common, own[20:])))
        sig = neardup.signatures(np.concatenate((a, b)), np.array([180, 180]))
        found = neardup.leaves(sig)
        missed += not (found[0] == found[1]).any()
        assert neardup.estimates(sig[:1], sig[1:], 80)[0, 0] > 0
        assert neardup._aligned_estimates(sig[:1], sig[1:], 80)[0] > 0
    assert missed <= 1
