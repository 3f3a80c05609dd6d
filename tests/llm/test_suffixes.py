import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import substring, suffixes

from .fixtures import documents, frame, prose, write_tables


def brute(rows, window):
    texts = [(t or "").encode() for _, t, _ in rows]
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, _, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def case():
    rng = random.Random(21)
    rows = documents(22, 30)
    base = prose(rng, 300)
    rows += [(700 + i, prose(rng, 5) + base[100 + 13 * i : 100 + 13 * i + 399 + i] + prose(rng, 5), "a") for i in range(6)]
    rows += [(800 + i, "ab" * (210 + i), "a") for i in range(2)] + [(810, "é" * 450, "a"), (811, base[:700] + "!" + base[:700], "a")]
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = case()
    folder = write_tables(spark, tmp_path, documents=frame(spark, rows, extra=True))
    got = [tuple(r) for r in suffixes.op10_suffix_dedup(spark, folder).collect()]
    assert sorted(got, key=str) == brute(rows, 400)


def test_small_windows_and_files(spark, monkeypatch):
    monkeypatch.setattr(substring, "GATHER", 3000)
    monkeypatch.setattr(suffixes, "IN_MEMORY", 100)
    rows = case()
    got = suffixes.remove_repeats(frame(spark, rows), window=40, gram=5).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, 40)


def test_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 2)
    rows = case()
    got = suffixes.remove_repeats(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, 400)


@pytest.mark.parametrize("in_memory", [1 << 20, 10])
def test_order_of_a_collection(monkeypatch, in_memory):
    """Suffix order, common prefixes and transform of random collections."""
    monkeypatch.setattr(suffixes, "IN_MEMORY", in_memory)
    monkeypatch.setattr(suffixes, "STEP", 7)
    rng = np.random.default_rng(4)
    for _ in range(40):
        count = rng.integers(0, 30, size=rng.integers(1, 12))
        begin = np.concatenate(([0], np.cumsum(count)))
        symbols = rng.integers(0, 3, size=begin[-1]).astype(np.int32)
        order, common, bwt = suffixes.suffix_order(symbols, begin, 6)
        end = np.repeat(begin[1:], count)
        texts = [symbols[i : end[i]].tolist() for i in np.asarray(order).tolist()]
        assert sorted(np.asarray(order).tolist()) == list(range(len(symbols))) and texts == sorted(texts)
        starts = set(begin[:-1].tolist())
        for j, i in enumerate(np.asarray(order).tolist()):
            assert bwt[j] == (-1 if i in starts else symbols[i - 1])
            if j:
                n = 0
                while n < min(len(texts[j]), len(texts[j - 1])) and texts[j][n] == texts[j - 1][n]:
                    n += 1
                assert common[j] == min(6, n)


@pytest.mark.parametrize("window", [8, 12, 16, 7, 32, 48])
def test_windows_of_aligned_strings(window):
    rng = random.Random(window)
    for _ in range(30):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        strings, anchor = [], []
        for _ in range(rng.randrange(1, 9)):
            a, b = sorted((rng.randrange(0, 25), rng.randrange(35, 61)))
            t = bytearray(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(60)] = rng.choice(b"abc")
            strings.append(bytes(t[a:b]))
            anchor.append(30 - a)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        times = np.array([rng.choice((1, 1, 1, 2)) for _ in strings])
        string, place = suffixes.repeated_windows(np.frombuffer(b"".join(strings), dtype=np.uint8), offsets, np.array(anchor), times, window)
        got = set(zip(string.tolist(), place.tolist(), strict=True))
        assert len(got) == len(string)
        every = [(i, p, s[p : p + window], anchor[i] - p) for i, s in enumerate(strings) for p in range(len(s) - window + 1)]
        # Windows at the same place from the anchor must be found; others that are equal may be.
        aligned = Counter((w, a) for i, _, w, a in every for _ in range(times[i]))
        total = Counter(w for i, _, w, _ in every for _ in range(times[i]))
        alone = {(i, p) for i, p, w, a in every if times[i] > 1 and aligned[w, a] == times[i]}
        assert {(i, p) for i, p, w, a in every if aligned[w, a] > 1} - alone <= got
        assert all(total[w] > 1 for i, p, w, _ in every if (i, p) in got)


def test_bytes_across_a_boundary():
    rng = random.Random(1)
    for size in (1, 2, 4, 8, 16):
        left, right = (bytes(rng.randrange(256) for _ in range(size)) for _ in range(2))
        halves = [suffixes._numbers(np.frombuffer(x, dtype=np.uint8), np.array([0]), size) for x in (left, right)]
        for d in range(size):
            high, low = suffixes._between(*halves, size, d)
            assert (int(high[0]) << 64 | int(low[0])).to_bytes(16, "big")[16 - size :] == left[size - d :] + right[: size - d]


def test_empty(spark):
    assert suffixes.remove_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("operator", [substring, suffixes])
def test_texts_are_cut_once_for_their_keys(spark, monkeypatch, operator):
    """Keys are counted and joined from a table, not from the texts again."""
    seen = {}
    write = substring.materialize

    def noting(df, name, **options):
        seen[name.split("-", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, **options)

    monkeypatch.setattr(substring, "materialize", noting)
    operator.remove_repeats(frame(spark, documents(4, 30)))
    assert "MapInArrow" in seen["places"]
    assert "MapInArrow" not in seen["keys"] and "MapInArrow" not in seen["wanted"]
