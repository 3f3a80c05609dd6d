import hashlib
import random
import re
from collections import Counter

import numpy as np

from loomgraph.llm import substring

from .fixtures import documents, frame, prose, write_tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t, _ in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def case():
    rng = random.Random(11)
    rows = documents(12, 40)
    shared = prose(rng, 34).split()
    rows += [(500, " ".join([*shared, "end", "x"]), "a"), (501, " ".join(["y", *shared, "end"]), "a"), (502, " ".join([*shared, "other"]), "a"), (503, "\t".join([*shared, "end", "z"]), "a")]
    rows += [(600 + i, "loop " * 50 + f"t{i}", "a") for i in range(3)]
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = case()
    folder = write_tables(spark, tmp_path, documents=frame(spark, rows, extra=True))
    got = [tuple(r) for r in substring.op7_substring_dedup(spark, folder).collect()]
    assert sorted(got, key=str) == brute(rows, 35)


def test_small_windows_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(substring, "GATHER", 2000)
    rows = case()
    got = substring.remove_repeats(frame(spark, rows), window=9, gram=3).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=str) == brute(rows, 9)


def test_hot_minimisers(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 2)
    rng = random.Random(5)
    core = prose(rng, 12)
    rows = case() + [(2000 + i, f"{prose(rng, 30)} {core} {prose(rng, 30)}", "a") for i in range(30)]
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows, 35)


def test_finer_pieces_hold_each_window_once():
    """After LEVELS cuts a core is a whole window."""
    rng = np.random.default_rng(3)
    hashes = rng.integers(1 << 63, size=500, dtype=np.uint64)
    whole = substring.minimiser_runs(hashes, np.array([0, 120, 500]), 35, 8)
    fine = whole
    for level in range(1, substring.LEVELS + 1):
        fine = fine.finer(35)
        windows = np.concatenate([np.arange(a, a + n) for a, n in zip(fine.first, fine.count, strict=True)])
        assert sorted(windows.tolist()) == [*range(0, 86), *range(120, 466)]
        assert (fine.left >= fine.first + fine.count - 1).all() and (fine.right <= fine.first + 35).all()
    assert (fine.right - fine.left == 35).all()


def test_places_of_a_key_are_one_row(spark):
    """A text that repeats a line has one row for its minimiser, however many pieces."""
    rows = [(i, "one two " * 300, "a") for i in range(4)]
    found = substring.places(substring.keyed_texts(frame(spark, rows)), substring.word_finder(35, 8)).collect()
    assert len(found) == 4 and min(len(r.starts) for r in found) > 100


def test_empty(spark):
    assert substring.remove_repeats(frame(spark, [])).collect() == []
