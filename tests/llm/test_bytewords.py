import tracemalloc

import numpy as np
import pytest

from loomgraph.llm import bytewords


def words(size):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, size, dtype=np.uint8)
    data[rng.integers(0, size, size // 6)] = 0x20
    data[size // 4 : size // 4 + size // 3] = 98  # a word longer than a stretch
    return bytewords.find_words(data, np.array([0, 5_000, 5_000, size]), bytewords.NOT_SPACE)


def test_hashes_do_not_depend_on_stretches(monkeypatch):
    w = words(600_000)
    one = w.hashes(), bytewords.gram_hashes(w.hashes(), 8), bytewords.gram_hashes(w.hashes(), 35)
    monkeypatch.setattr(bytewords, "HASH_BYTES", 1000)
    two = w.hashes(), bytewords.gram_hashes(w.hashes(), 8), bytewords.gram_hashes(w.hashes(), 35)
    for a, b in zip(one, two, strict=True):
        assert len(a) and (a == b).all()
    assert (one[0] == bytewords.span_hash(w.data, w.starts, w.ends, bytewords.BASES[0])).all()


@pytest.mark.parametrize("base", bytewords.BASES)
def test_memory_for_hashes_does_not_grow_with_the_block(monkeypatch, base):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 8 << 20, dtype=np.uint8)
    data[::9] = 0x20
    w = bytewords.find_words(data, np.array([0, len(data)]), bytewords.NOT_SPACE)
    monkeypatch.setattr(bytewords, "_POWERS", {})
    tracemalloc.start()
    try:
        bytewords.gram_hashes(w.hashes(base), 35, base)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 << 20  # two results of 7 MB each, and stretches
