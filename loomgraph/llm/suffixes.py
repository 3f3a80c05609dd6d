"""Byte-level substring dedup by column-wise construction of a collection's suffix order.

Every window of ``window`` bytes has an anchor, its gram of ``gram`` bytes with
the least hash.  Consecutive windows with one anchor form a segment; equal
windows have equal anchors, at the same place in them.  Segments go to buckets by
their anchors, and the segments of a bucket are the documents of a collection.
As with ``substring``, a first pass counts the anchors alone and segments whose
anchor occurs nowhere else stay at home; equal segments of a task are known to
repeat, and one of them travels to tell the others; and segments of an anchor
that more than ``substring.HOT`` texts have are cut by longer cores, ``LEVELS`` times.

A symbol is ``symbol_bytes`` bytes (16 for windows of 400), counted from the anchor
on, so equal windows are cut into the same symbols.  Each round inserts one
symbol of every document, the last ones first, before its suffix so far: the
symbols that precede the suffixes, in suffix order, are the collection's
Burrows-Wheeler transform, and a document's new suffix has its place among all
suffixes of all documents by that symbol and by its old place.  Common prefixes of
new neighbours are one symbol more than the least common prefix between the
places of what follows.  Suffix order, transform and common prefixes are read and
written in sequence each round, as arrays or, beyond ``IN_MEMORY`` symbols, as
temporary files that are deleted when they are closed.

At the end suffixes that share all whole symbols of a window are neighbours.
Windows begin and end inside the symbols before and after, whose bytes are compared.

Defined results: a null text has no bytes; texts shorter than a window lose
nothing; repeated rows are copies of each other, so all windows of both go;
what is left may end inside a character and is binary; an empty table gives no
rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Chunk, cover, give_back, group_blocks, spans_to_binary, text_chunks
from .rows import NO_ID, keyed_texts, partitions
from .storage import materialize
from .substring import RANGES, Finder, Pieces, gather, known_ranges, minimiser_runs, range_rows, ranges_by_text

WINDOW = 400
GRAM = 16
LEVELS = 3
#: Symbols of a collection beyond which its arrays are files.
IN_MEMORY = 8 << 20
#: Entries that a pass over such an array reads at a time.
STEP = 1 << 18
#: Common prefixes whose least is kept together.
BLOCK = 8
LOW = (1 << 32) - 1


def byte_finder(window: int, gram: int) -> Finder:
    """Cuts texts into segments of bytes, packed as two bytes of the anchor's place, then the segment."""

    def find(c: Chunk):
        def pack(some: Pieces) -> list[bytes]:
            whole = c.data.tobytes()
            place = (some.anchor - some.first).tolist()
            return [x.to_bytes(2, "little", signed=True) + whole[a:b] for x, a, b in zip(place, some.first.tolist(), (some.first + some.count + window - 1).tolist(), strict=True)]

        return minimiser_runs(c.data, c.offsets, window, gram), c.data, pack

    return Finder(find, window, LEVELS)


def symbol_bytes(window: int) -> int:
    return next(b for b in (16, 8, 4, 2, 1) if window % b == 0 and window > b)


def array(n: int, kind) -> np.ndarray:
    """An array, in a temporary file if it is long."""
    return np.memmap(tempfile.TemporaryFile(), dtype=kind, shape=(n,)) if n > IN_MEMORY else np.empty(n, dtype=kind)


class Least:
    """Least values of ranges of an array, from the least of its blocks."""

    def __init__(self, values: np.ndarray):
        n = len(values) // BLOCK
        self.values, self.levels = values, [np.minimum.reduce([values[k : n * BLOCK : BLOCK] for k in range(BLOCK)])] if n else []
        while self.levels and len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            h = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-h], self.levels[-1][h:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo:hi] for each pair; every range has entries."""
        out = self.values[lo]
        a, b = -(-lo // BLOCK), hi // BLOCK
        for k in range(1, BLOCK):
            out = np.minimum(out, self.values[np.minimum(lo + k, hi - 1)])
            out = np.minimum(out, self.values[np.maximum(hi - k, lo)])
        if len(wide := np.flatnonzero(b > a)):
            level = np.frexp((b - a)[wide].astype(np.float64))[1] - 1
            for x in np.unique(level).tolist():
                at = wide[level == x]
                table = self.levels[x]
                out[at] = np.minimum(out[at], np.minimum(table[a[at]], table[b[at] - (1 << x)]))
        return out


def suffix_order(symbols: np.ndarray, begin: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes in order (as places in symbols), their common prefixes with the suffix before (up to ``cap``), and the collection's Burrows-Wheeler transform (-1 before a document's first symbol).

    symbols: those of all documents, from 0 on; begin: where each document begins, and the end.
    """
    small = np.uint8 if cap < 256 else np.uint16
    # key: a suffix's first symbol, and the place of what follows it, from 1 on, or 0 where nothing does.
    # entry: the suffix's place in symbols, and above it the symbol before it, from 1 on, or 0 where there is none.
    key, entry, common = array(0, np.int64), array(0, np.int64), array(0, small)
    left, rank = np.diff(begin), np.zeros(len(begin) - 1, dtype=np.int64)
    live = np.flatnonzero(left > 0)
    following = symbols[begin[1:][live] - 1]
    while len(live):
        left[live] -= 1
        at = begin[live] + left[live]
        new = (following.astype(np.int64) << 32) | rank[live]
        by = np.argsort(new)
        new, at, live = new[by], at[by], live[by]
        place, m, n = np.searchsorted(key, new, side="right"), len(new), len(key)
        slot = place + np.arange(m)
        least = Least(common)

        def prefix(a: np.ndarray, b: np.ndarray, least=least) -> np.ndarray:
            """Common prefixes of suffixes a and b, given by keys, that are neighbours in this order."""
            out = ((a >> 32) == (b >> 32)).astype(small)
            x, y = a & LOW, b & LOW
            more = np.flatnonzero((out > 0) & (x > 0))
            out[more] = np.minimum(cap, 1 + least.between(x[more], y[more]).astype(np.int64))
            return out

        before = np.concatenate(([False], slot[1:] == slot[:-1] + 1))
        after = np.concatenate((before[1:], [False]))
        own = np.zeros(m, dtype=small)
        first = np.flatnonzero(~before & (place > 0))
        own[first] = prefix(key[place[first] - 1], new[first])
        inner = np.flatnonzero(before)
        own[inner] = prefix(new[inner - 1], new[inner])
        last = np.flatnonzero(~after & (place < n))
        next_ = prefix(new[last], key[place[last]])
        # Places of the suffixes so far among all.
        moved = array(n + 1, np.int32 if n + m < 1 << 31 else np.int64)
        moved[0] = 0
        for lo in range(0, n, STEP):
            hi = min(n, lo + STEP)
            a, b = np.searchsorted(place, (lo, hi))
            moved[lo + 1 : hi + 1] = np.arange(lo + 1, hi + 1) + a + np.cumsum(np.bincount(place[a:b] - lo, minlength=hi - lo))
        came = np.where(at > begin[live], symbols[np.maximum(at - 1, 0)] + 1, 0).astype(np.int64)
        out = [array(n + m, x.dtype) for x in (key, entry, common)]
        stays = array(n + m, bool)
        stays[:] = True
        stays[slot] = False
        for lo in range(0, n, STEP):
            hi = min(n, lo + STEP)
            # The suffixes so far fill a range of places in their order, but for the new ones' places.
            to = slice(int(moved[lo + 1]) - 1, int(moved[hi]))
            old, was = stays[to], key[lo:hi]
            out[0][to][old] = (was & ~LOW) | moved[was & LOW]
            out[1][to][old], out[2][to][old] = entry[lo:hi], common[lo:hi]
        out[0][slot] = (new & ~LOW) | moved[new & LOW]
        out[1][slot], out[2][slot] = (came << 32) | at, own
        out[2][slot[last] + 1] = next_
        key, entry, common = out
        rank[live] = slot + 1
        live = live[left[live] > 0]
        # The next symbols stand in the transform where their documents' suffixes do.
        following = (entry[rank[live] - 1] >> 32) - 1
    return entry & LOW, common, (entry >> 32) - 1


def _numbers(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` bytes at each place as a big-endian number of 128 bits: upper and lower half."""
    high, low = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        half = high if k < size - 8 else low
        half <<= np.uint64(8)
        half |= data[at + k]
    return high, low


def _between(left: tuple, right: tuple, size: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The last d bytes of ``left`` and then the first size - d of ``right``, as a number in two halves."""
    down, up = 8 * d, 8 * (size - d)
    (a, b), (x, y) = right, left
    # right without its last d bytes
    high, low = (a >> np.uint64(down), (b >> np.uint64(down)) | (a << np.uint64(64 - down) if down else np.uint64(0))) if down < 64 else (np.zeros_like(a), a >> np.uint64(down - 64))
    if not d:
        return high, low
    # left's last d bytes, moved up
    if d < 8:
        x, y = np.zeros_like(x), y & np.uint64((1 << down) - 1)
    else:
        x = x & np.uint64((1 << (down - 64)) - 1)
    x, y = (x << np.uint64(up) | y >> np.uint64(64 - up), y << np.uint64(up)) if up < 64 else (y << np.uint64(up - 64), np.zeros_like(y))
    return high | x, low | y


def repeated_windows(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """String and place in it of each window that occurs more than once in the strings.

    data, offsets: the strings; anchor: a place in each from which symbols are
    counted both ways; times: how often each string occurs.
    """
    size = symbol_bytes(window)
    core = window // size - 1
    phase = anchor % size
    count = np.maximum(0, (np.diff(offsets) - phase) // size)
    begin = np.concatenate(([0], np.cumsum(count)))
    string = np.repeat(np.arange(len(count)), count)
    at = offsets[string] + phase[string] + size * (np.arange(len(string)) - begin[string])
    padded = np.concatenate((np.zeros(size, dtype=np.uint8), data, np.zeros(size, dtype=np.uint8)))
    halves = [np.unique(x, return_inverse=True)[1] for x in _numbers(padded, at + size, size)]
    symbols = np.unique((halves[0] << 32) | halves[1], return_inverse=True)[1].astype(np.int32)
    order, common, _ = suffix_order(symbols, begin, core)
    # Runs of suffixes that share their first ``core`` symbols.
    near = np.concatenate((common >= core, [False]))
    member = near[:-1] | near[1:]
    suffix = order[member]
    group = np.cumsum(~near[:-1])[member]
    string, at = string[suffix], at[suffix]
    have_left, have_right = np.minimum(size, at - offsets[string]), np.minimum(size, offsets[string + 1] - at - core * size)
    left, right = _numbers(padded, at, size), _numbers(padded, at + size + core * size, size)
    strings, places = [], []
    # Where all of a run have the same bytes on both sides, all windows repeat.
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, dtype=np.int64)
    run = np.cumsum(np.concatenate(([False], group[1:] != group[:-1]))) if len(group) else group
    alike = np.ones(len(heads), dtype=bool)
    for halves, full in ((left, have_left == size), (right, have_right == size)):
        if len(heads):
            alike &= np.logical_and.reduceat(full, heads)
            for x in halves:
                alike &= np.minimum.reduceat(x, heads) == np.maximum.reduceat(x, heads)
    mixed = np.flatnonzero(~alike[run]) if len(group) else np.zeros(0, dtype=np.int64)
    for d in range(size):
        if len(group):
            strings.append(string[alike[run]])
            places.append((at - offsets[string])[alike[run]] - d)
        some = mixed[(have_left[mixed] >= d) & (have_right[mixed] >= size - d)]
        # d bytes before the symbols and the others after them.
        high, low = _between([x[some] for x in left], [x[some] for x in right], size, d)
        by = np.lexsort((low, high, run[some]))
        some, high, low = some[by], high[by], low[by]
        if not len(some):
            continue
        new = np.concatenate(([True], (run[some][1:] != run[some][:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        of = np.cumsum(new) - 1
        hit = some[np.bincount(of, weights=times[string[some]])[of] > 1]
        strings.append(string[hit])
        places.append(at[hit] - offsets[string[hit]] - d)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(strings) if strings else none, np.concatenate(places) if places else none


def repeated(pieces: DataFrame, window: int, parts: int) -> DataFrame:
    """Byte ranges [first, stop) of texts that are covered by windows that occur more than once. pieces: rows of PIECES."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_blocks(batches, "key", 4096, 2 << 20):
            ranges, batch = known_ranges(table)
            yield ranges
            if batch is None:
                continue
            # Strings whose key no other one has repeat nowhere else.
            key = batch.column("key").to_numpy()
            same = np.concatenate(([False], key[1:] == key[:-1], [False]))
            batch = batch.filter(pa.array(same[1:] | same[:-1]))
            if not batch.num_rows:
                continue
            c = next(text_chunks(batch.column("packed"), 1 << 40))
            head = c.offsets[:-1]
            anchor = np.stack((c.data[head], c.data[head + 1]), axis=1).view("<i2").ravel().astype(np.int64)
            body = np.ones(len(c.data), dtype=bool)
            body[head] = body[head + 1] = False
            offsets = c.offsets - 2 * np.arange(len(c.offsets))
            times = 1 + batch.column("many").to_numpy(zero_copy_only=False)
            string, place = repeated_windows(c.data[body], offsets, anchor, times, window)
            both = np.sort((string << 32) | place)
            string, place = both >> 32, both & LOW
            edge = np.ones(len(string) + 1, dtype=bool)
            edge[1:-1] = (string[1:] != string[:-1]) | (place[1:] > place[:-1] + 1)
            if len(string):
                heads, tails = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
                yield range_rows(batch, string[heads], place[heads], place[tails] + window)
        give_back()

    return pieces.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(of, RANGES)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    ranges = materialize(repeated(gather(docs, byte_finder(window, gram), "bytes"), window, partitions(docs, 16 << 20)), "byte-ranges")
    joined = keyed_texts(docs).join(ranges_by_text(ranges), ["did", "tid"], "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did = batch.column("did").to_numpy()
            for c in text_chunks(batch.column("text")):
                rows = slice(c.lo, c.hi)
                firsts, stops = batch.column("firsts")[rows], batch.column("stops")[rows]
                gone = np.zeros(len(c.data), dtype=bool)
                if len(flat := firsts.flatten()):
                    base = np.repeat(c.offsets[:-1], firsts.value_lengths().fill_null(0).to_numpy())
                    gone = cover(len(gone), flat.to_numpy() + base, stops.flatten().to_numpy() + base)
                seen = np.concatenate(([0], np.cumsum(gone)))
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                head[c.offsets[:-1][np.diff(c.offsets) > 0]] = gone[c.offsets[:-1][np.diff(c.offsets) > 0]]
                spans = np.concatenate(([0], np.cumsum(head)))
                ends = c.offsets - seen[c.offsets]
                own = did[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, mask=own == NO_ID), pa.array(np.diff(c.offsets)), pa.array(np.diff(seen[c.offsets])), pa.array(np.diff(spans[c.offsets])), spans_to_binary(c.data[~gone], ends[:-1], ends[1:])],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )
        give_back()

    return joined.select("did", "text", "firsts", "stops").mapInArrow(of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
