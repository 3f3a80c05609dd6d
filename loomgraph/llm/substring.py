"""Substring dedup: windows of words counted by super-k-mer partitioning.

A window is ``window`` consecutive words of a text.  Its minimiser is the gram
of ``gram`` words with the least hash in it.  Consecutive windows with the same
minimiser travel as one packed string, a super-k-mer, to the bucket of that
minimiser; equal windows have equal minimisers and meet there.  Each bucket
sorts the hashes of its windows and finds those that occur more than once.

A first pass counts the minimisers alone, a row for each of a text's.  A
super-k-mer whose minimiser occurs nowhere else has no equal window and stays at
home; the others travel.  Equal super-k-mers of a task are known to repeat: their
places are given at once and one of them travels, without a place, to tell the
others.  So a passage that a third of the rows share is one row for each map task.

A minimiser that more than ``HOT`` texts have may stand in very many different
strings.  Its super-k-mers are cut further: the windows that reach far to the
left of the minimiser and those that reach far to the right have longer cores in
common, which take its place, ``LEVELS`` times over; then the core is the window
itself, and no bucket holds more than equal windows.

Windows are compared by two 64-bit hashes, from two hashes of each word.

Defined results: null texts have no words; a text with fewer words than a
window loses nothing; repeated rows are copies of each other, so all windows of
both go; windows are judged on the input; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import BASES, NOT_SPACE, Chunk, cover, find_words, give_back, gram_hashes, group_blocks, list_column, sliding_min, span_hash, spans_to_binary, text_chunks
from .rows import NO_ID, keyed_texts, partitions
from .storage import drop, materialize

WINDOW = 35
GRAM = 8
#: Texts that share a minimiser beyond which its pieces are cut further, and how often.
HOT = 50_000
LEVELS = 5
U64 = np.uint64
_PLACE_BITS = 32
#: packed: null for a range of words that is known to repeat; many: the piece repeats, its places are known.
PIECES = "key long, packed binary, many boolean, did long, tid binary, first int, stop int"
RANGES = "did long, tid binary, first int, stop int"
#: Bytes of texts that are cut at a time, so that their arrays stay in a processor's cache.
CUT_BYTES = 1 << 17
#: Bytes of packed strings that a map task gathers before it drops the repeated ones.
GATHER = 24 << 20


class Pieces(NamedTuple):
    """Runs of windows of a chunk that share a core: units (words or bytes) [left, right), counted over the chunk.

    first: a run's first unit; count: its windows; anchor: the first unit of
    the minimiser; base: each document's first unit.
    """

    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    left: np.ndarray
    right: np.ndarray
    anchor: np.ndarray
    base: np.ndarray

    def start(self) -> np.ndarray:
        """The run's first unit in its document."""
        return self.first - self.base[self.doc]

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(*(x[at] for x in self[:6]), self.base)

    def finer(self, window: int) -> Pieces:
        """Each run cut in two: windows that reach to the left of the core by half of what a window has beside it, and the others."""
        reach = (window - (self.right - self.left) + 1) // 2
        edge, last = self.left - reach, self.first + self.count - 1
        to_left = self._replace(count=np.minimum(last, edge) - self.first + 1, left=edge)
        begin = np.maximum(self.first, edge + 1)
        to_right = self._replace(first=begin, count=last - begin + 1, right=edge + 1 + window)
        both = Pieces(*(np.concatenate((x, y)) for x, y in zip(to_left[:6], to_right[:6], strict=True)), self.base)
        return both.take(np.flatnonzero(both.count > 0))


class Finder(NamedTuple):
    """How to cut texts: ``find`` gives a chunk's pieces, their units' hashes, and a function that packs some pieces."""

    find: Callable
    window: int
    levels: int


def first_minimum(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive hashes, the place of the least, the first of equal ones."""
    place = U64((1 << _PLACE_BITS) - 1)
    at = np.arange(len(hashes), dtype=U64)
    if len(hashes) > int(place):
        raise ValueError("a text has more than 2**32 grams")
    return (sliding_min((hashes & ~place) | at, width) & place).astype(np.int64)


def one_space(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one space: the bytes, and the words' new starts and ends."""
    size = ends - starts
    new = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    out[np.flatnonzero(inside) - starts[word] + new[word]] = data[inside]
    return out, new, new + size


def minimiser_runs(hashes: np.ndarray, base: np.ndarray, window: int, gram: int) -> Pieces | None:
    """The runs of windows with one minimiser. hashes: of all units; base: each document's first unit, and the end."""
    n = len(hashes) - window + 1
    if n <= 0:
        return None
    least = first_minimum(gram_hashes(hashes, gram), window - gram + 1)
    stop = np.repeat(base[1:], np.diff(base))[:n]
    valid = np.arange(n) + window <= stop
    head = valid.copy()
    head[1:] &= (least[1:] != least[:-1]) | (stop[1:] != stop[:-1])
    heads = np.flatnonzero(head)
    if not len(heads):
        return None
    count = np.bincount((np.cumsum(head) - 1)[valid], minlength=len(heads))
    anchor = least[heads]
    return Pieces(np.searchsorted(base, heads, side="right") - 1, heads, count, anchor, anchor + gram, anchor, base)


def keys_of(pieces: Pieces, hashes: np.ndarray) -> np.ndarray:
    return span_hash(hashes, pieces.left, pieces.right, BASES[1]).view(np.int64)


class Gatherer:
    """Collects a map task's strings and gives each distinct (key, string) once; those that repeat without a place, and their places as ranges."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.at: dict[tuple[int, bytes], int] = {}
        self.places: list[list[tuple[int, bytes, int, int]]] = []
        self.size = 0

    def add(self, keys, strings, dids, tids, starts, stops):
        for key, s, place in zip(keys, strings, zip(dids, tids, starts, stops, strict=True), strict=True):
            i = self.at.setdefault((key, s), len(self.places))
            if i == len(self.places):
                self.places.append([place])
                self.size += len(s) + 200
            else:
                self.places[i].append(place)
                self.size += 100

    def flush(self) -> Iterator[pa.RecordBatch]:
        many = [len(x) > 1 for x in self.places]
        none = (None, None, None, None)
        own = [none if m else x[0] for x, m in zip(self.places, many, strict=True)]
        yield self.rows([k for k, _ in self.at], [s for _, s in self.at], many, own)
        by_text: dict[tuple[int, bytes], list[tuple[int, int]]] = defaultdict(list)
        for x, m in zip(self.places, many, strict=True):
            for did, tid, first, stop in x if m else ():
                by_text[did, tid].append((first, stop))
        ranges = [(did, tid, a, b) for (did, tid), spans in by_text.items() for a, b in united(spans)]
        # Dealt out by text, as no bucket needs them.
        yield self.rows([hash((did, tid, a)) for did, tid, a, _ in ranges], [None] * len(ranges), [None] * len(ranges), ranges)
        self.clear()

    @staticmethod
    def rows(keys, strings, many, places) -> pa.RecordBatch:
        dids, tids, firsts, stops = zip(*places, strict=True) if places else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, type=pa.int64()), pa.array(strings, type=pa.binary()), pa.array(many, type=pa.bool_()), pa.array(dids, type=pa.int64()), pa.array(tids, type=pa.binary()), pa.array(firsts, type=pa.int32()), pa.array(stops, type=pa.int32())],
            names=["key", "packed", "many", "did", "tid", "first", "stop"],
        )


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges without overlaps that cover the same."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def places(texts: DataFrame, finder: Finder) -> DataFrame:
    """key, did, tid, starts of the pieces of each text that have the key."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, tid = batch.column("did").to_numpy(), batch.column("tid")
            for c in text_chunks(batch.column("text"), CUT_BYTES):
                pieces, hashes, _ = finder.find(c)
                if pieces is None:
                    continue
                key, start = keys_of(pieces, hashes), pieces.start()
                order = np.lexsort((start, key, pieces.doc))
                key, doc = key[order], pieces.doc[order]
                head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
                row = c.lo + doc[head]
                yield pa.RecordBatch.from_arrays([pa.array(key[head]), pa.array(did[row]), tid.take(pa.array(row)), list_column(start[order], np.diff(np.append(head, len(key))), pa.int32())], names=["key", "did", "tid", "starts"])
        give_back()

    return texts.mapInArrow(of, "key long, did long, tid binary, starts array<int>")


def meeting_places(found: DataFrame, name: str) -> DataFrame:
    """did, tid, wanted, hot: the starts of the pieces whose key another piece has; only these need to travel."""
    several = found.groupBy("key").agg(F.sum(F.size("starts")).alias("n"), F.count(F.lit(1)).alias("texts")).filter("n > 1").select("key", (F.col("texts") > HOT).alias("much"))
    # Written out, so that a key that very many texts have is a skewed join that Spark splits.
    several = materialize(several, f"{name}-keys")
    joined = found.join(several, "key")
    out = joined.groupBy("did", "tid").agg(F.flatten(F.collect_set("starts")).alias("wanted"), F.flatten(F.collect_set(F.when(F.col("much"), F.col("starts")))).alias("hot"))
    wanted = materialize(out, f"{name}-wanted")
    drop(several)
    return wanted


def ship(texts: DataFrame, finder: Finder) -> DataFrame:
    """The wanted pieces as rows of PIECES. texts: did, tid, text, wanted, hot."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gatherer()
        for batch in batches:
            did, tid = batch.column("did").to_numpy(), batch.column("tid")
            for c in text_chunks(batch.column("text"), CUT_BYTES):
                pieces, hashes, pack = finder.find(c)
                if pieces is None:
                    continue
                own = (pieces.doc << 32) | pieces.start()

                def listed(name: str, own=own, batch=batch, c=c) -> np.ndarray:
                    starts = batch.column(name).slice(c.lo, c.hi - c.lo)
                    asked = (np.repeat(np.arange(c.hi - c.lo), starts.value_lengths().to_numpy()) << 32) | starts.flatten().to_numpy()
                    return np.isin(own, asked)

                hot = listed("hot")
                sets = [pieces.take(np.flatnonzero(listed("wanted") & ~hot))]
                if hot.any():
                    finer = pieces.take(np.flatnonzero(hot))
                    for _ in range(finder.levels):
                        finer = finer.finer(finder.window)
                    sets.append(finer)
                for some in sets:
                    if len(some.doc):
                        start, row = some.start(), c.lo + some.doc
                        held.add(keys_of(some, hashes).tolist(), pack(some), did[row].tolist(), tid.take(pa.array(row)).to_pylist(), start.tolist(), (start + some.count + finder.window - 1).tolist())
                if held.size > GATHER:
                    yield from held.flush()
        if held.at:
            yield from held.flush()
        give_back()

    return texts.mapInArrow(of, PIECES)


def gather(docs: DataFrame, finder: Finder, name: str) -> DataFrame:
    """Pieces of all texts that may meet an equal one, as rows of PIECES."""
    texts = keyed_texts(docs)
    # Written out, as the texts would be cut twice otherwise: to count the keys, and to join them.
    found = materialize(places(texts, finder), f"{name}-places")
    wanted = meeting_places(found, name)
    drop(found)
    return ship(texts.join(wanted, ["did", "tid"]), finder)


def word_finder(window: int, gram: int) -> Finder:
    """Cuts texts into super-k-mers of words, packed as words joined by one space."""

    def find(c: Chunk):
        w = find_words(c.data, c.offsets, NOT_SPACE)
        hashes = w.hashes()
        pieces = minimiser_runs(hashes, w.first, window, gram)

        def pack(some: Pieces) -> list[bytes]:
            joined, a, b = one_space(w.data, w.starts, w.ends, NOT_SPACE[w.data])
            whole = joined.tobytes()
            return [whole[x:y] for x, y in zip(a[some.first].tolist(), b[some.first + some.count + window - 2].tolist(), strict=True)]

        return pieces, hashes, pack

    return Finder(find, window, LEVELS)


def known_ranges(table: pa.Table) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """The ranges among rows of PIECES, and the pieces."""
    batch = table.combine_chunks().to_batches()[0]
    given = batch.column("packed").is_null()
    pieces = batch.filter(pa.compute.invert(given))
    return batch.filter(given).select(["did", "tid", "first", "stop"]), pieces if pieces.num_rows else None


def range_rows(pieces: pa.RecordBatch, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows of RANGES: units [begin, end) of the pieces at ``row`` that have a place."""
    some = np.flatnonzero(~pieces.column("many").to_numpy(zero_copy_only=False)[row])
    row = row[some]
    first = pieces.column("first").fill_null(0).to_numpy()[row]
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([pieces.column("did").take(at), pieces.column("tid").take(at), pa.array((first + begin[some]).astype(np.int32)), pa.array((first + end[some]).astype(np.int32))], names=["did", "tid", "first", "stop"])


def repeated(pieces: DataFrame, window: int, parts: int) -> DataFrame:
    """Word ranges [first, stop) of texts that are covered by windows that occur more than once. pieces: rows of PIECES."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_blocks(batches, "key", 8192, 4 << 20):
            ranges, batch = known_ranges(table)
            yield ranges
            if batch is None:
                continue
            key, times = batch.column("key").to_numpy(), 1 + batch.column("many").to_numpy(zero_copy_only=False)
            c = next(text_chunks(batch.column("packed"), 1 << 40))
            w = find_words(c.data, c.offsets, NOT_SPACE)
            one, two = gram_hashes(w.hashes(BASES[0]), window, BASES[0]), gram_hashes(w.hashes(BASES[1]), window, BASES[1])
            row = w.doc()[: len(one)]
            inside = np.flatnonzero(np.arange(len(one)) + window <= w.stop()[: len(one)])
            one, two, row = one[inside], two[inside], row[inside]
            # Sorting brings equal windows of a bucket together.
            order = np.lexsort((two, one, key[row]))
            k, x, y = key[row[order]], one[order], two[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            group = np.cumsum(new) - 1
            total = np.bincount(group, weights=times[row[order]])
            many = np.empty(len(order), dtype=bool)
            many[order] = total[group] > 1
            if not many.any():
                continue
            # Runs of such windows inside a string.
            place = inside - w.first[row]
            edge = np.ones(len(row) + 1, dtype=bool)
            edge[1:-1] = (row[1:] != row[:-1]) | (many[1:] != many[:-1])
            heads = np.flatnonzero(edge[:-1])
            tails = np.flatnonzero(edge[1:])
            heads, tails = heads[many[heads]], tails[many[heads]]
            yield range_rows(batch, row[heads], place[heads], place[tails] + window)
        give_back()

    return pieces.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(of, RANGES)


def ranges_by_text(ranges: DataFrame) -> DataFrame:
    """A row for each text: its ranges, at most one for each of its super-k-mers' runs."""
    return ranges.distinct().groupBy("did", "tid").agg(F.collect_list("first").alias("firsts"), F.collect_list("stop").alias("stops"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every row."""
    ranges = materialize(repeated(gather(docs, word_finder(window, gram), "repeat"), window, partitions(docs, 16 << 20)), "repeat-ranges")
    joined = keyed_texts(docs).join(ranges_by_text(ranges), ["did", "tid"], "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did = batch.column("did").to_numpy()
            for c in text_chunks(batch.column("text")):
                w = find_words(c.data, c.offsets, NOT_SPACE)
                rows = slice(c.lo, c.hi)
                firsts, stops = batch.column("firsts")[rows], batch.column("stops")[rows]
                gone = np.zeros(len(w.starts), dtype=bool)
                if len(flat := firsts.flatten()):
                    base = np.repeat(w.first[:-1], firsts.value_lengths().fill_null(0).to_numpy())
                    gone = cover(len(gone), flat.to_numpy() + base, stops.flatten().to_numpy() + base)
                seen = np.concatenate(([0], np.cumsum(gone)))
                removed = seen[w.first[1:]] - seen[w.first[:-1]]
                joined_bytes, a, b = one_space(w.data, w.starts[~gone], w.ends[~gone], _inside(w, ~gone))
                ends = np.concatenate(([0], np.cumsum(b - a + 1)))[w.first - seen[w.first]]
                kept = spans_to_binary(joined_bytes, ends[:-1], np.maximum(ends[1:] - 1, ends[:-1]))
                own = did[rows]
                yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(np.diff(w.first)), pa.array(removed), kept.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
        give_back()

    return joined.select("did", "text", "firsts", "stops").mapInArrow(of, "doc_id long, n_words long, n_removed long, kept string")


def _inside(w, keep: np.ndarray) -> np.ndarray:
    """The bytes of the words to keep."""
    return cover(len(w.data), w.starts[keep], w.ends[keep]) if keep.any() else np.zeros(len(w.data), dtype=bool)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
