"""Benchmark decontamination by winnowing.

Training and test texts are cut into words.  Of the hashes of each ``SPAN``
consecutive 5-word grams the least is a fingerprint, on both sides by the same
rule; with 10-word windows that is 6 grams, so any shared window holds a shared
fingerprint.  Fingerprints of documents are looked up among those of the
benchmark, each hit is extended to the windows around it, and these are
compared with the benchmark's windows word for word.  A test item shorter than
a window is one window; such lengths have whole-item fingerprints.

The benchmark's windows are a table, made on the executors.  Where it has at most
``LOCAL_WINDOWS`` rows, which is counted first, it goes to all executors and one
pass over the documents gives the results.  A larger one stays a table: a filter
of fixed size (``filters``) lets those windows of documents through whose
fingerprint the benchmark may have, and a join on fingerprint and words finds
the shared ones.  The driver and what is broadcast have a bound either way.

Defined results: null or word-less texts have no hits, and such items occur
nowhere; repeated items count by distinct item_id, and a null item_id is the
empty string; rows that share doc_id and text have the same result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import ALNUM, Words, cover, find_words, gram_hashes, mix, sliding_min, text_chunks
from .filters import key_filter, may_have
from .rows import NO_ID, keyed_rows, keyed_texts
from .storage import drop, materialize

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: Windows of test items that are sent to all executors at most.
LOCAL_WINDOWS = 200_000


def prints(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the n-word windows that lie inside their texts, and fingerprints."""
    if len(w.starts) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if n == WINDOW:
        found = sliding_min(gram_hashes(w.hashes(), GRAM), SPAN)
    else:
        found = mix(gram_hashes(w.hashes(), n) + np.uint64(n))
    at = np.flatnonzero(np.arange(len(found)) + n <= w.stop()[: len(found)])
    return at, found[at]


def spelled(w: Words, at: np.ndarray, n: int) -> list[bytes]:
    """The words of windows, joined by one space."""
    text = memoryview(w.data)
    return [b" ".join([bytes(text[a:b]) for a, b in zip(w.starts[i : i + n].tolist(), w.ends[i : i + n].tolist(), strict=True)]) for i in at.tolist()]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """n, print, words, items of the distinct windows of test items."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in text_chunks(batch.column("text")):
                w = find_words(c.data, c.offsets, ALNUM, lower=True)
                size = np.diff(w.first)
                for n in np.unique(np.minimum(size, WINDOW)).tolist():
                    if not n:
                        continue
                    at, found = prints(w, n)
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    own = np.flatnonzero(np.minimum(size[doc], WINDOW) == n)
                    yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(c.lo + doc[own])), pa.array(np.full(len(own), n, dtype=np.int32)), pa.array(found[own].view(np.int64)), pa.array(spelled(w, at[own], n), type=pa.binary())], names=["item", "n", "print", "words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "item string, n int, print long, words binary").groupBy("n", "print", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Index(NamedTuple):
    """Windows of test items: by length their sorted fingerprints, and the items that each window's words occur in."""

    prints: dict[int, np.ndarray]
    items: dict[bytes, tuple[str, ...]]


def local_index(windows: DataFrame) -> Index:
    """All windows, of which there are at most LOCAL_WINDOWS."""
    rows = windows.toArrow()
    n, found = rows.column("n").to_numpy(), rows.column("print").to_numpy().view(np.uint64)
    return Index({k: np.unique(found[n == k]) for k in np.unique(n).tolist()}, {w: tuple(i) for w, i in zip(rows.column("words").to_pylist(), rows.column("items").to_pylist(), strict=True)})


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def hits(data: np.ndarray, offsets: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Words per document, whether each word is hit, and the items found in each document that has any."""
    w = find_words(data, offsets, ALNUM, lower=True)
    found: dict[int, set[str]] = defaultdict(set)
    first, last, doc = [], [], w.doc()
    for n, table in index.prints.items():
        at, own = prints(w, n)
        at = at[among(own, table)]
        for i, words in zip(at.tolist(), spelled(w, at, n), strict=True):
            if items := index.items.get(words):
                first.append(i)
                last.append(i + n)
                found[int(doc[i])].update(items)
    hit = cover(len(w.starts), np.array(first), np.array(last)) if first else np.zeros(len(w.starts), dtype=bool)
    return np.diff(w.first), hit, found


def item_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and per row did and tid to join by."""
    windows = materialize(benchmark_windows(benchmark), "leak-windows")
    if windows.count() > LOCAL_WINDOWS:
        return joined_contamination(docs, windows)
    # Plain values: workers need no class of this library to read them.
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(local_index(windows)))
    drop(windows)
    return keyed_texts(docs).mapInArrow(lambda batches: _whole(batches, Index(*shipped.value)), f"did long, tid binary, {OUT}")


def _whole(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    none = item_digest(())
    for batch in batches:
        did = batch.column("did").to_numpy()
        for c in text_chunks(batch.column("text")):
            n, hit, found = hits(c.data, c.offsets, index)
            first = np.concatenate(([0], np.cumsum(n)))
            seen = np.concatenate(([0], np.cumsum(hit)))
            n_hit = seen[first[1:]] - seen[first[:-1]]
            own = did[c.lo : c.hi]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), batch.column("tid").slice(c.lo, c.hi - c.lo), pa.array(own, mask=own == NO_ID), pa.array(n.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(found.get(i, ())) for i in range(len(n))], type=pa.int64()), pa.array([item_digest(found[i]) if i in found else none for i in range(len(n))]), pa.array(n_hit > 0)],
                names=["did", "tid", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )


def likely_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """A row for each document with n_words, and one for each of its windows whose fingerprint the benchmark may have: first word, length, fingerprint, words."""

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Fingerprints are least values, whose leading bits are near zero.
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column("print").to_numpy().view(np.uint64)).view(np.int64))], names=["h"])

    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # WINDOW of them at most
    shipped = docs.sparkSession.sparkContext.broadcast(key_filter(windows.select("print").mapInArrow(mixed, "h long")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["did", "tid", "n_words", "first", "n", "print", "words"]
        for batch in batches:
            for c in text_chunks(batch.column("text")):
                w = find_words(c.data, c.offsets, ALNUM, lower=True)
                size, doc = c.hi - c.lo, w.doc()
                yield pa.RecordBatch.from_arrays([batch.column("did")[c.lo : c.hi], batch.column("tid")[c.lo : c.hi], pa.array(np.diff(w.first).astype(np.int64)), *(pa.nulls(size, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=names)
                for n in lengths:
                    at, found = prints(w, n)
                    some = may_have(shipped.value, mix(found))
                    at, found = at[some], found[some]
                    row = pa.array(c.lo + doc[at])
                    yield pa.RecordBatch.from_arrays([batch.column("did").take(row), batch.column("tid").take(row), pa.nulls(len(at), pa.int64()), pa.array((at - w.first[doc[at]]).astype(np.int32)), pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(found.view(np.int64)), pa.array(spelled(w, at, n), type=pa.binary())], names=names)

    return keyed_texts(docs).mapInArrow(of, "did long, tid binary, n_words long, first int, n int, print long, words binary")


def joined_contamination(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """As find_contamination, for a benchmark that stays a table."""
    rows = materialize(likely_windows(docs, windows), "leak-likely")
    shared = rows.filter("n_words is null").join(windows, ["n", "print", "words"]).select("did", "tid", "first", (F.col("first") + F.col("n")).alias("stop"), "items")
    # Words of a window that no window before it covers.
    before = Window.partitionBy("did", "tid").orderBy("first", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("first", F.coalesce(F.max("stop").over(before), F.lit(0))))
    found = shared.withColumn("fresh", fresh).groupBy("did", "tid").agg(F.sum("fresh").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = rows.filter("n_words is not null").select("did", "tid", "n_words").join(found, ["did", "tid"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("did", "tid", F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without the contaminated ones."""
    # Written out, so that its size is known and few of them are sent to the texts, not the texts to them.
    bad = materialize(find_contamination(docs, benchmark).filter("contaminated").select("did", "tid").distinct(), "leaks")
    return keyed_rows(docs).join(bad, ["did", "tid"], "left_anti").select("row.*")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
