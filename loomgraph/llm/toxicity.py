"""Toxicity scores from a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings, hashed into ``BUCKETS``
buckets.  Training counts in how many toxic and clean documents each bucket
occurs, keeps the ``FEATURES`` buckets that tell the classes apart best and up
to ``PAIRED`` more that do so beside another one (see ``mates``), and fits bias, weights and ``FACTORS`` factors for each by Adam on the logistic
loss.  The factors' inner products weigh pairs of terms, such as an insult with
the mention of a group, that no sum of single weights expresses.

Only training is bounded: it reads at most about ``TRAIN_ROWS`` labelled rows,
chosen by a hash of doc_id.  Scoring reads every whole text.  Model and lookup
table have a fixed size and are broadcast.

Defined results: null, empty and word-less texts get the bias alone; null
labels don't train; a doc_id labelled twice trains twice; without labels of
both classes every score is the share of toxic labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import LETTERS, find_words, give_back, mix, span_hash, text_chunks

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
FEATURES = 4096
FACTORS = 8
TRAIN_ROWS = 24_000
PREFIXES = (4, 5, 6)
LEAST_CHI2 = 20.0
THRESHOLD = 0.7
#: A bucket needs this many documents, and an odds ratio so far from 1, whatever the share of toxic labels: weak hints add up in long texts.
LEAST_DOCS = 6
ODDS = 3.0
#: Buckets that are taken for pairs, the hints and buckets that are tried for it, and the chi2 that a pair needs among so many.
PAIRED = 64
HINTS = 32
MATES = 8192
LEAST_PAIR_CHI2 = 40.0


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, bucket) pairs of a chunk, sorted."""
    w = find_words(data, offsets, LETTERS, lower=True)
    doc, size = w.doc(), w.ends - w.starts
    docs, hashes = [doc], [span_hash(w.data, w.starts, w.ends, 0x9E3779B97F4A7C15)]
    for n in PREFIXES:
        long = size > n
        docs.append(doc[long])
        hashes.append(mix(span_hash(w.data, w.starts[long], w.starts[long] + n, 0x9E3779B97F4A7C15) + np.uint64(n)))
    bucket = (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    pairs = np.unique((np.concatenate(docs) << BUCKET_BITS) | bucket)
    return pairs >> BUCKET_BITS, pairs & (BUCKETS - 1)


class Machine(NamedTuple):
    """lookup: bucket to feature or -1."""

    lookup: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """Scores of ``rows`` rows from (row, feature) pairs sorted by row."""
        return 1 / (1 + np.exp(-np.clip(self._raw(row, feature, rows)[0], -40, 40)))

    def _raw(self, row, feature, rows):
        linear = np.bincount(row, weights=self.weights[feature], minlength=rows)
        v = self.factors[feature]
        total = np.zeros((rows, v.shape[1]))
        square = np.zeros(rows)
        if len(row):
            heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            total[row[heads]] = np.add.reduceat(v, heads, axis=0)
            square = np.bincount(row, weights=(v * v).sum(1), minlength=rows)
        return self.bias + linear + 0.5 * ((total * total).sum(1) - square), total

    def of_texts(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for c in text_chunks(column):
            doc, bucket = terms(c.data, c.offsets)
            feature = self.lookup[bucket]
            known = feature >= 0
            out.append(self.scores(doc[known], feature[known], c.hi - c.lo))
        return np.concatenate(out)


def fit(row: np.ndarray, feature: np.ndarray, y: np.ndarray, features: int, steps: int = 400, rate: float = 0.05, penalty: float = 1e-5) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by full-batch Adam. (row, feature): pairs sorted by row.

    Each step leaves out half of the pairs at random, so that a term has to tell
    on its own what it mostly tells together with others.
    """
    n, rng = len(y), np.random.default_rng(7)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(features), rng.normal(0, 0.01, (features, FACTORS))
    state = [np.zeros((2, *np.shape(x))) for x in (bias, w, v)]
    everything = row, feature
    for t in range(1, steps + 1):
        half = rng.random(len(everything[0])) < 0.5
        row, feature = everything[0][half], everything[1][half]
        raw, total = Machine(np.zeros(0), bias, w, v)._raw(row, feature, n)
        error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y) / n
        e = error[row]
        grads = [error.sum(), np.bincount(feature, weights=e, minlength=features) + penalty * w, np.empty_like(v)]
        for f in range(FACTORS):
            grads[2][:, f] = np.bincount(feature, weights=e * (total[row, f] - v[feature, f]), minlength=features) + 10 * penalty * v[:, f]
        new = []
        for x, g, s in zip((bias, w, v), grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            new.append(x - rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-10))
        bias, w, v = float(new[0]), new[1], new[2]
    return bias, w, v


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def contrast(toxic, clean, all_toxic, all_clean):
    """chi2 and odds ratio (each count half more) of terms with so many of all toxic and clean documents; for columns and arrays."""
    n, both = all_toxic + all_clean, toxic + clean
    cross = toxic * (all_clean - clean) - clean * (all_toxic - toxic)
    chi2 = n * cross * cross / (both * (n - both) * all_clean * all_toxic)
    return chi2, (toxic + 0.5) * (all_clean - clean + 0.5) / ((clean + 0.5) * (all_toxic - toxic + 0.5))


def mates(sample: DataFrame, counts: DataFrame, taken: list[int], clean: int, toxic: int) -> list[int]:
    """Buckets that tell the classes apart among the documents of a hint, though not by themselves.

    Hints are buckets that lean to toxic documents but occur in both classes,
    such as a soft insult; the most frequent buckets of toxic documents are
    tried beside each, such as a group's name that is mostly used in clean ones.
    """
    chi2, odds = contrast(F.col("toxic").cast("double"), F.col("clean").cast("double"), float(toxic), float(clean))
    known = counts.filter((F.col("bucket") >= 0) & (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") + F.col("clean") < clean + toxic))
    hints = known.filter((F.col("clean") >= LEAST_DOCS) & (odds > 1) & (chi2 >= LEAST_CHI2)).orderBy(F.desc(chi2), "bucket").limit(HINTS).collect()
    tried = [r["bucket"] for r in known.orderBy(F.desc("toxic"), "bucket").limit(MATES + len(taken)).collect()]
    tried = np.array(sorted(set(tried) - set(taken)), dtype=np.int64)
    if not hints or not len(tried):
        return []
    of_hint, of_mate = np.full(BUCKETS, -1, dtype=np.int32), np.full(BUCKETS, -1, dtype=np.int32)
    of_hint[[r["bucket"] for r in hints]] = np.arange(len(hints))
    of_mate[tried] = np.arange(len(tried))
    width = len(tried)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, len(hints) * width), dtype=np.int32)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for c in text_chunks(batch.column("text")):
                doc, bucket = terms(c.data, c.offsets)
                mate = of_mate[bucket]
                at = np.flatnonzero(mate >= 0)
                first = np.searchsorted(doc[at], np.arange(c.hi - c.lo + 1))
                for i in np.flatnonzero(of_hint[bucket] >= 0).tolist():
                    d = doc[i]
                    seen[y[c.lo + d], of_hint[bucket[i]] * width + mate[at[first[d] : first[d + 1]]]] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at].astype(np.int64)), pa.array(seen[1, at].astype(np.int64))], names=["pair", "clean", "toxic"])

    pairs = sample.mapInArrow(count, "pair long, clean long, toxic long").groupBy("pair").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("clean") + F.col("toxic") >= LEAST_DOCS).toArrow()
    pair, c, t = (pairs.column(n).to_numpy() for n in ("pair", "clean", "toxic"))
    all_c, all_t = (np.array([r[n] for r in hints], dtype=float)[pair // width] for n in ("clean", "toxic"))
    some = np.flatnonzero(c + t < all_c + all_t)
    chi2, odds = contrast(t[some].astype(float), c[some].astype(float), all_t[some], all_c[some])
    good = np.flatnonzero((chi2 >= LEAST_PAIR_CHI2) & ((odds >= ODDS) | (odds <= 1 / ODDS)))
    best = np.zeros(width)
    np.maximum.at(best, pair[some[good]] % width, chi2[good])
    order = np.lexsort((tried, -best))[:PAIRED]
    # A hint may itself be too weak to be taken alone.
    mated = order[best[order] > 0]
    partners = {hints[p // width]["bucket"] for p in pair[some[good]].tolist()}
    return [*tried[mated].tolist(), *sorted(partners - set(taken) - set(tried[mated].tolist()))]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit a machine on the labelled documents that aren't held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("label_id"), (F.col("toxic") > 0).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    known = usable.count()
    chosen = usable.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, known)))).limit(2 * rows)
    # Of bounded size, see ``rows``.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("y", "label_id", F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), dtype=np.int64)
        n = np.zeros(2, dtype=np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            n += np.bincount(y, minlength=2)
            for c in text_chunks(batch.column("text")):
                doc, bucket = terms(c.data, c.offsets)
                of = y[c.lo : c.hi][doc]
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[of == k], minlength=BUCKETS)
        at = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0, at], n[0])), pa.array(np.append(seen[1, at], n[1]))], names=["bucket", "clean", "toxic"])

    counts = sample.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    totals = counts.filter("bucket = -1").collect()
    clean, toxic = (totals[0]["clean"], totals[0]["toxic"]) if totals else (0, 0)
    lookup = np.full(BUCKETS, -1, dtype=np.int32)
    if not clean or not toxic:
        counts.unpersist()
        share = toxic / (clean + toxic) if clean + toxic else 0.5
        return Machine(lookup, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(1), np.zeros((1, FACTORS)))
    both = F.col("toxic") + F.col("clean")
    chi2, odds = contrast(F.col("toxic").cast("double"), F.col("clean").cast("double"), float(toxic), float(clean))
    best = counts.filter(F.col("bucket") >= 0).filter((both >= LEAST_DOCS) & (both < clean + toxic) & ((odds >= ODDS) | (odds <= 1 / ODDS))).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "bucket").limit(FEATURES).select("bucket").collect()
    best = [r["bucket"] for r in best]
    best += mates(sample, counts, best, clean, toxic)
    counts.unpersist()
    lookup[best] = np.arange(len(best))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in text_chunks(batch.column("text")):
                doc, bucket = terms(c.data, c.offsets)
                feature = lookup[bucket]
                known = feature >= 0
                sizes = np.bincount(doc[known], minlength=c.hi - c.lo)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(c.lo, c.hi - c.lo) for x in ("y", "label_id", "mark")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature[known]))], names=["y", "label_id", "mark", "found"])

    # Fitting depends on the order of rows, so it mustn't depend on how the tables are cut.
    got = sample.mapInArrow(features, "y int, label_id long, mark long, found array<int>").toArrow().sort_by([(x, "ascending") for x in ("label_id", "mark", "y")])
    y = got.column("y").to_numpy().astype(float)
    found = got.column("found").combine_chunks()
    sizes = np.diff(found.offsets.to_numpy()) if len(found) else np.zeros(0, dtype=int)
    row = np.repeat(np.arange(len(y)), sizes)
    return Machine(lookup, *fit(row, found.flatten().to_numpy().astype(np.int64), y, max(1, len(best))))


def score(spark, text: Column, machine: Machine) -> Column:
    """The score of a text column."""
    # Plain values: workers need no class of this library to read them.
    shipped = spark.sparkContext.broadcast(tuple(machine))

    # Arrow's own arrays: no text becomes a Python object.
    @F.arrow_udf("double")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = Machine(*shipped.value)
        for column in texts:
            yield pa.array(machine.of_texts(column))
        give_back()

    return of(text.cast("string"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below ``threshold``."""
    machine = train(docs, labels)
    return docs.filter(score(docs.sparkSession, F.col("text"), machine) < threshold)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(spark, F.col("text"), machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
