"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its word shingles.  Documents with equal sets are one
vertex from the start.  Its signature has ``COORDS`` minwise tokens and, for
estimates, the least shingle hash in each of ``BINS`` ranges of hashes.

Each of ``TREES`` independent trees branches vertices: a node goes on to children
chosen by one minwise token each, and a vertex to the child named by its own
token, so a pair of similarity s stays together with probability s on each
branch.  No two trees, and no two nodes of a tree, choose the same token, so
their misses are independent: with branches of 2, 2 and 1, a pair of similarity
0.8 shares no leaf of a tree with probability 0.093, and none of six with 6e-7.

Leaves of up to ``SMALL`` members are compared exhaustively on signatures.  Of
the near pairs a node first gives only a spanning forest of its components, the
likeliest links first; links are confirmed on full sets and joined to
components, and only nodes that still hold several components give all their
near pairs between different ones, as lists.  A group of n copies thus costs
about n tests.  The first leaf alone goes first, as it is a partition; there,
larger groups are cut into parts of ``SMALL``.

Leaves with more members are compared with ``PIVOTS`` of them; what lies outside
the main component then meets all members in blocks, or, where more than
``OUTSIDE`` members do, the node is branched further, at most ``ROUNDS`` times.

A pair is near if the estimate isn't ``SURE`` standard deviations below the
threshold; at the threshold that drops it with probability about 1e-6.  Every
link is confirmed on the sets of 64-bit shingle hashes of both whole texts.
Texts are not sent about to find the few that are asked: a filter of fixed size
lets these pass, each goes to the blocks that test it, and a block holds at most
``HELD`` first ends while second ends stream past.

Defined results: texts without words are alone; equal sets have similarity 1,
so repeated rows are linked; a null doc_id never names a component that has
another one; rows that share a doc_id are told apart by their sets; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import BASES, NOT_SPACE, find_words, give_back, gram_hashes, group_blocks, list_column, mix, span_hash, text_chunks
from .components import connected_components
from .filters import key_filter, may_have
from .rows import NO_ID, keyed_rows, keyed_texts
from .storage import drop, materialize

TREES = 6
PICKS = (2, 2, 1)
#: Tokens of a tree: one for each node below its root.
PER_TREE = int(np.cumprod(PICKS).sum())
COORDS = TREES * PER_TREE
BINS = 256
#: Bytes of a signature: the tokens' lower bytes, their upper bytes, the bins.
SIG = 2 * COORDS + BINS
#: Picks of a further descent of large nodes, and how often it may be repeated.
DEEPER = (2, 1)
ROUNDS = 2
SMALL = 2048
PIVOTS = 4
#: Members outside a large node's main component up to which they meet all its members.
OUTSIDE = 4096
#: A large node's members that one task compares with a block of outsiders.
STREAMED = 1 << 16
SURE = 4.75
#: First ends that a confirming task holds at once, and second ends that one of them meets in a block of pairs.
HELD = 128
PARTNERS = 256
#: Vertices of which a group of the first leaf holds at most a part.
FIRST_PART = 1 << 20
U64 = np.uint64
_SALTS = mix(np.arange(1, 4096, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FACTORS = _SALTS[1000 : 1000 + COORDS] | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingle hashes, one document after the other, and each document's number of them."""
    w = find_words(data, offsets, NOT_SPACE, lower=True)
    hashes, n = w.hashes(), np.diff(w.first)
    grams = gram_hashes(hashes, width)
    short = np.flatnonzero((n > 0) & (n < width))
    whole = dict(zip(short.tolist(), span_hash(hashes, w.first[short], w.first[short + 1], BASES[1]), strict=True))
    out = []
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if i in whole:
            out.append(np.array([whole[i]], dtype=U64))
        else:
            out.append(np.unique(grams[a : max(a, b - width + 1)]))
    return np.concatenate(out) if out else np.zeros(0, dtype=U64), np.array([len(x) for x in out], dtype=np.int64)


def set_ids(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16 bytes for each set, the same for equal sets."""
    out = np.zeros((len(counts), 2), dtype=U64)
    if len(values):
        full = np.flatnonzero(counts)
        heads = (np.cumsum(counts) - counts)[full]
        for k in (0, 1):
            out[full, k] = np.add.reduceat(mix(values ^ _SALTS[k]), heads)
            out[:, k] = mix(out[:, k] + counts.astype(U64) * _SALTS[2 + k])
    return out


def minima(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """COORDS minwise tokens for each set that isn't empty."""
    heads = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(heads), COORDS), dtype=np.uint16)
    for k in range(COORDS):
        # The bits below the leading ones, which are near zero in a least value.
        out[:, k] = (np.minimum.reduceat((values ^ _SALTS[100 + k]) * _FACTORS[k], heads) & U64(0xFFFF)).astype(np.uint16) if len(heads) else 0
    return out


def bins(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each set a byte of the least value in each range of hashes, from 1 to 254; 0 where it has none. values: ascending in each set."""
    out = np.zeros(len(counts) * BINS, dtype=np.uint8)
    cell = np.repeat(np.arange(len(counts)) * BINS, counts) + (values // U64((1 << 64) // BINS)).astype(np.int64)
    first = np.ones(len(cell), dtype=bool)
    first[1:] = cell[1:] != cell[:-1]
    out[cell[first]] = 1 + (values[first] % U64(254)).astype(np.uint8)
    return out.reshape(-1, BINS)


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    tokens = minima(values, counts)
    out = np.zeros((len(counts), SIG), dtype=np.uint8)
    out[counts > 0, :COORDS] = tokens & 0xFF
    out[counts > 0, COORDS : 2 * COORDS] = tokens >> 8
    out[:, 2 * COORDS :] = bins(values, counts)
    return out


def _tokens(sig: np.ndarray) -> np.ndarray:
    return sig[:, :COORDS].astype(U64) | (sig[:, COORDS : 2 * COORDS].astype(U64) << U64(8))


def leaves(sig: np.ndarray) -> np.ndarray:
    """The leaves of all trees that each vertex reaches, in an order that is the same for all."""
    tokens, out, at = _tokens(sig), [], 0
    for t in range(TREES):
        paths = [np.full(len(sig), _SALTS[400 + t])]
        for n in PICKS:
            children = []
            for path in paths:
                for _ in range(n):
                    children.append(mix(path ^ mix(tokens[:, at] * U64(COORDS) + U64(at) + _SALTS[300])))
                    at += 1
            paths = children
        out += paths
    return np.stack(out, axis=1)


def descend(paths: np.ndarray, tokens: np.ndarray, picks: tuple[int, ...]) -> np.ndarray:
    """Children after len(picks) further levels, chosen by the node's path. paths: rows x nodes; tokens: rows x COORDS."""
    row = np.arange(len(paths))[:, None]
    for level, n in enumerate(picks):
        children = []
        for p in range(n):
            at = (mix(paths ^ _SALTS[200 + 8 * level + p]) % U64(COORDS)).astype(np.int64)
            children.append(mix(paths ^ mix(tokens[row, at] * U64(COORDS) + at.astype(U64) + _SALTS[301])))
        paths = np.concatenate(children, axis=1)
    return paths


def estimates(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Estimated similarity of each signature of a with each of b; -1 for pairs that are surely below the threshold."""
    x, y = a[:, 2 * COORDS :], b[:, 2 * COORDS :]
    # Empty ranges never match.
    left, right = np.concatenate((a[:, :COORDS], x), axis=1), np.concatenate((b[:, :COORDS], np.where(y == 0, 255, y)), axis=1)
    out = np.empty((len(a), len(b)), dtype=np.float32)
    p = percent / 100
    full_a, full_b = (x > 0).astype(np.float32), (y > 0).astype(np.float32)
    right = np.ascontiguousarray(right.T)
    for lo in range(0, len(a), 128):
        some = np.ascontiguousarray(left[lo : lo + 128].T)
        total = np.zeros((some.shape[1], len(b)), dtype=np.uint16)
        part = np.zeros(total.shape, dtype=np.uint8)
        for c in range(len(some)):
            part += some[c][:, None] == right[c][None, :]
            if c % 255 == 254 or c == len(some) - 1:
                total += part
                part[:] = 0
        fa = full_a[lo : lo + 128]
        samples = COORDS + fa.sum(1)[:, None] + full_b.sum(1)[None, :] - fa @ full_b.T
        est = total / samples
        est[total < samples * p - SURE * np.sqrt(samples * p * (1 - p))] = -1
        out[lo : lo + 128] = est
    return out


def _aligned_estimates(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """As estimates, of each row of a with the same row of b."""
    x, y = a[:, 2 * COORDS :], b[:, 2 * COORDS :]
    same = (a[:, :COORDS] == b[:, :COORDS]).sum(1) + ((x == y) & (x > 0)).sum(1)
    samples, p = COORDS + ((x | y) > 0).sum(1), percent / 100
    return np.where(same < samples * p - SURE * np.sqrt(samples * p * (1 - p)), -1, same / samples)


def forest(est: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the components ``part`` by the highest estimates above 0, in rounds that join each component to its nearest."""
    part = np.unique(part, return_inverse=True)[1]
    parent = np.arange(part.max() + 1)
    out = []
    while True:
        masked = np.where(part[:, None] == part[None, :], -1, est)
        best = masked.argmax(1)
        value = masked[np.arange(len(best)), best]
        order = np.lexsort((np.arange(len(best)), -value, part))
        head = order[np.concatenate(([True], part[order][1:] != part[order][:-1]))]
        joined = False
        for i in head[value[head] > 0].tolist():
            a, b = _top(parent, part[i]), _top(parent, part[best[i]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(best[i])))
                joined = True
        if not joined:
            return out
        part = np.array([_top(parent, x) for x in range(len(parent))])[part]


def _top(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        x = parent[x]
    return x


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The bytes of a binary column whose values all have ``width`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return data[start : start + len(column) * width].reshape(-1, width)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """did, tid, n, v (the set's id), sig."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in text_chunks(batch.column("text")):
                values, counts = shingle_sets(c.data, c.offsets, width)
                rows = slice(c.lo, c.hi)
                yield pa.RecordBatch.from_arrays([batch.column("did")[rows], batch.column("tid")[rows], pa.array(counts), _binary(set_ids(values, counts)), _binary(signatures(values, counts))], names=["did", "tid", "n", "v", "sig"])
        give_back()

    return keyed_texts(docs).mapInArrow(of, "did long, tid binary, n long, v binary, sig binary")


MEMBER = "node long, v binary, did long, tid binary, sig binary"


def deal_first(vertices: DataFrame, parts: int) -> DataFrame:
    """MEMBER rows of the first leaf of each vertex, in so many parts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), 16)
            node = mix(leaves(_matrix(batch.column("sig"), SIG))[:, 0] + _eight(v) % U64(parts))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(batch.column(c) for c in ("v", "did", "tid", "sig"))], names=["node", "v", "did", "tid", "sig"])

    return vertices.select("v", "did", "tid", "sig").mapInArrow(of, MEMBER)


def deal(vertices: DataFrame) -> DataFrame:
    """node, v for each leaf of each vertex."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = leaves(_matrix(batch.column("sig"), SIG))
            yield pa.RecordBatch.from_arrays([batch.column("v"), list_column(nodes.ravel().view(np.int64), np.full(len(nodes), nodes.shape[1]), pa.int64())], names=["v", "nodes"])

    return vertices.select("v", "sig").mapInArrow(of, "v binary, nodes array<long>").select(F.explode("nodes").alias("node"), "v")


def branch(members: DataFrame) -> DataFrame:
    """node, v for the children of members (node, v, sig) of large nodes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("node").to_numpy().view(U64)[:, None]
            children = descend(paths, _tokens(_matrix(batch.column("sig"), SIG)), DEEPER)
            yield pa.RecordBatch.from_arrays([batch.column("v"), list_column(children.ravel().view(np.int64), np.full(len(children), children.shape[1]), pa.int64())], names=["v", "nodes"])

    return members.select("node", "v", "sig").mapInArrow(of, "v binary, nodes array<long>").select(F.explode(F.array_distinct("nodes")).alias("node"), "v").distinct()


def _eight(v: np.ndarray) -> np.ndarray:
    """The first 8 bytes of ids of 16."""
    return np.ascontiguousarray(v).view(U64).reshape(-1, 2)[:, 0]


#: Rows to test: a block's first ends (kind 0, held), then second ends (kind 1) with the first ends that each meets; or, in ``open``, a node with more near pairs.
TESTS = "block long, kind int, v binary, did long, tid binary, others array<binary>, open long"


class _Tests:
    """Makes rows of TESTS about the rows of a table with v, did and tid."""

    def __init__(self, table):
        self.v, self.did, self.tid = (table.column(c) for c in ("v", "did", "tid"))
        self.ids = _matrix(self.v, 16)

    def rows(self, block: np.ndarray, kind: int, at: np.ndarray, others: pa.Array) -> pa.RecordBatch:
        at = pa.array(at)
        column = lambda c: x.combine_chunks() if isinstance(x := c.take(at), pa.ChunkedArray) else x
        return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(np.full(len(at), kind, dtype=np.int32)), column(self.v), column(self.did), column(self.tid), others, pa.nulls(len(at), pa.int64())], names=["block", "kind", "v", "did", "tid", "others", "open"])

    def pairs(self, a: np.ndarray, b: np.ndarray, salts: np.ndarray | None = None, first: _Tests | None = None) -> Iterator[pa.RecordBatch]:
        """Rows a (of ``first``) are held, each in a block of its own, or several for PARTNERS each; rows b come to them. salts: blocks for each pair's first end."""
        first = first or self
        salts = -(-np.bincount(a, minlength=1)[a] // PARTNERS) if salts is None else salts
        block = mix(_eight(first.ids)[a] + _eight(self.ids)[b] % salts.astype(U64)).view(np.int64)
        held = np.unique(np.stack((block, a), axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
        yield first.rows(held[:, 0], 0, held[:, 1], pa.nulls(len(held), pa.list_(pa.binary())))
        yield self.rows(block, 1, b, pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32)), _binary(first.ids[a])))

    def lists(self, block: int, held: np.ndarray, near: np.ndarray, first: _Tests | None = None) -> Iterator[pa.RecordBatch]:
        """near: whether each of ``held`` (rows of ``first``) is near each row."""
        first = first or self
        some = held[near.any(1)]
        yield first.rows(np.full(len(some), block), 0, some, pa.nulls(len(some), pa.list_(pa.binary())))
        at = np.flatnonzero(near.any(0))
        j, i = near[:, at].T.nonzero()
        yield self.rows(np.full(len(at), block), 1, at, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(near[:, at].sum(0)))).astype(np.int32)), _binary(first.ids[held[i]])))

    @staticmethod
    def opened(nodes: list[int]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(nodes), k) for k in kinds), pa.array(nodes, type=pa.int64())], names=["block", "kind", "v", "did", "tid", "others", "open"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Tables of whole groups, or of parts of SMALL of larger ones, with the bounds of these in them."""
    for table in group_blocks(batches, key, 4 * SMALL):
        ids = table.column(key).to_numpy()
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]))
        if (np.diff(bounds) > SMALL).any():
            bounds = np.unique(np.concatenate([*(np.arange(a, b, SMALL) for a, b in zip(bounds[:-1], bounds[1:], strict=True)), bounds]))
        yield bounds, table


def _numbered(roots: np.ndarray) -> np.ndarray:
    """A number for each root of 16 bytes, the same for equal ones."""
    words = np.ascontiguousarray(roots).view(U64).reshape(-1, 2)
    return np.unique(words[:, 0] ^ mix(words[:, 1]), return_inverse=True)[1]


def spanning(members: DataFrame, percent: int) -> DataFrame:
    """TESTS of pairs that join the components in each small node; of nodes that have more near pairs than that, the node in ``open``.

    members: MEMBER rows, with root where components are known.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, table in _groups(batches, "node"):
            tests, sig = _Tests(table), _matrix(table.column("sig"), SIG)
            part = _numbered(_matrix(table.column("root"), 16) if "root" in table.column_names else tests.ids)
            node, size = table.column("node").to_numpy(), np.diff(bounds)
            two = bounds[:-1][size == 2]
            two = two[part[two] != part[two + 1]]
            two = two[_aligned_estimates(sig[two], sig[two + 1], percent) > 0]
            a, b, open_ = [two], [two + 1], []
            for lo, hi in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist(), strict=True):
                own = part[lo:hi]
                if (own == own[0]).all():
                    continue
                est = estimates(sig[lo:hi], sig[lo:hi], percent)
                found = np.triu((est > 0) & (own[:, None] != own[None, :]), 1)
                near = int(found.sum())
                if not near:
                    continue
                x, y = found.nonzero() if near <= hi - lo else np.array(forest(est, own)).T
                if len(x) < near:
                    open_.append(node[lo])
                # The end with more partners is held, the others come to it.
                degree = np.bincount(np.concatenate((x, y)), minlength=hi - lo)
                swap = degree[y] > degree[x]
                a.append(lo + np.where(swap, y, x))
                b.append(lo + np.where(swap, x, y))
            yield from tests.pairs(np.concatenate(a), np.concatenate(b))
            yield tests.opened(open_)
        give_back()

    return members.repartition("node").sortWithinPartitions("node", "v").mapInArrow(of, TESTS)


def with_pivots(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """TESTS of each large node's members with the likeliest of its pivots. pivots: node, others (at most PIVOTS of v, did, tid, sig, root)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.column("others")
            counts = np.diff(others.offsets.to_numpy())
            flat, row = others.flatten(), np.repeat(np.arange(batch.num_rows), counts)
            chosen = pa.RecordBatch.from_struct_array(flat)
            est = _aligned_estimates(_matrix(batch.column("sig"), SIG)[row], _matrix(chosen.column("sig"), SIG), percent)
            est[(_matrix(batch.column("root"), 16)[row] == _matrix(chosen.column("root"), 16)).all(1)] = -1
            order = np.lexsort((-est, row))
            best = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))] if len(order) else order
            best = best[est[best] > 0]
            own, first = _Tests(batch), _Tests(chosen)
            b = row[best]
            yield from own.pairs(best, b, -(-batch.column("size").to_numpy()[b] // PARTNERS), first)

    return members.join(pivots, "node").select("v", "did", "tid", "sig", "root", "size", "others").mapInArrow(of, TESTS)


def all_near(members: DataFrame, percent: int) -> DataFrame:
    """TESTS of all near pairs between different components in small nodes. members: MEMBER rows with root."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, table in _groups(batches, "node"):
            sig, part, node = _matrix(table.column("sig"), SIG), _numbered(_matrix(table.column("root"), 16)), table.column("node").to_numpy()
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own, tests = part[lo:hi], _Tests(table.slice(lo, hi - lo))
                outside = np.flatnonzero(own != np.bincount(own).argmax())
                for at in range(0, len(outside), HELD):
                    some = outside[at : at + HELD]
                    near = (estimates(sig[lo:hi][some], sig[lo:hi], percent) > 0) & (own[some][:, None] != own[None, :])
                    # Pairs inside the block once.
                    near[:, some] &= some[:, None] < some[None, :]
                    # A pair of this block and an earlier one is that one's.
                    near[:, outside[:at]] = False
                    yield from tests.lists(int(node[lo]) ^ (at // HELD), some, near)
        give_back()

    return members.repartition("node").sortWithinPartitions("node", "v").mapInArrow(of, TESTS)


def blocks_near(members: DataFrame, percent: int) -> DataFrame:
    """TESTS of all near pairs of blocks of outsiders with the members of large nodes.

    members: MEMBER rows with root, size, rest, main.  A task has about HELD
    outsiders of a node and STREAMED of its members.
    """
    salts, chunks = F.ceil(F.col("size") / STREAMED), F.ceil(F.col("rest") / HELD)
    number, columns = F.pmod(F.xxhash64("v"), chunks), ["v", "did", "tid", "sig", "root"]
    out = members.filter("root <> main").select("node", number.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("kind"), *columns, number.alias("own"))
    every = members.select("node", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), F.pmod(F.xxhash64("v", F.lit(1)), salts).alias("salt"), F.lit(1).alias("kind"), *columns, F.when(F.col("root") != F.col("main"), number).otherwise(-1).alias("own"))
    rows = out.unionByName(every).withColumn("block", F.xxhash64("node", "chunk", "salt"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            block, kind, chunk, own = (batch.column(c).to_numpy() for c in ("block", "kind", "chunk", "own"))
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(block)], strict=True):
                part = batch.slice(lo, hi - lo)
                if block[lo] != current:
                    current, held = block[lo], []
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                outside = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, first, tests = [outside], _Tests(outside), _Tests(part)
                near = (estimates(_matrix(outside.column("sig"), SIG), _matrix(part.column("sig"), SIG), percent) > 0) & (_matrix(outside.column("root"), 16)[:, None] != _matrix(part.column("root"), 16)[None, :]).any(2)
                # A pair of outsiders belongs to the block with the lower number, or to the order of ids in one.
                near &= ~((own[lo:hi] >= 0) & (own[lo:hi] < chunk[lo:hi]))[None, :]
                for j in np.flatnonzero((own[lo:hi] == chunk[lo:hi]) & near.any(0)).tolist():
                    near[:, j] &= [x.tobytes() < tests.ids[j].tobytes() for x in first.ids]
                yield from tests.lists(int(current), np.arange(len(first.ids)), near, first)

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(of, TESTS)


class Links:
    """Confirms candidate pairs on full sets and keeps the components so far."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.roots: DataFrame | None = None

    def texts_of(self, tests: DataFrame) -> DataFrame:
        """did, tid, text of the rows that are asked, and of few others."""
        words = tests.sparkSession.sparkContext.broadcast(key_filter(tests.select(F.xxhash64("did", "tid").alias("h"))))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may_have(words.value, batch.column("h").to_numpy()))).select(["did", "tid", "text"])

        texts = keyed_texts(self.docs).withColumn("h", F.xxhash64("did", "tid")).mapInArrow(of, "did long, tid binary, text string")
        return texts.dropDuplicates(["did", "tid"])

    def confirm(self, tests: DataFrame) -> None:
        """Test the pairs in rows of TESTS and join the links to components."""
        tests = tests.filter("block is not null").drop("open")
        if tests.isEmpty():
            return
        width, percent = self.width, self.percent
        # Nodes of several trees ask for the same pairs.
        ready = tests.distinct().join(self.texts_of(tests), ["did", "tid"]).select("block", "kind", "v", "others", "text")

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, held = None, {}
            for batch in batches:
                block, kind, v, others = batch.column("block").to_numpy(), batch.column("kind").to_numpy(), batch.column("v").to_pylist(), batch.column("others").to_pylist()
                us, vs = [], []
                for c in text_chunks(batch.column("text")):
                    values, counts = shingle_sets(c.data, c.offsets, width)
                    ends = np.cumsum(counts)
                    for i in range(c.lo, c.hi):
                        if block[i] != current:
                            current, held = block[i], {}
                        x = values[ends[i - c.lo] - counts[i - c.lo] : ends[i - c.lo]]
                        if not kind[i]:
                            held[v[i]] = x.copy()
                            continue
                        for other in others[i]:
                            if linked(x, held[other], percent):
                                us.append(other)
                                vs.append(v[i])
                yield pa.RecordBatch.from_arrays([pa.array(us, type=pa.binary()), pa.array(vs, type=pa.binary())], names=["u", "v"])
            give_back()

        new = materialize(ready.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(of, "u binary, v binary"), "near-links")
        known = self.roots
        self.roots = connected_components(new if known is None else new.unionByName(known.select("u", F.col("root").alias("v"))))
        drop(new, known)

    def rooted(self, rows: DataFrame) -> DataFrame:
        """rows (v, ...) with the root of each vertex's component so far."""
        if self.roots is None:
            return rows.withColumn("root", F.col("v"))
        return rows.join(self.roots.withColumnRenamed("u", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, ascending, reach the threshold."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def open_members(dealt: DataFrame, vertices: DataFrame, links: Links) -> DataFrame:
    """MEMBER rows with size and root of the nodes that hold several components. dealt: node, v."""
    rooted = links.rooted(dealt)
    # 64 bits of a root tell roots apart. Written out, so that a node with very many members is a skewed join that Spark splits.
    mark = F.xxhash64("root")
    several = materialize(rooted.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("node", "size"), "near-several")
    members = materialize(rooted.join(several, "node").join(vertices.select("v", "did", "tid", "sig"), "v"), "near-members")
    drop(several)
    return members


def join_members(members: DataFrame, percent: int) -> DataFrame:
    """TESTS that join the components of each node by likely links, and in ``open`` the small nodes that have more near pairs."""
    tests = spanning(members.filter(F.col("size") <= SMALL).drop("size"), percent)
    big = members.filter(F.col("size") > SMALL)
    if not big.isEmpty():
        # Members with the least hashes, others in each node.
        h = F.xxhash64("node", "v")
        some = big.withColumn("h", h).filter(F.col("h").cast("double") + float(1 << 63) < float(1 << 64) * 16 * PIVOTS / F.col("size"))
        listed = some.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "v", "did", "tid", "sig", "root"))), 1, PIVOTS).alias("others"))
        tests = tests.unionByName(with_pivots(big, materialize(listed, "near-pivots"), percent))
    return materialize(tests, "near-tests")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """did, tid, n, root (the group's key), component (least doc_id reachable, or null) for every row."""
    rows = materialize(sketch(docs, width), "near-sketch")
    vertices = rows.filter("n > 0").groupBy("v").agg(F.min(F.struct("did", "tid")).alias("m"), F.first("sig").alias("sig"), F.min(F.when(F.col("did") != NO_ID, F.col("did"))).alias("least"))
    vertices = materialize(vertices.select("v", "m.did", "m.tid", "least", "sig"), "near-vertices")
    links = Links(docs, width, percent)
    tests = materialize(spanning(deal_first(vertices, 1 + vertices.count() // FIRST_PART), percent), "near-first")
    links.confirm(tests)
    drop(tests)
    dealt = deal(vertices)
    for depth in range(ROUNDS + 1):
        members = open_members(dealt, vertices, links)
        tests = join_members(members, percent)
        links.confirm(tests)
        # What is left: nodes that still hold several components.
        more = tests.filter("open is not null").select(F.col("open").alias("node"))
        small = links.rooted(members.join(more, "node", "left_semi").drop("root", "size"))
        left = all_near(small, percent)
        big, rest = members.filter(F.col("size") > SMALL), None
        if not big.isEmpty():
            known = links.rooted(big.drop("root"))
            parts = known.groupBy("node", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("all"))
            parts = materialize(parts.select("node", F.col("top.root").alias("main"), (F.col("all") - F.col("top.k")).alias("rest")).filter("rest > 0"), "near-parts")
            known = materialize(known.join(parts, "node"), "near-open")
            few = known if depth == ROUNDS else known.filter(F.col("rest") <= OUTSIDE)
            left = left.unionByName(blocks_near(few, percent))
            rest = known.filter(F.col("rest") > OUTSIDE)
        if rest is not None or not more.isEmpty():
            left = materialize(left, "near-left")
            links.confirm(left)
            drop(left)
        drop(tests, members)
        if depth == ROUNDS or rest is None or rest.isEmpty():
            break
        dealt = materialize(branch(rest), "near-dealt")
    own = vertices.select("v", F.col("v").alias("root"), F.col("least").alias("component"))
    if links.roots is not None:
        # Only what is linked needs to meet.
        linked_ = links.roots.withColumnRenamed("u", "v").unionByName(links.roots.select(F.col("root").alias("v"), "root").distinct())
        named = linked_.join(vertices.select("v", "least"), "v")
        named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root")
        named = materialize(named.select("v", "root", "component"), "near-named")
        out = rows.select("did", "tid", "n", "v").join(own, "v", "left").join(named.select("v", F.col("root").alias("top"), F.col("component").alias("of_top")), "v", "left")
        component = F.when(F.col("top").isNotNull(), F.col("of_top")).otherwise(F.col("component"))
        out = out.select("did", "tid", "n", F.coalesce("top", "root").alias("root"), component.alias("component"))
    else:
        out = rows.select("did", "tid", "n", "v").join(own, "v", "left").select("did", "tid", "n", "root", "component")
    alone = F.when(F.col("did") != NO_ID, F.col("did"))
    return out.select("did", "tid", "n", "root", F.when(F.col("n") > 0, F.col("component")).otherwise(alone).alias("component"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those whose component has another representative; rows without words all stay."""
    found = near_duplicates(docs, width, percent)
    # The representative's text; of its repeated rows one stays.
    own = F.when(F.col("did") != NO_ID, F.col("did")).eqNullSafe(F.col("component"))
    kept = found.filter(own & (F.col("n") > 0)).groupBy("root").agg(F.min(F.struct("did", "tid")).alias("m")).select("m.did", "m.tid", F.lit(False).alias("alone"))
    kept = kept.unionByName(found.filter("n = 0").select("did", "tid", F.lit(True).alias("alone")).distinct())
    kept = materialize(kept, "near-kept")
    joined = keyed_rows(docs).join(kept, ["did", "tid"])
    place = F.when(F.col("alone"), F.monotonically_increasing_id())
    return joined.withColumn("place", place).dropDuplicates(["did", "tid", "place"]).select("row.*")


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, width=4, percent=80)
    doc_id = F.when(F.col("did") != NO_ID, F.col("did"))
    return found.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), doc_id.eqNullSafe(F.col("component")).alias("kept"))
