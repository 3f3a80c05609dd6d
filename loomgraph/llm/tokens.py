"""Token-ID output: Parquet list columns that can be read selectively.

Documents are dealt to ranges of doc_id, sorted and encoded there, and written
as Parquet rows (part, doc_id, part_start, n_tokens, ids).  ids is a list
column with dictionary encoding (delta encoding where a dictionary grows too
large), in row groups and pages of set sizes with page indexes, so a reader can
take n_tokens without the ids, or the ids of a doc_id range without the rest.
A document's place in the whole stream is its place in its file plus the
tokens of the files before, one number for each file; these numbers are written
out first, so that they are sent to the ids and the ids stay where they are.

Encoding keeps a table of pieces.  A single space between two characters that
aren't white space always begins a pre-token, so the pieces of a text cut there
can be encoded apart, and so does a single line feed; texts with other spacing,
and those that hold the name of a special token, are encoded whole.

Defined results: a null or empty text has only the end id; rows that share a
doc_id all stay, ordered by their texts' hash, then text; a null doc_id comes first; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import _table, give_back, list_column, text_chunks
from .rows import NO_ID, did, partitions
from .storage import materialize, new_path, setting, tidy

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Marks that may end a piece; an apostrophe can begin a pre-token with the letters after it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Runs of marks whose ids a worker keeps.
RUNS = 4_096
#: Pieces that a worker keeps, of those that it met before; others are encoded anew each time.
TABLE_SIZE = 340_000
#: Bits that note which pieces a worker met.
MET_BITS = 25
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
FORMAT = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}
#: Spark's setting for lists of two levels, that is without a group around each id; a list's ids are never null.
TWO_LEVELS = "spark.sql.parquet.writeLegacyFormat"
SCHEMA = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("doc_id", "part_start", "n_tokens")), T.StructField("ids", T.ArrayType(T.IntegerType(), containsNull=False))])

#: The characters that stand for bytes in the vocabulary's pieces: printable bytes for themselves, the others by those from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_CHARS = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256))
#: Latin letters, which every version of Unicode has as such, and marks after them.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_WORD = re.compile(f"([{LATIN}]+)([{re.escape(MARKS)}]*)").fullmatch
#: ASCII white space but the space and the line feed.
RARE_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f"
_SPACES = _table((0x20, 0x20), (0x09, 0x0D), (0x1C, 0x1F))


def odd_spacing(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts in which a space isn't single between other characters, or white space isn't ASCII."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, dtype=bool)
    white = _SPACES[data]
    padded = np.ones(len(data) + 2, dtype=bool)
    padded[1:-1] = white
    left, right = padded[:-2].copy(), padded[2:].copy()
    full = offsets[:-1] < offsets[1:]
    left[offsets[:-1][full]] = True
    right[offsets[1:][full] - 1] = True
    odd = (data == 0x20) & (left | right)
    if data.max() >= 0x80:
        a, b, c = data, np.append(data[1:], 0), np.append(data[2:], [0, 0])[: len(data)]
        odd |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        if (high := a >= 0xE1).any():
            odd |= high & (((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)))
    at = np.flatnonzero(odd)
    return np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])


class Encoder(dict):
    """Piece after a space to its ids as little-endian 32-bit integers.

    A key that begins with a line feed follows a character that isn't white
    space, not a space.
    """

    def __init__(self, vocabulary: str, end: int = END_ID):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.tokens = self.tokenizer.model.tokenize
        self.line = self.whole("\n")
        self.runs: dict[str, bytes] = {}
        self.end = np.array([end], dtype="<i4").tobytes()
        self.met = bytearray(1 << (MET_BITS - 3))

    def whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def lined(text: str) -> bool:
        """Whether it has line feeds, and each is between characters that aren't white space. text: not with odd spacing."""
        return "\n" in text and text[0] != "\n" and text[-1] != "\n" and "\n\n" not in text and not any(c in text for c in RARE_SPACES)

    def letters(self, text: str, space: bool) -> bytes:
        """The ids of one pre-token: letters, with or without a space before them. The tokenizer's model alone gives them in less time."""
        spelled = text if text.isascii() else charmap_decode(text.encode(), "strict", BYTE_CHARS)[0]
        return array("i", [t.id for t in self.tokens("\u0120" + spelled if space else spelled)]).tobytes()

    def marks(self, run: str) -> bytes:
        """The ids of a run of marks, which is one pre-token."""
        ids = self.runs.get(run)
        if ids is None:
            ids = self.whole(run)
            if len(self.runs) < RUNS:
                self.runs[run] = ids
        return ids

    def __missing__(self, piece: str) -> bytes:
        # As letters(), without its calls: most pieces that aren't in the table are ASCII letters.
        ids = array("i", [t.id for t in self.tokens("\u0120" + piece)]).tobytes() if piece.isascii() and piece.isalpha() else self.mixed(piece)
        if len(self) < TABLE_SIZE:
            # Most pieces come once: they take no more room.
            at = hash(piece) & ((1 << MET_BITS) - 1)
            if self.met[at >> 3] >> (at & 7) & 1:
                self[piece] = ids
            else:
                self.met[at >> 3] |= 1 << (at & 7)
        return ids

    def mixed(self, piece: str) -> bytes:
        if word := _WORD(piece):
            letters, run = word.groups()
            return self[letters] + self.marks(run) if run else self.letters(letters, True)
        # Pre-tokens also begin at a single line feed, after it, and at the marks after a Latin letter.
        cut = piece.rfind("\n")
        if 0 < cut < len(piece) - 1 and not piece[cut - 1].isspace() and not piece[cut + 1].isspace():
            return self[piece[:cut]] + self[piece[cut:]]
        if cut == 0 and (word := _WORD(piece, 1)):
            letters, run = word.groups()
            return self["\n" + letters] + self.marks(run) if run else self.line + self.letters(letters, False)
        word = piece.rstrip(MARKS)
        if 0 < len(word) < len(piece) and _WORD(word[-1]):
            return self[word] + self.marks(piece[len(word) :])
        return self.whole(piece if cut == 0 else " " + piece)

    def encode(self, text: str, odd: bool) -> bytes:
        if odd or not text or any(t in text for t in self.special):
            return (self.whole(text) if text else b"") + self.end
        pieces = (text.replace("\n", " \n") if self.lined(text) else text).split(" ")
        return b"".join([self.whole(pieces[0]), *map(self.__getitem__, pieces[1:]), self.end])


def worker_encoder(vocabulary: str, end: int) -> Encoder:
    """The encoder of this Python worker, which later tasks find with its pieces."""
    state = sys.modules.setdefault("loomgraph_worker_state", types.ModuleType("loomgraph_worker_state"))
    key = zlib.crc32(vocabulary.encode()), len(vocabulary), end
    if getattr(state, "key", None) != key:
        state.key, state.encoder = key, Encoder(vocabulary, end)
    return state.encoder


def encode_column(column: pa.Array, encoder: Encoder) -> Iterator[tuple[int, list[bytes]]]:
    """For each chunk of texts, its first row and the ids of each text."""
    for chunk in text_chunks(column):
        odd = odd_spacing(chunk.data, chunk.offsets).tolist()
        texts = column.slice(chunk.lo, chunk.hi - chunk.lo).to_pylist()
        yield chunk.lo, [encoder.encode(t or "", o) for t, o in zip(texts, odd, strict=True)]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END_ID) -> None:
    """Encode every text of docs and write the files to ``path``. vocabulary: the tokenizer's JSON."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)  # of a fixed size
    n = partitions(docs)
    texts = docs.select(did(), F.col("text").cast("string").alias("text")).select("did", F.xxhash64("text").alias("h"), "text")
    ordered = texts.repartitionByRange(n, "did", "h").sortWithinPartitions("did", "h", "text").select("did", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = worker_encoder(shipped.value, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            dids = batch.column("did").to_numpy()
            for lo, found in encode_column(batch.column("text"), encoder):
                sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
                ids = np.frombuffer(b"".join(found), dtype="<i4")
                at = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                own = dids[lo : lo + len(found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), part, dtype=np.int32)), pa.array(own, mask=own == NO_ID), pa.array(at), pa.array(sizes), list_column(ids, sizes, pa.int32())],
                    names=["part", "doc_id", "part_start", "n_tokens", "ids"],
                )
        give_back()

    with tidy(spark), setting(spark, TWO_LEVELS, "true"):
        ordered.mapInArrow(encode, SCHEMA).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids; what isn't selected isn't read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each file.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")), "token-offsets")
    return rows.join(offsets, "part").select("doc_id", (F.col("skip") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or new_path(docs.sparkSession, "tokens")
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        write_tokens(docs, path, f.read())
    return token_digests(read_tokens(docs.sparkSession, path))


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    return tokenize_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
