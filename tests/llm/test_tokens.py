import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import tokens
from loomgraph.llm.bytewords import text_chunks
from loomgraph.llm.storage import new_path

from .fixtures import documents, frame, prose


def expected(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_digests_equal_plain_encoding(spark, extra):
    rows = documents()
    got = tokens.tokenize_documents(frame(spark, rows, extra)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(expected(rows), key=key)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id or -1 for r in ordered] == sorted(r.doc_id or -1 for r in got)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens


def test_pieces_equal_whole_texts():
    rng = random.Random(5)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    import pyarrow as pa

    alphabet = [" ", " ", " ", "\n", "\t", "a", "Bc", "é", "日", "1", "'s", "'", ".", "!?", " ", " ", "　", " ", "\x85", "\x1c", "“", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000)] + [prose(rng, 50)]
    column = pa.array(texts)
    for c in text_chunks(column, 500):
        odd = tokens.odd_spacing(c.data, c.offsets)
        for text, o in zip(texts[c.lo : c.hi], odd, strict=True):
            assert encoder.encode(text, bool(o)) == (encoder.whole(text) if text else b"") + encoder.end, repr(text)


def test_special_tokens_are_as_plain_encoding_has_them(spark):
    text = "hello <|endoftext|> world <|endoftext|>."
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert 50256 in ids
    path = new_path(spark, "tokens")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens.write_tokens(frame(spark, [(1, text, "a"), (2, "x", "a")]), path, f.read())
    assert [list(r.ids) for r in tokens.read_tokens(spark, path).orderBy("start").collect()][0] == [*ids, 0]


def test_ids_are_not_shuffled_to_be_read(spark):
    path = new_path(spark, "tokens")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens.write_tokens(frame(spark, documents()), path, f.read())
    plan = tokens.read_tokens(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_empty_table(spark):
    assert tokens.tokenize_documents(frame(spark, [])).collect() == []


def test_metadata_reads_leave_the_ids(spark):
    path = new_path(spark, "tokens")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens.write_tokens(frame(spark, documents()), path, f.read())
    rows = tokens.read_tokens(spark, path)
    plan = rows.select("doc_id", "n_tokens").filter("doc_id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "GreaterThan(doc_id,5)" in plan


def test_runs_of_marks_are_encoded_once(monkeypatch):
    rng = random.Random(8)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    ends = ["", ".", ",\nthen", "$$$", ".%%%", "***\nnext", "'s.", "'", "it's!!", "--'re", "é?!", "日...", "1&&&", "_'s_", "\\]}", "\n###"]
    texts = [" ".join(f"{chr(97 + rng.randrange(26))}or{chr(97 + rng.randrange(26))}{rng.choice(ends)}" for _ in range(40)) for _ in range(300)]
    for text in texts:
        assert encoder.encode(text, False) == encoder.whole(text) + encoder.end, repr(text)
    calls = []
    whole = tokens.Encoder.whole
    monkeypatch.setattr(tokens.Encoder, "whole", lambda self, text: calls.append(text) or whole(self, text))
    for i in range(500):
        encoder.encode(f"begin wo{chr(97 + i % 26)}{chr(97 + i // 26)}x$$$ so{chr(97 + i % 26)}{chr(97 + i // 26)}y.%%%", False)
    assert sum(x != "begin" for x in calls) <= 2


def test_ids_are_lists_of_two_levels(spark, tmp_path):
    # No group around each id, which takes the writer time for every one.
    import pyarrow.parquet as pq

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens.write_tokens(frame(spark, documents()), f"file://{tmp_path}/t", f.read())
    for part in (tmp_path / "t").glob("*.parquet"):
        ids = pq.ParquetFile(part).schema.column(4)
        assert (ids.path, ids.max_definition_level, ids.max_repetition_level) == ("ids.array", 2, 1)
    assert spark.conf.get("spark.sql.parquet.writeLegacyFormat") == "false"


def test_repeated_ids_come_in_one_order(spark):
    rows = [(i % 3 or None, f"text {i % 40}" if i % 7 else None, "a") for i in range(200)]
    orders = []
    for n in (1, 5):
        got = tokens.tokenize_documents(frame(spark, rows).repartition(n)).orderBy("start").collect()
        orders.append([tuple(r) for r in got])
    assert orders[0] == orders[1] and len(orders[0]) == 200


def test_table_keeps_only_pieces_that_come_again():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    lines = ["the first\nagain the", "line.\nAgain a line.\nAgain", "a\n\nb the", "é,\nÉté the\tfirst", "\nthe a", "a the\n"]
    for text in lines:
        assert encoder.encode(text, False) == encoder.whole(text) + encoder.end, repr(text)
    assert "the" in encoder and "first" not in encoder
    assert "\nAgain" in encoder and not any("\n" in piece[1:] for piece in encoder)
