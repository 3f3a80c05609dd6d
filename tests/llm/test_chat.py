import random

import duckdb
import pytest

from loomgraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def case():
    rng = random.Random(3)
    rows = []
    for c in range(12):
        turns = [(rng.choice(("user", "assistant")), rng.choice(("hi", "ho", "", None))) for _ in range(rng.randrange(1, 7))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
        cut = rng.randrange(1, len(turns) + 1)
        rows += [(100 + c, i + c % 2, r, t) for i, (r, t) in enumerate(turns[:cut])]
    rows += [(200, 0, "user", "same")] * 3 + [(201, 0, "user", "same")] * 2 + [(202, None, None, None), (203, 5, None, ""), (None, 0, "user", "no id"), (None, 1, "user", "either")]
    rows += [(300, i, "user", f"t{i}") for i in range(700)] + [(301, i, "user", f"t{i}") for i in range(600)]
    # Turns without a number, and many with the same one.
    rows += [(400 + k, n, rng.choice(("user", "assistant", None)), rng.choice(("hello", "help", "he", "h", "", None, "été", "zz"))) for k, n in ((0, None), (1, 7)) for _ in range(40)]
    rows += [(402, n, r, t) for c, n, r, t in rows if c == 400]
    return rows


@pytest.mark.parametrize(("block", "dense"), [(256, 1 << 16), (2, 1 << 16), (256, 5), (2, 1)])
def test_equals_sql(spark, monkeypatch, block, dense):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "DENSE", dense)
    rows = case()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, chat.format_chats(df.selectExpr("*", "1 as pos", "2 as h1", "3 as block")).collect()), key=str)
    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert got == sorted(c.execute(chat.ORACLE).fetchall(), key=str)


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_main_path_has_no_python(spark):
    plan = chat.format_chats(spark.createDataFrame(case(), SCHEMA))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "InArrow", "InPandas"))
