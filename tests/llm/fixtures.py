"""Small tables with the awkward cases that every operator has to handle."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng, n, words=400):
    pool = [f"{a}{b}" for a in ("th", "re", "Wo", "la", "ü", "zé", "x1", "q") for b in ("an", "er", "ion", "st,", "da.", "o'k", "日本", "7", "le", "ing")]
    pool += [f"w{i}" for i in range(words)]
    return " ".join(rng.choice(pool) for _ in range(n))


def documents(seed=1, n=60):
    """Rows (doc_id, text, source): copies, near copies, shared passages, odd spacing, nulls, empty and long texts."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice((3, 20, 60, 150))), f"s{i % 4}") for i in range(n)]
    passage = prose(rng, 70)
    for i in range(0, 12, 2):
        rows[i] = (i, f"{rows[i][1]} {passage} {prose(rng, 9)}", rows[i][2])
    rows += [(100 + i, rows[7][1], "hot") for i in range(5)]
    base = prose(rng, 200).split()
    for i in range(6):
        own = list(base)
        own[30 * i + 5] = f"edit{i}"
        rows.append((200 + i, " ".join(own), "hot"))
    rows += [
        (300, None, "s1"), (301, "", None), (302, "   \n\t ", "s2"), (303, "one", None), (304, "a b c", "s3"), (305, "  lead and trail  ", "s1"),
        (306, "tabs\tand\nlines \n mixed\r\n\x0bend", "s2"), (307, "nb sp em sp “quoted” don't 12'34", "s2"), (308, "x " * 90, "s3"), (309, "ab" * 700, "s3"),
        (310, prose(rng, 9000), "long"), (311, "<|endoftext|> plain", "s1"), (None, "no id here", "s1"), (None, rows[3][1], None), (20, rows[20][1], rows[20][2]), (21, "other text of a repeated id", "s1"),
    ]
    return rows


def frame(spark, rows, extra=False):
    out = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).repartition(3)
    # Columns named as the operators' own working columns.
    return out.selectExpr("*", "'c' as did", "1 as tid", "doc_id as key", "'x' as size", "0 as h", "'z' as part") if extra else out


def write_tables(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
