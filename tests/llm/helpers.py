"""Fixtures that every operator is held against: odd rows, clashing column names, empty tables."""

from __future__ import annotations

import math

import duckdb

CLASH = ["id", "size", "key", "kind", "n", "h", "score", "m", "component", "sig"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(700))


def odd_rows():
    words = "the cat sat on a mat and then it ran over the hill to see what was there at noon"
    texts = [
        None, "", " \n\t ", "one", words, words, words.upper(), words + " again", LONG, LONG + " tail", "éß 漢字 \U0001f643", "'s 't 're", "a" * 5000,
        "All rights reserved. Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "mail a.b@mail.example.com or +1 (337) 555-7349 card 4111 1111 1111 1111", "\u0000x\u0085y", "... !!! ???",
    ]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, [None, "en", "de"][i % 3], [None, "a", "b", "c"][i % 4], None if t is None else len(t), *(c if i % 2 else None for c in CLASH)))
    return rows


def odd_documents(spark, null_id=True, repeated=True):
    rows = odd_rows()
    if repeated:
        rows += [rows[4], rows[0]]
    if null_id:
        rows.append((None, "no id here at all today", "en", "a", 3, *CLASH))
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def write(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def duck(path, sql, *names):
    con = duckdb.connect()
    for name in names:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    out = con.sql(sql)
    return out.columns, out.fetchall()


def same_rows(df, columns, rows):
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: repr(r)
    ours = sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=key)
    place = [columns.index(c) for c in sorted(columns)]
    theirs = sorted((tuple(r[i] for i in place) for r in rows), key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12)), (a, b)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
