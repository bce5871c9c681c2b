"""Randomised checks of the text functions against small Python models of
the SQL and JavaScript rules they re-express (one Spark job per function,
thousands of generated strings)."""

import random
import re

from pyspark.sql import functions as F

from orderflow.functions import expr as X

ALPHABET = ["a", "B", "z", "7", " ", " ", ",", ",", "\t", "-", "#", "é", " ", "_"]


def gen(n=3000, seed=11):
    rnd = random.Random(seed)
    out = [None, "", " ", ",", " , ", "A,,B", " A , B "]
    for _ in range(n):
        out.append("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))))
    return out


def run(spark, col):
    vals = gen()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = {r.i: r.o for r in df.select("i", col.alias("o")).collect()}
    return vals, [got[i] for i in range(len(vals))]


def pg_trim(s):                      # PostgreSQL trim(): spaces only
    return s.strip(" ")


def model_items(v):
    """nullif(trim(coalesce(syrups,'')),'') -> regexp_split_to_table(.., '\\s*,\\s*') -> nullif(trim(x),'')"""
    base = pg_trim(v or "")
    base = base if base != "" else None
    parts = re.split(r"[ \t\n\r\f\v]*,[ \t\n\r\f\v]*", base or "")
    out = [pg_trim(p) for p in parts]
    return [p for p in out if p != ""]


def test_split_items(spark):
    col = F.filter(X.text_list(X.blank_to_null("v")), lambda s: X.blank_to_null(s).isNotNull())
    col = F.transform(col, lambda s: F.trim(s))
    vals, got = run(spark, col)
    for v, g in zip(vals, got):
        assert g == model_items(v), repr(v)


def js_ws(c):
    return c.isspace() or c in " ﻿"


def model_slug(v):
    s = (v or "")
    while s and js_ws(s[0]):
        s = s[1:]
    while s and js_ws(s[-1]):
        s = s[:-1]
    s = s.lower()
    s = re.sub(r"[^a-z0-9]+", "-", s)
    return re.sub(r"^-+|-+$", "", s)


def test_slug(spark):
    vals, got = run(spark, X.slug("v"))
    for v, g in zip(vals, got):
        assert g == model_slug(v), repr(v)


def model_words(v):
    return [w for w in re.split(r"\s+", (v or "").strip()) if w]


def test_words_and_first_name(spark):
    vals, got = run(spark, F.struct(X.word_count("v").alias("n"), X.first_name("v").alias("f")))
    for v, g in zip(vals, got):
        w = model_words(v)
        assert g.n == len(w), repr(v)
        assert g.f == (w[0] if w else "Guest"), repr(v)


def test_bool_text_model(spark):
    rnd = random.Random(3)
    words = ["t", "true", "y", "yes", "on", "1", "f", "false", "n", "no", "off", "0", "maybe", "", "2"]
    vals = []
    for _ in range(500):
        w = rnd.choice(words)
        w = "".join(c.upper() if rnd.random() < 0.5 else c for c in w)
        vals.append(" " * rnd.randint(0, 2) + w + " " * rnd.randint(0, 2))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = {r.i: r.o for r in df.select("i", X.bool_text("v", None).alias("o")).collect()}
    for i, v in enumerate(vals):
        k = v.strip(" ").lower()
        want = True if k in {"t", "true", "y", "yes", "on", "1"} else False if k in {
            "f", "false", "n", "no", "off", "0"} else None
        assert got[i] == want, repr(v)
