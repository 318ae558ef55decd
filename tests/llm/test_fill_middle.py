"""Fill-in-middle against slices of Python strings, the rank index against all offsets."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall_engine.llm import fill_middle as fim


def expected(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def text_of(draw, n):
    kinds = ["ab c\n", "äöß é", "語彙 漢字", "😀𝒳", "<SPM>"]
    out = []
    while len(out) < n:
        out += draw.choices(draw.choice(kinds), k=draw.randint(1, 400))
    return "".join(out[:n])


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
@pytest.mark.parametrize("error", [0, 3, 127])
def test_index_gives_every_offset(block, error):
    draw = random.Random(block + error)
    for n in (0, 1, 5, 3000):
        text = text_of(draw, n)
        data = np.frombuffer(text.encode(), np.uint8)
        index = fim.RankIndex(data, block, error)
        ranks = np.arange(len(text) + 1)
        true = np.cumsum([0, *[len(c.encode()) for c in text]])
        assert index.offsets(ranks).tolist() == true.tolist()
        assert np.abs(index.predict(ranks) - true).max() <= error
    assert len(fim.RankIndex(np.full(10_000, 65, np.uint8)).first) == 1


def test_equal_to_slices_of_strings(spark):
    draw = random.Random(5)
    rows = [(i, text_of(draw, draw.choice([0, 1, 2, 40, 900]))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a<P>b"), (1003, "<M>"), (1004, "<P<S"), (1005, text_of(draw, 400_000)), (None, "no id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t in rows], "doc_id long, text string, tag string, form string").repartition(3)
    cut = fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert cut.columns == ["doc_id", "text", "tag", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = cut.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.tag == "x"
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_other_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(none).collect() == []
    row = fim.fill_in_middle(spark.createDataFrame([("k", "héllo")], "key string, body string"), "key", "body").first()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == expected("k", "héllo")


def test_whole_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for r in fim.fill_in_middle(docs).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text)
