"""Contamination against a brute-force version, and the defined cases."""

import random
import re

import numpy as np
import pyarrow as pa

from recall_engine.llm import winnowing


def words(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window=10):
    out = {}
    for i, text in docs.items():
        have, hit, found = words(text), set(), set()
        for item, item_text in items.items():
            want = words(item_text)
            size = min(window, len(want))
            grams = {tuple(want[b : b + size]) for b in range(len(want) - size + 1)} if size else set()
            for b in range(len(have) - size + 1):
                if tuple(have[b : b + size]) in grams:
                    hit |= set(range(b, b + size))
                    found.add(str(item))
        out[i] = (len(have), len(hit), sorted(found))
    return out


def test_equal_to_brute_force(spark):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "ß9", "Zz"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = {i: text(draw.choice([1, 3, 6, 9, 10, 11, 25])) for i in range(12)} | {50: None, 51: "", 52: "?!"}
    docs = {i: text(draw.choice([0, 1, 5, 40])) for i in range(30)}
    for i in range(30, 40):  # pieces of items, in other case and with other separators
        piece = words(items[draw.randrange(12)])
        docs[i] = text(7) + "\n" + "--".join(w.upper() if w.isascii() else w for w in piece) + "," + text(3)
    docs |= {90: None, 91: "", 92: "...", 93: "w1 " * 5000}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in winnowing.contamination(d, b).collect()}
    assert got == brute(docs, items)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, passage, 5), (1, passage, 5), (None, passage, 6), (2, "clean", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _at int")
    items = spark.createDataFrame([(7, passage), (7, passage), (None, "clean")], "item_id long, text string")
    got = sorted(tuple(r) for r in winnowing.contamination(docs, items).collect())
    assert got == [(1, 11, 11, ["7"]), (2, 1, 0, [])]
    kept = winnowing.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r._at for r in kept.collect()) == [6, 7]
    assert winnowing.contamination(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in winnowing.contamination(docs, items.limit(0)).collect()} == {0}


def test_words_at_text_borders():
    texts = pa.array(["ab", "cd", "", "e!f", ""], pa.large_string())
    low, starts, ends, firsts = winnowing.words_of(texts)
    assert [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"e", b"f"]
    assert firsts.tolist() == [0, 1, 2, 2, 4, 4]
    one, two = (winnowing.word_hashes(*winnowing.words_of(pa.array(t, pa.large_string()))[:3]) for t in (["x ab"], ["ab"]))
    assert one[1] == two[0] and one[0] != two[0]
    assert np.all(winnowing.kept_grams(one, np.array([0, 2]), 5, 10)[1] == [])
