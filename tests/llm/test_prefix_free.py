"""Removed bytes against a brute-force version, and the defined cases."""

import hashlib
import random

from recall_engine.llm import prefix_free


def brute(docs, length=50):
    first = {}
    raw = {i: (t or "").encode() for i, t in docs.items()}
    for i in sorted(raw):
        for s in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][s : s + length], i)
    out = {}
    for i, body in raw.items():
        gone = [False] * len(body)
        for s in range(len(body) - length + 1):
            if first[body[s : s + length]] < i:
                gone[s : s + length] = [True] * length
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out[i] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_equal_to_brute_force(spark, sf_dir):
    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("abcd éß漢\n") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 80, 300)]
    docs = {}
    for i in range(60):
        docs[i] = "".join(draw.choice(shared) if draw.random() < 0.5 else text(draw.randint(0, 70)) for _ in range(draw.randint(0, 6)))
    docs |= {100: None, 101: "", 102: "a" * 3000, 103: "a" * 60, 104: "ab" * 400, 105: "x" + docs[3], 106: docs[3], 107: docs[3]}
    docs |= {r.doc_id + 1000: r.text[:3000] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in prefix_free.remove_repeats(table).collect()}
    want = brute(docs)
    assert {i for i in want if got[i] != want[i]} == set() and len(got) == len(want)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    text = "0123456789" * 6
    rows = [(1, text, "p"), (1, text, "p"), (2, f"é{text}!", "q"), (None, text, "n"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = prefix_free.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out.collect()) == [
        (0, 60, 0, text.encode()), (1, 60, 0, text.encode()), (1, 60, 0, text.encode()), (2, 63, 60, "é!".encode()), (3, 0, 0, b""),
    ]
    assert prefix_free.remove_repeats(docs.limit(0)).collect() == []


def test_no_row_per_string_is_staged(spark, monkeypatch):
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    common = [text(24) for _ in range(40)]
    docs = {i: "".join(draw.choice(common) + text(12) for _ in range(40)) for i in range(150)}
    staged, stage = [], prefix_free.Scratch.stage
    monkeypatch.setattr(prefix_free.Scratch, "stage", lambda *a, **b: staged.append(found := stage(*a, **b)) or found)
    rows = []
    monkeypatch.setattr(prefix_free.Scratch, "__exit__", lambda *_: rows.extend(t.count() for t in staged))
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in prefix_free.remove_repeats(table).collect()}
    assert got == brute(docs)
    # Triggers are common, whole strings are not: there are some 200,000 strings, and at most a row for each group and bucket.
    assert sum(rows) < 20_000


def test_ids_that_are_no_numbers_and_long_texts(spark):
    draw = random.Random(6)
    text = lambda n: "".join(draw.choice("abcd é\n") for _ in range(n))
    shared = text(100_000)
    docs = {"b": shared + text(300_000), "a": text(60_000) + shared[:70_000], "é": shared[:500] * 3, "c": text(10) + shared[60_000:60_200]}
    table = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in prefix_free.remove_repeats(table).collect()}
    assert got == brute(docs)
