"""The scan against plain loops, for every cut into blocks, and the defined cases."""

import numpy as np
import pytest

from recall_engine.llm import separator_scan as scan


def brute(ids, end):
    out, start = [], 0
    for i, t in enumerate(ids):
        if t == end:
            out.append((start, i + 1 - start, True))
            start = i + 1
    if start < len(ids):
        out.append((start, len(ids) - start, False))
    return out


@pytest.mark.parametrize(("width", "kind", "end"), [(1, "u1", 255), (2, "<u2", 50256), (4, "<u4", 100_000)])
def test_equal_to_brute_force(spark, width, kind, end):
    draw = np.random.default_rng(width)
    files = {
        0: draw.choice([1, 2, end], 200), 1: np.full(9, end), 2: np.array([3] * 50), 3: np.array([5, end]), 4: np.array([end, 7]),
    }
    for size in (1, 7, 64, 1000):
        rows = []
        for f, ids in files.items():
            rows += [(f, n, bytearray(ids[a : a + size].astype(kind).tobytes())) for n, a in enumerate(range(0, len(ids), size))]
        rows += [(9, 0, bytearray()), (10, 0, None)]
        blocks = spark.createDataFrame(rows, "file long, block long, payload binary").repartition(3)
        got = {}
        for r in scan.scan(blocks, end, width).orderBy("file", "ordinal").collect():
            assert r.ordinal == len(got.setdefault(r.file, []))
            got[r.file].append((r.start, r.n_tokens, r.closed))
        assert got == {f: brute(ids.tolist(), end) for f, ids in files.items()}


def test_documents_in_small_blocks(spark):
    texts = {0: "ab", 1: "", 2: None, 3: "é" * 40, 9: "x", 10: "long " * 9000}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(None, "left out", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(3)
    got = scan.scan(scan.write_blocks(docs, "doc_id", "text", 4, 16)).orderBy("file", "ordinal").collect()
    assert [(r.file, r.n_tokens) for r in got] == [(i // 4, len((t or "").encode()) + 1) for i, t in texts.items()]
    assert all(r.closed for r in got)
    twice = docs.unionByName(docs)
    assert scan.scan(scan.write_blocks(twice, "doc_id", "text", 4, 16)).count() == 12
    assert scan.scan(scan.write_blocks(docs.limit(0), "doc_id", "text", 4, 16)).collect() == []
    with pytest.raises(Exception, match="whole number"):
        scan.scan(spark.createDataFrame([(0, 0, bytearray(b"abc"))], "file long, block long, payload binary"), 1, 2).collect()
