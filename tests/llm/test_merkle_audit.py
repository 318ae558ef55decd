"""The audit against a brute-force comparison, and the defined cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from recall_engine.llm import merkle_audit as audit
from recall_engine.llm.common import Scratch


def records(rows, per_file=10):
    """place -> (id, from, to, hash) per file, by plain Python."""
    out, end, nth = {}, {}, {}
    made = []
    for i, url, html in rows:
        if i is None:
            continue
        body = (html or "").encode()
        raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: " + (url or "").encode()
        raw += f"\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        made.append((i, hashlib.sha256(raw).hexdigest(), len(raw)))
    for i, digest, size in sorted(made):
        f = i // per_file
        a = end.get(f, 0)
        out[f, nth.get(f, 0)] = (i, a, a + size, hashlib.sha256(f"{digest}:{a}:{a + size}".encode()).hexdigest())
        end[f], nth[f] = a + size, nth.get(f, 0) + 1
    return out


def leaves(spark, rows, per_file=10):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _to string").repartition(3)
    return audit.leaves(pages, F.floor(F.col("page_id") / per_file).cast("long"), "page_id", "url", "html")


@pytest.mark.parametrize("fanout", [2, 16])
def test_equal_to_brute_force(spark, fanout):
    rows = [(i, f"http://h/{i}", "é" * (i % 7)) for i in range(45)] + [(7, "http://h/7", "again"), (None, "u", "h"), (50, None, None)]
    other = [(i, u, "changed" if i in (3, 22) else h) for i, u, h in rows if i != 36] + [(60, "new", "z" * 50_000)]
    left, right = records(rows), records(other)
    want = {k: (left.get(k), right.get(k)) for k in left.keys() | right.keys() if left.get(k) != right.get(k)}
    wide = lambda rs: [(*r, "clash") for r in rs]
    got = audit.audit(leaves(spark, wide(rows)), leaves(spark, wide(other)), fanout).collect()
    assert {(r.file, r.place): (r.left_offset, r.left_hash, r.right_offset, r.right_hash) for r in got} == {
        k: (a and a[1], a and a[3], b and b[1], b and b[3]) for k, (a, b) in want.items()
    }


def test_equal_replicas_and_empty_tables(spark):
    rows = [(i, "u", "h", None) for i in range(30)]
    assert audit.audit(leaves(spark, rows), leaves(spark, rows)).collect() == []
    none = leaves(spark, rows).limit(0)
    assert audit.audit(none, none).collect() == []
    assert len(audit.audit(none, leaves(spark, rows[:3])).collect()) == 3


def test_only_branches_that_differ_are_descended(spark):
    rows = [(i, "u", "h", None) for i in range(64)]
    other = [(i, "u", "j" if i == 41 else "h", None) for i in range(64)]
    with Scratch(spark) as scratch:
        one, two = (audit.tree(leaves(spark, r, 1000), scratch, 4) for r in (rows, other))
        assert [level.count() for level in one] == [64, 16, 4, 1]
        suspects = None
        for level in (3, 2, 1, 0):
            suspects = audit._differing(one[level], two[level], suspects, 4).select("_file", "_place")
            assert suspects.count() == 1
        assert suspects.first()["_place"] == 41
