"""SimHash groups against a brute-force version, and the defined cases."""

from collections import Counter
import random
import re

import pytest
import xxhash

from recall_engine.llm import simhash
from recall_engine.llm.common import Scratch
from recall_engine.llm.components import components


def fingerprint(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64(s.encode(), seed=42).intdigest() >> b & 1)
    return sum(1 << b for b, n in counts.items() if 2 * n > len(shingles))


def groups(prints, most=2):
    """Component of every id by comparing all pairs."""
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("hot_rows", [128, 1])
def test_groups_equal_brute_force(spark, sf_dir, hot_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows |= {10_000: None, 10_001: "", 10_002: " \t", 10_003: "one", 10_004: "ONE two", 10_005: "İ ß Ω", 10_006: "w " * 30_000}
    for i in range(60):  # near copies of one text
        words = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 12).split()
        words[i] = f"x{i}"
        rows[20_000 + i] = " ".join(words)
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicate_groups(table, hot_rows=hot_rows).collect()}
    prints = {i: fingerprint(t) for i, t in rows.items()}
    assert {i: g[0] for i, g in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: g[1] for i, g in got.items()} == groups(prints)


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_links_lose_nothing_between_random_near_fingerprints(spark, hot_rows):
    draw = random.Random(5)
    seeds = [draw.getrandbits(64) for _ in range(20)]
    prints = {s for s in seeds}
    for s in seeds:
        for _ in range(15):
            for _ in range(draw.randint(1, 3)):
                s ^= 1 << draw.randrange(64)
            prints.add(s)
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    nodes = spark.createDataFrame(signed, "_print long, _first long")
    with Scratch(spark) as scratch:
        found = simhash.links(nodes, scratch, 2, 3, hot_rows).collect()
        roots = {r._node: r._root for r in components(spark.createDataFrame(found, "_a long, _b long"), scratch).collect()}
    want = groups({p: p & ((1 << 64) - 1) for p, _ in signed})
    assert {p: roots.get(p, p) for p, _ in signed} == want
    assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2 for a, b in found)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "y"), (4, "A  B c d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _print string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(docs).collect())
    assert got == [(1, 1), (1, 1), (4, 1)]
    kept = simhash.keep_first_of_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r._print) for r in kept.collect()) == [(0, "y"), (1, "x"), (1, "x")]
    empty = docs.limit(0)
    assert simhash.near_duplicate_groups(empty).collect() == [] and simhash.keep_first_of_group(empty).collect() == []


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "_a long, _b long")
    with Scratch(spark) as scratch:
        assert {r._root for r in components(links, scratch).collect()} == {0}
