"""Divergence of sources against a count in plain Python, and joint tables against pairs of counts."""

from collections import Counter, defaultdict
import random
import re

import numpy as np

from recall_engine.llm import source_divergence as audit


def brute_force(rows, least_docs=10, top=10):
    counts, docs, total, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(words)
        total[lang].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least_docs]
        size = lambda c: sum(c[t] for t in kept)
        price = lambda c, t, n: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept))
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        sizes = {s: size(counts[lang, s]) for s in sources}
        for s in sources:
            mine = counts[lang, s]
            pairs = [(sum(apart(price(mine, t, sizes[s]), price(counts[lang, o], t, sizes[o])) for t in kept), o) for o in sources - {s}]
            prices = [(price(mine, t, sizes[s]), price(total[lang], t, size(total[lang])), t) for t in kept if mine[t]]
            terms = [(apart(p, q), t) for p, q, t in prices if p > q]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                ranked = ranked[:top] if part == "term" else ranked
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)}
    return out


def rows_of(draw, n, sources=6):
    words = ["The", "of", "über", "été", "x", "ÉTÉ", "Word", "naïve", "語", *[f"w{chr(97 + i)}" for i in range(26)]]
    out = []
    for _ in range(n):
        lang = draw.choice(["en", "fr", None, "lonely"])
        source = "hot" if draw.random() < 0.4 else draw.choice([None, *[f"s{i}" for i in range(sources)]])
        k = draw.choice([0, 1, 5, 40])
        text = "".join(draw.choice(words[: draw.randint(3, len(words))]) + draw.choice([" ", "1", "\n", "_", "\x00"]) for _ in range(k))
        out.append((lang, "only" if lang == "lonely" else source, text))
    return out


def result(docs, **settings):
    return {tuple(r) for r in audit.audit_sources(docs, **settings).collect()}


def test_equal_to_brute_force(spark):
    rows = rows_of(random.Random(2), 500)
    rows += [("en", "s1", None), ("en", "s1", ""), ("xx", "a", None), ("xx", "b", "one"), ("en", "long", "The of wa " * 60_000)]
    rows += [("en", "s2", "again again")] * 12
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, value int, _term string").repartition(4)
    got = audit.audit_sources(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force(rows)
    assert ("xx", "a", "pair", "b", 0, 1) in got and not any(r[0] == "lonely" and r[2] == "pair" for r in got)
    assert result(docs, least_docs=40, top=3) == brute_force(rows, 40, 3)


def test_empty_table(spark):
    assert audit.audit_sources(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_joint_tables_hold_every_pair_of_levels(monkeypatch):
    draw = np.random.default_rng(3)
    prices = draw.integers(1, 30, (700, 5)).astype(np.int64) * 10**7
    for levels in (8, 1_024):
        monkeypatch.setattr(audit, "LEVELS", levels)
        cells = Counter()
        for joint, p, q, rows, columns in audit.joint_tables(prices, prices):
            for i, j in zip(*np.nonzero(joint), strict=True):
                key = (np.searchsorted(rows, i, "right") - 1, p[i], np.searchsorted(columns, j, "right") - 1, q[j])
                cells[tuple(map(int, key))] += int(joint[i, j])
        want = Counter((a, int(r[a]), b, int(r[b])) for r in prices for a in range(5) for b in range(5))
        assert cells == want


def test_tiles_and_blocks_sum_to_the_plain_sum(monkeypatch):
    draw = np.random.default_rng(4)
    prices = (draw.zipf(1.5, (300, 11)).clip(0, 10**6) * 997 + 1).astype(np.int64)
    apart = prices[:, :, None] - prices[:, None, :]
    want = (apart * apart // (prices[:, :, None] + prices[:, None, :])).sum(axis=0)
    for tile, block, levels in ((64, 4_096, 1_024), (4, 37, 20), (1, 1, 1)):
        for name, value in (("TILE", tile), ("BLOCK", block), ("LEVELS", levels)):
            monkeypatch.setattr(audit, name, value)
        for a, b, total in audit.divergences(prices):
            assert (total == want[a : a + tile, b : b + tile]).all()


def test_counts_beyond_32_bits_keep_exact_prices(spark):
    n, size, kept = 9_000_000_000_000, 40_000_000_000_000, 123_456
    row = spark.createDataFrame([(n, size, kept)], "n long, size long, kept long")
    from pyspark.sql import functions as F

    assert row.select(audit._price(F.col("n"), F.col("size"), F.col("kept"))).first()[0] == 1 + 10**9 * (n + 2) // (size + 2 * kept)
