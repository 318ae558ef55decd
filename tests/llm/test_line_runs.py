"""Line dedup against a brute-force version, and the defined cases."""

from collections import defaultdict
import random

import pytest

from recall_engine.llm import line_runs

SPACES = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACES))


def brute(docs):
    holders = defaultdict(set)
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(4, 3), (5, 2), (1, 3)])
def test_equal_to_brute_force(spark, batches, fanout):
    draw = random.Random(batches)
    pool = [f"line number {i} of the common pool" for i in range(25)] + ["short", "", "  ", "ÄÖÜ äöü ÄÖÜ äöü ÄÖÜ äöü"]
    shown = lambda x: draw.choice([x, x.upper() if x.isascii() else x, f" \t{x}\r", x])
    docs = {i: "\n".join(shown(draw.choice(pool)) for _ in range(draw.choice([0, 1, 4, 30]))) for i in range(60)}
    docs |= {100: None, 101: "", 102: "\n\n", 103: "\n".join(pool * 200), 104: "x" * 100_000}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text or "", r.n_lines, r.n_dropped) for r in line_runs.drop_repeated_lines(table, batches=batches, fanout=fanout).collect()}
    assert got == brute(docs)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    line = "a line that is long enough"
    rows = [(1, f"{line}\none", "p"), (1, f"{line}\none", "p"), (2, line, "q"), (3, f"x\n{line}", None), (None, line, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    out = line_runs.drop_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "_gone", "n_lines", "n_dropped"]
    assert sorted((r.doc_id or 0, r.text, r._gone or "") for r in out.collect()) == [
        (0, line, "n"), (1, "one", "p"), (1, "one", "p"), (2, "", "q"), (3, f"x\n{line}", ""),
    ]
    assert line_runs.drop_repeated_lines(docs.limit(0)).collect() == []
