"""Base spans against the plain patterns, the CRF against enumeration and held-out rows, the operator on defined cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from recall_engine.llm import private_spans as private
from recall_engine.llm.common import bytes_of

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_force(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19
                and sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


@pytest.fixture(scope="module")
def crf():
    return private.train(private.labelled_rows(0))


def test_base_spans_equal_the_patterns():
    draw = random.Random(1)
    pieces = ["a", "b_", "%", "@", ".", "é", " ", "-", "+", "(", ")", "1", "25", "255", "256", "007", "4111 1111 1111 1111", "+1 (415) 555-0000", "x@y.z", "0", "\n"]
    for _ in range(6000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 30)))
        assert private.base_spans(text) == brute_force(text), text


def test_base_spans_are_linear_in_long_runs():
    for piece in ("1", "1.", "a@", "@", "+1 ", "a", "1-"):
        private.base_spans(piece * 200_000)


def test_tokens_end_at_texts_and_marks():
    texts = ["see a.b@c.de, (at) x[.]y.", "", "...", "no\x00é1", "(see a@b.c) (323) 5-", "]"]
    data, offsets = bytes_of(pa.array(texts, pa.large_string()))
    tokens = private.tokens_of(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(tokens.starts, tokens.ends, strict=True)]
    found = [words[a:b] for a, b in itertools.pairwise(tokens.firsts)]
    assert found == [["see", "a.b@c.de", "(at)", "x[.]y"], [], [], ["no", "é1"], ["see", "a@b.c", "(323)", "5"], ["]"]]
    shapes = {t: private._hash(t, "shape") for t in ("12", "123", "1234", "12345", "999999", "ab", "é", "a-b", "1-b")}
    assert shapes["12"] == shapes["123"] != shapes["1234"] != shapes["12345"] == shapes["999999"] and shapes["ab"] == shapes["é"]
    assert private._hash("1234", "short") == private._hash("7", "short") != private._hash("a-b", "short")


def test_viterbi_and_sums_equal_enumeration():
    draw = np.random.default_rng(7)
    n, labels = 4, 3
    emissions, moves = draw.normal(size=(n, labels)), draw.normal(size=(labels, labels))
    paths = list(itertools.product(range(labels), repeat=n))
    score = lambda p: sum(emissions[i, x] + moves[p[i - 1] if i else 0, x] for i, x in enumerate(p))
    best = max(paths, key=score)
    got = private.viterbi(lambda rows: emissions[rows[:, 0]], np.arange(n)[:, None], np.array([0]), np.array([n]), moves)
    assert tuple(got) == best
    weight = np.exp([score(p) for p in paths])
    weight /= weight.sum()
    nodes, edges = private._marginals(emissions, moves, np.array([[0, 1, 2, 3, 4]]))  # the last place is beyond the text
    want = np.zeros((n, labels))
    ways = np.zeros((labels, labels))
    for p, w in zip(paths, weight, strict=True):
        for i, x in enumerate(p):
            want[i, x] += w
            ways[p[i - 1] if i else 0, x] += w
    assert np.allclose(nodes, want) and np.allclose(edges, ways)


def test_cutting_changes_no_label(crf):
    assert crf.quiet is not None
    draw = random.Random(3)
    rows = private.labelled_rows(5, rounds=1)
    filler = lambda: " ".join(draw.choice(["wen", "lin", "tor", "at", "dot", "12", "(x)"] if draw.random() < 0.1 else ["wen", "lin", "tor"]) for _ in range(draw.randint(0, 60)))
    texts = [" ".join(filler() + " " + draw.choice(rows)[0] for _ in range(draw.randint(0, 6))) for _ in range(200)]
    tokens = private.tokens_of(*bytes_of(pa.array(texts, pa.large_string())))
    whole = crf.labels(tokens, cut=False)
    assert (crf.labels(tokens) == whole).all() and (whole > 0).sum() > 500


def test_held_out_rows(crf):
    """Spans of newly drawn words, numbers and sentences; sentences without any stay clean."""
    rows = private.labelled_rows(99)
    found = [set() for _ in rows]
    for i, span in private.crf_spans(crf, *bytes_of(pa.array([text for text, _ in rows], pa.large_string()))):
        found[i].add(span)
    right = sum(len(f & set(s)) for f, (_, s) in zip(found, rows, strict=True))
    assert right >= 0.9 * sum(len(s) for _, s in rows) and right >= 0.93 * sum(map(len, found))
    clean = [f for f, (_, s) in zip(found, rows, strict=True) if not s]
    assert sum(map(bool, clean)) <= 0.03 * len(clean)


def test_operator_on_defined_cases(spark, crf):
    hidden = "köln: write to jane dot doe at mail dot com or call (415) 555-2671 today"
    rows = [(1, None), (2, ""), (3, hidden), (None, "me@x.org"), (4, "plain words only"), (4, "plain words only"), (5, "words " * 300_000 + "10.0.0.1")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, spans string, other int")
    got = private.find_private(docs, crf).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "other", "base", "spans"} and len(got) == len(rows)
    spans = {r.doc_id: [(s.kind, (r.text or "")[s.start : s.end]) for s in r.spans] for r in got}
    assert spans == {
        1: [], 2: [], 4: [], None: [("email", "me@x.org")], 5: [("ip", "10.0.0.1")],
        3: [("email", "jane dot doe at mail dot com"), ("phone", "(415) 555-2671")],
    }
    assert [r.base for r in got if r.doc_id == 3] == [[]]
    hidden_row = private.redact(private.find_private(docs, crf)).filter("doc_id = 3").first()
    assert hidden_row.text == "köln: write to <email> or call <phone> today"
    assert private.find_private(docs.limit(0), crf).collect() == []


def test_labelled_table_is_bounded_and_trained_on(spark, monkeypatch):
    labelled = private.labelled_table(spark).limit(50)
    rows = [(r.text, [tuple(s) for s in r.spans]) for r in labelled.collect()]
    assert rows == private.labelled_rows()[:50]
    monkeypatch.setattr(private, "MOST_LABELLED", 10)
    with pytest.raises(ValueError):
        private.fit(labelled)


def test_query_on_the_sample(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = private.op13_private_spans(spark, sf_dir).collect()
    assert len(got) == len(texts)
    added = 0
    for r in got:
        want = brute_force(texts[r.doc_id])
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == kind for s in want) for kind in private.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(joined) <= set(spans)
        added += len(spans) - len(want)
    assert added == 0  # the sample hides nothing
