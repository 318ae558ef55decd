"""The pipeline against the brute-force versions of its stages, one after the other."""

import hashlib

import sentencepiece
from test_line_runs import brute as line_brute
from test_simhash import fingerprint, groups
from test_target_ratio import base, verdicts
from test_winnowing import brute as window_brute

import corpus_pipeline
from recall_engine.llm import piece_agenda


def test_equal_to_brute_force(spark, tmp_path):
    text = lambda name, n: " ".join(f"{name}{i * i % 997}" for i in range(n))
    shared = "a line of more than twenty characters"
    passage = "one two three four five six seven eight nine ten eleven twelve"
    texts = {i: text("abcdefgh"[i], 60 + i) + (f"\n{shared}\nend {i}" if i < 4 else "") for i in range(8)}
    texts |= {10: texts[5], 11: texts[6] + f" {passage} ", 12: None, 13: "", 14: "too short", 15: "same same same " * 40, 16: text("é", 70)}
    tables = {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string"),
        "labels": spark.createDataFrame([(0, 1, 0), (1, 1, 0), (15, 0, 1)], "doc_id long, quality int, toxic int"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")

    scores, least = verdicts(spark, texts, (0, 1))
    kept = {i: t for i, t in texts.items() if not base(t)[-1] and scores[i] >= least - 4e-6}
    kept = {i: got[0] for i, got in line_brute(kept).items()}
    first = groups({i: fingerprint(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if first[i] == i}
    hits = window_brute(kept, {1: passage, 2: None})
    kept = {i: t for i, t in kept.items() if not hits[i][1]}
    assert kept and len(kept) < len(texts)

    library = sentencepiece.SentencePieceProcessor(model_file=piece_agenda.model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in kept.items():
        ids = library.encode(t)
        want[i] = (len(ids), ids, sha(",".join(map(str, ids))), sha(library.decode(ids)))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, list(r.ids), r.ids_sha256, r.decoded_sha256) for r in rows} == want
    assert len(rows) == len(want)


def test_stages_on_defined_cases(spark, tmp_path):
    """Null ids and texts, ids that rows share, repeated rows, a long text, columns named like those that operators add; and no rows."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, words("a", 80)), (1, words("a", 80)), (1, words("b", 80)), (None, words("c", 80)), (2, None), (3, ""), (4, words("d", 60_000)), (5, "short")]
    extra = "n_words string, score string, kept string, n_dropped string, fingerprint string, ids string, _id string, _text string"
    docs = spark.createDataFrame([(i, t, *"abcdefgh") for i, t in rows], f"doc_id long, text string, {extra}")
    spark.createDataFrame([(1, "nothing of this is in there at all but ten words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert {1, 4} <= ids <= {1, 2, 3, 4, 5, None}, name
        assert {tuple(r)[2:] for r in out.collect()} == {tuple("abcdefgh")}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "1", "4", "None"]
    name, stage = corpus_pipeline.STAGES[-1]
    encoded = stage(spark, docs, str(tmp_path)).collect()
    assert len(encoded) == len(rows) and {r.n_tokens for r in encoded if r.doc_id in (2, 3)} == {0}
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
