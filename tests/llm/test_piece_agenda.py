"""Agenda encoding against the sentencepiece library, and the defined cases."""

import hashlib
import random

import pytest
import sentencepiece

from recall_engine.llm import piece_agenda as agenda

TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "  two  blanks  ", "line\nbreak\ttab\r\x0b", "▁mark ▁▁", "naïve Übermaß señor ñandú",
    "日本語のテキスト 漢字", "emoji 😀👩‍👩‍👧 ok", "é combining", "\x00\x01 control", "<s> </s> <unk> <0x41>", "aaaa" * 5000, "the " * 20000,
    "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "." * 300, " " * 500 + "end", "ÀÈÌ" * 200,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=agenda.model_path())


def test_equal_to_the_library_on_whole_texts(spark, sf_dir, library):
    draw = random.Random(2)
    made = ["".join(draw.choice("ab Zé \n.漢") for _ in range(draw.randint(1, 200))) for _ in range(100)]
    texts = dict(enumerate(TEXTS + made))
    rows = list(texts.items()) + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = dict(rows)
    for row in agenda.encode_and_decode(docs).collect():
        want = library.encode(texts[row.doc_id] or "")
        assert row.ids == want and row.n_tokens == len(want)
        assert row.decoded == library.decode(want)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()


def test_long_and_short_agendas_agree():
    vocabulary = agenda.pieces(agenda.model_path())
    draw = random.Random(4)
    chunks = ["▁" + "".join(draw.choice("theriong") for _ in range(draw.randint(1, 60))) for _ in range(500)]
    one = [agenda.merge_one(vocabulary.symbols(c).tolist(), vocabulary) for c in chunks]
    flat, counts = agenda.merge_all(chunks, vocabulary)
    assert flat.tolist() == [i for ids in one for i in ids] and counts.tolist() == [len(ids) for ids in one]


def test_repeats_clashes_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", None)], "doc_id long, text string, ids string")
    out = agenda.encode_and_decode(docs)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert sorted((r.doc_id or 0, r.decoded) for r in out.collect()) == [(0, "c"), (1, "a b"), (1, "a b")]
    assert agenda.encode_and_decode(docs.limit(0)).collect() == []
