"""Round trips of the coder, whole texts against the tokenizers library, and the defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from recall_engine.llm import range_coder as coder


def test_blocks_survive_the_round_trip():
    draw = np.random.default_rng(1)
    blocks = [
        np.array([0]), np.array([65535]), draw.integers(0, 65536, 700), np.full(900, 5), np.arange(300) * 200,
        np.tile([1, 2, 3, 70, 49407], 150), draw.zipf(1.3, 800) % 49408, np.zeros(1000, np.int64),
    ]
    coded = coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode_blocks(coded), strict=True))
    assert len(coded[3]) < 100 and len(coded[2]) < 700 * 2.5
    # A block read alone gives the same ids.
    assert np.array_equal(coder.decode_blocks([coded[6]])[0], blocks[6])


def test_damage_is_found():
    file = coder.pack_files([([7, 8], np.array([3, 2]), np.array([5, 6, 1, 9, 1]))])[0]
    docs, counts, ids = coder.unpack_files([file])[0]
    assert docs.tolist() == [7, 8] and counts.tolist() == [3, 2] and ids.tolist() == [5, 6, 1, 9, 1]
    for at in (0, 20, len(file) - 1 - 4):
        bad = bytearray(file)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            coder.unpack_files([bytes(bad)])
    with pytest.raises(ValueError):
        coder.encode_blocks([np.array([1 << 16])])


def test_equal_to_the_library_on_whole_texts(spark, sf_dir):
    draw = random.Random(2)
    made = ["".join(draw.choice("ab Źé'sŐ \n\t.漢1٣  　") for _ in range(draw.randint(1, 200))) for _ in range(100)]
    fixed = [None, "", " ", "it's WE'LL", "İstanbul ΣΑΣ", "<|endoftext|> x <|startoftext|>y", "é ́e\ń", "a\x00b", "word " * 20_000]
    rows = list(enumerate(fixed + made)) + [(r.doc_id + 3000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    library = Tokenizer.from_file(coder.token_path())
    want, start = {}, 0
    for i, text in sorted(rows):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in coder.write_and_read(docs).collect()} == want


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(2, "b", 1), (1, "a", 2), (1, "a", 3), (None, "c", 4)], "doc_id long, text string, file int")
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in coder.write_and_read(docs).collect())
    assert got == [(1, 0, 2), (1, 2, 2), (2, 4, 2)]
    assert coder.write_and_read(docs.limit(0)).collect() == []


def test_files_stay_and_give_the_ids_back(spark, tmp_path):
    texts = {1: "the quick brown fox", 2: None, 3: "", 700: "jumps over the lazy dog " * 300, 701: "the quick brown fox"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    coder.write_files(docs, f"{tmp_path}/tokens")
    files = spark.read.parquet(f"{tmp_path}/tokens")
    got = {r._id: list(r.ids) for r in coder.read_files(files, with_ids=True).collect()}
    want = [ids.tolist() for ids in coder.token_ids([t or "" for t in texts.values()], coder.token_path())]
    assert got == {i: [*ids, coder.END_ID] for i, ids in zip(texts, want, strict=True)}
    assert "ids" not in coder.read_files(files).columns


def test_blocks_are_dealt_evenly_to_lanes(monkeypatch):
    """A step of the model costs much the same for few lanes as for many, so no few are left over."""
    ran, model = [], coder._model
    monkeypatch.setattr(coder, "LANES", 4)
    monkeypatch.setattr(coder, "_model", lambda *a: ran.append(a[1]) or model(*a))
    blocks = [np.arange(50) + i for i in range(9)]
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode_blocks(coder.encode_blocks(blocks)), strict=True))
    assert ran == [3] * 6
    assert coder.encode_blocks([]) == [] and coder.decode_blocks([]) == []


def test_files_of_before_can_be_read():
    """Encoded by the code before tables were flat."""
    ids = np.array([7, 9, 7, 9, 65535, 0, 7, 9, 7, 9, 4660, 1] * 30)
    code = coder.encode_blocks([ids])[0]
    assert hashlib.sha256(code).hexdigest() == "9634dec030b089724a14ba00257f2ccdfd5f4231f10fbfa0dfe5deed2cd28349"
    assert np.array_equal(coder.decode_blocks([code])[0], ids)
