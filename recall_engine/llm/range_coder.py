"""Token-id files coded by an adaptive range coder with mixed order-0 to order-2 predictions.

A file is a run of blocks behind an index of documents. A block of ``BLOCK`` ids is coded from a fresh model and
carries a CRC-32 of its ids, so any block can be read, checked or lost by itself. For each id

* order 2 (the two ids before) and order 1 (the id before) each predict an id, the last one that followed;
* a first flag says whether the order-2 id is right, a second whether the order-1 id is; the probability of each
  is the mean of two adaptive estimates, one chosen by the confidence of order 2, one by that of order 1;
* an id that neither predicts is coded as four hexadecimal digits with adaptive order-0 frequencies, each digit in
  the context of digits before it.

Blocks are independent, so up to ``LANES`` of them advance together: every step of the model and of the coder is a
numpy operation over all lanes. The coder keeps 32 bits and shifts out 16 at a time; carries are settled at the end.

Defined cases: a null or empty text has the end id alone; rows with a null id are left out; rows that share an id are
written one after the other in the order of their texts; ids have to be below 2**16; a changed byte makes
reading fail; an empty table gives no file. Columns besides id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm.common import Scratch, sliced, table, texts_of
from recall_engine.llm.registry import query
from recall_engine.operators import global_order

BLOCK, LANES = 4096, 2048
DOCS_PER_FILE = 512
END_ID = 1
MAGIC = b"IDRC"
KNOWN_WORDS = 500_000  # distinct words a worker remembers; a bound on memory, not on results
_ONE_BITS, _TWO_BITS = 10, 11
_SURE = 7  # highest confidence
_TOP = np.uint64(1 << 16)
_SHIFT, _LOW = np.uint64(16), np.uint64(0xFFFF)
_SCALE = 12  # bits of a flag's probability
_BITS, _ONE = np.uint64(_SCALE), np.uint64(1 << _SCALE)
_STEP, _LIMIT = 24, 1 << 13  # growth and bound of a digit's frequencies


class _Coder:
    """What both ends share: lanes, some of which are at work, with their ranges."""

    def __init__(self, lanes: int, offset: str):
        self._every, self._offset = np.arange(lanes), offset
        self.lanes, self.range = self._every, np.full(lanes, 1 << 32, np.uint64)

    def only(self, lanes: np.ndarray) -> None:
        """From now on these lanes are at work."""
        self._kept = getattr(self, self._offset), self.range
        setattr(self, self._offset, self._kept[0][lanes])
        self.lanes, self.range = lanes, self.range[lanes]

    def every(self) -> None:
        """All lanes are at work again."""
        offset, ranges = self._kept
        offset[self.lanes], ranges[self.lanes] = getattr(self, self._offset), self.range
        setattr(self, self._offset, offset)
        self.lanes, self.range = self._every, ranges


class _Encoder(_Coder):
    """Range coder over lanes; words of 16 bits, with a 17th for a carry into the word before."""

    def __init__(self, lanes: int, capacity: int):
        super().__init__(lanes, "low")
        self.low = np.zeros(lanes, np.uint64)
        self.words, self.count, self._most = np.zeros((lanes, capacity), np.uint32), np.zeros(lanes, np.int64), 0

    def put(self, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        self.low += unit * start
        self.range = unit * size
        at = np.flatnonzero(self.range < _TOP)
        if len(at):
            self._shift(at)

    def _shift(self, at: np.ndarray) -> None:
        self._most += 1
        if self._most + 2 >= self.words.shape[1]:
            self._most = int(self.count.max()) + 1
            if self._most + 2 >= self.words.shape[1]:
                self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        low, lanes = self.low[at], self.lanes[at]
        count = self.count[lanes]
        self.words.reshape(-1)[lanes * self.words.shape[1] + count] = low >> _SHIFT
        self.count[lanes] = count + 1
        self.low[at] = (low & _LOW) << _SHIFT
        self.range[at] <<= _SHIFT

    def flag(self, one: np.ndarray, probability: np.ndarray) -> np.ndarray:
        p = probability.astype(np.uint64)
        self.put(p * ~one, np.where(one, p, _ONE - p), self.range >> _BITS)
        return one

    def digit(self, digits: np.ndarray, below: np.ndarray) -> np.ndarray:
        """``below``: running frequency sums, 17 for each lane at work."""
        at = _lines(len(digits)) + digits
        flat = below.reshape(-1)
        start, end = flat.take(at), flat.take(at + 1)
        self.put(start.astype(np.uint64), (end - start).astype(np.uint64), self.range // below[:, 16])
        return digits

    def done(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(2):
            self._shift(every)
        words = self.words
        for i in range(int(self.count.max()) - 1, 0, -1):
            words[:, i - 1] += words[:, i] >> np.uint32(16)
        return [(words[i, : self.count[i]] & np.uint32(0xFFFF)).astype("<u2").tobytes() for i in every]


class _Decoder(_Coder):
    def __init__(self, payloads: list[bytes]):
        lanes, most = len(payloads), max(len(p) for p in payloads) // 2 + 4
        super().__init__(lanes, "code")
        self.words = np.zeros((lanes, most), np.uint64)
        for i, p in enumerate(payloads):
            self.words[i, : len(p) // 2] = np.frombuffer(p, "<u2")
        # ``code`` is the value read so far less the encoder's ``low``.
        self.code = self.words[:, 0] << _SHIFT | self.words[:, 1]
        self.at = np.full(lanes, 2)

    def _take(self, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        self.code -= unit * start
        self.range = unit * size
        at = np.flatnonzero(self.range < _TOP)
        if len(at):
            lanes, most = self.lanes[at], self.words.shape[1]
            place = self.at[lanes]
            self.code[at] = self.code[at] << _SHIFT | self.words.reshape(-1).take(lanes * most + np.minimum(place, most - 1))
            self.at[lanes] = place + 1
            self.range[at] <<= _SHIFT

    def flag(self, _: None, probability: np.ndarray) -> np.ndarray:
        unit = self.range >> _BITS
        p = probability.astype(np.uint64)
        one = self.code < unit * p
        self._take(p * ~one, np.where(one, p, _ONE - p), unit)
        return one

    def digit(self, _: None, below: np.ndarray) -> np.ndarray:
        unit = self.range // below[:, 16]
        target = np.minimum(self.code // unit, _LOW).astype(np.uint16)
        # The sums begin with 0, so as many of the first 16 as reach no further than the target make the digit and one.
        reached = below[:, :16] <= target[:, None]
        digits = np.bitwise_count(reached.view(np.uint64)).sum(axis=1, dtype=np.int64) - 1
        at = _lines(len(digits)) + digits
        flat = below.reshape(-1)
        start, end = flat.take(at), flat.take(at + 1)
        self._take(start.astype(np.uint64), (end - start).astype(np.uint64), unit)
        return digits


@lru_cache(maxsize=LANES)
def _lines(lanes: int) -> np.ndarray:
    """Where the running sums of each lane begin."""
    return np.arange(lanes) * 17


#: What a digit adds to the running sums of its row.
_GROWTH = (np.arange(17) > np.arange(16)[:, None]).astype(np.uint16) * np.uint16(_STEP)
#: Confidence after a wrong guess (first half) and after a right one.
_NEXT_SURE = np.array([s >> 1 if s > 1 else 0 for s in range(_SURE + 1)] + [min(s + 1, _SURE) for s in range(_SURE + 1)], np.int8)
_CONTEXTS = 1 + 16 + 256 + 256


def _model(coder: _Encoder | _Decoder, lanes: int, steps: int, ids: np.ndarray | None) -> np.ndarray:
    """Runs all lanes for ``steps`` ids; encodes ``ids`` (steps x lanes) or returns the decoded ones.

    Tables are flat, lane after lane; digits have running sums of their frequencies instead of the frequencies.
    """
    line = np.arange(lanes)
    out = np.zeros((steps, lanes), np.uint16) if ids is None else ids
    line1, line2, lines = line << _ONE_BITS, line << _TWO_BITS, line * (2 * (_SURE + 1))
    one_id, one_sure = np.zeros(lanes << _ONE_BITS, np.int32), np.zeros(lanes << _ONE_BITS, np.int8)
    two_id, two_sure = np.zeros(lanes << _TWO_BITS, np.int32), np.zeros(lanes << _TWO_BITS, np.int8)
    half = 1 << (_SCALE - 1)
    # Estimates of the two flags by the confidence of order 2 (with agreement) and of order 1.
    by_two = [np.full(lanes * 2 * (_SURE + 1), half, np.int32) for _ in range(2)]
    by_one = [np.full(lanes * 2 * (_SURE + 1), half, np.int32) for _ in range(2)]
    sums = np.tile(np.arange(17, dtype=np.uint16), (lanes * _CONTEXTS, 1))
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def flag(kind: int, two: np.ndarray, one: np.ndarray, truth: np.ndarray | None) -> np.ndarray:
        a, b = by_two[kind].take(two), by_one[kind].take(one)
        hit = coder.flag(truth, np.minimum(np.maximum((a + b) >> 1, 32), (1 << _SCALE) - 32))
        goal = hit.astype(np.int32) << _SCALE
        by_two[kind][two] = a + ((goal - a) >> 5)
        by_one[kind][one] = b + ((goal - b) >> 5)
        return hit

    def digits(truth: np.ndarray | None, base: np.ndarray) -> np.ndarray:
        """The ids of the lanes at work, whose tables begin at ``base``."""
        context, value = base, np.zeros(len(base), np.int64)
        first = None
        for place in range(4):
            below = sums.take(context, axis=0)
            digit = coder.digit(None if truth is None else truth >> (12 - 4 * place) & 15, below)
            below += _GROWTH.take(digit, axis=0)
            full = np.flatnonzero(below[:, 16] > _LIMIT)
            if len(full):
                below[full, 1:] = np.cumsum(np.diff(below[full]) >> 1 | 1, axis=1, dtype=np.uint16)
            sums[context] = below
            value = value << 4 | digit
            first = digit if place == 0 else first
            if place < 3:
                context = base + (1 + digit, 17 + value, 273 + (first << 4 | digit))[place]
        return value

    for step in range(steps):
        truth = None if ids is None else ids[step].astype(np.int64)
        slot1 = line1 + ((last * 0x9E3779B1 >> 7) & ((1 << _ONE_BITS) - 1))
        slot2 = line2 + (((last * 0x9E3779B1 + before * 0x85EBCA6B) >> 9) & ((1 << _TWO_BITS) - 1))
        guess1, guess2 = one_id.take(slot1), two_id.take(slot2)
        sure1, sure2 = one_sure.take(slot1), two_sure.take(slot2)
        same = lines + (guess1 == guess2)
        two, one = same + 2 * sure2, same + 2 * sure1
        hit2 = flag(0, two, one, None if truth is None else truth == guess2)
        hit1 = flag(1, two, one, None if truth is None else truth == guess1)
        value = np.where(hit2, guess2, guess1).astype(np.int64)
        use = np.flatnonzero(~(hit2 | hit1))
        if len(use) == lanes:
            value = digits(truth, line * _CONTEXTS)
        elif len(use):
            coder.only(use)
            value[use] = digits(None if truth is None else truth[use], use * _CONTEXTS)
            coder.every()
        if ids is None:
            out[step] = value
        for ids_, sure, slot, guess, hits in ((one_id, one_sure, slot1, guess1, sure1), (two_id, two_sure, slot2, guess2, sure2)):
            right = guess == value
            ids_[slot] = np.where(right | (hits > 1), guess, value)
            sure[slot] = _NEXT_SURE.take(hits + (_SURE + 1) * right)
        before, last = last, value
    return out


def _even(blocks: list) -> list[list]:
    """As few parts of at most ``LANES`` blocks as will do, of even size: a step costs much the same for few lanes."""
    n = -(-len(blocks) // LANES)
    return [blocks[len(blocks) * i // n : len(blocks) * (i + 1) // n] for i in range(n)]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Every block (ids below 2**16, none empty) as bytes: steps, count and CRC-32, then the code."""
    out: list[bytes] = []
    for part in _even(blocks):
        steps = max(len(b) for b in part)
        ids = np.zeros((steps, len(part)), np.uint16)
        for i, b in enumerate(part):
            if b.max() >> 16:
                raise ValueError("ids have to be below 2**16")
            ids[: len(b), i] = b
        coder = _Encoder(len(part), steps + 8)
        _model(coder, len(part), steps, ids)
        for b, code in zip(part, coder.done(), strict=True):
            out.append(struct.pack("<III", steps, len(b), zlib.crc32(b.astype("<u4").tobytes())) + code)
    return out


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of every block; a block whose checksum does not fit raises an error."""
    out: list[np.ndarray | None] = [None] * len(payloads)
    heads = [struct.unpack_from("<III", p) for p in payloads]
    order = sorted(range(len(payloads)), key=lambda i: heads[i][0])
    for part in _even(order):
        # Lanes that were coded over fewer steps read on into zeros; what lies behind their count is cut off.
        steps = max(heads[i][1] for i in part)
        ids = _model(_Decoder([payloads[i][12:] for i in part]), len(part), steps, None)
        for lane, i in enumerate(part):
            _, count, crc = heads[i]
            found = ids[:count, lane].astype("<u4")
            if len(found) != count or zlib.crc32(found.tobytes()) != crc:
                raise ValueError("a block does not fit its checksum")
            out[i] = found
    return out  # type: ignore[return-value]


def pack_files(files: list[tuple[list[int], np.ndarray, np.ndarray]], block: int = BLOCK) -> list[bytes]:
    """Files as bytes. Each is given as document ids, their token counts and all their token ids in a row."""
    cuts = [[ids[i : i + block] for i in range(0, len(ids), block)] for _, _, ids in files]
    coded = iter(encode_blocks([b for blocks in cuts for b in blocks]))
    out = []
    for (docs, counts, _), blocks in zip(files, cuts, strict=True):
        parts = [next(coded) for _ in blocks]
        index = np.asarray(docs, "<i8").tobytes() + np.asarray(counts, "<u8").tobytes() + np.asarray([len(p) for p in parts], "<u4").tobytes()
        out.append(MAGIC + struct.pack("<III", len(docs), len(parts), zlib.crc32(index)) + index + b"".join(parts))
    return out


def unpack_files(files: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, token counts and token ids of every file."""
    heads, payloads = [], []
    for file in files:
        if file[:4] != MAGIC:
            raise ValueError("not a token-id file")
        n_docs, n_blocks, crc = struct.unpack_from("<III", file, 4)
        body = 16 + 16 * n_docs + 4 * n_blocks
        if zlib.crc32(file[16:body]) != crc:
            raise ValueError("the index does not fit its checksum")
        docs, counts = np.frombuffer(file, "<i8", n_docs, 16), np.frombuffer(file, "<u8", n_docs, 16 + 8 * n_docs)
        ends = body + np.cumsum(np.frombuffer(file, "<u4", n_blocks, 16 + 16 * n_docs), dtype=np.int64)
        payloads += [file[a:b] for a, b in zip([body, *ends.tolist()], ends.tolist(), strict=False)]
        heads.append((docs, counts, n_blocks))
    blocks = iter(decode_blocks(payloads))
    return [(docs, counts, np.concatenate([np.zeros(0, "<u4"), *[next(blocks) for _ in range(n)]])) for docs, counts, n in heads]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of every text by the tokenizers library, without special tokens.

    The vocabulary drops white space before anything else looks at the text, so a text is encoded as its words, each
    distinct word once.
    """
    tokenizer, known = _tokenizer(path)
    words = [[w for w in t.replace("\n", " ").split(" ") if w] for t in texts]
    distinct = {w for ws in words for w in ws}
    fresh, new = list(distinct - known.keys()), {}
    for start in range(0, len(fresh), 10_000):
        part = fresh[start : start + 10_000]
        for word, found in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            new[word] = np.array(found.ids, "<u4").tobytes()
    if len(known) + len(new) <= KNOWN_WORDS:
        known.update(new)
        ids = known
    else:  # full: what came first stays, as frequent words come early
        ids = {w: known[w] for w in distinct if w in known} | new
    return [np.frombuffer(b"".join([ids[w] for w in ws]), "<u4") for ws in words]


def token_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_files(docs: DataFrame, path: str, id_col: str, text_col: str, docs_per_file: int, end_id: int) -> DataFrame:
    """``file`` (in id order) and ``payload``, one row per file."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[int], list[np.ndarray]]] = []

        def out(files: list[tuple[int, list[int], list[np.ndarray]]]) -> pa.RecordBatch:
            packed = pack_files([(ids, np.array([len(t) for t in tokens]), np.concatenate(tokens)) for _, ids, tokens in files])
            return pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in files], pa.int64()), pa.array(packed, pa.binary())], names=["file", "payload"])

        for batch in sliced(batches, "_text"):
            numbers, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for number, id_, tokens in zip(numbers, ids, token_ids(texts_of(batch.column(2)).to_pylist(), path), strict=True):
                if not held or held[-1][0] != number:
                    if sum(len(t) for _, _, ts in held for t in ts) >= BLOCK * LANES:
                        yield out(held)
                        held = []
                    held.append((number, [], []))
                held[-1][1].append(id_)
                held[-1][2].append(np.append(tokens, np.uint32(end_id)))
        if held:
            yield out(held)

    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.floor(F.col(id_col) / docs_per_file).cast("long").alias("_file"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")
    )
    return rows.repartition("_file").sortWithinPartitions("_file", "_id", "_text").mapInArrow(kernel, "file long, payload binary")


def write_files(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    docs_per_file: int = DOCS_PER_FILE,
    end_id: int = END_ID,
) -> None:
    """Write the token files of ``docs`` to ``folder`` (``file``, ``payload``), where they stay; an existing folder is an error."""
    token_files(docs, path or token_path(), id_col, text_col, docs_per_file, end_id).write.parquet(folder)


def read_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """``file``, ``_id``, ``_first`` (its first token in the file), ``n_tokens`` and ``ids_crc32`` of every document in the files,
    and, ``with_ids``, its decoded ``ids`` with the end id."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = 0
            while start < len(payloads):
                stop, size = start, 0
                while stop < len(payloads) and (stop == start or size < 2 * BLOCK * LANES):
                    size += len(payloads[stop])
                    stop += 1
                for number, (docs, counts, ids) in zip(numbers[start:stop], unpack_files(payloads[start:stop]), strict=True):
                    ends = np.cumsum(counts, dtype=np.int64)
                    firsts = ends - counts.astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
                    columns = {
                        "file": pa.array(np.full(len(docs), number)),
                        "_id": pa.array(docs),
                        "_first": pa.array(firsts),
                        "n_tokens": pa.array(counts.astype(np.int64)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                    if with_ids:
                        edges = pa.array(np.append(0, ends).astype(np.int32))
                        columns["ids"] = pa.ListArray.from_arrays(edges, pa.array(np.asarray(ids).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                start = stop

    schema = "file long, _id long, _first long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.select("file", "payload").mapInArrow(kernel, schema)


def write_and_read(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    docs_per_file: int = DOCS_PER_FILE,
    end_id: int = END_ID,
) -> DataFrame:
    """``id_col``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from files written and read back."""
    with Scratch(docs.sparkSession) as scratch:
        files = scratch.stage(token_files(docs, path or token_path(), id_col, text_col, docs_per_file, end_id), "token-files")
        found = scratch.stage(read_files(files), "token-documents", keep=True)
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = global_order.prefix_sums(totals, ["file"], {"_through": "_n"}).select("file", (F.col("_through") - F.col("_n")).alias("_before"))
    return found.join(before, "file").select(
        F.col("_id").alias(id_col), (F.col("_before") + F.col("_first")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op3_range_coder")
def op3_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents").select("doc_id", "text"))
