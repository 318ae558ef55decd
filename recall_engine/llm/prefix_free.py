"""Removes repeated byte strings across documents by a prefix-free parse.

Every ``LENGTH``-byte string has a trigger: the ``GRAM`` bytes inside it with the smallest rolling hash (the leftmost
of equals). Consecutive strings of a document with the same trigger make a phrase; neighbouring phrases
overlap by ``LENGTH - 1`` bytes, so each string lies in exactly one phrase and equal strings have equal triggers.

1. Triggers that one document alone holds are left out: nothing around them repeats.
2. The dictionary holds each distinct phrase around the other triggers once per group of documents, with the smallest id
   of a document that has it; the parse, where each document has which phrase, is made again from the text.
3. Order: suffixes of the dictionary are grouped by their first ``LENGTH`` bytes, trigger by trigger, inside tasks. To this
   depth the overlap lets the dictionary decide by itself, so of the parse only the places are needed, not a suffix
   array of its own.
4. The parse carries the first document of every string back to the documents.

Documents are dealt into groups by a hash, triggers into buckets by theirs; both numbers follow the bytes of the table. What goes
between a group and a bucket is one row of packed arrays, so disk holds hashes, distinct phrases and a bit per string, never a
row per string. A trigger is sent once per group, a phrase once per group, however many copies of a document there are. The distinct
phrases around one trigger meet in one task.

Defined cases: null and empty texts and texts shorter than ``LENGTH`` bytes lose nothing; rows with a null id lose
nothing and do not count; rows that share an id are one document (nothing repeats inside it) and each row has its
own places; an empty table gives an empty one. Other columns stay; columns named like those added are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm.common import Scratch, bytes_of, powers, sliced, table, texts_of
from recall_engine.llm.registry import query
from recall_engine.operators import global_order

LENGTH, GRAM = 50, 16
_BASE = 0xD1342543DE82EF95
_BASE_2 = 0x9E6C63D0876A9A63
#: One random 64-bit value for each byte, for each of two hashes.
_VALUE, _VALUE_2 = (np.random.default_rng(n).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (23, 29))
_PLACE_BITS = 28
#: Bytes of text for each group of documents and for each bucket of triggers, and the least number of both.
GROUP_BYTES, BUCKET_BYTES, LEAST = 16 << 20, 8 << 20, 64
#: Text that the arrays of a kernel cover at a time (they are several times larger), and triggers a task holds before it sends them.
KERNEL_BYTES, HELD = 256 << 10, 1 << 21
_KEY = ["_id", "_text_hash"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    return x


def _sums(data: np.ndarray, base: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of all bytes, and the factors that take the place out of a difference of two."""
    bits = max(12, len(data).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * powers(base, bits)[: len(data)], out=sums[1:])
    return sums, powers(pow(base, -1, 1 << 64), bits)


def rolling_hashes(data: np.ndarray, gram: int, base: int = _BASE, value: np.ndarray = _VALUE) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes, from one running sum."""
    sums, factors = _sums(data, base, value)
    return _mixed((sums[gram:] - sums[:-gram]) * factors[: len(data) + 1 - gram])


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, which no range is empty of."""
    sums, factors = _sums(data, _BASE_2, _VALUE_2)
    return _mixed((sums[ends] - sums[starts]) * factors[starts] + (ends - starts).astype(np.uint64))


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Trigger hash, trigger place, first string and number of strings of every phrase, and its text.

    Places count from the start of all bytes. A slice has to be shorter than 2**28 bytes.
    """
    none = np.zeros(0, np.int64)
    if len(data) >> _PLACE_BITS:
        raise ValueError("a single text of 256 MB or more has to be cut first")
    if len(data) < length:
        return none.astype(np.uint64), none, none, none, none
    hashes = rolling_hashes(data, gram)
    packed = (hashes >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    least, wide, span = packed, 1, length - gram + 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < span:
        least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
    trigger = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    # A string counts if it ends inside the text that it begins in.
    inside = np.zeros(len(data) + 1, np.int8)
    sizes = np.diff(offsets)
    long_enough = sizes >= length
    np.add.at(inside, offsets[:-1][long_enough], 1)
    np.add.at(inside, offsets[1:][long_enough] - length + 1, -1)
    valid = np.cumsum(inside)[: len(trigger)] > 0
    starts = np.flatnonzero(valid & np.concatenate([[True], (trigger[1:] != trigger[:-1]) | ~valid[:-1]]))
    if not len(starts):
        return none.astype(np.uint64), none, none, none, none
    # Strings of two texts never share a trigger: it lies inside both.
    ends = np.flatnonzero(valid & np.concatenate([(trigger[1:] != trigger[:-1]) | ~valid[1:], [True]]))
    owner = np.searchsorted(offsets, starts, "right") - 1
    return hashes[trigger[starts]], trigger[starts], starts, ends - starts + 1, owner


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_text_hash`` and ``_text`` of the rows that take part."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.col(text_col).alias("_text"))
    return rows.filter(F.col("_id").isNotNull() & F.col("_text").isNotNull())


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays, one after the other, compressed."""
    raw = b"".join([a.tobytes() for a in arrays])
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(payload: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays, of equal length and of these dtypes, that were packed."""
    (size,) = struct.unpack_from("<q", payload)
    raw = pa.decompress(payload[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n = size // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _joined(payloads: pa.ChunkedArray, *kinds: str) -> list[np.ndarray]:
    parts = [_unpacked(p, *kinds) for p in payloads.to_pylist()]
    return [np.concatenate([np.zeros(0, kind), *[part[i] for part in parts]]) for i, kind in enumerate(kinds)]


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def _bucket(triggers: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the trigger's hash."""
    return (((triggers >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _parse(texts: pa.RecordBatch | pa.Table, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes, trigger, first byte, end, row and start of the row of every phrase, for a slice of ``_text`` after the other."""
    row = 0
    for batch in sliced(iter(texts.to_batches() if isinstance(texts, pa.Table) else [texts]), "_text", KERNEL_BYTES):
        data, offsets = bytes_of(texts_of(batch.column(batch.schema.get_field_index("_text"))))
        hashes, _, starts, counts, owner = phrases(data, offsets, length, gram)
        # The least hash of many is small; triggers are hashed again to spread over buckets.
        yield data, _mixed(hashes * np.uint64(_BASE_2)), starts, starts + counts + (length - 1), row + owner, offsets[owner]
        row += batch.num_rows


def trigger_blocks(rows: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """``_bucket`` and ``_block``: packed triggers, groups, and the least id in the group with what the largest one adds to it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            triggers, groups, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((groups, triggers))
            triggers, groups, ids = triggers[order], groups[order], ids[order]
            at = _firsts(triggers, groups)
            low, high = (f.reduceat(ids, at) if len(at) else ids for f in (np.minimum, np.maximum))
            triggers, groups = triggers[at], groups[at]
            edges = np.searchsorted(_bucket(triggers, buckets), np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            blocks = [_packed(triggers[a:b], groups[a:b], low[a:b], high[a:b] - low[a:b]) for a, b in zip(edges[some], edges[some + 1], strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blocks, pa.binary())], names=["_bucket", "_block"])

        for batch in batches:
            ids, groups = (np.asarray(batch.column(i)) for i in (0, 1))
            for _, triggers, _, _, owner, _ in _parse(batch, length, gram):
                held.append((triggers, groups[owner], ids[owner]))
                if sum(len(h[0]) for h in held) >= HELD:
                    yield out()
        if held:
            yield out()

    return rows.select("_order", "_group", "_text").mapInArrow(kernel, "_bucket int, _block binary")


def shared_triggers(blocks: DataFrame) -> DataFrame:
    """``_group`` and ``_triggers``: packed triggers of the group that several documents have."""

    def kernel(rows: pa.Table) -> pa.Table:
        triggers, groups, low, span = _joined(rows["_block"], "<u8", "<i4", "<i8", "<i8")
        order = np.argsort(triggers, kind="stable")
        triggers, groups, low, high = triggers[order], groups[order], low[order], (low + span)[order]
        at = _firsts(triggers)
        several = np.minimum.reduceat(low, at) < np.maximum.reduceat(high, at)
        several = np.repeat(several, np.diff(np.append(at, len(triggers))))
        triggers, groups = triggers[several], groups[several]
        order = np.lexsort((triggers, groups))
        triggers, groups = triggers[order], groups[order]
        at = _firsts(groups, triggers)
        triggers, groups = triggers[at], groups[at]
        at = _firsts(groups)
        packed = [_packed(triggers[a:b]) for a, b in zip(at, np.append(at[1:], len(groups)), strict=True)]
        return pa.table({"_group": pa.array(groups[at]), "_triggers": pa.array(packed, pa.binary())})

    return blocks.groupBy("_bucket").applyInArrow(kernel, "_group int, _triggers binary")


def _member(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted known ones, and where."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def dictionaries(rows: DataFrame, shared: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """``_bucket``, ``_group``, ``_heads`` (least id and size of each distinct phrase of the group) and ``_bodies`` (their bytes, in a row)."""

    def kernel(docs: pa.Table, known: pa.Table) -> pa.Table:
        wanted = np.sort(_joined(known["_triggers"], "<u8")[0])
        ids = np.asarray(docs["_order"])
        found, bodies = [], []
        for data, triggers, starts, ends, owner, _ in _parse(docs, length, gram) if len(wanted) else ():
            some, _ = _member(triggers, wanted)
            starts, ends, raw = starts[some], ends[some], data.tobytes()
            found.append((triggers[some], range_hashes(data, starts, ends), ids[owner[some]]))
            bodies += [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        out = {"_bucket": pa.array([], pa.int32()), "_group": pa.array([], pa.int32()), "_heads": pa.array([], pa.binary()), "_bodies": pa.array([], pa.binary())}
        if not bodies:
            return pa.table(out)
        triggers, keys, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, keys))
        order = order[_firsts(keys[order])]
        order = order[np.argsort(triggers[order], kind="stable")]
        edges = np.searchsorted(_bucket(triggers[order], buckets), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(edges))
        heads, packed = [], []
        for a, b in zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True):
            part = [bodies[i] for i in order[a:b].tolist()]
            heads.append(_packed(ids[order[a:b]], np.array([len(x) for x in part], np.int32)))
            packed.append(_packed(np.frombuffer(b"".join(part), np.uint8)))
        group = np.full(len(some), docs["_group"][0].as_py(), np.int32)
        arrays = [pa.array(some.astype(np.int32)), pa.array(group), pa.array(heads, pa.binary()), pa.array(packed, pa.binary())]
        return pa.table(dict(zip(out, arrays, strict=True)))

    left = rows.select("_order", "_group", "_text").groupBy("_group")
    return left.cogroup(shared.groupBy("_group")).applyInArrow(kernel, "_bucket int, _group int, _heads binary, _bodies binary")


def earlier_strings(dictionary: DataFrame, length: int, gram: int) -> DataFrame:
    """``_group``, ``_keys`` (hashes of its phrases) and ``_bits``: for every string of the phrase, whether a document has it whose id
    is below the least one that the group has for the phrase. Phrases without such a string are left out."""
    width = length - gram + 1

    def kernel(rows: pa.Table) -> pa.Table:
        keys, low, counts, one, two = [], [], [], [], []
        for heads, bodies in zip(rows["_heads"].to_pylist(), rows["_bodies"].to_pylist(), strict=True):
            least, sizes = _unpacked(heads, "<i8", "<i4")
            (data,) = _unpacked(bodies, "u1")
            ends = np.cumsum(sizes, dtype=np.int64)
            n = sizes.astype(np.int64) - (length - 1)
            keys.append(range_hashes(data, ends - sizes, ends))
            place = np.arange(n.sum()) + np.repeat(ends - sizes - np.cumsum(n) + n, n)
            low.append(least)
            counts.append(n)
            one.append(rolling_hashes(data, length)[place])
            two.append(rolling_hashes(data, length, _BASE_2, _VALUE_2)[place])
        sizes = np.array([len(k) for k in keys])
        keys, low, counts, one, two = (np.concatenate(x) for x in (keys, low, counts, one, two))
        phrase = np.repeat(np.arange(len(keys)), counts)
        order = np.argsort(one)
        at = _firsts(one[order])
        if len(_firsts(one[order], two[order])) != len(at):  # two strings share the first hash
            order = np.lexsort((two, one))
            at = _firsts(one[order], two[order])
        ids = low[phrase]
        least = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(order))))
        gone = order[least < ids[order]]
        bits = np.zeros((len(keys), width), bool)
        bits[phrase[gone], gone - (np.cumsum(counts) - counts)[phrase[gone]]] = True
        some = bits.any(axis=1)
        packed = np.packbits(bits, axis=1)
        ends = np.cumsum(sizes)
        parts = [(g, np.arange(a, b)[some[a:b]]) for g, a, b in zip(rows["_group"].to_pylist(), ends - sizes, ends, strict=True)]
        parts = [(g, at) for g, at in parts if len(at)]
        return pa.table(
            {
                "_group": pa.array([g for g, _ in parts], pa.int32()),
                "_keys": pa.array([_packed(keys[at]) for _, at in parts], pa.binary()),
                "_bits": pa.array([_packed(packed[at]) for _, at in parts], pa.binary()),
            }
        )

    return dictionary.groupBy("_bucket").applyInArrow(kernel, "_group int, _keys binary, _bits binary")


def text_runs(rows: DataFrame, earlier: DataFrame, length: int, gram: int) -> DataFrame:
    """``_id``, ``_text_hash`` and ``_runs`` of the rows that lose something, once each."""
    width = length - gram + 1
    runs_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def kernel(docs: pa.Table, known: pa.Table) -> pa.Table:
        ids, texts = np.asarray(docs["_order"]), np.asarray(docs["_text_hash"])
        if len(ids):
            order = np.lexsort((texts, ids))
            docs = docs.take(pa.array(np.sort(order[_firsts(ids[order], texts[order])])))
            ids = np.asarray(docs["_order"])
        parts = [(range_hashes(data, starts, ends), starts - zero, ends - zero, row) for data, _, starts, ends, row, zero in _parse(docs, length, gram) if len(starts)]
        none = np.zeros(0, np.int64)
        key, start, end, row = (np.concatenate(x) for x in zip((none.view(np.uint64), none, none, none), *parts, strict=True))
        order = np.lexsort((ids[row], key))
        at = _firsts(key[order])
        least = np.empty(len(key), np.int64)
        least[order] = np.repeat(ids[row][order][at], np.diff(np.append(at, len(key))))
        # A phrase that the group has earlier goes whole; else its strings that other groups have earlier.
        later = ids[row] > least
        keys = _joined(known["_keys"], "<u8")[0]
        bits = _joined(known["_bits"], "u1")[0].reshape(len(keys), -(-width // 8))
        order = np.argsort(keys)
        hit, place = _member(key, keys[order])
        hit = np.flatnonzero(hit & ~later)
        which, i = np.nonzero(np.unpackbits(bits[order][place[hit]], axis=1, count=width)) if len(hit) else (none, none)
        a = np.concatenate([start[later], start[hit[which]] + i])
        b = np.concatenate([end[later], start[hit[which]] + i + length])
        owner = np.concatenate([row[later], row[hit[which]]])
        order = np.lexsort((a, owner))
        a, b, owner = a[order], b[order], owner[order]
        # Overlapping and touching ranges are joined: a new one begins behind all ends of the row so far.
        far = owner << 32
        reach = np.maximum.accumulate(far + b)
        new = np.ones(len(a), bool)
        new[1:] = far[1:] + a[1:] > reach[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(a)) - 1
        begin, stop, owner = a[at], reach[last] - far[last] if len(at) else none, owner[at]
        at = _firsts(owner)
        edges = pa.array(np.append(at, len(owner)).astype(np.int32))
        spans = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["a", "b"])
        lost = docs.take(pa.array(owner[at]))
        return pa.table({"_id": lost["_id"], "_text_hash": lost["_text_hash"], "_runs": pa.ListArray.from_arrays(edges, spans).cast(runs_type)})

    kind = rows.schema["_id"].dataType.simpleString()
    left = rows.select(*_KEY, "_order", "_group", "_text").groupBy("_group")
    return left.cogroup(earlier.groupBy("_group")).applyInArrow(kernel, f"_id {kind}, _text_hash long, _runs array<struct<a:int,b:int>>")


def repeated_runs(plain: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``_id``, ``_text_hash`` and ``_runs``: structs ``a``, ``b`` of byte ranges to remove, in order and apart."""
    size = plain.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    groups, buckets = (max(LEAST, size // most) for most in (GROUP_BYTES, BUCKET_BYTES))
    if isinstance(plain.schema["_id"].dataType, T.IntegralType):
        rows = plain.withColumn("_order", F.col("_id").cast("long"))
    else:
        rows = plain.join(global_order.dense_id(plain.select("_id").distinct(), ["_id"], "_order"), "_id")
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(*_KEY), F.lit(groups)).cast("int"))
    shared = scratch.stage(shared_triggers(trigger_blocks(rows, buckets, length, gram)), "shared-triggers")
    dictionary = dictionaries(rows, shared, buckets, length, gram)
    earlier = scratch.stage(earlier_strings(dictionary, length, gram), "earlier-strings")
    return text_runs(rows, earlier, length, gram)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, digest_only: bool = False
) -> DataFrame:
    """All columns with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, unless ``digest_only``, ``kept`` (bytes)
    and ``spans`` (what was removed, as byte ranges)."""
    span = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    added = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    if not digest_only:
        added |= {"kept": T.BinaryType(), "spans": span}
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.stage(repeated_runs(_plain(docs, id_col, text_col), scratch, length, gram), "repeated-runs", keep=True)
    gone = gone.select(F.col("_id").alias("_gone_id"), F.col("_text_hash").alias("_gone_hash"), "_runs")
    row = docs.select(F.struct("*").alias("_row"))
    text = F.col("_row")[text_col]
    on = (F.col("_row")[id_col] == F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_hash"))
    marked = row.join(gone, on, "left").select("_row", text.alias("_text"), "_runs")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            sizes, removed, spans, keeps = [], [], [], []
            for body, runs in zip(texts_of(batch.column(1)).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cut = merged([(r["a"], r["b"]) for r in runs or ()])
                edges = [0, *[x for run in cut for x in run], len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(body))
                removed.append(len(body) - len(kept))
                spans.append([{"a": a, "b": b} for a, b in cut])
                keeps.append(kept)
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array([len(s) for s in spans], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in keeps], pa.string()),
            ]
            if not digest_only:
                columns += [pa.array(keeps, pa.binary()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", *added])

    schema = T.StructType([marked.schema["_row"], *[T.StructField(n, t) for n, t in added.items()]])
    out = marked.mapInArrow(kernel, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *added)


@query("op10_prefix_free")
def op10_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, digest_only=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
