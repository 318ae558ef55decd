"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of the adjacent symbol pairs that are pieces and always merges the best: the highest
score, and of equal scores the leftmost. No piece of such a vocabulary has a blank mark behind another
character, so nothing merges across the start of a run of blank marks, and a text falls into chunks (blank
marks, then other characters) that are encoded independently; this is checked when the model is read. Each
Arrow batch is cut into its distinct chunks, all their agendas advance together in numpy, one merge per chunk and
round, and each distinct chunk is encoded by the sentencepiece library as well. A difference stops the job.

Symbols without a piece become the bytes of their UTF-8 form. Ids are decoded by the library.

Defined cases: a null or empty text has no ids and decodes to an empty text; texts may be of any length (a chunk
longer than ``LONGEST`` symbols runs its agenda on a heap instead of in the shared rounds); repeated rows give
equal rows; an empty table gives an empty one; other columns stay, columns named like those added are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm.common import sliced, table, texts_of
from recall_engine.llm.registry import query

BLANK = "\u2581"
CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*")
LONGEST = 64
IDS_AT_ONCE = 1 << 18
KNOWN_CHUNKS = 400_000  # distinct chunks a worker remembers; a bound on memory, not on results


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary as sorted arrays: piece pairs that merge, with the rank of the result."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        usable = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in usable}
        self.of_code = -1 - np.arange(0x110000, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_code[ord(piece)] = i
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(BLANK in piece.lstrip(BLANK) for piece in self.ids):
            raise ValueError("a piece runs across a blank mark; texts of this model cannot be cut there")
        if any(not self.library.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no byte pieces")
        scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Score order of each piece, 0 the best.
        self.rank = np.full(n, len(order), np.int32)
        for piece, i in self.ids.items():
            self.rank[i] = order[scores[piece]]
        pairs = [
            (self.ids[piece[:k]] * n + self.ids[piece[k:]], i)
            for piece, i in self.ids.items()
            for k in range(1, len(piece))
            if piece[:k] in self.ids and piece[k:] in self.ids
        ]
        pairs.sort()
        self.size = n
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ids = np.array([i for _, i in pairs], np.int32)
        self.merged = dict(pairs)
        #: Chunks met so far in this worker by number; ids of these in a row, and how many each has.
        self.known: dict[str, int] = {}
        self.known_ids = np.zeros(0, np.int32), np.zeros(0, np.int64)
        #: ",0,1,2,..." and where each id begins in it.
        written = [f",{i}".encode() for i in range(n)]
        self.decimals = np.frombuffer(b"".join(written), np.uint8)
        self.decimal_counts = np.array([len(w) for w in written], np.int64)
        self.decimal_starts = np.cumsum(self.decimal_counts) - self.decimal_counts
        # Pairs of Latin letters, the first step of nearly all texts, are read from a square table.
        letters = [i for p, i in self.ids.items() if len(p) == 1 and (ord(p) < 0x250 or p == BLANK)]
        self.letter = np.full(n + 1, len(letters), np.int32)  # the last entry is for symbols without a piece
        self.letter[letters] = np.arange(len(letters))
        self.square = np.full((len(letters) + 1, len(letters) + 1), -1, np.int32)
        left, right = (x.ravel() for x in np.meshgrid(letters, letters, indexing="ij"))
        self.square[: len(letters), : len(letters)] = self.lookup(left, right).reshape(len(letters), -1)

    def symbols(self, text: str) -> np.ndarray:
        """A piece id per character; -1 - code point where there is no piece."""
        return self.of_code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def spelled(self, symbols: list[int]) -> list[int]:
        """Ids with byte pieces for the characters that have none."""
        out: list[int] = []
        for s in symbols:
            out.extend([s] if s >= 0 else [self.bytes[b] for b in chr(-1 - s).encode()])
        return out

    def first_pairs(self, sym: np.ndarray) -> np.ndarray:
        """``lookup`` of all neighbours in a matrix of symbols."""
        other = len(self.square) - 1
        letters = self.letter[np.where(sym >= 0, sym, self.size)]
        found = self.square[letters[:, :-1], letters[:, 1:]]
        rest = np.nonzero(((letters[:, :-1] == other) | (letters[:, 1:] == other)) & (sym[:, :-1] >= 0) & (sym[:, 1:] >= 0))
        found[rest] = self.lookup(sym[:, :-1][rest], sym[:, 1:][rest])
        return found

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the merged piece of each pair, -1 where there is none."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], -1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def merge_one(symbols: list[int], vocabulary: Pieces) -> list[int]:
    """The agenda of one long chunk, on a heap over a linked list."""
    n, rank, merged, size = len(symbols), vocabulary.rank, vocabulary.merged, vocabulary.size
    after, before, sym = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and sym[i] >= 0 and sym[j] >= 0 and (to := merged.get(sym[i] * size + sym[j], -1)) >= 0:
            heapq.heappush(agenda, (int(rank[to]), i, to, sym[i], sym[j]))

    for i in range(n - 1):
        offer(i)
    gone = [False] * n
    while agenda:
        _, i, to, a, b = heapq.heappop(agenda)
        j = after[i]
        if gone[i] or j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], gone[j] = to, True
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s, g in zip(sym, gone, strict=True) if not g]


def merge_all(chunks: list[str], vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The agendas of many short chunks (none of them empty): each round merges the best pair of every chunk that has one.

    Chunks are rows of a matrix padded on the right; a merge closes the gap in its row. Ranks of the pairs are
    kept and only the two pairs beside a merge are looked up again. Returns all symbols in a row, and their number
    per chunk.
    """
    if not chunks:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    lengths = np.array([len(c) for c in chunks], np.int64)
    width = int(lengths.max())
    none = np.int32(1 << 30)
    sym = np.full((len(chunks), width + 1), -(1 << 30), np.int32)
    mask = np.arange(width + 1) < lengths[:, None]
    sym[mask] = vocabulary.symbols("".join(chunks))
    to = vocabulary.first_pairs(sym)
    cost = np.where(to >= 0, vocabulary.rank[to], none)
    out, counts = np.zeros((len(chunks), width + 1), np.int32), np.zeros(len(chunks), np.int64)
    rows = np.arange(len(chunks))
    columns = np.arange(width + 1)
    while True:
        best = cost.argmin(axis=1)
        line = np.arange(len(rows))
        open_ = cost[line, best] < none
        if not open_.all():
            out[rows[~open_]], counts[rows[~open_]] = sym[~open_], lengths[~open_]
        if not open_.any():
            return out[np.arange(width + 1) < counts[:, None]], counts
        if not open_.all():
            sym, cost, to, best, rows, lengths = sym[open_], cost[open_], to[open_], best[open_], rows[open_], lengths[open_]
            line = np.arange(len(rows))
        new = to[line, best]
        shift = columns[None, :] > best[:, None]
        source = np.minimum(columns[None, :] + shift, width)
        sym = np.take_along_axis(sym, source, axis=1)
        sym[line, best] = new
        source = source[:, :width]
        to, cost = (np.take_along_axis(x, np.minimum(source, width - 1), axis=1) for x in (to, cost))
        lengths = lengths - 1
        sym[line, lengths] = -(1 << 30)
        cost[line, np.minimum(lengths - 1, width - 1)] = none
        for at in (best, best - 1):
            ok = (at >= 0) & (at < lengths - 1)
            r, c = line[ok], at[ok]
            fresh = vocabulary.lookup(sym[r, c], sym[r, c + 1])
            to[r, c], cost[r, c] = fresh, np.where(fresh >= 0, vocabulary.rank[fresh], none)


def encode_chunks(chunks: list[str], vocabulary: Pieces) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The chunks in some order, all their ids in a row and their numbers of ids, by the agenda; checked against the library."""
    short = sorted((c for c in chunks if len(c) <= LONGEST), key=len)
    order, ids, counts, odd = [], [], [], []
    for start in range(0, len(short), 20_000):  # alike lengths together: little padding
        part = short[start : start + 20_000]
        flat, number = merge_all(part, vocabulary)
        owner = np.repeat(np.arange(len(part)), number)
        strange = np.unique(owner[flat < 0])  # with characters that have no piece
        ends = np.cumsum(number)
        for at in strange.tolist():
            odd.append((part[at], flat[ends[at] - number[at] : ends[at]].tolist()))
        plain = np.ones(len(part), bool)
        plain[strange] = False
        order += part if not len(strange) else [c for c, p in zip(part, plain.tolist(), strict=True) if p]
        ids.append(flat[plain[owner]])
        counts.append(number[plain])
    odd += [(c, merge_one(vocabulary.symbols(c).tolist(), vocabulary)) for c in chunks if len(c) > LONGEST]
    spelled = [vocabulary.spelled(symbols) for _, symbols in odd]
    order += [chunk for chunk, _ in odd]
    ids.append(np.fromiter(chain.from_iterable(spelled), np.int32))
    counts.append(np.fromiter(map(len, spelled), np.int64, len(spelled)))
    flat = np.concatenate([np.zeros(0, np.int32), *ids])
    number = np.concatenate([np.zeros(0, np.int64), *counts])
    _compare(order, flat, number, vocabulary)
    return order, flat, number


def _compare(order: list[str], flat: np.ndarray, number: np.ndarray, vocabulary: Pieces) -> None:
    """Raises where the library has other ids for a chunk."""
    library = vocabulary.library.encode([c[1:].replace(BLANK, " ") for c in order], num_threads=1)
    ends = np.cumsum(number)
    if BLANK in order:
        # The library puts one blank mark in front of whatever it encodes; a single mark is therefore not compared.
        at = order.index(BLANK)
        library[at] = flat[ends[at] - number[at] : ends[at]].tolist()
    lengths = np.fromiter(map(len, library), np.int64, len(library))
    if np.array_equal(lengths, number) and np.array_equal(np.fromiter(chain.from_iterable(library), np.int32, len(flat)), flat):
        return
    for chunk, want, end, n in zip(order, library, ends.tolist(), number.tolist(), strict=True):
        if flat[end - n : end].tolist() != want:
            raise ValueError(f"chunk {chunk!r}: {flat[end - n : end].tolist()} differs from the library's {want}")


def chunks_of(text: str) -> list[str]:
    """Runs of blank marks, each with the characters behind it; the library puts one blank in front."""
    return CHUNK.findall(BLANK + text.replace(" ", BLANK)) if text else []


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run behind the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def encode_batch(texts: pa.Array, vocabulary: Pieces) -> list[np.ndarray]:
    """Ids of every text. A chunk is looked up for its number, and the ids of the numbers are gathered at once."""
    chunks = [chunks_of(t) for t in texts.to_pylist()]
    known, (ids, counts) = vocabulary.known, vocabulary.known_ids
    distinct = set().union(*chunks)
    order, new_ids, new_counts = encode_chunks([c for c in distinct if c not in known], vocabulary)
    ids, counts = np.concatenate([ids, new_ids]), np.concatenate([counts, new_counts])
    numbers = dict(zip(order, range(len(known), len(counts)), strict=True))
    if len(known) + len(order) <= KNOWN_CHUNKS:
        known.update(numbers)
        vocabulary.known_ids, numbers = (ids, counts), known
    else:  # full: what came first stays, as frequent chunks come early
        numbers |= {c: known[c] for c in distinct if c in known}
    starts = np.cumsum(counts) - counts
    out = []
    for cs in chunks:
        at = np.fromiter(map(numbers.__getitem__, cs), np.int64, len(cs))
        out.append(ids[_runs(starts[at], counts[at])])
    return out


def decimals_sha256(ids: np.ndarray, vocabulary: Pieces) -> str:
    """Hash of the ids as decimals joined by commas."""
    found = hashlib.sha256()
    for start in range(0, len(ids), IDS_AT_ONCE):
        part = ids[start : start + IDS_AT_ONCE]
        written = vocabulary.decimals[_runs(vocabulary.decimal_starts[part], vocabulary.decimal_counts[part])]
        found.update(written.tobytes()[0 if start else 1 :])  # no comma in front of the first
    return found.hexdigest()


def encode_and_decode(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False
) -> DataFrame:
    """All columns with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, unless ``digest_only``, ``ids`` and ``decoded``."""
    where = path or model_path()
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if not digest_only:
        added |= {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    kept = [f for f in docs.schema.fields if f.name not in added]
    named = [f.name for f in kept]
    text_at = named.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(where)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in sliced(batches, text_col):
            encoded = encode_batch(texts_of(batch.column(text_at)), vocabulary)
            plain = [ids.tolist() for ids in encoded]
            decoded = vocabulary.library.decode(plain, num_threads=1)
            columns = [
                pa.array([len(ids) for ids in encoded], pa.int64()),
                pa.array([decimals_sha256(ids, vocabulary) for ids in encoded], pa.string()),
                pa.array([digest(s) for s in decoded], pa.string()),
            ]
            if not digest_only:
                columns += [pa.array(plain, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*named, *added])

    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in added.items()]])
    return docs.select(*[docs[n] for n in named]).mapInArrow(kernel, schema)


@query("op4_piece_agenda")
def op4_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_and_decode(docs, digest_only=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
