"""Personal data in whole texts: patterns for plain forms, and a linear-chain CRF for what they miss.

Base spans come from patterns with checks (Luhn, parts, number of digits). The CRF labels tokens (runs of letters, digits
and the marks of addresses) with begin, inside or outside of four kinds. Its features are identities that the labelled
table holds: the words that stand inside its spans, the shape of a token (letters as one ``a``, digits as one to three ``9``) and the
short shape (every run as one), of the token and its neighbours. Weights are trained by gradient ascent with
forward-backward sums. Decoded spans that pass the check of their kind and touch no base span are added.

Decoding is Viterbi over numpy batches of sequences. Most tokens of running text have none of the features. When the model is
made, the least number of such plain tokens is found through which a best path can always be led over "outside" (and
that staying outside is best between two such places); texts are cut there, which changes no label, and the pieces
are decoded together. If there is no such number whole texts are decoded. A test compares both.

The table for training is small and collected; more than ``MOST_LABELLED`` rows are refused. What a task holds follows ``SLICE_BYTES`` of
text or its longest single text; weights travel with the function.

Defined cases: null and empty texts have no spans; offsets count code points; rows are judged one by one, so null
ids and repeated rows are like others; an empty table gives an empty one. Columns named like those added are
replaced, all others stay.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm.common import bytes_of, sliced, table, texts_of
from recall_engine.llm.registry import query
from recall_engine.llm.winnowing import word_hashes

KINDS = ("email", "ip", "card", "phone")
MOST_LABELLED = 5_000
STEPS, RATE, DECAY = 150, 0.2, 1e-3
#: Patterns of the base spans. A run of digits is entered at its first digit only, which finds the same and stays linear.
_MAILBOX = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile("[0-9]+")

Span = tuple[str, int, int]


# --- base patterns ----------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = "".join(_DIGITS.findall(text))
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 9 <= sum(map(len, _DIGITS.findall(text))) <= 15


def _is_ip(text: str) -> bool:
    parts = [part.lstrip("0") for part in _DIGITS.findall(text)]
    return len(parts) == 4 and all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def _is_email(text: str) -> bool:
    words = set(re.split(r"[^\w@.]+", text.lower()))
    return ("@" in text or bool(words & AT_WORDS)) and ("." in text or bool(words & DOT_WORDS))


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield "email", begin, domain.end()
            free = domain.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    for kind, pattern, check in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        if kind != "phone" or "+" in text:
            found += [(kind, *m.span()) for m in pattern.finditer(text) if check(m[0])]
    return _in_order(found)


def _in_order(spans: Sequence[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the labelled table -----------------------------------------------------------------------------

#: Words that stand for the marks of an address (fixed values).
AT_WORDS = frozenset({"at", "ät", "arroba", "arobase"})
DOT_WORDS = frozenset({"dot", "punkt", "punto", "point"})
#: Forms of personal data; lower-case letters in braces are drawn.
FORMS = {
    "email": (
        "{a}@{b}.{c}", "{a}.{a}@{b}.{c}", "{a}.{k}@{b}{d}.{b}.{c}", "{a} at {b} dot {c}", "{a} dot {a} at {b} dot {c}", "{a}{k} at {b} dot {c}",
        "{a} (at) {b} (dot) {c}", "{a} [at] {b} [dot] {c}", "{a} [at] {b}.{c}", "{a}(at){b}.{c}", "{a}[at]{b}[dot]{c}", "{a} at {b}.{c}",
        "{a} arroba {b} punto {c}", "{a} arobase {b} point {c}", "{a} ät {b} punkt {c}", "{a}.{a} (at) {b} dot {b} dot {c}",
    ),
    "ip": ("{i}.{i}.{i}.{i}", "{i}[.]{i}[.]{i}[.]{i}", "{i}(.){i}(.){i}(.){i}", "{i} dot {i} dot {i} dot {i}", "{i}[dot]{i}[dot]{i}[dot]{i}"),
    "card": ("{q} {q} {q} {q}", "{q}-{q}-{q}-{q}", "{q}.{q}.{q}.{q}", "{q}_{q}_{q}_{q}", "{q}/{q}/{q}/{q}"),
    "phone": ("+{d} ({t}) {t}-{q}", "({t}) {t}-{q}", "{t}-{t}-{q}", "({t}) {t} {q}", "{t}.{t}.{q}", "00{k} {t} {t} {q}", "+{k} {k} {t} {q}"),
}
#: Sentences around them, and sentences without any.
AROUND = (
    "write to {x} for more", "{x}", "my address is {x} and hers is {y}", "please use {x}, thank you", "schreib an {x} bitte", "il faut passer par {x}",
    "se puede usar {x} o {y}", "from {x} to {y} in one day", "they were at the station when {x} came up", "the host (see {x}) was down",
    "{x} {y}", "a dot on the map and {x}", "in 2019 and 2020 the number was {x}", "page 12: {x}",
)
NEITHER = (
    "we met at noon and left at {d}", "the dot at the end of a line", "at {b} they sat at the table", "on {k}.{k}.2019 at {k}:{k}", "it was 20{k}-{k}-{k} {k}:{k}:{k}",
    "version {d}.{d}.{d} of {b}", "{q} of {q} pages", "between {t} and {t}, about {k} at most", "{t} {t} {t} people", "order {q}{q}{d} came on day {k}",
    "paid {k},{t}.{k} for {d} of them", "see section {d}.{d} at point {d}", "isbn 978-{d}-{k}-{t}{t}-{d}", "| {t} | {q} | {k} | {t} |", "{t}, {t}, {t}, {q}, {q}",
    "the point at which {a} came", "el punto en {b}", "der Punkt an dem {a}", "{q}-{q} and {k}-{k}", "a key {t}f{k}ae{t}c{q}b", "x = {t}.{t} y = {d}.{q}",
    "({d}) one, ({d}) two, ({k}) three", "room {t}-{d} at gate {k}", "from {q} to {q}", "what (at) first was (dot) last", "{a}.{a} and {b}.{b} are names", "# {t} {t} {t} {t} {t} {t}",
    "{k} {k} {k} {k}", "{d} {d} {d} {d} {d} {d} {d}", "{q} {k} {q} {t}", "{t}-{t}", "we were at {b} dot",
)
SYLLABLES = "an ber che der el fen gra hol ist jo ken lin mar no or pet que ral son tor und vel wen xi yan zu".split()


def labelled_rows(seed: int = 0, rounds: int = 10) -> list[tuple[str, list[Span]]]:
    """Texts with their spans: every form in drawn surroundings, every sentence without any, ``rounds`` times."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices(SYLLABLES, k=draw.randint(1, 3)))
    number = lambda low, high: str(draw.randint(low, high))
    fill = {
        "a": word, "b": word, "c": lambda: draw.choice(("com", "org", "net", "info", "edu")), "d": lambda: number(1, 9), "k": lambda: number(10, 99),
        "t": lambda: number(100, 999), "q": lambda: number(1000, 9999), "i": lambda: number(0, 255),
    }
    drawn = lambda form: re.sub(r"\{([a-z])\}", lambda m: fill[m[1]](), form)
    plain = lambda: " ".join(word() for _ in range(draw.randint(0, 7)))
    out = []
    for _ in range(rounds):
        for kind, forms in FORMS.items():
            for form in forms:
                text, spans = f"{plain()} ", []
                for part in re.split(r"(\{[xy]\})", draw.choice(AROUND)):
                    if part in ("{x}", "{y}"):
                        own = kind if part == "{x}" else draw.choice(KINDS)
                        body = drawn(form if part == "{x}" else draw.choice(FORMS[own]))
                        spans.append((own, len(text), len(text) + len(body)))
                        text += body
                    else:
                        text += part
                out.append((f"{text} {plain()}", spans))
        out += [(f"{plain()} {drawn(form)} {plain()}", []) for form in NEITHER]
    return out


def labelled_table(spark: SparkSession, seed: int = 0) -> DataFrame:
    rows = [(text, [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]) for text, spans in labelled_rows(seed)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)]))


# --- tokens and features ----------------------------------------------------------------------------

_CLASS = np.zeros(256, np.uint8)  # 0 parts tokens; letters are one class, digits another, marks stand for themselves
_CLASS[48:58] = ord("9")
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = ord("a")
for _mark in b"@._+-()[]":
    _CLASS[_mark] = _mark
_CORE = (_CLASS != 0) & ~np.isin(np.arange(256), list(b"._-"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Places in a run of digits that the shape keeps: runs of up to three, of four, and longer ones differ.
_DIGIT_PLACES = (0, 3, 4)
#: Columns of ``features``: (what, offset of the token it is taken from).
FEATURES = tuple(("word", o) for o in (-2, -1, 0, 1, 2)) + tuple(("short", o) for o in (-1, 0, 1)) + (("shape", 0),)


@dataclass(frozen=True)
class Tokens:
    """Start and end byte of every token, the first token of each text, and hashes of word, shape and short shape."""

    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    word: np.ndarray
    shape: np.ndarray
    short: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    kind = _CLASS[data]
    inside = kind != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    edges = edges[inside[edges] & inside[edges - 1]]  # a text that begins inside a run begins a token
    begins[edges] = True
    ends[edges - 1] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    core = np.flatnonzero(_CORE[data])  # dots and dashes at the ends of a token are not part of it
    first, last = np.searchsorted(core, starts), np.searchsorted(core, ends) - 1
    some = first <= last
    starts, ends = core[first[some]], core[last[some]] + 1
    for opening, closing in ("()", "[]"):  # nor is a bracket at an end that is not closed inside
        single = [np.flatnonzero((data[starts] == ord(opening)) & (ends - starts > 1)), np.flatnonzero((data[ends - 1] == ord(closing)) & (ends - starts > 1))]
        lone = [_without(data, starts[at], ends[at], mark) for at, mark in zip(single, (closing, opening), strict=True)]
        starts[single[0][lone[0]]] += 1
        at = single[1][lone[1]]
        ends[at] = np.maximum(ends[at] - 1, starts[at] + 1)
    firsts = np.searchsorted(starts, offsets)
    place = np.arange(len(data))
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    run = place - np.maximum.accumulate(np.where(new, place, 0)) if len(data) else place
    marks = (kind != ord("a")) & (kind != ord("9"))
    hashes = []
    for kept in (new | marks | ((kind == ord("9")) & np.isin(run, _DIGIT_PLACES)), new | marks):
        before = np.concatenate([[0], np.cumsum(kept)])
        hashes.append(word_hashes(kind[kept], before[starts], before[ends]))
    return Tokens(starts, ends, firsts, word_hashes(_LOWER[data], starts, ends), *hashes)


def _without(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mark: str) -> np.ndarray:
    """Which of the ranges do not hold ``mark``."""
    at = np.flatnonzero(data == ord(mark))
    return np.searchsorted(at, starts) == np.searchsorted(at, ends)


def _hash(text: str, kind: str) -> np.uint64:
    data = np.frombuffer(text.encode(), np.uint8)
    return getattr(tokens_of(data, np.array([0, len(data)])), kind)[0]


@dataclass
class Vocabulary:
    """Sorted hashes of the known words and shapes; code 0 is any other."""

    word: np.ndarray
    shape: np.ndarray
    short: np.ndarray

    def features(self, tokens: Tokens) -> np.ndarray:
        """Codes, one column for each of ``FEATURES``; 0 beyond the ends of a text."""
        codes = {}
        for name in ("word", "shape", "short"):
            known, mine = getattr(self, name), getattr(tokens, name)
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            codes[name] = np.where(known[at] == mine, at + 1, 0).astype(np.int32)
        n = len(tokens.starts)
        owner = np.repeat(np.arange(len(tokens.firsts) - 1), np.diff(tokens.firsts))
        out = np.zeros((n, len(FEATURES)), np.int32)
        for column, (name, offset) in enumerate(FEATURES):
            a, b = max(0, -offset), n - max(0, offset)
            if a < b:
                same = owner[a:b] == owner[a + offset : b + offset]
                out[a:b, column] = np.where(same, codes[name][a + offset : b + offset], 0)
        return out


# --- the model --------------------------------------------------------------------------------------

LABELS = ("O", *[f"{part}-{kind}" for kind in KINDS for part in "BI"])
_NEVER = -1e9
_FORBIDDEN = np.zeros((len(LABELS), len(LABELS)))
for _j, _label in enumerate(LABELS):
    if _label.startswith("I-"):
        _FORBIDDEN[[i for i, other in enumerate(LABELS) if other[2:] != _label[2:] or other == "O"], _j] = _NEVER


@dataclass
class Crf:
    """Weights by feature code and label, of transitions, and of every token. Before a text stands an "outside"."""

    vocabulary: Vocabulary
    weights: list[np.ndarray]
    bias: np.ndarray
    moves: np.ndarray
    quiet: int | None = field(default=None)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.tile(self.bias, (len(features), 1))
        for column, weight in enumerate(self.weights):
            some = np.flatnonzero(features[:, column])
            out[some] += weight[features[some, column]]
        return out

    def labels(self, tokens: Tokens, cut: bool = True) -> np.ndarray:
        """Best label of every token, text by text."""
        features = self.vocabulary.features(tokens)
        first, last = tokens.firsts[:-1], tokens.firsts[1:]
        if cut and self.quiet is not None:
            busy = np.flatnonzero(features.any(axis=1))
            if not len(busy):
                return np.zeros(len(features), np.int8)
            owner = np.searchsorted(tokens.firsts, busy, "right") - 1
            begin, end = np.maximum(busy - self.quiet, first[owner]), np.minimum(busy + self.quiet + 1, last[owner])
            new = np.concatenate([[True], (begin[1:] > end[:-1]) | (owner[1:] != owner[:-1])])
            first, last = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
        some = last > first
        return viterbi(self.emissions, features, first[some], last[some], self.moves)


def viterbi(emissions, features: np.ndarray, first: np.ndarray, last: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of the sequences [first, last), all at once, step by step; other tokens are "outside"."""
    labels = np.zeros(len(features), np.int8)
    order = np.argsort(first - last, kind="stable")
    first, size = first[order], (last - first)[order]
    if not len(first):
        return labels
    running = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than t
    before = np.concatenate([[0], np.cumsum(running)])
    came = np.zeros((before[-1], len(moves)), np.int8)
    final = np.zeros((len(first), len(moves)))
    score = np.tile(np.where(np.arange(len(moves)) == 0, 0.0, _NEVER), (len(first), 1))
    for t, n in enumerate(running):
        ways = score[:n, :, None] + moves
        best = ways.argmax(axis=1)
        came[before[t] : before[t + 1]] = best
        score = np.take_along_axis(ways, best[:, None, :], axis=1)[:, 0] + emissions(features[first[:n] + t])
        final[:n] = score
    label = final.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = running[t]
        labels[first[:n] + t] = label[:n]
        label[:n] = came[before[t] : before[t + 1]][np.arange(n), label[:n]]
    return labels


def _quiet_run(crf: Crf, most: int = 64) -> int | None:
    """The least number of plain tokens that a best path can cross over "outside" in their middle, whatever comes on both sides."""
    step = crf.moves + crf.bias
    best = lambda a, b: (a[:, :, None] + b[None]).max(axis=1)
    powers = [np.where(np.eye(len(step)) > 0, 0.0, 2 * _NEVER), step]
    for _ in range(most):
        powers.append(best(powers[-1], step))
    for n in range(1, len(step) + 1):  # no cycle of labels beats staying outside
        if (np.diag(powers[n]) > n * step[0, 0] + 1e-9).any():
            return None
    leave = np.concatenate([crf.moves, np.zeros((len(step), 1))], axis=1)  # into any label, or to the end of the text
    for n in range(2, most):
        free = best(powers[n], leave)
        led = powers[n // 2][:, :1] + best(powers[n - n // 2], leave)[:1]
        if (led >= free - 1e-9)[free > _NEVER / 2].all():
            return n
    return None


def train(rows: Sequence[tuple[str, Sequence[Span]]], steps: int = STEPS) -> Crf:
    """Maximum of the penalised log-likelihood over labelled texts, by Adam steps."""
    texts = pa.array([text for text, _ in rows], pa.large_string())
    data, offsets = bytes_of(texts)
    tokens = tokens_of(data, offsets)
    owner = np.repeat(np.arange(len(rows)), np.diff(tokens.firsts))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    start, end = chars[tokens.starts] - chars[offsets[owner]], chars[tokens.ends] - chars[offsets[owner]]
    gold = np.zeros(len(owner), np.int64)
    for i, (_, spans) in enumerate(rows):
        for kind, a, b in spans:
            mine = np.arange(tokens.firsts[i], tokens.firsts[i + 1])
            mine = mine[(start[mine] < b) & (end[mine] > a)]
            gold[mine] = LABELS.index(f"I-{kind}")
            gold[mine[:1]] = LABELS.index(f"B-{kind}")
    inside = gold > 0
    letters = _hash("a", "shape")
    words, counts = np.unique(tokens.word[inside & (tokens.shape == letters)], return_counts=True)
    parts = {"word": words[counts >= 6]}
    for name in ("shape", "short"):
        parts[name] = np.setdiff1d(getattr(tokens, name), [letters])
    crf = Crf(Vocabulary(**parts), [], np.zeros(len(LABELS)), _FORBIDDEN.copy())
    crf.weights = [np.zeros((len(parts[name]) + 1, len(LABELS))) for name, _ in FEATURES]
    features = crf.vocabulary.features(tokens)
    size = np.diff(tokens.firsts)
    place = np.arange(len(owner)) - tokens.firsts[owner]
    padded = np.full((len(rows), size.max()), len(owner))
    padded[owner, place] = np.arange(len(owner))
    previous = np.where(place > 0, np.roll(gold, 1), 0)
    seen = np.zeros_like(crf.moves)
    np.add.at(seen, (previous, gold), 1)
    values = [*crf.weights, crf.bias, crf.moves]
    memory = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    truth = np.eye(len(LABELS))[gold]
    for step in range(1, steps + 1):
        nodes, edges = _marginals(crf.emissions(features), crf.moves, padded)
        gap = truth - nodes
        slopes = []
        for column, weight in enumerate(crf.weights):
            slope = np.zeros_like(weight)
            np.add.at(slope, features[:, column], gap)
            slope[0] = 0
            slopes.append(slope)
        slopes += [gap.sum(axis=0), np.where(_FORBIDDEN < 0, 0.0, seen - edges)]
        for value, slope, (mean, square) in zip(values, slopes, memory, strict=True):
            slope = slope / len(rows) - DECAY * np.where(value <= _NEVER, 0, value)
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            value += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    crf.quiet = _quiet_run(crf)
    return crf


def _marginals(emissions: np.ndarray, moves: np.ndarray, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of every label of every token, and expected number of every transition (the first one from "outside")."""
    rows, width = padded.shape
    n, labels = emissions.shape
    real = padded < n
    scores = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    local = np.concatenate([scores, np.ones((1, labels))])[padded]
    way = np.exp(moves)
    forward, backward = np.zeros((width, rows, labels)), np.ones((width, rows, labels))
    state = np.zeros((rows, labels))
    state[:, 0] = 1
    entered = []
    for t in range(width):
        entered.append(state)
        moved = state @ way * local[:, t]
        state = np.where(real[:, t, None], moved / moved.sum(axis=1, keepdims=True), state)
        forward[t] = state
    tail = np.ones((rows, labels))
    edges = np.zeros((labels, labels))
    for t in range(width - 1, -1, -1):
        backward[t] = tail
        right = local[:, t] * tail * real[:, t, None]
        total = np.einsum("ri,ij,rj->r", entered[t], way, right)
        scaled = np.divide(right, total[:, None], out=np.zeros_like(right), where=total[:, None] > 0)
        edges += way * (entered[t].T @ scaled)
        back = (local[:, t] * tail) @ way.T
        tail = np.where(real[:, t, None], back / back.sum(axis=1, keepdims=True), tail)
    joint = (forward * backward).transpose(1, 0, 2)[real]
    nodes = np.empty((n, labels))
    nodes[padded[real]] = joint / joint.sum(axis=1, keepdims=True)
    return nodes, edges


def fit(labelled: DataFrame) -> Crf:
    """Trains on a table of ``text`` and ``spans`` (structs of kind, start, end in code points)."""
    rows = labelled.select("text", "spans").limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"a labelled table has at most {MOST_LABELLED} rows")
    return train([(r.text or "", [(s["kind"], s["start"], s["end"]) for s in r.spans or ()]) for r in rows])


# --- the operator -----------------------------------------------------------------------------------

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)
CHECKS = {"email": _is_email, "ip": _is_ip, "card": _is_card, "phone": _is_phone}


def crf_spans(crf: Crf, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, Span]]:
    """(text, span) of all decoded spans, in code points of the text."""
    tokens = tokens_of(data, offsets)
    labels = crf.labels(tokens)
    some = np.flatnonzero(labels)
    if not len(some):
        return []
    begins = some[labels[some] % 2 == 1]  # odd labels begin
    inner = np.append(some, -1)
    last = [next(inner[k] for k in range(i, len(some)) if labels[inner[k + 1]] % 2 or inner[k + 1] != inner[k] + 1) for i in np.searchsorted(some, begins)]
    owner = np.searchsorted(tokens.firsts, begins, "right") - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    start, end = chars[tokens.starts[begins]] - chars[offsets[owner]], chars[tokens.ends[last]] - chars[offsets[owner]]
    kinds = [LABELS[label][2:] for label in labels[begins]]
    return [(o, (k, a, b)) for o, k, a, b in zip(owner.tolist(), kinds, start.tolist(), end.tolist(), strict=True)]


def find_private(docs: DataFrame, crf: Crf, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``base`` and ``spans``: arrays of kind, start and end, by start, then kind."""
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    row = F.struct(*[F.col(c) for c in kept] or [F.lit(None).alias("_none")])
    marked = docs.select(row.alias("_row"), F.col(text_col).alias("_text"))
    listed = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in sliced(batches, "_text"):
            texts = texts_of(batch.column(1))
            bodies = texts.to_pylist()
            base = [base_spans(body) for body in bodies]
            spans = [list(found) for found in base]
            for i, (name, a, b) in crf_spans(crf, *bytes_of(texts)):
                if CHECKS[name](bodies[i][a:b]) and all(b <= s[1] or s[2] <= a for s in base[i]):
                    spans[i].append((name, a, b))
            arrays = [pa.array([listed(_in_order(found)) for found in each], kind) for each in (base, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_row", "base", "spans"])

    schema = T.StructType([marked.schema["_row"], T.StructField("base", SPANS), T.StructField("spans", SPANS)])
    out = marked.mapInArrow(kernel, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "base", "spans")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``text_col`` with every span of ``spans`` replaced by its kind in angle brackets; overlapping spans go as one."""
    end = lambda s: F.greatest(s["end"], F.lit(0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    merged = F.aggregate(
        "spans",
        state,
        lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["out"], piece(s["at"], x["start"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], end(x)).alias("at"),
        ),
        lambda s: F.concat(s["out"], piece(s["at"], F.length(text).cast("long"))),
    )
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), merged))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op13_private_spans")
def op13_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"), fit(labelled_table(spark)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
