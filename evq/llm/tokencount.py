"""Token counts by compiled finite-state transducers.

Two deterministic transducers replace the tokenizer:

* The *splitter* reads character classes and emits the starts of pre-tokens, with the delays that its
  look-aheads need. It has 14 states, so a chunk of text is a map from states to states. The maps of
  all chunks of a batch are found in numpy for all start states at once, composed by a parallel
  prefix scan, and give each chunk its true start state; long texts are not read in sequence.
* The *merger* reads the bytes of a pre-token. Every transition is annotated with the change in the
  number of emitted tokens (it may be negative, when a byte completes a longer token). A state holds
  the longest suffix that still begins a token and the last token of the encoding at each position
  of that suffix. The encoding of a prefix ends in the only token that is compatible with the
  encoding before it, so the state determines the next one. States are compiled on demand; their
  number is bounded by the vocabulary, and a cache of finished pre-tokens is emptied when full.

Counts equal those of the tokenizers library without special tokens added; a special string inside a
text is one token, as the library's default has it. Nulls and empty texts have no tokens. Every row
is returned; repeated rows and ids stay.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.common import sliced

CHUNK = 128
CACHE = 400_000
STATES = 150_000
#: The Unicode White_Space characters.
WHITE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Character classes; the contraction letters have their own.
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, ONE, R, V, LL, E, RESET = range(12)
# Splitter states: what the current pre-token is.
START, SPACE1, SPACES, BLANK1, BLANKS, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, DONE = range(13)
HERE, BACK = 1, 2  # emitted: a pre-token starts at this character, at the one before


@lru_cache(1)
def char_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kinds[c] = LETTER if k == "L" else NUMBER
    kinds[list(WHITE)] = BLANK
    kinds[0x20], kinds[0x27] = SPACE, QUOTE
    for letters, kind in (("stmd", ONE), ("r", R), ("v", V), ("l", LL), ("e", E)):
        for x in letters:
            kinds[ord(x)] = kind
    return kinds


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions, by state * 12 + class."""
    letters = (LETTER, ONE, R, V, LL, E)

    def fresh(c: int) -> int:
        """State of a pre-token that starts with class c."""
        return LETTERS if c in letters else {SPACE: SPACE1, BLANK: BLANK1, NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: QUOTED}[c]

    def joined(c: int) -> int:
        """State where a character continues a single space."""
        return LETTERS if c in letters else NUMBERS if c == NUMBER else OTHERS

    def step(s: int, c: int) -> tuple[int, int]:
        pending = s in (QUOTED_R, QUOTED_V, QUOTED_L)
        if c == RESET:
            return START, HERE | (BACK if pending else 0)
        if s in (START, DONE):
            return fresh(c), HERE
        if pending:
            if c == {QUOTED_R: E, QUOTED_V: E, QUOTED_L: LL}[s]:
                return DONE, 0
            return (LETTERS, BACK) if c in letters else (fresh(c), BACK | HERE)
        if s in (SPACE1, SPACES, BLANK1, BLANKS):
            if c in (SPACE, BLANK):
                return (SPACES if c == SPACE else BLANKS), 0
            if s == SPACE1:
                return joined(c), 0
            if s == SPACES:
                return joined(c), BACK
            return fresh(c), HERE | (BACK if s == BLANKS else 0)
        if s == QUOTED and c in (ONE, R, V, LL):
            return {ONE: DONE, R: QUOTED_R, V: QUOTED_V, LL: QUOTED_L}[c], 0
        if s in (QUOTED, OTHERS) and c in (OTHER, QUOTE):
            return OTHERS, 0
        if s == LETTERS and c in letters or s == NUMBERS and c == NUMBER:
            return s, 0
        return fresh(c), HERE

    table = [step(s, c) for s in range(13) for c in range(12)]
    return np.array([t[0] for t in table], dtype=np.uint8), np.array([t[1] for t in table], dtype=np.uint8)


def starts(kinds: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens start, of a stream of character classes that ends with RESET."""
    nexts, emits = splitter()
    n = len(kinds)
    lanes = -(-n // CHUNK)
    k = np.full(lanes * CHUNK, RESET, dtype=np.uint8)
    k[:n] = kinds
    k = np.ascontiguousarray(k.reshape(lanes, CHUNK).T)
    # State map of every chunk: where each of the 13 states ends.
    maps = np.repeat(np.arange(13, dtype=np.uint8)[:, None], lanes, axis=1)
    for row in k:
        maps = nexts[maps * np.uint8(12) + row]
    # Inclusive prefix composition of the maps, doubling the reach.
    reach, lane = 1, np.arange(lanes)
    while reach < lanes:
        maps[:, reach:] = maps[maps[:, :-reach], lane[reach:]]
        reach *= 2
    state = np.concatenate(([START], maps[START, :-1])).astype(np.uint8)
    marks = np.empty((CHUNK, lanes), dtype=np.uint8)
    for j, row in enumerate(k):
        at = state * np.uint8(12) + row
        marks[j], state = emits[at], nexts[at]
    flat = marks.T.reshape(-1)[:n]
    begins = (flat & HERE) > 0
    begins[:-1] |= (flat[1:] & BACK) > 0
    return np.flatnonzero(begins)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files: visible Latin-1 stays, the rest follows from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_rules(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Merges in order and special strings of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model = held["model"]
    pre = held.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or held.get("normalizer"):
        raise ValueError("only plain byte-level BPE files are compiled")
    alphabet = byte_alphabet()
    raw = lambda s: bytes(alphabet[c] for c in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return [(raw(a), raw(b)) for a, b in pairs], [t["content"] for t in held["added_tokens"]]


class Merger:
    """Transducer over the bytes of a pre-token, compiled on demand."""

    def __init__(self, merges: list[tuple[bytes, bytes]]) -> None:
        self.number = {bytes([b]): b for b in range(256)}
        #: Of each token: its merge's rank (-1 for a byte) and the two tokens that it is made of.
        self.rank, self.left, self.right = [-1] * 256, [-1] * 256, [-1] * 256
        self.pairs: dict[tuple[int, int], int] = {}
        for r, (x, y) in enumerate(merges):
            i, j = self.number[x], self.number[y]
            self.pairs.setdefault((i, j), r)
            if x + y not in self.number:
                self.number[x + y] = len(self.rank)
                self.rank.append(r)
                self.left.append(i)
                self.right.append(j)
        self.begins = {t[:k] for t in self.number for k in range(1, len(t))}
        self.cache: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        #: A state is (suffix, last tokens at its positions, token counts there less the present count).
        first = (b"", (-1,), (0,))
        self.states, self.ids, self.fits = [first], {first: 0}, {}
        #: (state * 256 + byte) -> (next state, change), compiled so far.
        self.arcs: dict[int, tuple[int, int]] = {}

    def _adjacent(self, x: int, y: int) -> bool:
        """Whether no merge crosses the border while x and y are built beside each other.

        x's right edge and y's left edge are taken apart, latest merge first; a pair of parts stands
        until the earlier of the merges that consume them, and must not have merged before that.
        """
        rank, pairs = self.rank, self.pairs
        ends_x = ends_y = 1 << 60  # ranks at which the present parts are consumed
        while True:
            r = pairs.get((x, y))
            if r is not None and r < ends_x and r <= ends_y:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] > rank[y]:
                ends_x, x = rank[x], self.right[x]
            else:
                ends_y, y = rank[y], self.left[y]

    def compatible(self, last: int, token: int) -> bool:
        """Whether the encoding of a text that ends in `last` goes on with `token`, given the bytes of both."""
        if last < 0:
            return True
        key = last << 20 | token
        fit = self.fits.get(key)
        if fit is None:
            fit = self.fits[key] = self._adjacent(last, token)
        return fit

    def compile(self, at: int, byte: int) -> tuple[int, int]:
        """Transition of a state under a byte: next state and change in the number of tokens."""
        suffix, lasts, counts = self.states[at]
        x = suffix + bytes((byte,))
        n, number = len(x), self.number
        for k in range(n):
            token = number.get(x[k:])
            if token is not None and self.compatible(lasts[n - k - 1], token):
                break
        change = counts[n - k - 1] + 1
        begins = self.begins
        for k in range(n):
            if x[k:] in begins:
                break
        else:
            k = n
        state = (x[k:], (token, *lasts[:n - k]), (0, *[c - change for c in counts[:n - k]]))
        to = self.ids.get(state)
        if to is None:
            to = self.ids[state] = len(self.states)
            self.states.append(state)
        arc = self.arcs[at << 8 | byte] = (to, change)
        return arc

    def count(self, word: str) -> int:
        if len(self.states) > STATES:
            self.clear()
        arcs, at, total = self.arcs, 0, 0
        for b in word.encode("utf-8", "surrogatepass"):
            arc = arcs.get(at << 8 | b) or self.compile(at, b)
            at = arc[0]
            total += arc[1]
        return total

    def counts(self, words: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE:
            self.cache.clear()
        held = self.cache
        for w in set(words).difference(held):
            held[w] = self.count(w)
        return np.fromiter(map(held.__getitem__, words), dtype=np.int64, count=len(words))


def count_texts(texts: list[str | None], merger: Merger, specials: list[str]) -> list[int]:
    """Number of tokens of each text."""
    out, parts, owner = [0] * len(texts), [], []
    for i, t in enumerate(texts):
        pieces = [t or ""]
        for s in specials:
            pieces = [y for p in pieces for y in p.split(s)]
        out[i] += len(pieces) - 1
        parts += [p for p in pieces if p]
        owner += [i] * sum(map(bool, pieces))
    if not parts:
        return out
    stream = "\0".join(parts) + "\0"
    kinds = char_classes()[np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    kinds[ends] = RESET
    begins = starts(kinds)
    words = [stream[a:b] for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(stream)], strict=True)]
    n = merger.counts(words)
    n[np.searchsorted(begins, ends)] = 0  # the marks between texts
    sums = np.diff(np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.searchsorted(begins, ends) + 1))])
    for i, x in zip(owner, sums.tolist(), strict=True):
        out[i] += x
    return out


#: Compiled transducers of this Python worker, kept between its tasks.
_MERGERS: dict[tuple[str, int], Merger] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) per row. `path`: vocabulary file, read on the driver; its rules (bounded by the file) are broadcast."""
    spark = docs.sparkSession
    rules = spark.sparkContext.broadcast(load_rules(path))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, specials = rules.value
        key = (path, len(merges))
        if key not in _MERGERS:
            _MERGERS[key] = Merger(merges)
        merger = _MERGERS[key]
        for b in sliced(parts):
            n = count_texts(b.column(1).to_pylist(), merger, specials)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, type=pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
