"""Hidden Markov language model over the corpus.

Tokens are lower-cased words and one end. A token's class is itself for the CLASSES_HEAD most frequent
words, else a hash class of its last two characters. The chain of latent states emits classes; within
a class a token has its smoothed corpus frequency, so

    P(text) = P(classes | HMM) * prod (c(w) + 1) / (N_class + V_class + 1)

and the model is a proper distribution over texts with one unknown symbol per class.

Corpus statistics. Word counts come from one grouped aggregation over all training texts. Baum-Welch
expectation counts are summed per task over all its training tokens, then across partitions by a
grouped aggregation of (state, class) cells, whose number is fixed by parameters; the driver sees only
that table. For training, texts are cut into segments of SEGMENT tokens (every token takes part; a
later segment starts from the stationary distribution). Scoring is exact: the scaled forward
recursion runs over the whole class sequence of a text.

Frequencies of words outside the broadcast head (HEAD words) are looked up by a shuffle join on the
word, spread by AQE, and summed per text.

Nulls and empty texts hold only the end. A null id has the checksum of the empty string (training).
Repeated rows and ids stay rows of their own. Without training texts counts are zero and the states
are uniform.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.common import sliced, staged

STATES, CLASSES_HEAD, CLASSES_TAIL = 8, 1024, 1024
HEAD = 1 << 16
SEGMENT, ROUNDS, SEED = 256, 5, 7
SMOOTH = 0.02
END = ""
#: Texts from which the first emissions of the states are taken; the fit that follows covers all texts.
ANCHORS = 64
FLUSH = 300_000
#: Tokens that a task works on at once, about.
GATHER = 1 << 19


def words_of(text: str | None) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def tail_class(word: str) -> int:
    return CLASSES_HEAD + zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % CLASSES_TAIL


def held_out(doc_id: Column, fold: int = 2, folds: int = 7) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the rows of (text); each task sends a word once per FLUSH distinct words."""
    names = ["word", "n"]

    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.string()), pa.array(list(c.values()), type=pa.int64())], names=names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in sliced(parts):
            for t in b.column(0).to_pylist():
                c.update(words_of(t))
            if b.num_rows:
                c[END] += b.num_rows
            if len(c) > FLUSH:
                yield out(c)
                c = Counter()
        yield out(c)

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Lexicon:
    """Counts and classes of the head words; classes of all others; frequencies of the classes."""

    def __init__(self, head: list[tuple[str, int]], by_tail: dict[int, tuple[int, int]], total: int, distinct: int) -> None:
        order = [w for w, _ in head if w != END]
        self.counts = dict(head)
        self.classes = {w: i for i, w in enumerate([END, *order[:CLASSES_HEAD - 1]])}
        self.total, self.distinct = total, distinct
        n, v = np.zeros(CLASSES_HEAD + CLASSES_TAIL), np.zeros(CLASSES_HEAD + CLASSES_TAIL)
        for k, (a, b) in by_tail.items():
            n[k], v[k] = a, b
        for w, k in self.classes.items():
            if w in self.counts:
                n[k], v[k] = self.counts[w], 1
        self.log_size = np.log10(n + v + 1)
        self.tails: dict[str, int] = {}

    def encode(self, words: list[str]) -> np.ndarray:
        get, tails, out = self.classes.get, self.tails, []
        for w in words:
            k = get(w)
            if k is None:
                s = w[-2:]
                k = tails.get(s)
                if k is None:
                    k = tails[s] = tail_class(w)
            out.append(k)
        if len(tails) > FLUSH:
            tails.clear()
        return np.array(out, dtype=np.uint16)


def lexicon(counts: DataFrame) -> Lexicon:
    """counts: (word, c), written. The head is the end token and a top-k of fixed size; the rest arrives as sums by class."""
    head = [(r.word, r.c) for r in counts.orderBy(F.desc(F.col("word") == END), F.desc("c"), "word").limit(HEAD).collect()]
    own = [END, *[w for w, _ in head if w != END][:CLASSES_HEAD - 1]]
    tail = counts.filter(~F.col("word").isin(own)).groupBy((F.crc32(F.right("word", F.lit(2)).cast("binary")) % CLASSES_TAIL + CLASSES_HEAD).alias("k")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    all_ = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    return Lexicon(head, {int(r.k): (r.n, r.v) for r in tail}, all_.n or 0, all_.v or 0)


def encoded(docs: DataFrame, lex, id_col: str, text_col: str) -> DataFrame:
    """(key, id, held_out, n_tokens, classes, known, log_known, tail): class sequence, sums over head words and the words to look up."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = lex.value
        logs = {w: float(np.log10(c + 1)) for w, c in x.counts.items()}
        task = TaskContext.get()
        at = task.partitionId() << 36 if task else 0
        for b in sliced(parts):
            n = b.num_rows
            classes, sizes, known, sums, tails = [], [], [], [], []
            for t in b.column(2).to_pylist():
                w = words_of(t)
                w.append(END)
                classes.append(x.encode(w).tobytes())
                sizes.append(len(w))
                held = [logs[v] for v in w if v in logs]
                known.append(len(held))
                sums.append(sum(held))
                tails.append([v for v in w if v not in logs])
            tails = [[v for v in t if v != END] for t in tails]
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + n), type=pa.int64()), b.column(0), b.column(1), pa.array(sizes, type=pa.int64()), pa.array(classes, type=pa.binary()),
                                              pa.array(known, type=pa.int64()), pa.array(sums, type=pa.float64()), pa.array(tails, type=pa.list_(pa.string()))],
                                             names=["key", "id", "held_out", "n_tokens", "classes", "known", "log_known", "tail"])
            at += n

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"key long, id {kind}, held_out boolean, n_tokens long, classes binary, known long, log_known double, tail array<string>")


def _lanes(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, as one array by time step: tokens, lanes alive at each step, order."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    begins = np.concatenate(([0], np.cumsum(alive)))[:-1]
    flat = np.empty(int(sizes.sum()), dtype=np.int64)
    for lane, i in enumerate(order):
        s = sequences[i]
        flat[begins[:len(s)] + lane] = s
    return flat, alive, order


def forward(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence by the scaled forward recursion. emit: (class, state)."""
    if not sequences:
        return np.zeros(0)
    flat, alive, order = _lanes(sequences)
    logs, at, a = np.zeros(len(sequences)), 0, None
    for n in alive.tolist():
        e = emit[flat[at:at + n]]
        a = (start if a is None else a[:n] @ move) * e
        scale = a.sum(axis=1)
        a /= scale[:, None]
        logs[:n] += np.log(scale)
        at += n
    out = np.empty(len(sequences))
    out[order] = logs
    return out


def expectations(sequences: list[np.ndarray], firsts: np.ndarray, start: np.ndarray, steady: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (starts of first segments, moves, emissions by class and state) over segments."""
    k = len(start)
    flat, alive, order = _lanes(sequences)
    first = firsts[order]
    a = np.empty((len(flat), k))
    scales = np.empty(len(flat))
    at, prev = 0, None
    begins = []
    for n in alive.tolist():
        e = emit[flat[at:at + n]]
        x = (np.where(first[:, None], start, steady) if prev is None else prev[:n] @ move) * e
        s = x.sum(axis=1)
        prev = x / s[:, None]
        a[at:at + n], scales[at:at + n] = prev, s
        begins.append(at)
        at += n
    moves = np.zeros((k, k))
    beta = np.ones((0, k))
    for t in range(len(alive) - 1, -1, -1):
        lo, n = begins[t], int(alive[t])
        if t + 1 < len(alive):
            m, nx = int(alive[t + 1]), begins[t + 1]
            w = emit[flat[nx:nx + m]] * beta / scales[nx:nx + m, None]
            moves += (a[lo:lo + m].T @ w) * move
            beta = np.concatenate([w @ move.T, np.ones((n - m, k))])
        else:
            beta = np.ones((n, k))
        a[lo:lo + n] *= beta
    starts = a[:len(sequences)][first].sum(axis=0)
    cells = np.stack([np.bincount(flat, a[:, j], len(emit)) for j in range(k)], axis=1)
    return starts, moves, cells


def gathered(parts: Iterator[pa.RecordBatch], tokens: int = GATHER) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Batches of (classes, ...) put together until they hold about so many tokens, with their class sequences."""
    held, size = [], 0

    def whole() -> tuple[pa.Table, list[np.ndarray]]:
        t = pa.Table.from_batches(held)
        return t, [np.frombuffer(x, dtype=np.uint16) for x in t.column("classes").to_pylist()]

    for b in sliced(parts):
        if b.num_rows:
            held.append(b)
            size += b.column("classes").nbytes // 2
        if size >= tokens:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


def _steady(move: np.ndarray) -> np.ndarray:
    p = np.full(len(move), 1 / len(move))
    for _ in range(200):
        p = p @ move
    return p / p.sum()


def first_model(rows: DataFrame, states: int = STATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sticky states, each around one of the most different of ANCHORS texts."""
    size = CLASSES_HEAD + CLASSES_TAIL
    texts = [np.frombuffer(r.classes, dtype=np.uint16) for r in rows.filter("not held_out and n_tokens > 50").orderBy(F.xxhash64("id", "classes"), "key").limit(ANCHORS).select("classes").collect()]
    hist = np.stack([np.bincount(t, minlength=size) / len(t) for t in texts]) if texts else np.full((1, size), 1 / size)
    mean, chosen = hist.mean(axis=0), [0]
    far = np.full(len(hist), np.inf)
    while len(chosen) < min(states, len(hist)):
        far = np.minimum(far, 1 - np.sqrt(hist * hist[chosen[-1]]).sum(axis=1))
        chosen.append(int(np.argmax(far)))
    noise = np.random.default_rng(SEED).uniform(0.9, 1.1, size=(states, size))
    emit = np.stack([0.5 * hist[chosen[j % len(chosen)]] + 0.3 * mean + 0.2 / size for j in range(states)]) * noise
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    return np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), (emit / emit.sum(axis=1, keepdims=True)).T.copy()


def baum_welch(rows: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, move, emit) after `rounds` rounds over all training rows of (held_out, classes)."""
    spark = rows.sparkSession
    start, move, emit = first_model(rows, states)
    size = len(emit)
    train = rows.filter("not held_out").select("classes")
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((start, _steady(move), move, emit))

        def run(parts: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            begin, steady, step, out = model.value
            sums = [np.zeros(len(begin)), np.zeros_like(step), np.zeros_like(out)]
            for _, texts in gathered(parts):
                cut = [(t[i:i + SEGMENT], i == 0) for t in texts for i in range(0, len(t), SEGMENT)]
                for total, part in zip(sums, expectations([c for c, _ in cut], np.array([f for _, f in cut]), begin, steady, step, out), strict=True):
                    total += part
            flat = np.concatenate([x.reshape(-1) for x in sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "n"])

        cells = train.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        flat = np.zeros(states + states * states + size * states)
        flat[cells["cell"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy()
        if flat.sum() <= 0:
            break
        a, b, c = flat[:states] + SMOOTH, flat[states:states * (states + 1)].reshape(states, states) + SMOOTH, flat[states * (states + 1):].reshape(size, states)
        common = (c.sum(axis=1) + 1) / (c.sum() + size)
        c = c + (SMOOTH * size) * common[:, None]
        start, move, emit = a / a.sum(), b / b.sum(axis=1, keepdims=True), c / c.sum(axis=0, keepdims=True)
        model.unpersist()
    return start, move, emit


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; scores are log10 probabilities."""
    spark = docs.sparkSession
    counts = staged(word_counts(docs.filter(~held_out(F.col(id_col))).select(F.col(text_col).alias("text"))), "word-counts")
    lex = lexicon(counts)
    shared = spark.sparkContext.broadcast(lex)
    rows = staged(encoded(docs, shared, id_col, text_col), "class-sequences")
    model = spark.sparkContext.broadcast(baum_welch(rows, states, rounds))
    tail = (rows.select("key", F.explode("tail").alias("word")).join(counts, "word").groupBy("key")
            .agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("c") + 1)).alias("log_tail")))

    kept = ["key", "id", "held_out", "n_tokens", "known", "log_known"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, step, out = model.value
        size = shared.value.log_size
        for t, texts in gathered(parts):
            logs = forward(texts, begin, step, out) / np.log(10) - np.array([size[x].sum() for x in texts])
            yield from t.select(kept).append_column("log_classes", pa.array(logs)).combine_chunks().to_batches()

    schema = f"key long, id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, log_known double, log_classes double"
    joined = rows.select(*kept, "classes").mapInArrow(run, schema).join(tail, "key", "left")
    sums = F.col("log_known") + F.coalesce("log_tail", F.lit(0.0))
    n, v = lex.total, lex.distinct
    return joined.select("id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                         (sums - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (sums + F.col("log_classes")).alias("score"))
