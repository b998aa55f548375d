"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel compares strings by their common three-character subsequences, gaps
allowed: one that spans s characters weighs ``DECAY ** s``. So an insult with
inserted characters, a gap or a new ending stays close to the insult. Strings
are windows of sentences: words, lower-cased, with marks inside dropped and
look-alike digits folded; letters written apart, joined; and neighbours of at
most ``PIECE`` letters each, not both among the ``COMMON`` most frequent words,
with the blank between them, so that an insult may be broken in two.

Training reads labelled sentences only: those of a bounded, documented sample
of ``MOST_LABELLED`` documents, least hashes first, whose crc32 says training.
Equal sentences are one, toxic if all documents that hold them are. Every
window counts as a positive example for each toxic sentence that holds it and
as a negative one for each other, so an ordinary word of toxic sentences pulls
both ways and what only toxic sentences hold pulls one. The machine (squared
hinge, Newton steps, in a Nystroem approximation of the kernel spanned by
``LANDMARKS`` windows) is fitted on the ``MOST_SEEN`` windows that most toxic
sentences hold and on ``MOST_OTHERS`` of the rest, by hash; windows that it
takes for toxic against most of their sentences are then added as hard
negatives, ``ROUNDS`` times. As the decision is linear in kernels to landmarks,
it folds to one weight for each subsequence: scoring a window sums weights over
its own subsequences, with no kernel left to compute. A document's score is a
logistic function, fitted on the training documents, of its highest window
decision, at most the margin, over the whole text.

Scoring is one pass without shuffle. Windows already scored are kept in a
bounded table per worker.

Defined cases: null, empty or wordless texts get the score of the lowest
decision; words of any length are read in pieces; null labels train nothing;
null ids hash as the empty string; with no toxic or no other training document
every score is the share of toxic ones (0 without any); no documents give no
rows; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import sliced

DECAY, SPAN, LONGEST, PIECE = 0.7, 8, 16, 5
MOST_LABELLED, MOST_SEEN, MOST_OTHERS, MOST_HARD, LANDMARKS = 20_000, 1_500, 4_000, 1_500, 256
#: Sentences beyond which a window's weight doesn't grow; how much more an example of a toxic sentence weighs.
MOST_WEIGHT, TOXIC_WEIGHT = 50, 2.0
RIDGE, ROUNDS = 0.05, 2
#: Words that, next to each other, are no broken insult.
COMMON = 20_000
WORDS_KEPT = 200_000
FLOOR = -3.0
ALPHABET = 48
#: Digits and marks read as letters.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_TRIPLES = np.array([t for t in combinations(range(LONGEST + 2), 3) if t[2] - t[0] < SPAN])
_WEIGHTS = DECAY ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1.0)
_MARKS = "!|.,;:?\"'()[]{}#%&*$<>-_"
_FOLD = str.maketrans(LOOK_ALIKE)


def _codes(strings: list[str]) -> np.ndarray:
    """A row of codes for each string, with borders. 0: none, 1: border or blank, 2-27: a-z, the rest: other letters."""
    size = np.array([len(s) for s in strings], np.int64)
    o = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where(o == 32, 1, np.where((o >= 97) & (o < 123), o - 95, 28 + o % (ALPHABET - 28)))
    c = np.zeros((len(strings), max(size.max(initial=0), 1) + 2), np.int64)
    c[np.repeat(np.arange(len(strings)), size), 1 + np.arange(len(o)) - np.repeat(np.cumsum(size) - size, size)] = code
    c[:, 0] = 1
    c[np.arange(len(strings)), size + 1] = 1
    return c


def folded(token: str) -> str:
    word = token.strip(_MARKS)
    return word if word.isalpha() else "".join(filter(str.isalpha, word.translate(_FOLD)))


def tokens(text: str, common: frozenset[str] = frozenset()) -> set[str]:
    """Distinct tokens of a text, words whose letters stand apart, and pairs of short neighbours not both ``common``."""
    line = text.lower().split()
    out = set(line)
    if len([t for t in out if len(t) == 1]) >= 3:
        run = []
        for t in [*line, "  "]:
            if len(t) == 1 and t.isalnum():
                run.append(t)
            else:
                if len(run) >= 3:
                    out.add("".join(run))
                run = []
    for i in [i for i, t in enumerate(line) if len(t) <= PIECE and t not in common]:
        for a, b in zip(line[max(i - 1, 0) : i + 1], line[max(i - 1, 0) + 1 : i + 2]):
            if len(a) <= PIECE and len(b) <= PIECE and len(a) + len(b) > 3:
                out.add(f"{a} {b}")
    return out


def windows(token: str) -> list[str]:
    """Folded strings of a token: pieces of at most LONGEST characters, half overlapping; none if too short to tell."""
    if " " in token:
        a, b = map(folded, token.split(" "))
        return [f"{a} {b}"] if a and b and len(a) + len(b) > 3 else []
    word = folded(token)
    if len(word) > LONGEST:
        return [word[i : i + LONGEST] for i in range(0, max(1, len(word) - LONGEST // 2), LONGEST // 2)]
    return [word] if len(word) > 2 else []


def sentences(text: str) -> set[str]:
    return {x for s in re.split(r"[.!?\n]+", text) if (x := s.strip())}


def _subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all subsequences, one row per string, and their weights (0 where the string is shorter), of unit length."""
    c = _codes(strings)
    on = _TRIPLES[:, 2] < c.shape[1]
    a, b, d = (c[:, _TRIPLES[on, j]] for j in range(3))
    w = np.where(d > 0, _WEIGHTS[on], 0.0)
    w /= np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-12)
    return (a * ALPHABET + b) * ALPHABET + d, w


class Machine:
    """Weights of subsequences, a bias, the logistic function of a document's best, and words too common to be pieces."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0, common: frozenset[str] = frozenset()):
        self.weights, self.bias, self.slope, self.shift, self.common = weights, bias, slope, shift, common
        self.seen: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def __reduce__(self):
        return Machine, (self.weights, self.bias, self.slope, self.shift, self.common)

    def decide(self, strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings))
        # strings of like length together: short ones have few subsequences
        order = np.argsort([len(s) for s in strings], kind="stable") if strings else np.zeros(0, int)
        for i in range(0, len(strings), 2048):
            part = order[i : i + 2048]
            codes, w = _subsequences([strings[j] for j in part.tolist()])
            out[part] = (self.weights[codes] * w).sum(1) + self.bias
        return out

    def learn(self, found: set[str]) -> None:
        new = []
        for t in found:
            if t not in self.seen:
                if t in self.older:
                    self.seen[t] = self.older[t]
                else:
                    new.append(t)
        pieces, own = [], []
        for i, t in enumerate(new):
            for p in windows(t):
                pieces.append(p)
                own.append(i)
        best = np.full(len(new), FLOOR)
        if pieces:
            np.maximum.at(best, np.array(own), self.decide(pieces))
        self.seen.update(zip(new, best.tolist()))

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The highest window decision of each whole text."""
        sets = [tokens(t or "", self.common) for t in texts]
        if len(self.seen) > WORDS_KEPT:
            self.older, self.seen = self.seen, {}
        self.learn(set().union(*sets))
        return np.array([max(map(self.seen.__getitem__, s), default=FLOOR) for s in sets])

    def score(self, highest: np.ndarray) -> np.ndarray:
        # decisions beyond the margin are as sure as those on it
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(highest, 1) + self.shift, -40, 40)))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Squared hinge with a ridge; the last coefficient is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    v = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(30):
        on = y * (x @ v) < 1
        a, wt = x[on], weight[on]
        nxt = np.linalg.solve((a * wt[:, None]).T @ a + np.diag(pen), (a * wt[:, None]).T @ y[on])
        if np.allclose(nxt, v, atol=1e-8):
            break
        v = nxt
    return v


def fitted(strings: list[str], toxic: np.ndarray, others: np.ndarray, marks: list[str]) -> Machine:
    """The machine of windows that stand in so many toxic and other sentences; marks: the landmarks."""
    dense = np.zeros((len(marks), ALPHABET**3), np.float32)
    codes, w = _subsequences(marks)
    for i in range(len(marks)):
        np.add.at(dense[i], codes[i], w[i])

    def kernel(to: list[str]) -> np.ndarray:
        out = np.zeros((len(to), len(marks)))
        for i in range(0, len(to), 256):
            codes, w = _subsequences(to[i : i + 256])
            for j in range(len(marks)):
                out[i : i + 256, j] = (dense[j][codes] * w).sum(1)
        return out

    own = kernel(marks)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = kernel(strings) @ root
    share = np.minimum(toxic + others, MOST_WEIGHT) / (toxic + others)
    y = np.repeat([1.0, -1.0], len(strings))
    weight = np.concatenate([TOXIC_WEIGHT * toxic * share, others * share])
    v = _newton(np.concatenate([x, x]), y, weight / weight.mean(), RIDGE)
    return Machine((root @ v[:-1]) @ dense.astype(np.float64), float(v[-1]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _decided(counts: DataFrame, machine: Machine) -> DataFrame:
    """window, t, c, f: the decision on each window."""
    sent = counts.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.decide(batch.column(0).to_pylist()))], ["window", "t", "c", "f"])

    return counts.select("window", "t", "c").mapInArrow(run, "window string, t long, c long, f double")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Machine | float:
    """The machine, or the share of toxic training rows where only one class is there."""
    spark = docs.sparkSession
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 0):
                rows = [(x, y) for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x in sentences(t or "")]
                x, y = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.int32())], ["sentence", "toxic"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 0):
                rows = [(w, y) for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for w in {w for t in tokens(x) for w in windows(t)}]
                w, y = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(y, pa.int32())], ["window", "toxic"])

    n_toxic, n = texts.agg(F.sum("toxic"), F.count("*")).first()
    if not n or not 0 < n_toxic < n:
        return float((n_toxic or 0) / n if n else 0.0)
    said = texts.mapInArrow(parted, "sentence string, toxic int").groupBy("sentence").agg(F.min("toxic").alias("toxic"))
    counts = said.mapInArrow(each, "window string, toxic int").groupBy("window").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = written(counts, "window-counts")
    p0 = counts.agg(F.sum("t") / F.sum(F.col("t") + F.col("c"))).first()[0]
    if not p0 or p0 == 1:
        return float(n_toxic / n)
    seen = counts.where("t > 0").orderBy(F.desc("t"), "window").limit(MOST_SEEN)
    other = counts.join(seen.select("window"), "window", "left_anti").orderBy(F.xxhash64("window"), "window").limit(MOST_OTHERS)
    # words that toxic sentences hold most beyond their share are landmarks
    excess = F.desc(F.col("t") - p0 * (F.col("t") + F.col("c")))
    beyond = [r["window"] for r in counts.where("not contains(window, ' ')").orderBy(excess, "window").limit(LANDMARKS // 2).collect()]
    rows = {r["window"]: (r["t"], r["c"]) for df in (seen, other) for r in df.collect()}
    usual, hard = [r for r in rows if rows[r][1] > 0 and r not in set(beyond)][-LANDMARKS:], []
    machine = None
    for step in range(ROUNDS + 1):
        if step:
            found = _decided(counts.where(f"t < c * {TOXIC_WEIGHT}"), machine).orderBy(F.desc("f"), "window").limit(MOST_HARD).collect()
            hard = [r["window"] for r in found if r["f"] > -1]
            rows |= {r["window"]: (r["t"], r["c"]) for r in found}
        marks = [*beyond, *hard[: LANDMARKS // 4]]
        marks = list(dict.fromkeys([*marks, *usual]))[:LANDMARKS]
        machine = fitted(list(rows), np.array([t for t, _ in rows.values()], float), np.array([c for _, c in rows.values()], float), marks)
    usual = counts.where("not contains(window, ' ')").orderBy(F.desc(F.col("t") + F.col("c")), "window").limit(COMMON).collect()
    machine.common = frozenset(r["window"] + mark for r in usual for mark in ("", ",", "."))
    sent = spark.sparkContext.broadcast(machine)

    def high(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.highest(part.column(0).to_pylist())), part.column(1).cast(pa.int32())], ["f", "toxic"])

    highs = texts.mapInArrow(high, "f double, toxic int").toArrow()
    f, y = highs.column("f").to_numpy(), highs.column("toxic").to_numpy().astype(float)
    machine.slope, machine.shift = _logistic(np.minimum(f, 1), y)
    return machine


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with smoothed targets."""
    x = np.stack([f, np.ones(len(f))], 1)
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    goal, v = np.where(y > 0, up, down), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * v)
        v = v - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def scored(docs: DataFrame, machine: Machine | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    if isinstance(machine, float):
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(machine).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1, 4_000_000):
                m = sent.value
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(m.highest(part.column(1).to_pylist())))], ["doc_id", "score"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, train(docs.select("doc_id", "text"), labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
