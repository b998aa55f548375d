"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model predicts a word's characters from up to ``ORDER - 1`` characters
before, within its language; a blank opens and closes each word. It is trained
on trusted text only: documents labelled good, four fifths of them by hash.

Counting. Tasks split whole texts into words, take each distinct word of a
slice apart and send each distinct n-gram of it once, with its count; one
shuffle by n-gram shards the counts. Adjusted counts (continuations below the
highest order), the three discounts of each order and the back-off mass of each
context follow as aggregates and joins on (language, context).

Scoring. The distinct n-grams of all documents are joined with the count
shards, order by order: the probability of an n-gram is its own discounted part
plus its context's mass times the probability of the one-shorter n-gram. The
result is one log-probability for each distinct n-gram of the corpus, a table
that grows with it. It goes back to the documents as hot keys and the rest do
in any skewed join: the ``HOT_GRAMS`` most frequent n-grams go to the tasks
(16 bytes each, at any size), the others of a document leave its task as
(row, n-gram, count) and are joined. Log-probabilities are whole numbers
(units of 1 / ``SCALE``), so sums are the same whichever way an n-gram took.

Threshold. The trusted documents not trained on are scored; the cut of a
language is the quantile ``QUANTILE`` of their log-perplexities, read off
counts on a grid of 1 / ``GRID``, so that a document is rejected if hardly any
trusted text of its language is as odd. Log-perplexities are shrunk to the
language's median by ``PRIOR_CHARS`` characters: chance moves those of short
texts most. A language with too few such documents for that quantile
(1 / (1 - QUANTILE) of them) also scores the trusted documents it trained on,
each fifth by a model of the other four. If even these are too few, the
quantile is estimated: the highest of their own values, of what a normal
distribution with their spread predicts (wider the fewer they are), and of
their median plus the same quantile of all languages' deviations from theirs.

Defined cases: null, empty or wordless texts have perplexity null and are kept
(nothing speaks against them); words may be of any length; a null language is a
language of its own; null labels train nothing; in a language without trusted
text the perplexity is null and nothing is rejected; a language with too little
to score any of it, or to show a spread, has cut null and rejects nothing; null
and repeated ids are scored row by row; no documents give no rows; extra
columns pass through :func:`kept`, and through :func:`classified` unless they
bear the names of its results.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import ceil, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, held, let_go, written
from .words import U, mix, sliced

ORDER = 5
QUANTILE = 0.99
#: Characters at the language's median that are added to each document, so that a short text needs more to be rejected.
PRIOR_CHARS = 200
#: N-grams whose scores go to the tasks; those of all others are joined.
HOT_GRAMS = 1_000_000
#: Ids, or keys of documents, that may be broadcast (8 bytes each); beyond it, they are joined by shuffle.
BROADCAST_IDS = 2_000_000
SCALE, GRID = 1 << 24, 4096
#: Bytes of text that a task takes apart at once.
SLICE = 5_000_000
#: N-grams turned to Python strings at once.
GRAMS = 50_000
_BITS = 20
_PLACES = mix(np.arange(1, ORDER + 1, dtype=U)) | U(1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(index of each word in the list of distinct ones, bounds of each text's words, distinct words)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = flat.filter(real).dictionary_encode()
    return coded.indices.to_numpy(), before[bounds - bounds[0]], coded.dictionary


class Positions:
    """The n-gram at each character and closing blank of some words of a language."""

    def __init__(self, words: pa.Array, lang: str):
        self.lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = f" {' '.join(words.to_pylist())} "
        self.ends = np.cumsum(self.lengths + 1)
        self.starts = self.ends - self.lengths - 1
        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(U) + U(1)
        n = int(self.ends[-1]) if len(words) else 0
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), self.lengths + 1)
        #: characters back to the opening blank
        self.back = (np.arange(n) - self.starts[self.word] + 1).astype(np.int32)
        salt = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
        h = codes[1 : n + 1] * _PLACES[0] + U(salt)
        for j in range(1, ORDER):
            h[j - 1 :] += np.where(self.back[j - 1 :] >= j, codes[: max(n + 1 - j, 0)], U(0)) * _PLACES[j]
        self.hash = mix(h).view(np.int64)

    def gram(self, i: int) -> tuple[str, str]:
        """(context, character) of a position: contexts reach back to the opening blank."""
        return self.text[i + 1 - min(self.back[i], ORDER - 1) : i + 1], self.text[i + 1]


def _by_language(part: pa.RecordBatch, lang: str, text: str) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(language, its rows, their texts) of a slice."""
    coded = pc.fill_null(part.column(lang), "").dictionary_encode()
    for i, name in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(coded.indices.to_numpy() == i)
        yield name, rows, part.column(text).take(pa.array(rows))


def counted(texts: DataFrame) -> DataFrame:
    """lang, ctx, ch, h (hash), c: count of the n-gram, of the longest context, at every position. texts: lang, text."""
    schema = "lang string, ctx string, ch string, h long, c long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                for lang, _, found in _by_language(part, "lang", "text"):
                    codes, _, words = words_of(found)
                    at = Positions(words, lang)
                    order = np.argsort(at.hash, kind="stable")
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(at.hash[order]) != 0])) if len(order) else order
                    times = np.bincount(codes, minlength=len(words))[at.word[order]]
                    first, h = order[starts], at.hash[order[starts]]
                    c = np.add.reduceat(times, starts) if len(starts) else times
                    del order, times
                    for i in range(0, len(first), GRAMS):
                        ctx, ch = zip(*map(at.gram, first[i : i + GRAMS].tolist()))
                        part_h = h[i : i + GRAMS]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ctx), pa.string()), pa.array(ctx, pa.string()), pa.array(ch, pa.string()), pa.array(part_h), pa.array(c[i : i + GRAMS])], ["lang", "ctx", "ch", "h", "c"])

    raw = texts.select("lang", "text").mapInArrow(run, schema)
    return raw.groupBy("lang", "ctx", "ch", "h").agg(F.sum("c").alias("c"))


def model(texts: DataFrame) -> DataFrame:
    """lang, ctx, ch, p (discounted part of the probability), b (mass of ctx left to the shorter context).

    Contexts shorter than ORDER - 1 that start with the blank are whole histories
    and keep raw counts; others use continuation counts. The empty context is
    interpolated with the uniform distribution over the language's characters
    and one unseen.
    """
    raw = written(counted(texts).drop("h"), "grams")
    full = (F.length("ctx") == ORDER - 1) | F.col("ctx").startswith(" ")
    top = raw.where(full)
    levels, upper = [top], top
    # a continuation count is the number of distinct one-longer n-grams with the same end
    for n in range(ORDER - 2, -1, -1):
        here = upper.where(F.length("ctx") == n + 1).select("lang", F.expr("substring(ctx, 2)").alias("ctx"), "ch")
        here = here.groupBy("lang", "ctx", "ch").agg(F.count("*").alias("c"))
        levels.append(here)
        upper = here.unionByName(top)
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    counts = written(counts.groupBy("lang", "ctx", "ch").agg(F.max("c").alias("c")), "adjusted")
    of = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    order = counts.groupBy("lang", F.length("ctx").alias("len")).agg(*of)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int):
        raw_d = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        sane = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{k}") > 0)
        return F.when(sane, F.greatest(F.lit(0.1), F.least(F.lit(k - 0.05), raw_d))).otherwise(0.5 * k if k < 3 else 1.5).alias(f"d{k}")

    order = order.select("lang", "len", *(discount(k) for k in (1, 2, 3)))
    c = F.col("c")
    d = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = counts.withColumn("len", F.length("ctx")).join(F.broadcast(order), ["lang", "len"]).withColumn("d", F.least(d, c))
    ctx = cut.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
    return cut.join(ctx, ["lang", "ctx"]).select("lang", "ctx", "ch", ((c - F.col("d")) / F.col("total")).alias("p"), (F.col("left") / F.col("total")).alias("b"))


def gram_scores(need: DataFrame, fitted: DataFrame) -> DataFrame:
    """h, c, lp of each n-gram of need (lang, ctx, ch, h, c) in a language of the model, by joins with the count shards; any size of either."""
    keys = ["lang", "ctx", "ch"]
    masses = fitted.groupBy("lang", "ctx").agg(F.max("b").alias("b"))
    uniform = fitted.where("ctx = ''").groupBy("lang").agg((1 / (F.count("*") + 1)).alias("below"))
    out, low = None, None
    for n in range(ORDER):
        here = need.where(F.length("ctx") >= n).select("lang", (F.expr(f"right(ctx, {n})") if n else F.lit("")).alias("ctx"), "ch").distinct()
        shorter = here.join(uniform, "lang") if low is None else here.join(low.select("lang", F.col("ctx").alias("tail"), "ch", F.col("prob").alias("below")), (here["lang"] == low["lang"]) & (F.expr("substring(ctx, 2)") == F.col("tail")) & (here["ch"] == low["ch"])).select(here["lang"], here["ctx"], here["ch"], "below")
        found = shorter.join(fitted.select(*keys, "p"), keys, "left").join(masses, ["lang", "ctx"], "left")
        now = written(found.select(*keys, (F.coalesce("p", F.lit(0.0)) + F.coalesce("b", F.lit(1.0)) * F.col("below")).alias("prob")), "gram-scores")
        part = need.where(F.length("ctx") == n).join(now, keys)
        out = part if out is None else out.unionByName(part)
        low = now
    return out.select("h", "c", F.round(F.log("prob") * SCALE).cast("long").alias("lp"))


class Hot:
    """The scores of frequent n-grams, by hash."""

    def __init__(self, h: np.ndarray, lp: np.ndarray):
        order = np.argsort(h.view(U))
        self.h, self.lp = h[order], lp[order]
        top = (self.h.view(U) >> U(64 - _BITS)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << _BITS) + 1)).astype(np.int64)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score or 0, whether it is here) of each hash."""
        top = (h.view(U) >> U(64 - _BITS)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        lp, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.h[at[todo]] == h[todo]
            hit = todo[same]
            lp[hit], known[hit] = self.lp[at[hit]], True
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return lp, known


def _hottest(scores: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The most frequent n-grams, ``most`` at most, and whether there are others."""
    level = F.floor(F.log2("c") * 16)
    # 16 levels an octave: some hundreds of rows at any size
    left, least, every = most, None, True
    for r in sorted(scores.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["l"]):
        if r["n"] > left:
            every = False
            break
        left, least = left - r["n"], r["l"]
    return (scores if every else scores.where(level >= least) if least is not None else scores.limit(0)), not every


def scored(docs: DataFrame, scores: DataFrame, langs: list[str], most: int = HOT_GRAMS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``carry``, lang (null as ''), key (of language and text), total (log-probability, null without words or a model), chars of every row; no texts."""
    spark = docs.sparkSession
    hot, others = _hottest(scores, most)
    data = hot.select("h", "lp").toArrow()
    sent = spark.sparkContext.broadcast((data.column("h").to_numpy(), data.column("lp").to_numpy()))
    name, known_langs = uuid.uuid4().hex, frozenset(langs)
    rows = docs.select(*carry, F.col("lang").alias("__lang"), F.col("text").alias("__text"), F.xxhash64(F.coalesce("lang", F.lit("")), "text").alias("__key"))
    kept_ = [f for f in rows.schema if f.name in carry]
    schema = T.StructType([*kept_, *(T.StructField(n, t) for n, t in (("lang", T.StringType()), ("key", T.LongType()), ("total", T.LongType()), ("chars", T.LongType()), ("rest_h", T.ArrayType(T.LongType())), ("rest_m", T.ArrayType(T.LongType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held(("quality", name), lambda: Hot(*sent.value))
        for batch in batches:
            for part in sliced(batch, batch.schema.names.index("__text"), SLICE):
                total, chars, none = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, bool)
                rest: list[tuple[np.ndarray, np.ndarray] | None] = [None] * part.num_rows
                for lang, at, texts in _by_language(part, "__lang", "__text"):
                    codes, o, words = words_of(texts)
                    grams = Positions(words, lang)
                    runs = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[o])  # noqa: B023, E731
                    chars[at] = runs(grams.lengths[codes] + 1)
                    none[at] = chars[at] == 0
                    if lang not in known_langs:
                        none[at] = True
                        continue
                    if not len(words):
                        continue
                    lp, known = table.look(grams.hash)
                    total[at] = runs(np.add.reduceat(lp, grams.starts)[codes])
                    # words with n-grams that are joined
                    lacking = np.add.reduceat((~known).astype(np.int64), grams.starts)
                    if others and lacking.any():
                        where = np.flatnonzero(lacking[codes])
                        own, n = np.searchsorted(o, where, "right") - 1, lacking[codes[where]]
                        unknown = grams.hash[~known]
                        first = (np.cumsum(lacking) - lacking)[codes[where]]
                        each = unknown[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
                        own = np.repeat(own, n)
                        for d in np.unique(own).tolist():
                            rest[at[d]] = np.unique(each[np.searchsorted(own, d) : np.searchsorted(own, d, "right")], return_counts=True)
                lists = [pa.array([None if r is None else r[i] for r in rest], pa.list_(pa.int64())) for i in (0, 1)]
                lang = pc.fill_null(part.column("__lang"), "")
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept_), lang, part.column("__key"), pa.array(total, mask=none), pa.array(chars), *lists], schema.names)

    out = rows.mapInArrow(run, schema)
    if not others:
        return out.drop("rest_h", "rest_m")
    out = written(out.withColumn("row", F.monotonically_increasing_id()), "hot-scores")
    rest = out.where("rest_h is not null").select("row", F.explode(F.arrays_zip("rest_h", "rest_m")).alias("r"))
    more = rest.select("row", F.col("r.rest_h").alias("h"), F.col("r.rest_m").alias("m")).join(scores, "h").groupBy("row").agg(F.sum(F.col("m") * F.col("lp")).alias("more"))
    return out.drop("rest_h", "rest_m").join(more, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0))).drop("row", "more")


def fold(doc_id: Column) -> Column:
    """The fifth, 0 to 4, that a document belongs to."""
    return F.pmod(F.xxhash64(doc_id, F.lit("quality")), F.lit(5))


def trained_on(doc_id: Column) -> Column:
    """Four fifths of trusted documents train; the rest set the cut."""
    return fold(doc_id) != 0


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, text of the documents labelled good."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    good = written(good.where("q = 1").select("doc_id"), "trusted")
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    return docs.select("doc_id", "lang", "text").join(good, "doc_id", "left_semi")


def _languages(fitted: DataFrame) -> list[str]:
    return [r["lang"] for r in fitted.select("lang").distinct().collect()]


def _held_out(texts: DataFrame, scores: DataFrame, langs: list[str], most: int) -> DataFrame:
    """lang, lp (log-perplexity), chars of trusted documents that can be scored."""
    out = scored(texts, scores, langs, most).where("total is not null")
    return written(out.select("lang", (-F.col("total") / SCALE / F.col("chars")).alias("lp"), "chars"), "held-out")


def _crossed(few: DataFrame, most: int) -> DataFrame:
    """lang, lp, chars of trusted documents that were trained on, each fifth by a model of the other four.

    A language and a fifth make a language of their own, so that one pass fits all models.
    """
    few = written(few.select(F.coalesce("lang", F.lit("")).alias("lang"), "text", fold(F.col("doc_id")).alias("own")), "thin-languages")
    apart = lambda part: F.concat("lang", F.lit("\0"), part.cast("string")).alias("lang")
    others = few.withColumn("part", F.explode(F.array(*map(F.lit, range(1, 5))))).where("part <> own")
    fitted = written(model(others.select(apart(F.col("part")), "text")), "model")
    mine = few.where("own > 0").select(apart(F.col("own")), "text")
    scores = written(gram_scores(written(counted(mine), "grams"), fitted), "scores")
    return _held_out(mine, scores, _languages(fitted), most).withColumn("lang", F.substring_index("lang", "\0", 1))


def _quantiles(values: DataFrame, shares: tuple[float, ...]) -> dict[str, tuple[int, list[float]]]:
    """language: (rows, each share's quantile of lp on the grid). A short row a language comes to the driver."""
    cells = values.groupBy("lang", F.ceil(F.col("lp") * GRID).alias("cell")).agg(F.count("*").alias("n"))
    # as many rows a language as the grid has cells, whatever the number of documents
    up = Window.partitionBy("lang").orderBy("cell")
    cells = cells.select("lang", "cell", F.sum("n").over(up).alias("upto"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    at = [F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("cell"))).alias(f"q{i}") for i, q in enumerate(shares)]
    return {r["lang"]: (r["m"], [r[f"q{i}"] / GRID for i in range(len(shares))]) for r in cells.groupBy("lang").agg(F.max("all").alias("m"), *at).collect()}


def _shrunk(lp: Column, chars: Column, middle: dict[str, float]) -> Column:
    mid = _value(middle)
    return F.coalesce((lp * chars + PRIOR_CHARS * mid) / (chars + PRIOR_CHARS), lp)


def fewest(quantile: float) -> int:
    """Values that a quantile takes."""
    return ceil(round(1 / (1 - quantile), 6))


def _cuts(clean: DataFrame, quantile: float) -> dict[str, float | None]:
    """Each language's cut. clean: lang, lp."""
    found, least = _quantiles(clean, (0.5, quantile)), fewest(quantile)
    out = {lang: high for lang, (m, (_, high)) in found.items() if m >= least}
    if len(out) == len(found):
        return out
    apart = F.col("lp") - _value({lang: mid for lang, (m, (mid, _)) in found.items() if m > 1})
    pooled = _quantiles(clean.select(F.lit("").alias("lang"), apart.alias("lp")).where("lp is not null"), (quantile,))
    sds = {r["lang"]: r["sd"] or 0.0 for r in clean.groupBy("lang").agg(F.stddev("lp").alias("sd")).collect()}
    z = NormalDist().inv_cdf(quantile)
    for lang, (m, (mid, high)) in found.items():
        if lang not in out:
            # the normal quantile, corrected for a mean and a deviation of m values
            own = z * (1 + (z * z + 1) / (4 * m)) * sqrt(1 + 1 / m) * sds[lang]
            out[lang] = max(high, mid + own, mid + pooled[""][1][0]) if pooled else None
    return out


def _value(by_language: dict[str, float | None]) -> Column:
    known = [F.lit(x) for name, value in by_language.items() if value is not None for x in (name, float(value))]
    return F.try_element_at(F.create_map(*known), F.col("lang")) if known else F.lit(None).cast("double")


def judged(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, most: int = HOT_GRAMS, quantile: float = QUANTILE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``carry``, key, log_perplexity, cut, keep of every row of docs (lang, text). Trusted text comes from ``training`` (doc_id, lang, text), ``docs`` themselves by default."""
    good = trusted(docs if training is None else training, labels)
    fitted = written(model(good.where(trained_on(F.col("doc_id")))), "model")
    langs = _languages(fitted)
    texts = docs.select("lang", "text")
    need = written(counted(texts if training is None else texts.unionByName(good.where(~trained_on(F.col("doc_id"))).select("lang", "text"))), "grams")
    scores = written(gram_scores(need, fitted), "scores")
    clean = _held_out(good.where(~trained_on(F.col("doc_id"))), scores, langs, most)
    enough = clean.groupBy("lang").count().where(F.col("count") >= fewest(quantile))
    thin = [r["lang"] for r in fitted.select("lang").distinct().join(enough, "lang", "left_anti").collect()]
    if thin:
        clean = clean.unionByName(_crossed(good.where(F.coalesce("lang", F.lit("")).isin(thin)), most))
    discard(need)
    middle = {lang: q[0] for lang, (_, q) in _quantiles(clean, (0.5,)).items()}
    cuts = _cuts(clean.withColumn("lp", _shrunk(F.col("lp"), F.col("chars"), middle)), quantile)
    out = scored(docs, scores, langs, most, carry)
    lp = -F.col("total") / SCALE / F.col("chars")
    out = out.select(*carry, "key", _shrunk(lp, F.col("chars"), middle).alias("log_perplexity"), _value(cuts).alias("cut"))
    return out.withColumn("keep", F.coalesce(F.col("log_perplexity") <= F.col("cut"), F.lit(True)))


def _key() -> Column:
    return F.xxhash64(F.coalesce("lang", F.lit("")), "text")


def classified(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, most: int = HOT_GRAMS, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` with log_perplexity, cut and keep."""
    found = judged(docs, labels, training, most, quantile).dropDuplicates(["key"]).withColumnRenamed("key", "__key")
    plain = docs.drop("log_perplexity", "cut", "keep").withColumn("__key", _key())
    return plain.join(found, "__key").drop("__key")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with all columns, without the rejected documents."""
    gone = written(judged(docs, labels).where("not keep").select(F.col("key").alias("__key")).distinct(), "rejected")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, _key() == F.col("__key"), "left_anti")


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_perplexity, cut, keep of every document."""
    return judged(docs.select("doc_id", "lang", "text"), labels, carry=("doc_id",)).drop("key")
