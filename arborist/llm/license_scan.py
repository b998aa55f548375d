"""License scan by ordered signature rules.

Native: DataFrame and SQL functions only.

Text is brought to words with one space on each side, once. Base phrases are
counted with string functions over every whole text; texts that hold a rule's
keyword keep their words for the rules, and this table is written, so that no
text is taken apart twice. The method's rules (hundreds of regexes, see
``license_rules``) run only on chunks of 64 words, cut at every 40th word so
that any match of up to 24 words lies whole in some chunk, and only if a chunk
holds a rule's keyword and, if the rule names a licence, a word of that name:
chunks join the fixed rule table by keyword. Detections of a document are put
in order of start, longest first, then priority, then rule; one that lies
within an earlier one of its own or a higher priority is suppressed, whatever
else overlaps stays. That pass is a running maximum for each priority, so a
text full of detections costs a sort, not pairs.

Defined cases: null and empty texts have no words, no labels and score 0; ids
may be null or repeat, as rows are told apart by id and text, and equal rows
get equal results; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, written
from .license_rules import MOST_WORDS, rules

#: Base phrases and labels of the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
CHUNK, STEP = 64, 64 - MOST_WORDS


def with_words(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with w, `` w1  w2 ``: each word between two spaces of its own; no words: an empty string."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    # a projection of its own, so that the replacement runs once
    inner = df.withColumn("w", F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")))
    return inner.withColumn("w", F.when(F.col("w") == "", "").otherwise(F.concat(F.lit(" "), "w", F.lit(" "))))


def _phrase(phrase: str) -> str:
    return f" {phrase.replace(' ', '  ')} "


def n_words(padded: Column) -> Column:
    """Two spaces belong to each word."""
    return ((F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit("")))) / 2).cast("long")


def base(df: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (array of labels) to rows with ``w``."""
    w = F.col("w")
    has = [w.contains(_phrase(p)) for p, _ in PHRASES]
    count = [(F.length(w) - F.length(F.replace(w, F.lit(_phrase(p)), F.lit("")))) / len(_phrase(p)) for p, _ in PHRASES]
    first = [F.when(h, n_words(F.substring_index(w, _phrase(p), 1))) for h, (p, _) in zip(has, PHRASES)]
    last = [F.when(h, F.col("n_words") - n_words(F.substring_index(w, _phrase(p), -1)) - len(p.split())) for h, (p, _) in zip(has, PHRASES)]
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(h, F.lit(x)) for h, (_, x) in zip(has, PHRASES)]), lambda x: x.isNotNull())))
    return df.withColumn("n_words", n_words(w)).withColumns(
        {"n_base": reduce(add, count).cast("long"), "first_word": F.least(*first), "last_word": F.greatest(*last), "base": labels}
    )


def rule_table(spark) -> DataFrame:
    """The fixed rules as literal rows; a few hundred short ones, so always fit to broadcast."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(
        f"({i}, {text(label)}, {text(keyword)}, array({', '.join(map(text, names))}), {text(regex)}, {priority}, {sure}D)"
        for i, label, keyword, names, regex, priority, sure in rules()
    )
    return spark.sql(f"SELECT rule, label, keyword, cast(names AS array<string>) AS names, regex, priority, relevance FROM VALUES {rows} AS r(rule, label, keyword, names, regex, priority, relevance)")


def either(words: list[str]) -> str:
    """A regex for any of some words that shares what they begin with, so that most text fails at its first letter."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by_first.setdefault(w[:1], []).append(w[1:])
    branches = [first + (either(rest) if first else "") for first, rest in by_first.items()]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(sorted(branches, key=lambda b: b == ''))})"


def gate(w: Column) -> Column:
    """Whether some rule's keyword stands in words between spaces."""
    return F.rlike(w, F.lit(f" {either([r[2] for r in rules()])} "))


def detections(df: DataFrame) -> DataFrame:
    """d, t, label, start, end (words), relevance of what survives suppression. df: d, t, w."""
    table = rule_table(df.sparkSession)
    keywords = sorted({r[2] for r in rules()})
    words = F.split(F.trim("w"), "  ")
    chunks = (
        df.select("d", "t", words.alias("words"))
        .select("d", "t", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STEP))).alias("at"))
        .select("d", "t", "at", F.slice("words", F.col("at") + 1, CHUNK).alias("words"))
        .withColumn("keys", F.array_intersect("words", F.array(*map(F.lit, keywords))))
        .where(F.size("keys") > 0)
        .select("d", "t", "at", "words", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("chunk"), F.explode("keys").alias("keyword"))
    )
    named = (F.size("names") == 0) | F.arrays_overlap("words", "names")
    tried = chunks.join(F.broadcast(table), "keyword").where(named).where(F.expr("rlike(chunk, regex)"))
    parts = tried.select(
        "d", "t", "at", "rule", "label", "priority", "relevance",
        F.expr("split(chunk, regex)").alias("between"), F.expr("regexp_extract_all(chunk, regex, lit(0))".replace("lit(0)", "0")).alias("found"),
    )
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    where = F.transform(
        F.sequence(F.lit(0), F.size("found") - 1),
        lambda i: F.struct(
            (
                F.col("at")
                + spaces(F.array_join(F.slice("between", 1, i + 1), ""))
                + F.when(i > 0, spaces(F.array_join(F.slice("found", 1, i), ""))).otherwise(0)
            ).alias("start"),
            spaces(F.get("found", i)).alias("n"),
        ),
    )
    seen = (
        parts.select("d", "t", "rule", "label", "priority", "relevance", F.explode(where).alias("p"))
        .select("d", "t", "rule", "label", "priority", "relevance", F.col("p.start").alias("start"), (F.col("p.start") + F.col("p.n")).alias("end"))
        .dropDuplicates(["d", "t", "rule", "start", "end"])
    )
    order = Window.partitionBy("d", "t").orderBy("start", F.desc("end"), F.desc("priority"), "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r[5] for r in rules()})
    reach = [F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before).alias(f"reach{p}") for p in levels]
    own = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"reach{p}")) for p in levels])
    return seen.select("*", *reach).where(own.isNull() | (own < F.col("end"))).select("d", "t", "label", "relevance", "start", "end")


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, n_words, n_base, first_word, last_word, base, labels (arrays), score for every row."""
    rows = with_words(docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("x")), F.col("x")).drop("x")
    rows = written(base(rows).withColumn("w", F.when(gate(F.col("w")), F.col("w"))), "license-words")
    found = detections(rows.where("w is not null").select("d", "t", "w")).groupBy("d", "t").agg(F.collect_set("label").alias("more"), F.max("relevance").alias("sure"))
    found = found.select(F.col("d").alias("fd"), F.col("t").alias("ft"), "more", "sure")
    slim = rows.drop("w")
    out = slim.join(found, F.col("d").eqNullSafe(F.col("fd")) & (F.col("t") == F.col("ft")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce("sure", F.lit(0.0)))
    return out.select("d", "n_words", "n_base", "first_word", "last_word", "base", labels.alias("labels"), score.alias("score"))


def op8(docs: DataFrame) -> DataFrame:
    out = scanned(docs)
    text = lambda c: F.array_join(c, ",")
    return out.select(
        F.col("d").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", text("base").alias("base_labels"), text("labels").alias("labels"), "score"
    )
