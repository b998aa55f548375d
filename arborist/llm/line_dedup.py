"""Line deduplication that returns keep bitmaps instead of text.

Native: DataFrame and SQL functions only.

1. Lines become 128-bit key hashes. One partially aggregated count per key
   gives the number of documents that hold it; a key that fills a third of all
   rows leaves each task as one row.
2. Only lines whose key reaches ``min_docs`` go on; they are written, so that
   ranges are drawn from them and not from the texts again. They are
   range-partitioned by (hash, salt) with a secondary sort by document and
   position, and a window streams over each run: its first row is the first
   occurrence within the salt, and the least of those over the salts is the
   first occurrence of all. The salt comes from the document and has a value
   for each ``SALTED`` documents of the key, so a hot key spreads over as many
   tasks as it needs.
3. Dropped positions are packed into 64-bit words, of which only those with a
   set bit are kept: a sparse bitmap for each document. Bitmaps go to the texts
   by broadcast up to ``BROADCAST_BITMAPS`` bytes, by a shuffle join beyond.

Defined cases: a null or empty text is one empty line; empty keys are never
dropped; a document is a distinct (doc_id, text), so repeated rows count once
and each gets the same result; a null doc_id is an id like any other; extra
columns are ignored, or carried by :func:`deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, ascii_lower, written

#: Documents of a key that share a salt.
SALTED = 50_000
#: Bytes of bitmaps that may be broadcast.
BROADCAST_BITMAPS = 64_000_000
#: Frequent keys that may be broadcast (24 bytes each); beyond it they are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line that may be dropped: d, t, pos, h1, h2."""
    k = F.col("k")
    return (
        docs.select("d", "t", F.posexplode(split_lines(F.col("x"))).alias("pos", "line"))
        .select("d", "t", "pos", line_key(F.col("line")).alias("k"))
        .where(F.length(k) >= max(1, min_chars))
        .select("d", "t", "pos", F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    )


def frequent_keys(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """Key hashes found in at least ``min_docs`` documents: h1, h2, n_docs."""
    keys = F.array_distinct(F.transform(split_lines(F.col("x")), line_key))
    k = F.col("k")
    each = (
        docs.select("d", "t", F.explode(keys).alias("k"))
        .where(F.length(k) >= max(1, min_chars))
        .select("d", "t", F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    )
    return each.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _distinct(rows: DataFrame) -> DataFrame:
    """Rows of distinct documents; texts are shuffled only if a document really repeats."""
    repeated = rows.groupBy("d", "t").count().where(F.col("count") > 1)
    return rows.dropDuplicates(["d", "t"]) if repeated.head(1) else rows


def keep_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False
) -> DataFrame:
    """Sparse drop bitmaps: d, t (hash of the text), words map<w, bits>, n_first.

    Bit ``i`` of word ``w`` set means that line ``64 w + i`` goes; ``n_first``
    counts the document's lines that are the first of a frequent key. Documents
    with neither have no row. ``keep_first`` spares each key's first occurrence.
    """
    rows = _distinct(_identified(docs, doc_id, text))
    often = written(frequent_keys(rows, min_docs, min_chars), "line-keys")
    if often.count() <= BROADCAST_KEYS:
        often = F.broadcast(often)
    salts = F.ceil(F.col("n_docs") / SALTED)
    lines = _lines(rows, min_chars).join(often, ["h1", "h2"]).withColumn("salt", F.pmod(F.xxhash64("d", "t"), salts)).drop("n_docs")
    ranged = written(lines, "frequent-lines").repartitionByRange("h1", "h2", "salt")
    run = Window.partitionBy("h1", "h2", "salt").orderBy("d", "t", "pos")
    streamed = ranged.withColumn("first_in_salt", F.row_number().over(run) == 1)
    firsts = streamed.where("first_in_salt").groupBy("h1", "h2").agg(F.min(F.struct("d", "t", "pos")).alias("f")).select("h1", "h2", "f.*")
    if keep_first:
        first = firsts.toDF("k1", "k2", "fd", "ft", "fp")
        same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("d").eqNullSafe(F.col("fd")) & (F.col("t") == F.col("ft")) & (F.col("pos") == F.col("fp"))
        streamed = streamed.join(first, same, "left_anti")
    word = F.expr("pos div 64")
    dropped = streamed.select("d", "t", word.alias("w"), F.expr("shiftleft(1L, cast(pos & 63 as int))").alias("bit"), F.lit(0).alias("first"))
    led = firsts.select("d", "t", word.alias("w"), F.lit(0).cast("bigint").alias("bit"), F.lit(1).alias("first"))
    return (
        dropped.unionByName(led)
        .groupBy("d", "t", "w")
        .agg(F.bit_or("bit").alias("bits"), F.sum("first").alias("first"))
        .groupBy("d", "t")
        .agg(F.map_from_entries(F.collect_list(F.when(F.col("bits") != 0, F.struct("w", "bits")))).alias("words"), F.sum("first").alias("n_first"))
    )


def _kept(lines: Column, words: Column) -> Column:
    """The lines whose bit is clear."""

    def clear(_, i):
        bits = F.coalesce(F.try_element_at(words, F.floor(i / 64)), F.lit(0).cast("bigint"))
        return F.getbit(bits, (i % 64).cast("int")) == 0

    return F.when(words.isNull(), lines).otherwise(F.filter(lines, clear))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, ``text`` reduced to the lines kept, and ``__n_lines``, ``__n_dropped``, ``__n_first``."""
    bitmaps = keep_bitmaps(docs, doc_id, text, **options).select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("words").alias("__words"), F.col("n_first").alias("__n_first"))
    bitmaps = written(bitmaps, "bitmaps")
    size = bitmaps.agg(F.sum(16 * F.coalesce(F.size("__words"), F.lit(0)) + 48)).first()[0] or 0
    bitmaps = F.broadcast(bitmaps) if size <= BROADCAST_BITMAPS else bitmaps
    there = docs[doc_id].eqNullSafe(bitmaps["__d"]) & (F.xxhash64(docs[text]) == bitmaps["__t"])
    joined = docs.join(bitmaps, there, "left").withColumn("__lines", split_lines(F.col(text)))
    kept = joined.withColumn("__kept", _kept(F.col("__lines"), F.col("__words")))
    out = kept.withColumns(
        {
            text: F.array_join("__kept", "\n"),
            "__n_lines": F.size("__lines").cast("long"),
            "__n_first": F.coalesce("__n_first", F.lit(0)),
            "__n_dropped": (F.size("__lines") - F.size("__kept")).cast("long"),
        }
    )
    return out.drop("__d", "__t", "__words", "__lines", "__kept")


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, n_first with keys of one character or more in ten documents or more."""
    out = deduplicated(docs.select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
        F.col("__n_first").alias("n_first"),
    )


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k, min(doc_id * 10000000 + pos) AS first FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT y.*, o.k IS NOT NULL AS gone, coalesce(doc_id * 10000000 + pos = first, false) AS led FROM keyed y LEFT JOIN often o ON y.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256,
  count(*) FILTER (WHERE led) AS n_first
FROM marked GROUP BY doc_id
"""
