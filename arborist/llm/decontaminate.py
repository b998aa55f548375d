"""Benchmark decontamination by spaced-seed hashing.

Windows of ``WINDOW`` words are hashed under fixed masks. A mask reads some
positions and ignores the others: positions are dealt into ``GROUPS`` classes
and each mask ignores as many of them as substitutions are tolerated
(``TOLERATED``), so a window with that many substituted words, wherever they
stand, still meets its source under at least one mask. Hashes of benchmark
windows form a table; documents look their own windows up in it. Around each
hit the words themselves are compared: two windows match if at most that many
words differ. An item is found in a document if any two of their windows match.
An item shorter than a window is one window of its own length: of ``MIDDLE``
words or more it tolerates one substitution, below that none.

Only distinct windows meet: a window that a text repeats stands for its first
place, so a text of one word repeated is one window, and hits are bounded by
distinct contents, not places. ``n_equal`` counts the item's words that stand
equal in some matching window, ``first_word`` is the least place in the
document of a matching window's first equal word.

Words are runs of letters, digits and non-ASCII characters with A-Z folded.

The benchmark's table goes to the tasks only in parts of at most
``PART_WORDS`` words (two characters hold one word at most, which is what is
counted), or one item that alone is longer; a larger benchmark takes more
passes over the documents, each with one part, and their results are united.
Documents are never shuffled and never sent anywhere: each task reads whole
texts and emits (document, item) pairs.

Defined cases: null or empty texts hold nothing; items without words, or of
fewer than ``LEAST`` words, which any text may hold by chance, match nothing;
null ids are carried; repeated rows give repeated results; extra columns pass
through :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go
from .words import U, mix, sliced, word_hashes

WINDOW, GROUPS, TOLERATED = 13, 4, 2
#: Words of an item: from MIDDLE on it tolerates a substitution; fewer than LEAST can't be told from chance.
MIDDLE, LEAST = 8, 5
#: Words of benchmark text in one table: at most 6 seeds of 24 bytes each a word.
PART_WORDS = 1_000_000
_FILTER_BITS = 22
#: Pairs of windows compared at once.
PAIRS = 200_000


def tolerated(window: int) -> int:
    """Substitutions that a window of so many words may hold."""
    return TOLERATED if window >= WINDOW else 1 if window >= MIDDLE else 0


def masks(window: int) -> list[tuple[int, ...]]:
    """The positions that each mask of a window reads."""
    return [tuple(i for i in range(window) if i % GROUPS not in skip) for skip in combinations(range(GROUPS), tolerated(window))]


def seeds(words: np.ndarray, window: int, reads: tuple[int, ...], salt: int) -> np.ndarray:
    """The hash of what a mask reads of each window of consecutive words."""
    n = max(0, len(words) - window + 1)
    out = np.full(n, U(salt + 1))
    weights = mix(np.arange(1, window + 1, dtype=U) + U(1000 * (salt + 1))) | U(1)
    for i in reads if n else ():
        out += words[i : i + n] * weights[i]
    return mix(out)


class Table:
    """Seeds of a part of the benchmark."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.words, self.o = word_hashes(pa.array(texts, pa.string()), "mark")
        self.sizes = np.diff(self.o)
        #: window length: per mask (hashes in order, their window, a filter); windows by item and first word
        self.tables: dict[int, tuple[list, np.ndarray, np.ndarray]] = {}
        for window in sorted({min(int(n), WINDOW) for n in self.sizes if n >= LEAST}):
            which = np.flatnonzero(self.sizes >= WINDOW if window == WINDOW else self.sizes == window)
            item = np.repeat(which, self.sizes[which] - window + 1)
            first = np.concatenate([np.arange(self.sizes[i] - window + 1) for i in which])
            full = seeds(self.words, window, tuple(range(window)), 99)[self.o[item] + first]
            order = np.lexsort((first, full, item))
            new = np.concatenate([[True], (full[order][1:] != full[order][:-1]) | (item[order][1:] != item[order][:-1])])
            item, first = item[order][new], first[order][new]
            self.tables[window] = [self._sorted(seeds(self.words, window, m, k)[self.o[item] + first]) for k, m in enumerate(masks(window))], item, first

    @staticmethod
    def _sorted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(h, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(h >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
        return h[order], order, seen

    @staticmethod
    def _look(h: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, window of the table) of all hits."""
        known, window, seen = table
        near = np.flatnonzero(seen[(h >> U(64 - _FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(known, h[near], "left"), np.searchsorted(known, h[near], "right")
        n = hi - lo
        at = np.repeat(near, n)
        return at, window[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]

    def _windows(self, words: np.ndarray, o: np.ndarray, window: int, tables: list) -> np.ndarray:
        """First places of the distinct windows of each document that hit under some mask."""
        n = len(words) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        hit = np.zeros(n, bool)
        for (k, m), (known, _, seen) in zip(enumerate(masks(window)), tables):
            h = seeds(words, window, m, k)
            near = np.flatnonzero(seen[(h >> U(64 - _FILTER_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, h[near]), len(known) - 1)
            hit[near[known[at] == h[near]]] = True
        at = np.flatnonzero(hit)
        doc = np.searchsorted(o, at, "right") - 1
        inside = at + window <= o[doc + 1]
        at, doc = at[inside], doc[inside]
        full = np.full(len(at), U(99))
        for i in range(window):
            full = mix(full + words[at + i])
        order = np.lexsort((at, full, doc))
        new = np.concatenate([[True], (full[order][1:] != full[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(at) else np.zeros(0, bool)
        return np.sort(at[order][new])

    def verified(self, words: np.ndarray, o: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, words equal, words of the item) of each pair that overlaps."""
        found: dict[tuple[int, int], list] = {}
        for window, (tables, item, first) in self.tables.items():
            at = self._windows(words, o, window, tables)
            for a in range(0, len(at), 4096):
                part = at[a : a + 4096]
                own = words[part[:, None] + np.arange(window)]
                met = []
                for k, m in enumerate(masks(window)):
                    h = np.full(len(part), U(k + 1))
                    weights = mix(np.arange(1, window + 1, dtype=U) + U(1000 * (k + 1))) | U(1)
                    for i in m:
                        h += own[:, i] * weights[i]
                    x, y = self._look(mix(h), tables[k])
                    met.append(x * len(item) + y)
                met = np.unique(np.concatenate(met))
                for b in range(0, len(met), PAIRS):
                    x, y = np.divmod(met[b : b + PAIRS], len(item))
                    equal = own[x] == self.words[(self.o[item[y]] + first[y])[:, None] + np.arange(window)]
                    good = equal.sum(1) >= window - tolerated(window)
                    x, y, equal = x[good], y[good], equal[good]
                    doc = np.searchsorted(o, part[x], "right") - 1
                    place = part[x] - o[doc] + equal.argmax(1)
                    for d, i, f, p, e in zip(doc.tolist(), item[y].tolist(), first[y].tolist(), place.tolist(), equal):
                        if (d, i) not in found:
                            found[d, i] = [p, np.zeros(self.sizes[i], bool)]
                        got = found[d, i]
                        got[0] = min(got[0], p)
                        got[1][f : f + window] |= e
        return [(d, i, p, int(e.sum()), int(self.sizes[i])) for (d, i), (p, e) in sorted(found.items())]


def parts(benchmark: DataFrame, item_id: str, text: str, most: int = PART_WORDS) -> Iterator[Table]:
    """The benchmark in tables of at most ``most`` words; items come to the driver one partition at a time."""
    ids, texts, n = [], [], 0
    for row in benchmark.select(item_id, text).toLocalIterator():
        size = len(row[1] or "") // 2 + 1
        if ids and n + size > most:
            yield Table(ids, texts)
            ids, texts, n = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        n += size
    if ids:
        yield Table(ids, texts)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, n_equal, n_item_words: a row for each document and item that overlap."""
    kinds = docs.schema[doc_id].dataType, benchmark.schema[item_id].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, first_word long, n_equal long, n_item_words long"
    source = docs.select(doc_id, text)
    out = None
    for table in parts(benchmark, item_id, item_text, part_words):
        sent = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            arrow = [pa.field("doc_id", to_arrow_type(kinds[0])), pa.field("item_id", to_arrow_type(kinds[1])), *(pa.field(n, pa.int64()) for n in ("first_word", "n_equal", "n_item_words"))]
            let_go()
            for batch in batches:
                for part in sliced(batch, 1):
                    found = sent.value.verified(*word_hashes(part.column(1), "mark"))
                    d, i, *rest = zip(*found, strict=True) if found else ((),) * 5
                    items = pa.array([sent.value.ids[x] for x in i], arrow[1].type)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d, pa.int64())), items, *(pa.array(x, pa.int64()) for x in rest)], schema=pa.schema([arrow[0].with_type(part.column(0).type), *arrow[1:]]))

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """``docs``, with all columns, without the documents that overlap the benchmark."""
    for table in parts(benchmark, item_id, item_text, part_words):
        sent = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in batches:
                for part in sliced(batch, batch.schema.names.index(text)):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, *_ in sent.value.verified(*word_hashes(part.column(text), "mark"))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document that overlaps an item of the benchmark, with the item and the share of its words found."""
    out = overlaps(docs, benchmark)
    return out.withColumn("score", F.col("n_equal") / F.col("n_item_words"))


#: States items of 13 words and more; a shorter one would need windows of its own.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), dg AS (SELECT doc_id, p, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d)),
ig AS (SELECT item_id, q, array_to_string(w[q:q + 3], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS q FROM i WHERE len(w) >= 13)),
along AS (SELECT DISTINCT doc_id, item_id, p - q AS diagonal FROM dg JOIN ig USING (g)),
places AS (SELECT doc_id, item_id, diagonal, q, q + diagonal AS p, w[q] AS x FROM (SELECT a.*, i.w, unnest(range(1, len(i.w) + 1)) AS q FROM along a JOIN i USING (item_id))),
met AS (SELECT s.doc_id, item_id, diagonal, q, p, d.w[p] = x AS e FROM places s JOIN d USING (doc_id) WHERE p BETWEEN 1 AND len(d.w)),
windows AS (
  SELECT *, count(*) OVER f = 13 AND sum(e::INTEGER) OVER f >= 11 AS good, min(CASE WHEN e THEN p END) OVER f AS first FROM met
  WINDOW f AS (PARTITION BY doc_id, item_id, diagonal ORDER BY q ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), covered AS (
  SELECT *, bool_or(good) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS within FROM windows
)
SELECT doc_id, item_id, min(CASE WHEN good THEN first END) - 1 AS first_word, count(DISTINCT CASE WHEN e AND within THEN q END) AS n_equal, len(any_value(i.w))::BIGINT AS n_item_words,
  count(DISTINCT CASE WHEN e AND within THEN q END) / len(any_value(i.w)) AS score
FROM covered JOIN i USING (item_id) GROUP BY doc_id, item_id HAVING bool_or(good)
"""
