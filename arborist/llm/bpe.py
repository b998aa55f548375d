"""Byte-level BPE encoding and decoding by DuckDB recursive queries.

Each Python worker holds one in-memory DuckDB connection with the byte table,
the vocabulary and the merge table of a public rank file. A partition's texts
are split by the pre-token pattern; distinct words not seen by the worker go
to DuckDB as token-position rows. A recursive query joins adjacent tokens with
the merge table and contracts each word's minimum-rank pair, leftmost first,
until no pair is left. Decoding joins id-position rows with the vocabulary and
aggregates bytes in order of position.

Words of over 64 bytes are cut first where no token of the vocabulary that
stands in the word reaches across: no merge can cross there, so the pieces are
words of their own. In pieces that are still that long, equal pairs are
contracted in one step (leftmost first among overlapping ones), unless the
merged token could take part in a merge of a lower rank; then only the leftmost
is, so the result is always that of one merge at a time. Their recursion is
keyed by position and so holds the current step only: memory is in proportion
to the word, whatever the number of steps.

Words already encoded are kept in a bounded table per worker, which is emptied
when full; a query takes a bounded number of token rows over all its steps.
Nothing is shuffled.

Defined cases: null and empty texts have no tokens; a word may be as long as
its text; lone or repeated rows are
independent of each other; decoding an id outside the vocabulary or a null id
list gives null; extra columns pass through or are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import held

#: Distinct words of one generation; a worker keeps two, and those in use move on to the younger.
WORDS_KEPT = 150_000
#: Token rows that all steps of one recursive query may hold, unless a single word needs more.
QUERY_ROWS = 2_000_000
#: Words of more bytes are cut, and contract all pairs of the least rank in a step.
SHORT = 64

MERGES = """
CREATE TABLE merges AS
WITH cuts AS (SELECT id, tok, unnest(generate_series(1, len(tok) // 2 - 1)) AS k FROM vocab)
SELECT a.id AS l, b.id AS r, a.id::BIGINT * 4294967296 + b.id AS pair, c.id AS merged
FROM cuts c JOIN vocab a ON a.tok = substr(c.tok, 1, 2 * k) JOIN vocab b ON b.tok = substr(c.tok, 2 * k + 1)
"""
#: Merged tokens that are part of a merge of lower rank.
EARLY = "CREATE TABLE early AS SELECT DISTINCT x AS merged FROM (SELECT unnest([l, r]) AS x, merged FROM merges) WHERE merged < x"
#: One merge a step: for short words, of which a query holds many. k is word * 2^32 + position.
ENCODE_SHORT = """
WITH RECURSIVE bpe(step, k, tok) AS (
  SELECT 0, k, tok FROM seed
  UNION ALL
  SELECT * FROM (
    WITH here AS (SELECT step, k, tok, lead(tok) OVER w AS nxt, lead(k) OVER w AS nxt_k FROM bpe WINDOW w AS (ORDER BY k)),
    least AS (SELECT h.k >> 32 AS word, min(m.merged::BIGINT * 4294967296 + (h.k & 4294967295)) AS best, arg_min(h.nxt_k, m.merged::BIGINT * 4294967296 + (h.k & 4294967295)) AS gone
      FROM here h JOIN merges m ON m.pair = h.tok::BIGINT * 4294967296 + h.nxt WHERE h.k >> 32 = h.nxt_k >> 32 GROUP BY h.k >> 32)
    SELECT h.step + 1, h.k, CASE WHEN h.k & 4294967295 = l.best & 4294967295 THEN (l.best >> 32)::INTEGER ELSE h.tok END
    FROM here h JOIN least l ON h.k >> 32 = l.word WHERE h.k <> l.gone))
SELECT k >> 32 AS word, list(tok ORDER BY k) AS ids FROM bpe JOIN (SELECT k >> 32 AS word, max(step) AS step FROM bpe GROUP BY 1) l ON k >> 32 = l.word AND bpe.step = l.step GROUP BY 1
"""
#: All merges of the least rank in one step: for long words. A token that went into the one before it is -1.
ENCODE_LONG = """
WITH RECURSIVE bpe(word, pos, tok) USING KEY (word, pos) AS (
  SELECT k >> 32, k & 4294967295, tok FROM seed
  UNION
  SELECT * FROM (
    WITH here AS (SELECT word, pos, tok, lead(tok) OVER w AS nxt, lead(pos) OVER w AS nxt_pos, row_number() OVER w AS n FROM recurring.bpe WHERE tok >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)),
    pairs AS (SELECT h.word, h.pos, h.nxt_pos, h.n, m.merged FROM here h JOIN merges m ON m.pair = h.tok::BIGINT * 4294967296 + h.nxt),
    best AS (SELECT word, min(merged) AS merged FROM pairs GROUP BY word),
    least AS (SELECT p.*, p.n - row_number() OVER (PARTITION BY p.word ORDER BY p.n) AS run, e.merged IS NOT NULL AS alone
      FROM pairs p JOIN best b ON p.word = b.word AND p.merged = b.merged LEFT JOIN early e ON p.merged = e.merged),
    chosen AS (SELECT word, pos, nxt_pos, merged FROM (SELECT *, min(n) OVER (PARTITION BY word, run) AS start, min(n) OVER (PARTITION BY word) AS first FROM least)
      WHERE (n - start) % 2 = 0 AND (NOT alone OR n = first))
    SELECT word, pos, merged FROM chosen UNION ALL SELECT word, nxt_pos, -1 FROM chosen))
SELECT word, list(tok ORDER BY pos) AS ids FROM bpe WHERE tok >= 0 GROUP BY word
"""
DECODE = """
SELECT s.seq, CASE WHEN count(v.tok) = count(*) THEN unhex(string_agg(v.tok, '' ORDER BY s.pos)) END AS bytes, string_agg(s.id::VARCHAR, ',' ORDER BY s.pos) AS ids, count(*) AS n
FROM ids s LEFT JOIN vocab v ON s.id = v.id GROUP BY s.seq ORDER BY s.seq
"""


class Tokenizer:
    """One rank file's tables in one DuckDB connection."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # \\s of the rank files' library is White_Space, without the separators U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.whole = {t: i for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.starts = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.execute("CREATE TABLE vocab (id INTEGER, tok VARCHAR)")
        rows = pa.table({"id": pa.array(ranks.values(), pa.int32()), "tok": [t.hex() for t in ranks]})
        self.db.register("rows", rows)
        self.db.execute("INSERT INTO vocab SELECT * FROM rows")
        self.db.unregister("rows")
        self.db.execute(MERGES)
        self.db.execute(EARLY)
        self.seen: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def cut(self, word: bytes) -> list[bytes]:
        """The word in pieces, parted where no token that stands in it reaches across."""
        out, start, reach = [], 0, 1
        for i in range(len(word)):
            if i >= reach:
                out.append(word[start:i])
                start, reach = i, i + 1
            n = 2
            while i + n <= len(word) and word[i : i + n] in self.starts:
                if i + n > reach and word[i : i + n] in self.whole:
                    reach = i + n
                n += 1
        return [*out, word[start:]]

    def _query(self, name: str, rows: dict[str, np.ndarray], query: str) -> pa.Table:
        self.db.register(name, pa.table(rows))
        out = self.db.sql(query).to_arrow_table()
        self.db.unregister(name)
        return out

    def _merged(self, query: str, pieces: list[bytes], which: np.ndarray, rows) -> tuple[np.ndarray, np.ndarray]:
        """(piece, id) rows of the pieces ``which``, in order within a piece; rows: how many token rows lengths need."""
        sizes = np.array([len(pieces[i]) for i in which.tolist()], np.int64)
        need = np.cumsum(rows(sizes))
        start, found = 0, []
        while start < len(which):
            end = max(start + 1, int(np.searchsorted(need, (need[start - 1] if start else 0) + QUERY_ROWS, "right")))
            n = sizes[start:end]
            tok = self.byte[np.frombuffer(b"".join(pieces[i] for i in which[start:end].tolist()), np.uint8)]
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
            got = self._query("seed", {"k": (np.repeat(which[start:end], n) << 32) + pos, "tok": tok}, query)
            ids = got.column("ids").combine_chunks()
            found.append((np.repeat(got.column("word").to_numpy(), pc.list_value_length(ids).to_numpy()), ids.flatten().to_numpy()))
            start = end
        own, ids = zip(*found) if found else ((np.zeros(0, np.int64),), (np.zeros(0, np.int32),))
        return np.concatenate(own), np.concatenate(ids)

    def encoded_rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) rows in order: by the recursive query; a word that is a token is that token."""
        pieces: list[bytes] = []
        own: list[int] = []
        token: list[int] = []
        for i, w in enumerate(words):
            t = self.whole.get(w, -1)
            parts = [w] if t >= 0 or len(w) <= SHORT else self.cut(w)
            pieces += parts
            own += [i] * len(parts)
            token += [t] * len(parts)
        known, size = np.array(token, np.int64), np.array([len(p) for p in pieces], np.int64)
        single = np.array([self.byte[p[0]] if len(p) == 1 else -1 for p in pieces], np.int64)
        known = np.where(known < 0, single, known)
        short, long = (np.flatnonzero((known < 0) & (size > 1) & on) for on in (size <= SHORT, size > SHORT))
        done = np.flatnonzero(known >= 0)
        found = [(done, known[done]), self._merged(ENCODE_SHORT, pieces, short, lambda n: n * (n + 1) // 2), self._merged(ENCODE_LONG, pieces, long, lambda n: 8 * n)]
        piece, ids = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.argsort(piece, kind="stable")
        return np.array(own, np.int64)[piece[order]] if own else piece, ids[order].astype(np.int32)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        own, ids = self.encoded_rows(words)
        return [x.tolist() for x in np.split(ids, np.searchsorted(own, np.arange(1, len(words))))] if words else []

    def _decoded(self, seq: np.ndarray, ids: np.ndarray) -> pa.Table:
        """seq, bytes, ids (joined by commas), n of rows in order, by an ordered aggregation."""
        first = np.concatenate([[True], seq[1:] != seq[:-1]]) if len(seq) else np.zeros(0, bool)
        at = np.arange(len(seq))
        return self._query("ids", {"seq": seq, "pos": at - np.maximum.accumulate(np.where(first, at, 0)), "id": ids}, DECODE)

    def decode_ids(self, sequences: list[list[int] | None]) -> list[bytes | None]:
        """Bytes of each id sequence."""
        out: list[bytes | None] = [None if s is None else b"" for s in sequences]
        size = [len(s or ()) for s in sequences]
        if sum(size):
            got = self._decoded(np.repeat(np.arange(len(sequences)), size), np.array([i for s in sequences for i in s or ()], np.int64))
            for i, x in zip(got.column("seq").to_pylist(), got.column("bytes").to_pylist()):
                out[i] = x
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encode, and decode again, distinct words that are not kept yet."""
        new = []
        for w in words:
            if w not in self.seen:
                if w in self.older:
                    self.seen[w] = self.older[w]
                else:
                    new.append(w)
        if not new:
            return
        got = self._decoded(*self.encoded_rows([w.encode() for w in new]))
        self.seen.update(zip(new, zip(*(got.column(c).to_pylist() for c in ("ids", "n", "bytes"))), strict=True))

    def pieces(self, texts: list[str]) -> list[list[str]]:
        split = [self.split(t) for t in texts]
        if len(self.seen) > WORDS_KEPT:
            self.older, self.seen = self.seen, {}
        self.learn({w for ws in split for w in ws})
        return split


def tokenizer(path: str, pattern: str) -> Tokenizer:
    return held(("bpe", path, pattern), lambda: Tokenizer(path, pattern))


def chunked(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in order, null as empty, in lists of about ``most`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out`` array<int>: the ids of each whole text."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in docs.schema if f.name != out), T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            ids = []
            for part in chunked(batch.column(text).to_pylist()):
                for ws in t.pieces(part):
                    ids.append([int(x) for w in ws for x in t.seen[w][0].split(",")])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(ids, pa.list_(pa.int32()))], [*names, out])

    return docs.mapInArrow(run, schema)


def decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``df`` with ``out`` binary: the bytes of each id list."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in df.schema if f.name != out), T.StructField(out, T.BinaryType())])
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            made: list[bytes | None] = []
            for i in range(0, batch.num_rows, 64):
                made += t.decode_ids(batch.column(ids).slice(i, 64).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, pa.binary())], [*names, out])

    return df.mapInArrow(run, schema)


def digested(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, without building its id list as a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            n, ids, raw = [], [], []
            for part in chunked(batch.column(1).to_pylist()):
                for ws in t.pieces(part):
                    found = zip(*map(t.seen.__getitem__, ws)) if ws else ((), (), ())
                    own, sizes, part_bytes = found
                    n.append(sum(sizes))
                    ids.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                    raw.append(hashlib.sha256(b"".join(part_bytes)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    return digested(docs, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
