"""N-gram Jaccard self-join by token-combination prefixes, and its components.

A document is the set of its distinct k-word shingles, as 64-bit hashes. Two
link if 100 * intersection >= percent * union. The steps, each exact:

1. Equal sets are one *set* (64-bit signature, held against a second one; where
   two different sets have the same, theirs is replaced); copies never meet in pairs.
2. Only shingles of two or more sets can be shared. Tasks send each distinct
   shingle of a slice once to a range of hashes: with its set if one set of
   the slice has it, else as a mere mark, its sets being known to share it.
   So a shingle in a third of all documents is one entry per slice. What goes
   out is packed: a set's signature once for its shingles in a range. A set
   whose shared shingles fall short of ``percent`` of its size links with
   nothing and is dropped; the rest carry all of their shared shingles, which
   decide every intersection.
3. Shingles are ordered by document frequency among those sets, rare first. A
   set of size n can lose ``n - ceil(percent n / 100)`` shingles and still
   link. Its prefix is extended until its keys survive any such loss: a rare
   shingle (at most ``RARE`` sets) is a key by itself; frequent ones are dealt
   by hash into classes, and each k of a class are a key, k being 2, 3 or 4 as
   frequency passes powers of ``RARE``; c shingles of a class take the loss of
   c - k + 1 to leave no key. Where a set's shingles run out before that, it is
   keyed again with k at most 3, then 2, then 1, which always suffices: two
   such sets meet at the k where the first of them has keys enough, as all
   shingles of the other are in its prefix there. The number of classes follows the
   size band; a set is indexed in its band and the next, so any two sets that
   may link share a band.
4. Sets under one key don't meet all with all. In a first round each set meets
   its most frequent hub (the member with the largest share of shared
   shingles), exact intersections decide, and links merge into components.
   Then only members of *different* components under a key meet, if their
   bitmaps allow an intersection large enough; a key of many members is dealt
   to as many tasks.
5. Components by minimum labels with pointer jumping; nothing is collected.

Defined cases: a text of fewer than k words is one shingle of all of them;
null, empty or blank texts have the empty set, link with nothing and are their
own component; null ids are carried, and count only where a group has no other
id; repeated rows are copies; extra columns pass through :func:`representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, let_go, written
from .words import U, mix, sliced, word_hashes

RARE = 8
#: Classes per shingle of a set, by the size of combinations: a class then has a few more than it needs.
CLASS_SHARE = {2: 0.05, 3: 0.15, 4: 0.2}
#: Longs of a set's bitmap.
MAPS = 8
#: Shingles that one range of hashes holds, on average.
RANGE = 1_000_000
#: Pairs of one set that are verified in one task.
PAIRS = 2_000
#: Sets with more pairs than that which may be broadcast (16 bytes each).
BROADCAST_HUBS = 1_000_000
BLOCK = "g long, sids binary, counts binary, toks binary"


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes of one text, sorted."""
    n = max(1, len(words) - k + 1) if len(words) else 0
    width = min(k, len(words))
    out = np.full(n, U(width))
    for i in range(width):
        out = mix(out + words[i : i + n])
    return np.unique(out)


def _signature(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """A hash of each set: 0 if empty, else odd."""
    return np.array([int(mix(mix(s + U(salt)).sum(dtype=U, keepdims=True) + U(len(s)))[0] | U(1)) if len(s) else 0 for s in sets], U).view(np.int64)


def _sets(part: pa.RecordBatch, k: int, clashing: frozenset[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sets of a slice's texts and their signatures: the second one where the first is among ``clashing``."""
    words, o = word_hashes(part.column(1), "space")
    sets = [shingles(words[o[i] : o[i + 1]], k) for i in range(part.num_rows)]
    sig = _signature(sets, 1)
    again = [i for i, x in enumerate(sig.tolist()) if x in clashing] if clashing else []
    if again:
        sig[again] = _signature([sets[i] for i in again], 2)
    return sets, sig


def signatures(docs: DataFrame, k: int, doc_id: str, text: str) -> tuple[DataFrame, frozenset[int]]:
    """doc_id, n, sid, t (hash of the text) of every row; first signatures that different sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in sliced(batch, 1):
                sets, sig = _sets(part, k, frozenset())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig), pa.array(_signature(sets, 2)), part.column(2)], ["doc_id", "n", "sid", "sid2", "t"])

    rows = docs.select(doc_id, text, F.xxhash64(text)).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n long, sid long, sid2 long, t long")
    rows = written(rows, "signatures")
    # chance makes a few of these among 10^10 sets
    clashes = rows.groupBy("sid").agg(F.min("sid2").alias("lo"), F.max("sid2").alias("hi")).where("lo < hi").select("sid")
    clashing = frozenset(r["sid"] for r in clashes.toLocalIterator())
    if clashing:
        rows = rows.withColumn("sid", F.when(F.col("sid").isin(*clashing), F.col("sid2")).otherwise(F.col("sid")))
    return rows.drop("sid2"), clashing


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(key)]]))


def _blocks(g: np.ndarray, sid: np.ndarray, tok: np.ndarray) -> pa.Table:
    """One row for each run of g; sets are runs of sid within it."""
    rows: list[tuple] = []
    for a, length in zip(*_runs(g)):
        part = slice(a, a + length)
        s, c = _runs(sid[part])
        rows.append((int(g[a]), sid[part][s].tobytes(), c.astype(np.uint32).tobytes(), tok[part].tobytes()))
    cols = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["g", "sids", "counts", "toks"])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Set and shingle of each entry of a group of blocks."""
    sid, c = _joined(group.column("sids"), np.int64), _joined(group.column("counts"), np.uint32)
    return np.repeat(sid, c), _joined(group.column("toks"), U)


def _bucket(sid: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(sid.view(U)) % U(ranges)).astype(np.int64)


def shared(docs: DataFrame, rows: DataFrame, clashing: frozenset[int], k: int, total: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """sid, n, toks: sets of which ``percent`` or more of the shingles are shared, with those. rows: as :func:`signatures` gives them."""
    ranges = max(1, total // RANGE)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for number, batch in enumerate(batches):
            for part in sliced(batch, 1):
                sets, sig = _sets(part, k, clashing)
                _, firsts = np.unique(sig, return_index=True)
                firsts = firsts[sig[firsts] != 0]
                if not len(firsts):
                    continue
                size = np.array([len(sets[i]) for i in firsts])
                tok, own = np.concatenate([sets[i] for i in firsts]), np.repeat(np.arange(len(firsts)), size)
                del sets
                order = np.argsort(tok)
                tok, own = tok[order], own[order]
                starts, times = _runs(tok)
                many = np.repeat(times > 1, times)
                # marks: own -1; known to be shared: sent aside, spread by set
                t = np.concatenate([tok[~many], tok[starts[times > 1]], tok[many]])
                w = np.concatenate([own[~many], np.full((times > 1).sum(), -1), own[many]])
                g = ((t >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
                g[len(t) - many.sum() :] = ranges + (number + sig[firsts][own[many]]) % ranges
                order = np.lexsort((w, g))
                t, w, g = t[order], w[order], g[order]
                yield from _blocks(g, np.where(w < 0, 0, sig[firsts][w]), t).to_batches()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures and sizes for :func:`gather`, as blocks without shingles."""
        for batch in batches:
            sid, n = (batch.column(i).to_numpy() for i in (0, 1))
            bucket = _bucket(sid, ranges)
            order = np.argsort(bucket, kind="stable")
            made = [(int(bucket[order[a]]), sid[order[a : a + c]].tobytes(), n[order[a : a + c]].tobytes(), None) for a, c in zip(*_runs(bucket[order]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), *[pa.binary()] * 3))] if made else [pa.array([], t) for t in (pa.int64(), *[pa.binary()] * 3)], ["g", "sids", "counts", "toks"])

    def meet(key, group):
        let_go()
        own, tok = _unpacked(group)
        if key[0].as_py() < ranges:
            order = np.argsort(tok)
            s, times = _runs(tok[order])
            order = order[np.repeat(times > 1, times)]
            order = order[np.lexsort((own[order], tok[order]))]
            t, i = tok[order], own[order]
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (i[1:] == 0)]) if len(t) else np.zeros(0, bool)
            order, t = order[new], t[new]
            s, times = _runs(t)
            order = order[np.repeat(times > 1, times)]
            order = order[own[order] != 0]
            own, tok = own[order], tok[order]
        bucket = _bucket(own, ranges)
        order = np.lexsort((own, bucket))
        return _blocks(bucket[order], own[order], tok[order])

    def gather(key, group):
        let_go()
        known = pa.compute.is_null(group.column("toks"))
        table = group.filter(known)
        every, size_of = _joined(table.column("sids"), np.int64), _joined(table.column("counts"), np.int64)
        order = np.argsort(every)
        every, size_of = every[order], size_of[order]
        own, t = _unpacked(group.filter(pa.compute.invert(known)))
        order = np.lexsort((t, own))
        own, t = own[order], t[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (own[1:] != own[:-1])]) if len(t) else np.zeros(0, bool)
        own, t = own[new], t[new]
        s, length = _runs(own)
        size = size_of[np.searchsorted(every, own[s])]
        keep = length * 100 >= size * percent
        t = t[np.repeat(keep, length)]
        ends = np.concatenate([[0], np.cumsum(length[keep])])
        toks = pa.LargeListArray.from_arrays(ends, pa.array(t.view(np.int64))).cast(pa.list_(pa.int64()))
        return pa.table({"sid": pa.array(own[s][keep], pa.int64()), "n": pa.array(size[keep], pa.int64()), "toks": toks})

    blocks = docs.select(doc_id, text).mapInArrow(send, BLOCK)
    parts = blocks.groupBy("g").applyInArrow(meet, BLOCK)
    # a third of all rows may be copies: partial aggregation leaves a row per task
    known = rows.where("n > 0").groupBy("sid").agg(F.max("n").alias("n")).mapInArrow(sizes, BLOCK)
    return parts.unionByName(known).groupBy("g").applyInArrow(gather, "sid long, n long, toks array<long>")


def _band(n: int, percent: int) -> int:
    return int(np.floor(np.log(max(n, 1)) / -np.log(percent / 100) + 1e-9))


def prefix_keys(n: int, toks: np.ndarray, df: np.ndarray, percent: int, band: int) -> list[int]:
    """Keys of a set of size n in a size band: signed 64-bit hashes of shingle combinations.

    toks: its shared shingles in order of (df, shingle); all others are unique to it.
    """
    kills = n - -(-percent * n // 100) + 1 - (n - len(toks))
    if kills <= 0:
        return []
    least, loss = (100 / percent) ** band, kills
    out: dict[tuple[int, ...], None] = {}
    for cap in (4, 3, 2, 1):
        groups: dict[tuple[int, int], list[int]] = {}
        kills = loss
        for t, f in zip(toks.tolist(), df.tolist()):
            k = min(cap, 1 if f <= RARE else 2 if f <= RARE**2 else 3 if f <= RARE**3 else 4)
            if k == 1:
                out[(t,)] = None
                kills -= 1
            else:
                members = groups.setdefault((k, t % max(1, int(least * CLASS_SHARE[k]))), [])
                out.update(((*c, t), None) for c in combinations(members, k - 1))
                members.append(t)
                kills -= len(members) >= k
            if kills <= 0:
                break
        if kills <= 0:
            break
    salt = U(band + 1)
    keys = np.full(len(out), salt)
    for i in range(4):
        have = np.array([len(c) > i for c in out])
        at = np.array([c[i] if len(c) > i else 0 for c in out], np.int64).view(U)
        keys = np.where(have, mix(keys + at), keys)
    return keys.view(np.int64).tolist()


def indexed(sets: DataFrame, percent: int) -> DataFrame:
    """key, sid, n, m (shingles shared with others), own (key of its own size band), b0.. (bitmap of those shingles): the index. sets: sid, n, toks."""
    maps_ = [f"b{i}" for i in range(MAPS)]
    each = sets.select("sid", "n", F.explode("toks").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    core = each.join(often, "t").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    core = core.where(F.size("ts") * 100 >= F.col("n") * percent).select("sid", "n", F.col("ts.df").alias("df"), F.col("ts.t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for i in range(batch.num_rows):
                sid, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                df, t = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                band = _band(n, percent)
                mine = set(prefix_keys(n, t, df, percent, band))
                keys = [*mine, *(set(prefix_keys(n, t, df, percent, band + 1)) - mine)]
                bits = np.zeros(64 * MAPS, np.uint8)
                bits[(mix(t.view(U)) % U(64 * MAPS)).astype(np.int64)] = 1
                maps = np.packbits(bits, bitorder="little").view(np.int64)
                if keys:
                    full = lambda x: pa.array(np.full(len(keys), x))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), full(sid), full(n), full(len(t)), pa.array(np.arange(len(keys)) < len(mine)), *map(full, maps)], ["key", "sid", "n", "m", "own", *maps_])

    return core.mapInArrow(run, "key long, sid long, n long, m long, own boolean, " + ", ".join(f"{x} long" for x in maps_))


def _dealt(rows: DataFrame, side: DataFrame, key: str, by: str, most: int = PAIRS) -> tuple[DataFrame, DataFrame, list[str]]:
    """``rows`` and ``side`` with what they join on: where a key has many rows, they are dealt to tasks by ``by`` and its side is copied to each."""
    hubs = written(rows.groupBy(key).agg(F.ceil(F.count("*") / most).alias("tasks")).where("tasks > 1"), "hubs")
    many = hubs.count()
    if not many:
        return rows, side, [key]
    hubs = F.broadcast(hubs) if many <= BROADCAST_HUBS else hubs
    task, none = f"task_{key}", F.lit(0).cast("long")
    rows = rows.join(hubs, key, "left").withColumn(task, F.coalesce(F.pmod(F.xxhash64(by), "tasks"), none)).drop("tasks")
    side = side.join(hubs, key, "left").withColumn(task, F.explode(F.sequence(none, F.coalesce(F.col("tasks") - 1, none)))).drop("tasks")
    return rows, side, [key, task]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b), by exact intersections."""
    pairs = written(pairs, "pairs")
    pairs, left, on_a = _dealt(pairs, sets.toDF("a", "na", "ta"), "a", "b")
    pairs, right, on_b = _dealt(pairs, sets.toDF("b", "nb", "tb"), "b", "a")
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, on_a).join(right, on_b).where(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """v, label: the least vertex of each vertex's component. edges: a, b."""
    edges = written(edges.union(edges.select("b", "a")).toDF("v", "u").distinct(), "edges")
    table = written(edges.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")), "labels")
    while True:
        now = table.select("v", "label")
        near = edges.join(now.toDF("u", "l"), "u").groupBy("v").agg(F.min("l").alias("l"))
        step = now.join(near, "v").select("v", F.least("label", "l").alias("label"), F.col("label").alias("before"))
        step = written(step, "labels")
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("up"))
        nxt = step.join(jump, "label", "left").select("v", F.least("label", "up").alias("label"), (F.least("label", "up") < F.col("before")).alias("moved"))
        nxt = written(nxt, "labels")
        discard(table, step)
        table = nxt
        if not nxt.where("moved").head(1):
            discard(edges)
            return nxt.drop("moved")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets that join everything that links, directly or through others; written, ``sets`` being free to go."""
    index = written(indexed(sets, percent), "index")
    hubs = index.groupBy("key").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("share"), F.col("sid"))).alias("h"), F.count("*").alias("c")).where("c > 1").select("key", F.col("h.sid").alias("hub"))
    votes = index.join(hubs, "key").where("sid <> hub").groupBy("sid", "hub").agg(F.count("*").alias("votes"))
    best = votes.groupBy("sid").agg(F.max(F.struct("votes", "hub")).alias("h")).select(F.col("sid").alias("a"), F.col("h.hub").alias("b"))
    found = written(verified(best, sets, percent), "links")
    labelled = index.join(components(found).withColumnRenamed("v", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_ = written(labelled.join(mixed, "key"), "open")
    discard(index)
    side = lambda x: open_.select("key", *(F.col(c).alias(f"{x}_{c}") for c in open_.columns if c != "key"))
    left, right, on = _dealt(side("l"), side("r"), "key", "l_sid")
    # each bit that one bitmap lacks is a shingle that the sets don't share: a bound of the intersection
    lack = lambda x, y: sum((F.bit_count(F.col(f"{x}_b{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}_b{i}")))) for i in range(MAPS)), F.lit(0))
    most = F.least(F.col("l_m") - lack("l", "r"), F.col("r_m") - lack("r", "l"))
    fits = (F.col("l_label") < F.col("r_label")) & (F.col("l_own") | F.col("r_own"))
    fits &= most * 100 >= (F.col("l_n") + F.col("r_n") - most) * percent
    rest = left.join(right, on).where(fits).select(F.col("l_sid").alias("a"), F.col("r_sid").alias("b")).distinct()
    every = written(found.unionByName(verified(rest, sets, percent)), "links")
    discard(found, open_)
    return every


def grouped(docs: DataFrame, k: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, sid, t, group (its least set; null for the empty set) of every row."""
    rows, clashing = signatures(docs, k, doc_id, text)
    total = rows.agg(F.sum("n")).first()[0] or 0
    sets = written(shared(docs, rows, clashing, k, total, percent, doc_id, text), "sets")
    found = links(sets, percent)
    discard(sets)
    label = components(found).withColumnRenamed("v", "sid")
    least = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    linked = written(least.join(label, "sid"), "linked")
    groups = linked.groupBy("label").agg(F.min("least").alias("group"))
    ids = least.join(linked.select("sid", "label").join(groups, "label"), "sid", "left").select("sid", F.coalesce("group", "least").alias("component_id"), F.coalesce("label", "sid").alias("group"))
    out = rows.join(ids, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "sid", "t", "group")


def representatives(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all columns, one row of each group: the one with the group's least id.

    Rows are told apart by id and text, so ids may be null, repeat or clash; of
    equal rows any one stays. Rows of the empty set are no one's copies and all stay.
    """
    ids = grouped(docs, k, percent, doc_id, text).where("n_shingles > 0").groupBy("group", "doc_id", "t").agg(F.count("*").alias("rows"))
    ids = written(ids, "groups")
    # non-null ids first; ties of a clashing id by text
    firsts = ids.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("f"), F.count("*").alias("keys")).where("keys > 1")
    others = ids.join(firsts, "group").where(~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t") == F.col("f.t"))))
    key = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
    same = lambda df: F.col(doc_id).eqNullSafe(df["__id"]) & (F.xxhash64(text) == df["__t"])
    gone, again = key(others), key(ids.where("rows > 1"))
    out = docs.join(gone, same(gone), "left_anti")
    if not again.head(1):
        return out
    once = out.join(again, same(again), "left_semi").withColumn("__t", F.xxhash64(text)).dropDuplicates([doc_id, "__t"]).drop("__t")
    return out.join(again, same(again), "left_anti").unionByName(once)


def op3(docs: DataFrame) -> DataFrame:
    return grouped(docs, 4, 85).select("doc_id", "n_shingles", "component_id")


#: Compares all texts that share a shingle: for tables of some thousand rows.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w
), x AS (SELECT doc_id, unnest(sh) AS g FROM s), n AS (SELECT doc_id, len(sh) AS n FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
least(id, label) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT l.b, min(r.label) FROM recurring.least r JOIN links l ON l.a = r.id JOIN recurring.least me ON me.id = l.b WHERE r.label < me.label GROUP BY l.b
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least.label AS component_id FROM n JOIN least ON least.id = n.doc_id
"""
