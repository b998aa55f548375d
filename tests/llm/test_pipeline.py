"""The whole pipeline against a plain Python version of each stage."""

import base64
import hashlib
import math
import random
import re

import pytest
from test_llm import LOWER, SPACE, brute_perplexity, prose

from arborist.llm import decontaminate, quality


def quantile(values, share):
    cells = sorted(math.ceil(v * quality.GRID) for v in values)
    return cells[math.ceil(len(cells) * share) - 1] / quality.GRID


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(31)
    d = tmp_path_factory.mktemp("tables")
    item = prose(25, rnd)
    rows = []
    for i in range(640):
        text = prose(rnd.randrange(30, 60), rnd)
        before = [r[1] for r in rows if r[0] % 16 != 5]
        if i % 20 == 3:
            text = rnd.choice(before)
        if i % 20 == 7:
            w = before[-2].split(" ")
            w[rnd.randrange(len(w))] = "other"
            text = " ".join(w)
        if i % 25 == 4:
            text += "\n Shared Line \n" + prose(5, rnd)
        if i % 40 == 9:
            text = f"{text} {item} {prose(4, rnd)}"
        if i % 16 == 5:
            text = " ".join("".join(rnd.choice("#$%&xqz9") for _ in range(6)) for _ in range(40))
        rows.append((i, text, "en", "web", len(text)))
    rows += [(1000, None, "en", "web", None), (1001, "", None, None, 0), (1002, prose(40, rnd), "zz", "web", 1), (1003, prose(3, rnd), "en", "web", 1)]
    labels = [(i, int(i % 16 != 5), 0) for i in range(640)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (1, prose(30, random.Random(5)))], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, labels, item


def test_pipeline_equals_brute_force(spark, folder):
    import public_tokenizers
    import tiktoken
    from pyspark.sql import functions as F

    import corpus_pipeline

    d, rows, labels, item = folder
    text = {r[0]: r[1] or "" for r in rows}
    fold = {r["doc_id"]: r["f"] for r in spark.createDataFrame([(i,) for i in text], "doc_id bigint").select("doc_id", quality.fold(F.col("doc_id")).alias("f")).collect()}
    good = [i for i, q, _ in labels if q]
    kept = set(text)
    en = [i for i in text if rows[[r[0] for r in rows].index(i)][2] == "en"]
    lp = dict(zip(en, brute_perplexity([text[i] for i in good if fold[i]], [text[i] for i in en])))
    apart = [i for i in good if not fold[i]]
    assert len(apart) >= quality.fewest(quality.QUANTILE)
    chars = {i: sum(len(w) + 1 for w in text[i].split()) for i in en}
    middle = quantile([lp[i] for i in apart], 0.5)
    shrunk = {i: (lp[i] * chars[i] + quality.PRIOR_CHARS * middle) / (chars[i] + quality.PRIOR_CHARS) for i in en if lp[i] is not None}
    cut = quantile([shrunk[i] for i in apart], quality.QUANTILE)
    kept -= {i for i, v in shrunk.items() if v > cut}
    assert not any(i in kept for i, q, _ in labels if not q) and len(kept) > 580

    key = lambda x: x.strip(SPACE).translate(LOWER)
    holders = {}
    for i in sorted(kept):
        for k in {key(x) for x in text[i].split("\n")}:
            holders.setdefault(k, []).append(i)
    often = {k: min(v) for k, v in holders.items() if k and len(v) >= 10}
    assert often
    for i in sorted(kept):
        out, seen = [], set()
        for x in text[i].split("\n"):
            if key(x) not in often or (often[key(x)] == i and key(x) not in seen):
                out.append(x)
            seen.add(key(x))
        text[i] = "\n".join(out)

    sets = {}
    for i in kept:
        w = re.findall(r"[^\x20\x09-\x0D]+", text[i].translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in kept}
    pairs = [(a, b) for a in kept for b in kept if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in kept:
        moved = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
        if not moved:
            break
    assert len(pairs) > 20
    kept = {i for i in kept if label[i] == i}

    x = item.split()
    def overlaps(t):
        w, n = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t), decontaminate.WINDOW
        return any(sum(p == q for p, q in zip(w[j : j + n], x[k : k + n])) >= n - 2 for j in range(len(w) - n + 1) for k in range(len(x) - n + 1))
    gone = {i for i in kept if overlaps(text[i])}
    assert gone
    kept -= gone

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i in kept:
        ids = own.encode_ordinary(text[i])
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[i].encode()).hexdigest())
    out = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, d).collect()}
    assert out == want


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_begin_with_little_heap(spark):
    """Executors (here the driver) collect garbage before each stage that follows another."""
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    times = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "a text", "en", "web", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.line_dedup_stage, corpus_pipeline.byte_bpe):
        before = times()
        stage(spark, docs, "")
        assert times() > before
