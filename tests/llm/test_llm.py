"""Operators against brute force on small tables with nulls, empty and long texts, repeats and extra columns."""

import hashlib
import json
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborist.llm import ann, bpe, chat_format, decontaminate, license_scan, line_dedup, ngram_join, quality, toxicity, url_filter

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RND = random.Random(4)
WORDS = [a + b for a in ("the", "ing", "ha", "é", "or") for b in ("re", "st", "n", "ou", "ß")]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


LONG = prose(5000)
BASE = prose(60)
NEAR = BASE.split()
NEAR[30] = "other"
ITEM = prose(20)
SUBSTITUTED = ITEM.split()
SUBSTITUTED[5] = SUBSTITUTED[9] = "zzz"
TEXTS = [None, "", "   \n ", "One", BASE, BASE, BASE.upper(), " ".join(NEAR), LONG, f"{LONG} end", f"a {ITEM} b", f"x {' '.join(SUBSTITUTED)} y", "Foo bar\n same line \nfoo BAR", *[f"Same Line\n{prose(9)}" for _ in range(12)], "same line", "same line", "aaaa" * 300 + " 12 été's \x85 !!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", 0, "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", "en", "s", 0, "x", "y")], "doc_id bigint, text string, lang string, source string, n_chars bigint, d string, t string")


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_line_dedup(spark, docs):
    texts = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "null id"}
    key = lambda x: x.strip(SPACE).translate(LOWER)
    found = {}
    for i, t in texts.items():
        for x in t.split("\n"):
            found.setdefault(key(x), set()).add(i)
    gone = {k for k, v in found.items() if k and len(v) >= 10}
    assert gone == {"same line"}
    out = got(line_dedup.op5(docs))
    for i, t in texts.items():
        ls = t.split("\n")
        kept = "\n".join(x for x in ls if key(x) not in gone)
        assert tuple(out[i])[1:4] == (len(ls), sum(key(x) in gone for x in ls), hashlib.sha256(kept.encode()).hexdigest()), i
    assert line_dedup.op5(docs).count() == docs.count()
    first = line_dedup.deduplicated(docs, min_docs=10, keep_first=True)
    assert {"d", "t"} <= set(first.columns)
    assert sum((r["text"] or "").lower().count("same line") for r in first.dropDuplicates(["doc_id"]).collect()) == 1
    assert line_dedup.op5(docs.limit(0)).count() == 0


def test_bpe(spark, docs):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = got(bpe.op7(docs))
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert tuple(out[i])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), i
    long = ["".join(RND.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "a" * 50_000, "".join(RND.choice("etaoin") for _ in range(5000))]
    ids = [own.encode_ordinary(x) for x in long]
    out_long = got(bpe.op7(spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")))
    assert [out_long[i]["ids_sha256"] for i in range(3)] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
    back = bpe.decoded(bpe.encoded(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in back.collect())
    bad = spark.createDataFrame([([99999],), (None,), ([],)], "ids array<int>")
    assert [r["bytes"] for r in bpe.decoded(bad, path, public_tokenizers.PATTERN).collect()] == [None, None, b""]
    t = bpe.tokenizer(path, public_tokenizers.PATTERN)
    words = ["".join(RND.choice("abcdeé") for _ in range(n)) for n in (70, 200, 500)] + ["ab" * 90, " " * 300]
    assert [t.encode_words([w.encode()])[0] for w in words] == [own._encode_single_piece(w) for w in words]


def shingle_sets(k):
    out = []
    for t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


@pytest.mark.parametrize("percent", [85, 60])
def test_ngram_join(spark, docs, percent):
    sets = shingle_sets(4)
    label = list(range(len(sets)))
    for _ in sets:
        for a, b in combinations(range(len(sets)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    out = got(ngram_join.grouped(docs, 4, percent))
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i in range(len(sets))] == [(len(s), x) for s, x in zip(sets, label)]
    assert ngram_join.op3(docs.limit(0)).count() == 0


def test_ngram_join_large_group(spark):
    """Near copies with many shared shingles: keys of several shingles must lose no link."""
    rnd = random.Random(1)
    base = [rnd.choice(WORDS) + str(i) for i in range(120)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(120)] = f"new{rnd.randrange(40)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    label = list(range(len(sets)))
    for _ in range(5):
        for a, b in combinations(range(len(sets)), 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = got(ngram_join.op3(df))
    assert [out[i]["component_id"] for i in range(len(sets))] == label


def test_prefix_keys_survive_losses():
    """Any two sets at the threshold share a key, whichever shingles differ."""
    rnd = np.random.default_rng(0)
    for _ in range(200):
        n = int(rnd.integers(20, 200))
        x = np.sort(rnd.choice(100_000, n, replace=False)).astype(np.int64)
        lose = n - -(-85 * n // 100)
        y = np.delete(x, rnd.choice(n, int(rnd.integers(0, lose + 1)), replace=False))
        df = {int(t): int(rnd.choice([2, 20, 100, 1000])) for t in x}
        keys = []
        for s in (x, y):
            f = np.array([df[int(t)] for t in s])
            order = np.lexsort((s, f))
            b = ngram_join._band(len(s), 85)
            keys.append([set(ngram_join.prefix_keys(len(s), s[order], f[order], 85, k)) for k in (b, b + 1)])
        assert any(p & q for p, q in ((keys[0][0], keys[1][0]), (keys[0][0], keys[1][1]), (keys[0][1], keys[1][0])))


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "only four words here"), (10, prose(30, random.Random(99))), (11, "One"), (12, "Foo bar same line foo")], "item_id bigint, text string")
    for size in (1_000_000, 10):
        out = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(docs, bench, part_words=size).collect()}
        assert set(out) == {(10, 7), (11, 7), (12, 12)}
        assert tuple(out[11, 7])[2:] == (1, 18, 20)
        assert {r["doc_id"] for r in decontaminate.clean(docs, bench, part_words=size).collect()} == ({None} | set(range(len(TEXTS)))) - {10, 11, 12}
    assert decontaminate.op1(docs, bench.limit(0)).count() == 0 and decontaminate.op1(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("window", [13, 8, 12])
def test_masks_tolerate_substitutions(window):
    words = np.arange(1, window + 1, dtype=np.uint64)
    for gone in combinations(range(window), decontaminate.tolerated(window)):
        other = words.copy()
        other[list(gone)] += np.uint64(100)
        assert any(decontaminate.seeds(words, window, m, k)[0] == decontaminate.seeds(other, window, m, k)[0] for k, m in enumerate(decontaminate.masks(window)))


def test_decontamination_equals_brute_force(spark):
    """Random texts over few words, with copies, substitutions and repetition; every pair of windows is compared."""
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefghijklm")
    items = [[word() for _ in range(n)] for n in (40, 13, 20, 9, 8, 6, 5, 4, 0)] + [["a"] * 30, ["a", "b"] * 12, ["x"] * 7]
    texts = [["a"] * 2000, ["b", "a"] * 300, ["x"] * 50, []]
    for i in range(60):
        w = [word() for _ in range(rnd.randrange(40))] + list(items[i % len(items)]) + [word() for _ in range(rnd.randrange(20))]
        for _ in range(rnd.randrange(4)):
            if w:
                w[rnd.randrange(len(w))] = word()
        texts.append(w)
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            n = min(len(x), decontaminate.WINDOW)
            if n < decontaminate.LEAST:
                continue
            cover, first = set(), None
            seen = {}
            for p in range(len(t) - n + 1):
                seen.setdefault(tuple(t[p : p + n]), p)
            for q in range(len(x) - n + 1):
                for v, p in seen.items():
                    e = [j for j in range(n) if v[j] == x[q + j]]
                    if len(e) >= n - decontaminate.tolerated(n):
                        cover |= {q + j for j in e}
                        first = min(p + e[0], first if first is not None else p + e[0])
            if cover:
                want[d, i] = (first, cover)
    table = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{name} bigint, text string")
    got_ = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(table(texts, "doc_id"), table(items, "item_id")).collect()}
    assert set(got_) == set(want) and len(want) > 40
    for k, (first, cover) in want.items():
        r = got_[k]
        assert r["first_word"] == first and r["n_item_words"] == len(items[k[1]])
        repeated = len({tuple(items[k[1]][q : q + 13]) for q in range(len(items[k[1]]) - 12)}) < len(items[k[1]]) - 12
        assert r["n_equal"] == len(cover) or repeated and 0 < r["n_equal"] <= len(cover)


def test_decontamination_of_repetitive_and_unbroken_texts(spark):
    docs = spark.createDataFrame([(0, "a " * 100_000), (1, "a,b," * 5000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(0, "a " * 100), (1, "a,b," * 5000)], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, items).collect()} == {(0, 0), (1, 1)}
    assert [len(t.ids) for t in decontaminate.parts(items, "item_id", "text", 9_000)] == [1, 1]


def test_license_scan(spark):
    texts = [None, "", "Released under the MIT License.", "cc-by-nc 4.0 CC BY NC", "Under the\nMIT license; Apache License, Version 2.0", "undér the mit licensé", "mit", prose(200) + " SPDX-License-Identifier: GPL-3.0 " + prose(100), "x " * 70 + "licensed under the GNU General Public License, version 3"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, w int")
    out = got(license_scan.op8(df))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(j, lab) for p, lab in license_scan.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None)), i
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert out[7]["labels"] == "gpl-3" and out[8]["labels"] == "gpl-3"
    assert license_scan.op8(df.limit(0)).count() == 0


def test_license_rules_equal_brute_force(spark):
    """Notices in random order against every rule on whole texts, and suppression by comparing all pairs."""
    from arborist.llm.license_rules import rules

    rnd = random.Random(17)
    parts = ["Licensed under the GPL 3", "Copyright 2020 Acme.", "All rights reserved.", "the MIT License", "license: MIT", "GNU General Public License version 2", "provided as is without warranty of any kind",
             "Permission is hereby granted, free of charge, to any person obtaining a copy", "http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: BSD-3-Clause", "available under the terms of the MPL 2.0",
             "SPDX-License-Identifier: GPL-2.0 only", "subject to the zlib license", "the BSD license", "dual licensed under Apache 2.0", "cc by nc 4.0 license", "proprietary license", "public domain"]
    texts = ["\n".join(rnd.choice([prose(rnd.randrange(1, 60), rnd), rnd.choice(parts), rnd.choice(parts)]) for _ in range(rnd.randrange(1, 14))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    out, some = got(license_scan.op8(df)), set()
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        line = f" {' '.join(words)} "
        seen = []
        for rule, label, keyword, names, regex, priority, sure in rules():
            for m in re.finditer(regex, line):
                start, n = line[: m.start()].count(" "), m.group().count(" ")
                if keyword in words and (not names or set(names) & set(words)):
                    seen.append((start, -(start + n), -priority, rule, label, sure))
        seen.sort()
        left = [x for j, x in enumerate(seen) if not any(y[1] <= x[1] and y[2] <= x[2] for y in seen[:j])]
        some |= {x[4] for x in left}
        base = {lab for p, lab in license_scan.PHRASES if f" {p} " in line}
        assert set(filter(None, out[i]["labels"].split(","))) == base | {x[4] for x in left}, (i, t)
        assert out[i]["score"] == max([float(bool(base)), *(x[5] for x in left)])
    assert len(some) >= 10


def test_url_filter(spark):
    urls = [None, "no scheme", "HTTP://A.Example.NET/en/x?y#z", "http://b.net/q", "http://example.com/de/1", "http://xexample.com/de/1", "https://m.example.org/fr/2", "https://example.org", "http://bad.test/a?b://c"] + [f"http://bad.test/{i}" for i in range(40)] + [f"http://good{i}.test2/x" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(i, 0 if "bad" in (u or "") else 1, 0) for i, u in enumerate(urls)], "doc_id bigint, quality int, toxic int")
    out = got(url_filter.op6(pages, labels), "page_id")
    assert [tuple(out[i])[1:4] for i in range(9)] == [("", "", None), ("", "", None), ("a.example.net", "/en/x", "example.net/en/"), ("b.net", "/q", "net/"), ("example.com", "/de/1", "example.com/de/"), ("xexample.com", "/de/1", None), ("m.example.org", "/fr/2", "org/fr/"), ("example.org", "", None), ("bad.test", "/a", None)]
    assert [out[i]["verdict"] for i in (0, 2, 3, 4, 6, 8, 60)] == ["allow", "allow", "block", "block", "allow", "block", "allow"]
    assert got(url_filter.op6(pages, labels.limit(0)), "page_id")[8]["verdict"] == "allow"
    assert url_filter.op6(pages.limit(0), labels).count() == 0
    twice = url_filter.op6(pages.union(pages).withColumn("verdict", F.lit("x")), labels.union(labels))
    assert twice.count() == 2 * len(urls)


def test_chat_format(spark):
    tools = {"tools": [{"name": "add", "parameters": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a"]}}]}
    call = lambda i, args, **k: {"id": i, "name": "add", "arguments": args, **k}
    rows = [
        (1, 0, "system", json.dumps(tools)), (1, 1, "user", "hi"),
        (1, 2, "assistant", json.dumps({"tool_calls": [call("y", {"b": 2.5, "a": 1}, depends_on=["x"]), call("x", {"b": "no", "a": 1})]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "y", "content": {"z": 1, "a": [1, {"q": 2, "b": 3}]}})), (1, 4, "tool", json.dumps({"tool_call_id": "nope", "content": 1})), (1, 5, "tool", "{"),
        (1, 6, "assistant", json.dumps({"tool_calls": [call("y", {}), call("m", {"b": 1}), {"id": "u", "name": "zzz", "arguments": {}}, {"name": "add"}]})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("p", {}, depends_on=["q"]), call("q", {}, depends_on=["p"])]})),
        (None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, level int")
    out = chat_format.formatted(df).collect()
    status = {(r["conv_id"], r["order_turn"], r["kind"], r["call_id"]): r["status"] for r in out}
    assert status[1, 2, "call", "x"] == "type" and status[1, 2, "call", "y"] == "ok" and status[1, 2, "result", "y"] == "ok"
    assert status[1, 4, "result", "nope"] == "orphan" and status[1, 6, "call", "y"] == "duplicate" and status[1, 6, "call", "m"] == "missing"
    assert status[1, 6, "call", "u"] == "undeclared" and status[1, 6, "call", None] == "invalid" and status[2, 0, "call", "p"] == "cyclic"
    assert status[1, 5, "invalid", None] == "invalid" and status[None, None, "plain", None] == "plain"
    one = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: [r[k] for k in chat_format.KEYS[1:]] + [r["kind"]])
    assert [r["call_id"] for r in one if r["order_turn"] == 2] == ["x", "y", "y"]
    assert next(r["line"] for r in one if r["kind"] == "result" and r["call_id"] == "y") == '{"content":{"a":[1,{"b":3,"q":2}],"z":1},"role":"tool","tool_call_id":"y"}'
    assert chat_format.op2(df.limit(0)).count() == 0


def test_quality(spark):
    rnd = random.Random(2)
    rows = [(i, prose(80, rnd), "en") for i in range(150)] + [(i, " ".join("".join(rnd.choice("#$%&xqz9") for _ in range(6)) for _ in range(60)), "en") for i in range(150, 170)] + [(170, None, "en"), (171, "", None), (172, prose(50, rnd), None), (None, prose(50, rnd), "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 170)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    near, far = (got(quality.classified(docs, labels, most=m, quantile=0.9)) for m in (quality.HOT_GRAMS, 60))
    assert [near[i]["keep"] for i in (170, 171)] == [True, True]
    # the cut is the quantile of the trusted documents that trained nothing, on the grid
    apart = [r["doc_id"] for r in docs.where(~quality.trained_on(F.col("doc_id"))).select("doc_id").collect() if r["doc_id"] is not None and r["doc_id"] < 150]
    cells = sorted(math.ceil(near[i]["log_perplexity"] * quality.GRID) for i in apart)
    assert {near[i]["cut"] for i in range(170)} == {cells[math.ceil(len(cells) * 0.9) - 1] / quality.GRID}
    assert all(near[i]["keep"] == (near[i]["log_perplexity"] <= near[i]["cut"]) for i in range(170))
    assert sum(near[i]["keep"] for i in range(150)) >= 120 and not any(near[i]["keep"] for i in range(150, 170))
    assert near == far
    out = got(quality.op4(docs, labels))
    assert sum(out[i]["keep"] for i in range(150)) >= 148 and not any(out[i]["keep"] for i in range(150, 170))
    m = quality.model(docs).groupBy("lang", "ctx").agg({"p": "sum", "b": "max"}).collect()
    assert all(r[2] + r[3] == pytest.approx(1) for r in m)
    assert got(quality.op4(docs, labels.limit(0)))[160]["keep"]
    clash = docs.withColumns({"keep": F.lit(9), "cut": F.lit("x"), "key": F.lit(1), "row": F.lit(2)})
    assert sorted(quality.kept(clash, labels).columns) == sorted(clash.columns) and got(quality.classified(clash, labels))[3]["keep"] is True
    assert quality.op4(docs.limit(0), labels).count() == 0 and quality.kept(docs.limit(0), labels).count() == 0


def brute_perplexity(train, texts):
    """Interpolated modified Kneser-Ney over characters of words, by definition. One language."""
    top, order = {}, 5
    def grams(word):
        padded = f" {word} "
        return [(padded[max(0, i - order + 1) : i], padded[i]) for i in range(1, len(padded))]
    for t in train:
        for w in t.split():
            for g in grams(w):
                top[g] = top.get(g, 0) + 1
    # the longest n-grams, and those that start a word, have raw counts; all others count what stands before them
    count, seen = dict(top), set(top)
    for n in range(order - 1, 0, -1):
        lower = {}
        for ctx, ch in {g for g in seen if len(g[0]) == n}:
            lower[ctx[1:], ch] = lower.get((ctx[1:], ch), 0) + 1
        for g, c in lower.items():
            count[g] = max(count.get(g, 0), c)
            seen.add(g)
    levels = {}
    for (ctx, _), c in count.items():
        levels.setdefault(len(ctx), []).append(c)
    d = {}
    for n, cs in levels.items():
        k = [sum(c == i for c in cs) for i in range(5)]
        for i in (1, 2, 3):
            y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0
            d[n, i] = max(0.1, min(i - 0.05, i - (i + 1) * y * k[i + 1] / k[i])) if k[1] and k[2] and k[i] else 0.5 * i if i < 3 else 1.5
    by = {}
    for (ctx, ch), c in count.items():
        by.setdefault(ctx, {})[ch] = c
    def prob(ctx, ch):
        below = prob(ctx[1:], ch) if ctx else 1 / (len(by[""]) + 1)
        if ctx not in by:
            return below
        total, cut = sum(by[ctx].values()), {x: min(d[len(ctx), min(c, 3)], c) for x, c in by[ctx].items()}
        own = (by[ctx][ch] - cut[ch]) / total if ch in by[ctx] else 0
        return own + sum(cut.values()) / total * below
    out = []
    for t in texts:
        g = [x for w in t.split() for x in grams(w)]
        out.append(-sum(math.log(prob(*x)) for x in g) / len(g) if g else None)
    return out


def test_perplexity_equals_brute_force(spark):
    rnd = random.Random(20)
    train = [prose(rnd.randrange(1, 60), rnd) for _ in range(30)]
    texts = [*train[:5], "", "x" * 3000, "été \x85 unseen words", "the the the", prose(40, rnd), "ing\u3000ha\U0001f600"]
    frame = lambda rows: spark.createDataFrame([("en", t) for t in rows], "lang string, text string")
    scores = quality.gram_scores(quality.counted(frame(texts)), quality.model(frame(train))).cache()
    want = brute_perplexity(train, texts)
    for most in (quality.HOT_GRAMS, 20, 0):
        out = quality.scored(frame(texts).withColumn("i", F.monotonically_increasing_id()), scores, ["en"], most, ("i",)).orderBy("i").collect()
        mine = [None if r["total"] is None else -r["total"] / quality.SCALE / r["chars"] for r in out]
        assert [x is None for x in mine] == [x is None for x in want]
        assert all(a == pytest.approx(b, abs=1e-6) for a, b in zip(mine, want) if b is not None)


def test_toxicity(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = prose(40, rnd).split() + (["worthless", "moron"] if bad else [])
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(400, None), (401, ""), (402, "you wor.th.less thing"), (403, "m o r o n here"), (404, "the ingst hare"), (405, "mo ron there"), (406, "the mor on ingst"), (407, "x" * 100_000 + "moron"), (None, "a")]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = got(toxicity.op9(docs, marks))
    held = [i for i in range(400) if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert [out[i]["predicted"] for i in (400, 401, 402, 403, 404)] == [0, 0, 1, 1, 0]
    assert out[405]["score"] > out[404]["score"] and out[406]["score"] > out[404]["score"] and out[407]["score"] > out[404]["score"]
    assert toxicity.op9(docs.limit(0), marks).count() == 0
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert got(toxicity.op9(docs, marks.limit(0)))[3]["score"] == 0


def test_ann(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    x[7] = x[11] = x[13] = x[20]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] + [1.0] * 7, 0), (303, [None] + [1.0] * 7, 0), (320, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, list int")
    out = ann.op10(df).collect()
    for q in range(0, 300, 20):
        s = [(-float(np.dot(x[q], x[j])), j) for j in range(300) if j != q]
        mine = sorted((r["rank"], r["vec_id"]) for r in out if r["query_id"] == q)
        assert [r for r, _ in mine] == list(range(1, 21))
        assert len({j for _, j in mine} & {j for _, j in sorted(s)[:20]}) >= 18
    assert {r["query_id"] for r in out} == set(range(0, 300, 20))
    few = ann.op10(df.where("vec_id in (0, 5, 6)")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]
    assert ann.op10(df.limit(0)).count() == 0
