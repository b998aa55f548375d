"""Inputs on which an operator once did less than its whole job."""

import json
import random

import numpy as np
import pytest

from arborist.llm import ann, chat_format, license_scan, ngram_join, quality, url_filter


@pytest.mark.parametrize("percent", [80, 85])
def test_prefix_keys_of_frequent_shingles(percent):
    """Short sets of frequent shingles only, in classes that never fill, still share a key."""
    rnd = np.random.default_rng(5)
    for n in list(range(1, 31)) * 20:
        x = np.sort(rnd.choice(100_000, n, replace=False)).astype(np.int64)
        lose = n - -(-percent * n // 100)
        y = np.delete(x, rnd.choice(n, lose, replace=False))
        df = {int(t): int(rnd.choice([20, 100, 600])) for t in x}
        keys = []
        for s in (x, y):
            f = np.array([df[int(t)] for t in s])
            order = np.lexsort((s, f))
            b = ngram_join._band(len(s), percent)
            keys.append([set(ngram_join.prefix_keys(len(s), s[order], f[order], percent, k)) for k in (b, b + 1)])
        assert any(p & q for p, q in ((keys[0][0], keys[1][0]), (keys[0][0], keys[1][1]), (keys[0][1], keys[1][0]))), n


def test_quality_of_languages_with_little_trusted_text(spark):
    """A language without trusted text rejects nothing; one with little has a cut at its own level."""
    rnd = random.Random(6)
    text = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    plain = ["the", "then", "there", "other", "hot", "tone"]
    wild = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(3000)]
    junk = lambda: " ".join("".join(rnd.choice("#$%&0189") for _ in range(6)) for _ in range(60))
    rows = [(i, text(plain, 80), "en") for i in range(150)] + [(i, text(wild, 80), "rare") for i in range(200, 240)] + [(i, text(wild, 80), "rare") for i in range(240, 260)] + [(i, junk(), "rare") for i in range(260, 265)]
    rows += [(i, text(plain, 80), None) for i in range(300, 310)] + [(i, text(plain, 80), "xx") for i in range(310, 320)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(150), *range(200, 240)]], "doc_id bigint, quality int, toxic int")
    for most in (quality.HOT_GRAMS, 100):
        out = {r["doc_id"]: r for r in quality.classified(docs, labels, most=most).collect()}
        assert all(out[i]["keep"] and out[i]["log_perplexity"] is None for i in range(300, 320))
        assert sum(out[i]["keep"] for i in range(240, 260)) >= 19 and not any(out[i]["keep"] for i in range(260, 265))
        assert out[240]["cut"] > out[0]["cut"]


def test_license_notice_within_a_notice_of_less_priority(spark):
    df = spark.createDataFrame([(0, "Copyright 2020 Acme. Licensed under the GPL 3. All rights reserved."), (1, "Licensed under the GPL 3")], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in license_scan.op8(df).collect()}
    assert (out[0]["labels"], out[0]["score"]) == ("all-rights-reserved,gpl-3", 1.0)
    assert (out[1]["labels"], out[1]["score"]) == ("gpl-3", 1.0)


def test_chat_chain_of_any_depth(spark):
    """A chain deeper than 64 is ordered; only cycles, and what depends on them, are marked."""
    n = 70
    call = lambda i, *deps: {"id": i, "name": "f", "arguments": {}, "depends_on": list(deps)}
    rows = [(c, 0, "system", json.dumps({"tools": [{"name": "f"}]})) for c in (1, 2)]
    rows += [(1, i + 1, "assistant", json.dumps({"tool_calls": [call(f"c{i}", *([f"c{i - 1}"] if i else []))]})) for i in range(n)]
    rows += [(2, 1, "assistant", json.dumps({"tool_calls": [call("p", "q"), call("q", "p"), call("after", "p"), call("self", "self"), call("free", "gone"), call("two", "free", "free")]}))]
    out = {(r["conv_id"], r["call_id"]): r for r in chat_format.op2(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).where("kind = 'call'").collect()}
    assert [(out[1, f"c{i}"]["level"], out[1, f"c{i}"]["order_turn"], out[1, f"c{i}"]["status"]) for i in range(n)] == [(i, i + 1, "ok") for i in range(n)]
    assert {k: out[2, k]["status"] for k in ("p", "q", "after", "self", "free", "two")} == {"p": "cyclic", "q": "cyclic", "after": "cyclic", "self": "cyclic", "free": "ok", "two": "ok"}


def test_url_host_without_outcomes_takes_its_domains(spark):
    urls = [f"http://h{i % 30}.bad.test/{i}" for i in range(600)] + [f"http://h{i % 30}.good.test/{i}" for i in range(600)] + ["http://new.bad.test/1", "http://new.good.test/1", "http://new.unseen/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i >= 600), 0) for i in range(1200)], "doc_id bigint, quality int, toxic int")
    out = {r["page_id"]: r["verdict"] for r in url_filter.op6(pages, labels).collect()}
    assert [out[i] for i in (0, 600, 1200, 1201, 1202)] == ["block", "allow", "block", "allow", "allow"]


def test_representatives_of_null_repeated_and_clashing_ids(spark):
    """One row of each group stays, whatever its ids."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a, 0), (1, a, 0), (None, a, 0), (2, b, 0), (2, f"{a} end", 0), (5, f"{b} end", 0), (None, c, 0), (None, c, 0), (7, d, 0), (8, d, 0), (9, None, 0), (None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, t int")
    out = sorted((str(r["doc_id"]), r["text"] or "") for r in ngram_join.representatives(docs).collect())
    assert out == sorted([("1", a), ("2", b), ("None", c), ("7", d), ("9", ""), ("None", "")])


def test_ann_of_repeated_rows(spark):
    """Repeated rows change no answer."""
    x = np.random.default_rng(3).normal(size=(120, 8))
    x[41:61] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for many in (rows * 3, rows + [rows[40]] * 25):
        out = ann.op10(spark.createDataFrame(many, "vec_id bigint, embedding array<double>")).collect()
        for q in range(0, 120, 20):
            s = sorted((-float(np.dot(x[q], x[j])), j) for j in range(120) if j != q)[:20]
            mine = sorted((r["rank"], r["vec_id"]) for r in out if r["query_id"] == q)
            assert [r for r, _ in mine] == list(range(1, 21)) and len({j for _, j in mine} & {j for _, j in s}) == 20


def test_ann_block_keeps_distinct_ids():
    x = np.random.default_rng(4).normal(size=(30, 4))
    q = np.random.default_rng(5).normal(size=(5, 4))
    ids = np.arange(30)
    once = ann._local_best(q, x, ids, 10)
    thrice = ann._local_best(q, np.concatenate([x, 0.5 * x, x]), np.concatenate([ids] * 3), 10)
    best = np.maximum(q @ x.T, 0.5 * q @ x.T)
    assert len(once[0]) == len(thrice[0]) == 50
    assert [set(thrice[1][thrice[0] == i]) for i in range(5)] == [set(np.argsort(-best[i])[:10]) for i in range(5)]


def test_chat_messages_without_calls_and_content_beside_calls(spark):
    call = {"id": "a", "name": "f", "arguments": {"x": 1}}
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [], "content": "none"})), (1, 1, "assistant", json.dumps({"tool_calls": None})),
        (1, 2, "assistant", json.dumps({"tool_calls": [call], "content": "I call"})), (1, 2, "assistant", json.dumps({"tool_calls": [call], "content": "I call"})),
        (1, 2, "assistant", json.dumps({"tool_calls": [{**call, "arguments": {"x": 0}}], "content": None})), (None, 0, "assistant", json.dumps({"tool_calls": [call]})),
        (1, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": {"properties": {"x": {"type": "integer"}}}}]})),
    ]
    out = chat_format.op2(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    plain = sorted(r["line"] for r in out if r["kind"] == "plain")
    assert plain == sorted([*(json.dumps({"content": rows[i][3], "role": "assistant"}, separators=(",", ":")) for i in (0, 1)), *['{"content":"I call","role":"assistant"}'] * 2])
    calls = sorted((r["conv_id"] is None, r["status"], r["line"]) for r in out if r["kind"] == "call")
    line = lambda x: f'{{"arguments":{{"x":{x}}},"id":"a","name":"f","role":"assistant"}}'
    assert calls == [(False, "duplicate", line(1)), (False, "duplicate", line(1)), (False, "ok", line(0)), (True, "invalid", line(1))]


def test_chat_linking_equals_brute_force(spark):
    """Random conversations with calls, dependencies, cycles, faults and results against a plain Python version."""
    rnd = random.Random(12)
    rows, want = [], {}
    for conv in range(25):
        fields = {"n": {"type": "integer"}, "s": {"type": "string"}}
        rows.append((conv, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": {"properties": fields, "required": ["n"]}}]})))
        calls = {}
        for turn in range(1, 1 + rnd.randrange(8)):
            batch = []
            for _ in range(rnd.randrange(1, 4)):
                i = f"c{rnd.randrange(12)}"
                args = {k: rnd.choice([1, "x"]) for k in ("n", "s", "other") if rnd.random() < 0.6}
                batch.append({"id": i, "name": rnd.choice(["f", "f", "g"]), "arguments": args, "depends_on": [f"c{rnd.randrange(12)}" for _ in range(rnd.randrange(3))]})
                calls.setdefault(i, (turn, len(batch) - 1, batch[-1]))
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": batch})))
        for r in range(rnd.randrange(5)):
            rows.append((conv, 50 + r, "tool", json.dumps({"tool_call_id": f"c{rnd.randrange(14)}", "content": r})))
        deps = {i: {d for d in c["depends_on"] if d in calls} for i, (_, _, c) in calls.items()}
        level, order = {}, {}
        while any(i not in level and deps[i] <= set(level) for i in deps):
            now = [i for i in deps if i not in level and deps[i] <= set(level)]
            for i in now:
                order[i] = max([calls[i][0], *(order[d] for d in deps[i])])
            level.update({i: 1 + max((level[d] for d in deps[i]), default=-1) for i in now})
        for i, (turn, seq, c) in calls.items():
            faults = []
            if c["name"] != "f":
                faults = ["undeclared"]
            else:
                faults += ["missing"] * ("n" not in c["arguments"]) + ["unknown"] * ("other" in c["arguments"])
                faults += ["type"] * any(k in fields and not isinstance(v, int if k == "n" else str) for k, v in c["arguments"].items())
            want[conv, i] = ("cyclic" if i not in level else min(faults, default="ok"), level.get(i), order.get(i), seq)
    out = chat_format.op2(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    mine = {(r["conv_id"], r["call_id"]): (r["status"], r["level"] if r["status"] != "cyclic" else None, r["order_turn"] if r["status"] != "cyclic" else None, r["seq"]) for r in out if r["kind"] == "call" and r["status"] != "duplicate"}
    assert mine == want and {"ok", "cyclic", "missing", "type", "unknown", "undeclared"} <= {x[0] for x in want.values()}
    for r in out:
        if r["kind"] == "result":
            known = want.get((r["conv_id"], r["call_id"]))
            assert (r["status"] == "orphan") == (known is None)
            assert known is None or known[2] is None or r["order_turn"] == known[2]


def brute_nearest(x, q, k):
    s = sorted((-float(ann.dot(x[q][None], x[j][None])[0]), j) for j in range(len(x)) if j != q)
    return [j for _, j in s[:k]]


@pytest.mark.parametrize("kind", ["even", "uneven"])
def test_ann_recall_where_lists_are_skipped(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 32)) * (1 if kind == "even" else rng.lognormal(0, 0.3, (20_000, 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    ask = df.where("vec_id % 100 = 0")
    out = {}
    for r in ann.nearest(df, ask).collect():
        out.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x[::100] @ x.T
    s[np.arange(200), np.arange(0, 20_000, 100)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    recall = np.mean([len(out[i * 100] & set(b.tolist())) / 20 for i, b in enumerate(best)])
    assert all(len(v) == 20 for v in out.values()) and 0.95 <= recall < 1, recall


def test_ann_lengths_sizes_and_copies(spark):
    """Queries of another length take no part; huge components don't break the index; queries that are copies each leave out themselves."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3)) * 1e200
    x[0:41] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, *((100 + 20 * i, [1.0, 2.0]) for i in range(19))], "vec_id bigint, embedding array<double>")
    out = ann.op10(df).collect()
    assert {r["query_id"] for r in out} == {0, 20, 40}
    small = ann.op10(spark.createDataFrame([(i, (v / 1e200).tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()
    for q in (0, 20, 40):
        mine = [r["vec_id"] for r in sorted((r for r in small if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == brute_nearest(x / 1e200, q, 20)
    odd = spark.createDataFrame([(i, [1.0 * i, 1.0, 1.0]) for i in range(1, 20)] + [(20, [1.0, 1.0]), (40, [2.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert ann.op10(odd).count() == 0


def test_hub_of_thousands_of_near_copies(spark, monkeypatch):
    """A group of thousands whose hub is dealt to several tasks, and a passage that many unlinked texts share."""
    monkeypatch.setattr(ngram_join, "PAIRS", 300)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)]
    for i in range(2499):
        w = list(base)
        w[rnd.randrange(60)] = f"x{i % 700}"
        texts.append(" ".join(w))
    passage = [f"p{i}" for i in range(40)]
    for i in range(900):
        texts.append(" ".join([*passage, *(f"q{i // 3}z{j}" for j in range(8)), f"r{i}"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.op3(docs).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert {out[i] for i in range(2500)} == {0}
    for i in range(2500, 3400, 3):
        assert link(i, i + 1) and {out[i], out[i + 1], out[i + 2]} == {i}
