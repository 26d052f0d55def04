"""Mixing, host rules, URL templates and chat formatting against brute force on small odd tables."""

import collections
import hashlib
import re

import numpy as np
import pytest
from common_data import frame, texts, words
from pyspark.sql import functions as F

from docketry.llm import chat, mixing, rules, urls


def brute_targets(sizes, weights, cap):
    total, fixed = sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed and sizes[i] > 0]
        left = total - sum(fixed.values())
        got = {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        over = {i: cap * sizes[i] for i in rest if got[i] > cap * sizes[i]}
        if not over:
            return [{**got, **fixed}.get(i, 0.0) for i in range(len(sizes))]
        fixed |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 3], [0, 5, 0, 50], [1, 1, 1000, 4, 7, 9], []])
def test_targets(sizes):
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes, w, 3) == pytest.approx(brute_targets(sizes, w, 3))


def test_split_tree_meets_quotas():
    q = np.array([1000, 3, 0, 417])
    dealt = mixing.split_tree(q, 13, 1)
    assert (dealt.sum(0) == q).all() and (dealt >= 0).all()
    assert dealt.sum(1).max() - dealt.sum(1).min() <= 13
    assert (dealt == mixing.split_tree(q, 13, 1)).all()


def test_mix(spark):
    docs = frame(spark)
    rows = mixing.plan_mix(docs, shards=8).collect()
    assert len(rows) == len(texts())
    size = collections.Counter()
    for r in texts():
        size[r[3]] += len(words(r[1]))
    names = sorted(s for s in size if s is not None) + [None]
    goal = dict(zip(names, brute_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (len(r["shards"]) > 0) == (r["taken"] > 0)
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan_mix(docs.repartition(5), shards=8).collect()))
    plan = mixing.plan_mix(docs.dropDuplicates(["doc_id"]), shards=4)
    drawn = mixing.draw_mix(docs.dropDuplicates(["doc_id"]), plan, shards=4)
    assert drawn.count() == plan.agg(F.sum(F.size("shards"))).first()[0]
    assert mixing.plan_mix(docs.limit(0)).count() == 0


def test_draws(spark):
    """Draws of rows that share a doc_id or repeat, with columns named like the added ones, against the plan's words."""
    rows = [(i % 7 if i % 5 else None, " ".join(["w"] * (i % 23)), f"s{i % 3}" if i % 4 else None, f"t{i}", i) for i in range(120)] + [(1, "a b c", "s1", "t1", 1)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string, size int").repartition(3)
    drawn = mixing.draw_mix(docs, shards=5).collect()
    assert len(set(drawn[0].asDict())) == len(docs.columns) + 6
    size, got = collections.Counter(), collections.Counter()
    for _, t, s, _, _ in rows:
        size[s] += len(words(t))
    names = sorted(s for s in size if s) + [None]
    goal = dict(zip(names, brute_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    for r in drawn:
        assert r["size_"] == len(words(r["text"])) and 0 < r["taken_"] <= r["size_"] and 0 <= r["shard"] < 5
        got[r["source"]] += r["taken_"]
    for s in names:
        assert abs(got[s] - goal[s]) <= 1
    most = collections.Counter((r["doc_id"], r["text"], r["source"], r["taken"], r["size"]) for r in drawn)
    assert all(n <= 3 * rows.count(k) for k, n in most.items())


def test_many_sources(spark):
    """More sources than one task plans: targets and exact quotas, dealt in two steps."""
    docs = spark.createDataFrame([(i, "w " * (i % 5 + 1), f"s{i % 700:04d}") for i in range(2100)], "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs, shards=4, blocks=16).collect()
    size = collections.Counter()
    for r in plan:
        size[r["source"]] += r["size"]
    names = sorted(size)
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    taken, at = collections.Counter(), collections.Counter()
    for r in plan:
        taken[r["source"]] += r["taken"]
        at.update(r["shards"])
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)
    assert max(at.values()) - min(at.values()) < 0.2 * max(at.values())


def brute_rules(text):
    w = words(text)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    cover = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_host_rules(spark):
    extra = [(200, "a b c d e a b c d e f g h i j k l m n o p q r s t", None, "bad", 0, None, None, None), (201, "l\nl\n\nl\nx y\nx y", None, "bad", 0, None, None, None), (202, "a a a a a a a", None, "bad", 0, None, None, None)]
    got = rules.judge(frame(spark, texts() + extra)).collect()
    want = {r[0]: brute_rules(r[1]) for r in texts() + extra}
    fails = collections.defaultdict(list)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]], r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        fails[r["source"]].append(r["base_failed"])
    rates = [np.mean(v) for v in fails.values()]
    m, v = np.mean(rates), np.var(rates)
    s = min(max(m * (1 - m) / v - 1, 2), 200)
    for r in got:
        k, n = sum(fails[r["source"]]), len(fails[r["source"]])
        assert r["host_rate"] == pytest.approx((k + m * s) / (n + s))
        assert r["kept"] == (not r["base_failed"] and r["host_rate"] <= 0.5)
    assert rules.judge(frame(spark).limit(0)).count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    rows = ["http://Ä.Example.NET/en/1?x", "https://example.net", "x", None, "", "http://a.example.com/de/5#t", "http://b.org/fr/1/2", "http://b.org/frx", "http://notexample.net/en/", "ftp://h?://x/", "http://net/a", "http://x.y/ a\nb/c?d"]
    rows += [f"http://shop.com/p/slug-{i}-x/view" for i in range(40)] + [f"http://shop.com/item/{i}.html" for i in range(9)] + ["http://shop.com/item/1.html"] * 3
    pages = spark.createDataFrame([(i, u, "", "h") for i, u in enumerate(rows)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(got) == len(rows)
    ordered = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    for i, u in enumerate(rows):
        host, path = brute_url(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        fit = [r for r in ordered if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        assert got[i]["rule"] == (fit[0][0] + fit[0][1] if fit else None)
        if fit:
            assert got[i]["verdict"] == fit[0][2]
    assert {got[i]["template"] for i, u in enumerate(rows) if u and "slug" in u} == {"/p/*/view"}
    assert {got[i]["template"] for i, u in enumerate(rows) if u and "/item/" in u} == {"/item/{n}.html"}
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_purity(spark):
    rows = [f"http://a.com/x/{i}" for i in range(30)] + [f"http://a.com/y/{i}" for i in range(30)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, (("a.com", "/x/1", "block"), ("a.com", "/x/2", "block"), ("a.com", "/y/1", "allow"))).collect()}
    assert got[3]["verdict"] == "block" and got[3]["rule"] is None  # /x/3 shares the template of blocked pages
    assert got[33]["verdict"] == "allow"


def brute_verdicts(pages, rules_):
    """Purity of every (host, template) by recursion over a tree of dictionaries; pages: (host, segments, blocked or None)."""
    trees = collections.defaultdict(lambda: {"kids": {}, "rows": []})
    for host, segs, label in pages:
        at = trees[host]
        for x in segs:
            at = at["kids"].setdefault(x, {"kids": {}, "rows": []})
        at["rows"].append(label)

    def count(node):
        return len(node["rows"]) + sum(map(count, node["kids"].values()))

    def join(nodes):
        out = {"kids": {}, "rows": [x for n in nodes for x in n["rows"]]}
        for name in {k for n in nodes for k in n["kids"]}:
            out["kids"][name] = join([n["kids"][name] for n in nodes if name in n["kids"]])
        return out

    def generalise(node):
        kids = node["kids"]
        if len(kids) >= urls.MIN_CHILDREN and sum(map(count, kids.values())) < urls.MAX_SUPPORT * len(kids):
            node["kids"] = {"*": join(list(kids.values()))}
        for k in node["kids"].values():
            generalise(k)

    def pool(node):
        labels = [x for x in node["rows"] if x is not None]
        b, n = sum(labels), len(labels)
        pools = {k: pool(c) for k, c in node["kids"].items()}
        tb, tn = b + sum(p[0] for p in pools.values()), n + sum(p[1] for p in pools.values())
        for k, (kb, kn) in pools.items():
            rb, rn = tb - kb, tn - kn
            mean = (tb + 0.5) / (tn + 1)
            z = abs((kb + 0.5) / (kn + 1) - (rb + 0.5) / (rn + 1)) / (mean * (1 - mean) * (1 / (kn + 1) + 1 / (rn + 1))) ** 0.5
            node["kids"][k]["apart"] = kn > 0 and rn > 0 and z > urls.MERGE_Z
            if not node["kids"][k]["apart"]:
                b, n = b + kb, n + kn
        node["pool"] = b, n
        return b, n

    out = {}

    def walk(host, node, path, above):
        b, n = node["pool"]
        purity = (b + urls.PRIOR_PAGES * urls.PRIOR_BLOCKED) / (n + urls.PRIOR_PAGES) if above is None or node["apart"] else above
        out[host, path] = purity
        for k, c in node["kids"].items():
            walk(host, c, f"{path}/{k}", purity)

    for host, tree in trees.items():
        generalise(tree)
        pool(tree)
        walk(host, tree, "", None)
    return out


def test_url_tree(spark):
    """Method verdicts on random trees, deeper than eight segments too, against recursion."""
    rnd = np.random.default_rng(5)
    names, rows = ["de", "en", "shop", "a", "b"], []
    for _ in range(1500):
        host = ["a.com", "b.com", "c.com"][rnd.integers(3)]
        deep = int(rnd.integers(0, 4)) if rnd.random() < 0.95 else 11
        segs = [names[rnd.integers(5)] if rnd.random() < 0.8 else f"p{rnd.integers(10**6)}x" for _ in range(deep)]
        rows.append((host, segs))
    rules_ = (("a.com", "/de/", "block"), ("a.com", "/en/a/", "block"), ("b.com", "/shop/", "allow"), ("b.com", "/a/b", "block"), ("b.com", "/a/de", "allow"), ("c.com", "/b/a/", "block"))
    pages = spark.createDataFrame([(i, f"http://{h}/" + "/".join(s)) for i, (h, s) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, rules_).collect()}
    assert len(got) == len(rows)
    want = brute_verdicts([(h, s, None if got[i]["ruled"] is None else int(got[i]["ruled"] == "block")) for i, (h, s) in enumerate(rows)], rules_)
    for r in got.values():
        assert r["purity"] == pytest.approx(want[r["host"], r["template"]])
        assert r["verdict"] == (r["ruled"] or ("block" if r["purity"] > urls.MAX_BLOCKED else "allow"))
    assert len({round(x, 6) for x in want.values()}) > 3


def test_chat_events(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "one "), (1, 4, "delta", 2, None, "two"),
        (1, 5, "message", 3, "user", "later"), (1, 6, "regenerate", 2, "assistant", "new"), (1, 7, "delta", 2, None, "!"), (1, 8, "message", 4, "user", "<|end|>\n& [x] &amp;"),
        (1, 9, "edit", 1, "user", "hello"), (2, 1, "message", 1, None, None),
    ]
    out = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string"))
    turns = [(r["conv_id"], r["role"], r["text"]) for r in out.orderBy("conv_id", "place").collect()]
    assert turns == [(1, "user", "hello"), (1, "assistant", "new!"), (1, "user", "<|end|>\n& [x] &amp;"), (2, "", "")]
    done = chat.render(out).withColumn("back", chat.read_back(F.col("formatted"))).orderBy("conv_id").collect()
    assert [(t["role"], t["text"]) for t in done[0]["back"]] == [t[1:] for t in turns[:3]]
    for a, n in done[0]["loss_spans"]:
        assert done[0]["formatted"][a : a + n] == "new!"


def test_chat_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "b\n\n"), (1, 0, "user", None), (1, 1, "assistant", "b\n\n"), (2, 0, None, "<|a|>\n[INST]&lt;é"), (2, 1, "assistant", "\\<|end|>\n"), (None, 0, "user", "x"), (3, 5, "a|>\n<", "\U0001f600")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op10_chat_events(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
