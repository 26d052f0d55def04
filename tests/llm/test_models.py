"""Language ID, quality, language model and token counts: held-out accuracy, brute force and normalisation on small tables."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from common_data import LOW, frame, texts, words
from pyspark.sql import functions as F

from docketry.llm import langid, lm, quality, tokens
from docketry.llm.common import fold
from docketry.llm.textbytes import labelled, labelled_sample, likely


def test_language(spark):
    docs = frame(spark, [r for r in texts(n=200) if r[2] or r[0] >= 100])
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    truth = {r[0]: r for r in texts(n=200)}
    right = [r["lang_pred"] == truth[r["doc_id"]][2] for r in got if r["doc_id"] < 100 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and len(words(truth[r["doc_id"]][1])) > 3]
    assert np.mean(right) > 0.9
    for r in got:
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in truth[r["doc_id"]][1] or ""):
            assert r["lang_pred"] == "und"
    assert langid.keep(docs).columns == docs.columns
    assert langid.predict(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6, 12])
def test_codewords_differ(k):
    book = langid.code_book(k)
    assert len({tuple(r) for r in book}) == k and (np.abs(book.sum(0)) < k).all()


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()} == {"und"}
    one = spark.createDataFrame([(i, "abc", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(one, langid.fit(one)).collect()} == {"en"}


def test_decoding_by_brute_force():
    """Margins from a count of every n-gram, and the least weighted loss among all codewords, one by one."""
    rows = [(t, y) for _, t, y, *_ in texts(n=120) if t and y]
    model = langid.train(rows)
    many = [t for t, _ in rows[:40]] + ["", "a", "ab", "abc", "Été"]
    raw = [t.encode() for t in many]
    got = langid.margins(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    best, share, lead = langid.decode(model, got)
    fold = lambda b: bytes(x + 32 if 65 <= x <= 90 else x for x in b)
    for i, b in enumerate(raw):
        if not b:
            assert np.allclose(got[i], model["b"])
            continue
        b = fold(b.ljust(3))
        m = np.zeros(len(model["b"]))
        for k in range(len(b) - 2):
            m += model["w"][:, b[k] << 8 | b[k + 1]]
            m += model["w"][:, langid.TABLE + (((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435761 & 0xFFFFFFFF) >> 16)]
        m = m / (len(b) - 2) + model["b"]
        assert got[i] == pytest.approx(m, abs=1e-3)
        loss = []
        for word in model["book"]:
            loss.append(sum(w * math.log1p(math.exp(-x * c)) for w, x, c in zip(model["trust"], got[i].tolist(), word, strict=True)) / sum(model["trust"]))
        z = [math.exp(-x * len(m)) for x in loss]
        order = sorted((x / sum(z) for x in z), reverse=True)
        assert best[i] == int(np.argmin(loss)) and share[i] == pytest.approx(order[0]) and lead[i] == pytest.approx(order[0] - order[1])


def test_scores_by_brute_force():
    """The network's probability from each window, filter and chunk in turn."""
    m, rnd = quality.new_model(), random.Random(4)
    many = ["", "x", "ab cd" * 30, "".join(chr(rnd.randint(32, 300)) for _ in range(900))]
    raw = [t.encode() for t in many]
    got = quality.scores(m, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for b, p in zip(raw, got, strict=True):
        n = max(1, -(-len(b) // quality.STEP))
        b = b.ljust((n + quality.SPAN - 1) * quality.STEP, b"\0")
        z = np.zeros((n, quality.FILTERS))
        for i in range(n):
            for k in range(quality.SPAN):
                at = (i + k) * quality.STEP
                z[i] += np.concatenate([m["e"][x] for x in b[at : at + quality.STEP]]).astype(float) @ m["w"][k]
        h = [np.maximum(z[a : a + quality.CHUNK].max(0) + m["b"], 0) for a in range(0, n, quality.CHUNK)]
        feats = np.concatenate([np.max(h, 0), np.mean(h, 0)])
        assert p == pytest.approx(1 / (1 + math.exp(-(feats @ m["v"] + m["c"][0]))), abs=1e-4)


def test_fit_on_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "z", "y")], "doc_id long, text string, lang string, __letters string, extra_letters string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert langid.fit(docs.limit(0))["names"] == [] and quality.fit(docs.limit(0), labels) == {"constant": 0.5}
    assert langid.keep(docs).columns == docs.columns and quality.keep(docs, labels).columns == docs.columns
    assert langid.keep(docs.limit(0)).count() == 0 and quality.keep(docs, labels).count() == 1


def quality_rows(n=240):
    rnd, rows = random.Random(8), []
    for i in range(n):
        good = i % 4 != 0
        body = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) + ("" if good else rnd.choice(["$$$", "!!"])) for _ in range(rnd.randint(20, 200)))
        rows.append((i, body, int(good)))
    return rows


def test_quality(spark):
    rows = quality_rows()
    docs = frame(spark, [(i, t, "en", "s", 1, None, None, None) for i, t, _ in rows] + texts()[-7:])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.predict(docs, quality.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: q for i, _, q in rows}
    held = [(r["score"] >= 0.5) == truth[r["doc_id"]] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] in truth and r["doc_id"] < 100]
    assert np.mean(held) > 0.9
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.predict(docs, none).collect()} == {0.5}
    assert quality.predict(docs.limit(0), none).count() == 0


def test_convolution_covers_the_whole_text():
    m = quality.new_model()
    plain = np.frombuffer(b"a" * 300_001, np.uint8)
    for at in (0, 150_000, 299_990, 300_000):
        odd = plain.copy()
        odd[at] = 200
        whole, first = quality.to_blocks(odd, np.array([0, len(odd)]))
        z, _ = quality.convolve(m, whole)
        assert np.allclose(quality.pool(m, whole)[: quality.FILTERS], np.maximum(z.max(0), 0), atol=1e-5)
        assert not np.allclose(quality.pool(m, whole), quality.pool(m, quality.to_blocks(plain, np.array([0, len(plain)]))[0]))


def test_gradient():
    rng = np.random.default_rng(0)
    m = {k: x.astype(np.float64) for k, x in quality.new_model().items()}
    blocks = rng.integers(0, 256, (300, quality.STEP)).astype(np.uint8)
    g = {k: np.zeros_like(x) for k, x in m.items()}
    quality.gradient(m, blocks, 1.0, 1.0, g)

    def loss(m):
        z, _ = quality.convolve(m, blocks)
        h = np.maximum(np.stack([z[a : a + quality.CHUNK].max(0) for a in range(0, len(z), quality.CHUNK)]), 0)
        return np.log1p(np.exp(-(np.concatenate([h.max(0), h.mean(0)]) @ m["v"] + m["c"][0])))

    for k in m:
        i = tuple(rng.integers(0, s) for s in m[k].shape)
        up, down = ({n: x.copy() for n, x in m.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-4)


def test_base_scores(spark):
    rows = texts()
    docs = frame(spark, rows)
    got = collections.defaultdict(list)
    for r in lm.score(docs, docs.filter("doc_id % 5 != 1")).collect():
        got[r["doc_id"]].append(r)
    toks = {r[0]: [*words((r[1] or "").translate(LOW)), None] for r in rows}
    count = collections.Counter()
    for r in rows:
        if r[0] % 5 != 1:
            count.update(toks[r[0]])
    n, v = sum(count.values()), len(count)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in toks.items():
        for r in got[i]:
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(count[x] > 0 for x in t), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
            assert r["score"] < 0
    assert lm.score(docs, docs.limit(0)).filter("score is null or n_known != 0").count() == 0
    assert lm.score(docs.limit(0), docs).count() == 0


def brute_tree(counts, depth):
    """Estimates and shares of all nodes by direct recursion; counts: of byte strings, the symbol last."""
    nodes = collections.defaultdict(lambda: [0, 0])
    for s, n in counts.items():
        for j in range(8):
            node, bit = (1 << j) | (s[-1] >> (8 - j)), (s[-1] >> (7 - j)) & 1
            for d in range(depth + 1):
                nodes[(s[-1 - d : -1] if d else b"", node)][bit] += n
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weight, share = {}, {}
    for c, node in sorted(nodes, key=lambda x: -len(x[0])):
        own = kt(*nodes[c, node])
        if len(c) == depth:
            weight[c, node], share[c, node] = own, 1.0
        else:
            below = sum(w for (c2, n2), w in weight.items() if n2 == node and len(c2) == len(c) + 1 and (c2[1:] == c))
            total = np.logaddexp(own, below) - math.log(2)
            weight[c, node], share[c, node] = total, math.exp(own - math.log(2) - total)
    return nodes, share


def test_context_tree(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, "abba é"), (3, None)], "doc_id long, text string")
    p, s = lm.build(lm.count_corpus(docs))
    counts = collections.Counter()
    for t in ("abab", "abba é", ""):
        raw = bytes([lm.EDGE]) * lm.DEPTH + t.encode() + bytes([lm.EDGE])
        counts.update(raw[i : i + lm.DEPTH + 1] for i in range(len(raw) - lm.DEPTH))
    nodes, share = brute_tree(counts, lm.DEPTH)
    for (c, node), (a, b) in nodes.items():
        at = lm.slot(np.array([int.from_bytes(c, "big") << 8 | node]), len(c))
        assert p[at[0]] == pytest.approx((b + 0.5) / (a + b + 1), abs=1e-5)
        assert float(s[at[0]]) == pytest.approx(share[c, node], abs=2e-3)


def test_probabilities_sum_to_one(spark):
    docs = frame(spark)
    scorer = lm.Scorer(lm.build(lm.count_corpus(docs)))
    rng = np.random.default_rng(1)
    for ctx in [b"\xff" * lm.DEPTH, b"iver "[: lm.DEPTH].rjust(lm.DEPTH), bytes(rng.integers(0, 255, lm.DEPTH).tolist())]:
        keys = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        assert (10.0 ** scorer.work_out(keys)).sum() == pytest.approx(1, abs=1e-4)


def test_exact_nodes_of_varied_text(spark):
    """Scores of texts, seen and held out, against a tree in which no two nodes share a place."""
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("abcdefghijklmnopqrst uvwxyzé") for _ in range(rnd.randint(0, 900)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    raw = {i: bytes([lm.EDGE]) * lm.DEPTH + t.encode() + bytes([lm.EDGE]) for i, t in rows}
    keys = {i: [t[k : k + lm.DEPTH + 1] for k in range(len(t) - lm.DEPTH)] for i, t in raw.items()}
    seen = collections.defaultdict(lambda: [0, 0])
    for i in range(30):
        for s in keys[i]:
            for j in range(8):
                for d in range(lm.DEPTH + 1):
                    seen[s[lm.DEPTH - d : lm.DEPTH], (1 << j) | (s[-1] >> (8 - j))][(s[-1] >> (7 - j)) & 1] += 1
    share, below = {}, collections.defaultdict(float)
    for c, node in sorted(seen, key=lambda x: -len(x[0])):
        a, b = seen[c, node]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        total = own if len(c) == lm.DEPTH else np.logaddexp(own, below[c, node]) - math.log(2)
        share[c, node] = 1.0 if len(c) == lm.DEPTH else math.exp(own - math.log(2) - total)
        below[c[1:], node] += total if c else 0
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, docs.filter("doc_id < 30")).collect()}
    for i in (0, 7, 30, 31, 35, 39):
        want = 0.0
        for s in keys[i]:
            for j in range(8):
                node, bit, p = (1 << j) | (s[-1] >> (8 - j)), (s[-1] >> (7 - j)) & 1, None
                for d in range(lm.DEPTH, -1, -1):
                    c = s[lm.DEPTH - d : lm.DEPTH]
                    if (c, node) in seen:
                        a, b = seen[c, node]
                        own, w = (b + 0.5) / (a + b + 1), share[c, node]
                        p = own if p is None else w * own + (1 - w) * p
                p = 0.5 if p is None else p
                want += math.log10(p if bit else 1 - p)
        assert got[i] == pytest.approx(want, rel=1e-7)


def test_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, rnd = Tokenizer.from_file(path), random.Random(1)
    alphabet = "ab  \n\t\x0b\x1c\x85\xa0\u3000é日本\u0661²'sll ve!?$\u200b\U0001f600\x00"
    rows = texts() + [(1000 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "<|endoftext|>"]), None, None, 0, None, None, None) for i in range(300)]
    rows += [(2000, "ab" * 3000, None, None, 0, None, None, None), (2001, "<|endoftext|><|endoftext|> x", None, None, 0, None, None, None)]
    truth = {r[0]: r[1] or "" for r in rows}
    for r in tokens.count_tokens(frame(spark, rows), path, public_tokenizers.PATTERN).collect():
        n = len(lib.encode(truth[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(truth[r["doc_id"]].encode()), n, n > 512)


def test_f19_every_labelled_text_is_learnt_from(spark, monkeypatch):
    """A text outside the sample that training starts from changes the model, and its n-grams get weights."""
    monkeypatch.setattr(langid, "PER_LANGUAGE", 4)
    monkeypatch.setattr(quality, "PER_LABEL", 4)
    rows = quality_rows(60)
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(i, t, "en" if y else "de") for i, t, y in rows], schema)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    for fit, by, label, n, rest in ((lambda d: langid.fit(d), docs, "lang", 4, 2), (lambda d: quality.fit(d, labels), labels, "quality", 3, 1)):
        known = by.filter(fold(F.col("doc_id"), n) != rest)
        used = {r["doc_id"] for r in labelled_sample(docs, known, label, 4).collect()}
        other = next(i for i, *_ in rows if i not in used and zlib.crc32(str(i).encode()) % n != rest)
        changed = docs.withColumn("text", F.when(F.col("doc_id") == other, F.lit("QXJ qxj " * 20)).otherwise(F.col("text")))
        before, after = fit(docs), fit(changed)
        weights = [k for k in before if k in ("w", "e")]
        assert any(not np.array_equal(before[k], after[k]) for k in weights)
        assert all(np.array_equal(after[k], again) for k, again in ((k, fit(changed)[k]) for k in weights))
        if label == "lang":
            idx, _ = langid.features(b"qxj")
            assert (after["w"][:, idx] != 0).all()


def shuffled_bytes(spark):
    """Bytes that all stages of the session have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_op4_texts_without_label_are_not_shuffled(spark):
    """Where labels are too many for a broadcast, few texts but the labelled ones move, and no labelled one is lost."""
    rnd = random.Random(5)
    rows = [(i % 390, rnd.randbytes(10_000).hex() if i % 50 else None) for i in range(400)] + [(None, "a")]
    marks = [(i, i // 3 % 2) for i in range(0, 390, 13)] + [(0, 1), (13, None), (None, 1), (9999, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id int, quality int")
    best = {}
    for i, y in marks:
        if i is not None and y is not None:
            best[i] = max(y, best.get(i, 0))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = docs.localCheckpoint()
        before = shuffled_bytes(spark)
        got = labelled(docs, labels, "quality").collect()
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = sorted((t, best[i]) for i, t in rows if t is not None and i in best)
    assert sorted(tuple(r) for r in got) == want
    assert sum(len(t) for t, _ in want) / 3 < moved < sum(len(t) for _, t in rows if t) / 5


def test_op4_the_filter_loses_no_id(spark, monkeypatch):
    """A filter that is too small for its ids keeps rows that aren't asked for, but each that is."""
    texts = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    for words, most in ((1 << 19, 410), (16, 4000)):
        monkeypatch.setattr("docketry.llm.textbytes.FILTER_WORDS", words)
        got = {r["doc_id"] for r in likely(texts, texts.filter("doc_id % 10 = 0")).collect()}
        assert got >= set(range(0, 4000, 10)) and len(got) <= most
