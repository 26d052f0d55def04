"""Near duplicates, decontamination and the pipeline against brute force on small odd tables."""

import collections
import random

import numpy as np
import pytest
from common_data import LOW, frame, texts, words

from docketry.llm import decontam, neardup, shingles
from docketry.llm.components import components


def near_rows(seed=3):
    rnd, rows = random.Random(seed), []
    vocab = [f"w{i}" for i in range(4000)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(3, 250))] for _ in range(25)]
    for i in range(220):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 8])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w).upper() if i % 7 == 0 else " ".join(w), "en", "s", 1, None, None, None))
    return rows + [(300 + k, *r[1:]) for k, r in enumerate(texts()[-7:])]


def brute_groups(rows, percent=85):
    sets = {}
    for r in rows:
        w = words((r[1] or "").translate(LOW))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    rows = near_rows()
    want = brute_groups(rows)
    docs = frame(spark, rows)
    got = neardup.group(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    kept = neardup.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}
    assert neardup.group(docs.limit(0)).count() == 0


def brute_rows(rows, percent):
    """Component of each row, for rows that may share a doc_id or have none."""
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(c) if sets[k] else rows[k][0] for k, c in enumerate(label)]


@pytest.mark.parametrize("index", [neardup.AT_85, neardup.AT_80])
def test_rows_that_share_a_doc_id(spark, index):
    rnd = random.Random(index.percent)
    vocab = [f"w{i}" for i in range(900)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(30, 120))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((rnd.choice([None, *range(60)]), " ".join(w)))
    rows += [(1, None), (2, ""), (None, None), (1, rows[0][1])]
    want = collections.Counter((i, c) for (i, _), c in zip(rows, brute_rows(rows, index.percent), strict=True))
    for _ in range(2):
        rnd.shuffle(rows)
        docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, label string, __id string").repartition(3)
        got = neardup.group(docs, index).collect()
        assert collections.Counter((r["doc_id"], r["component_id"]) for r in got) == want
        kept = neardup.keep(docs, index)
        assert kept.columns == docs.columns
        stay = collections.Counter((i, t) for (i, t), c in zip(rows, brute_rows(rows, index.percent), strict=True) if i is None or i == c)
        assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == stay


def test_certain_pairs_spare_others_only_on_demand():
    rng = np.random.default_rng(4)
    words_ = rng.integers(0, 1 << 30, 400)
    texts_ = [" ".join(map(str, words_)).encode(), " ".join(map(str, words_[:-2])).encode(), " ".join(map(str, words_[1:])).encode()]
    off = np.cumsum([0, *map(len, texts_)])
    n, _, chunks, odd = neardup.signatures(np.frombuffer(b"".join(texts_), np.uint8), off)
    found = {flag: set() for flag in (True, False)}
    for flag in found:
        for key_no in range(neardup.POSITIONS):
            found[flag] |= {p[:2] for p in neardup.compare(np.arange(3), np.arange(3), n, chunks, odd.view(np.uint64), np.full(3, 2), key_no, sparing=flag)}
    assert found[False] == {(0, 1), (0, 2), (1, 2)} and found[True] <= found[False] and len(found[True]) >= 2


def test_index_finds_all_pairs_within_the_distance():
    """Pigeonhole: any two signatures that differ in at most MAX_DISTANCE positions share a key."""
    rng = np.random.default_rng(2)
    for _ in range(2000):
        a = rng.integers(0, 1 << neardup.BITS, neardup.POSITIONS)
        b = a.copy()
        b[rng.choice(neardup.POSITIONS, neardup.MAX_DISTANCE, replace=False)] += 1
        chunks = (a != b).reshape(neardup.CHUNKS, neardup.PER_CHUNK).sum(1)
        assert chunks.min() <= neardup.ERRORS


def test_components(spark):
    rnd = random.Random(5)
    for n, m in ((1, 0), (50, 30), (200, 150), (200, 400)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1030)]
        parent = {x: x for p in pairs for x in p}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        linked = {x for a, b in pairs if a != b for x in (a, b)}
        assert got == {x: find(x) for x in linked}


def test_shingle_hashes_match_words():
    rnd, seen, back = random.Random(2), {}, {}
    many = ["".join(rnd.choice("aB b\n\té") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    raw = [t.encode() for t in many]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, _, _, first = shingles.words(np.frombuffer(b"".join(raw), np.uint8), off)
    all_, at = shingles.shingles(h, first, 5)
    for i, t in enumerate(many):
        w = words(t.translate(LOW))
        want = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
        got = all_[at[i] : at[i + 1]].tolist()
        assert len(got) == len(want)
        for x, y in zip(want, got, strict=True):
            assert seen.setdefault(x, y) == y and back.setdefault(y, x) == x


def test_common_length():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randint(1, 20))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common_length(decontam.places(np.array(a)), len(a), b) == table[-1, -1]


def test_decontamination(spark):
    rnd = random.Random(9)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "été", "zu") for b in range(300)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(9, 60))) + ".") for k in range(30)] + [(30, None), (31, ""), (32, "a b")]
    rows, truth = [], {}
    for i in range(150):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 400))]
        if i % 3 == 0:
            k = rnd.randrange(30)
            at = rnd.randint(0, len(w))
            leak = items[k][1].split()
            if i % 2:
                leak = [x.upper() + "!!" for x in leak]
            if i % 9 == 0:
                leak[rnd.randrange(len(leak))] = "other"
            w[at:at] = leak
            truth[i] = k
        rows.append((i, " ".join(w), "en", "s", 1, None, None, None))
    rows += [(300 + k, *r[1:]) for k, r in enumerate(texts()[-7:])]
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find(docs, bench).collect()}
    for i, r in got.items():
        assert r["contaminated"] == (i in truth), (i, truth.get(i), r)
        assert i not in truth or truth[i] in r["item_ids"]
    kept = decontam.keep(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - set(truth)
    assert decontam.find(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.find(docs.limit(0), bench).count() == 0


def test_texts_that_share_no_word_with_the_benchmark(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta " * 30, "", None, "gamma"])], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight. nine")], "item_id long, text string")
    assert [r["contaminated"] for r in decontam.find(docs, bench).collect()] == [False] * 4
    assert decontam.keep(docs, bench).count() == 4


def test_decontamination_of_long_and_changed_items(spark):
    """Items of 5 to 500 words, 0 to 45 % of the words changed, against the checks at every passage without any gate."""
    rnd = random.Random(12)
    vocab, common = [f"w{i}" for i in range(3000)], ["the", "of", "and", "to", "in", "a"]
    draw = lambda: rnd.choice(common if rnd.random() < 0.4 else vocab)
    items = [[draw() for _ in range(n)] for n in (5, 6, 8, 12, 16, 25, 40, 70, 130, 160, 200, 300, 500) for _ in range(2)]
    rows = []
    for i in range(156):
        leak = list(items[i % len(items)])
        for at in rnd.sample(range(len(leak)), round(len(leak) * (0, 0.25, 0.3, 0.35, 0.4, 0.45)[i // len(items)])):
            leak[at] = draw()
        rows.append((i, [draw() for _ in range(rnd.randint(0, 90))] + leak + [draw() for _ in range(rnd.randint(0, 90))]))
    masks = []
    number = {w: k for k, w in enumerate([*vocab, *common])}
    for it in items:
        own = np.array([number[w] for w in it])
        masks.append(decontam.places(own))
    want = {}
    for i, w in rows:
        h = [number[x] for x in w]
        want[i] = set()
        for k, it in enumerate(items):
            m = len(it)
            for at in range(0, len(h), decontam.BLOCK):
                part = h[max(0, at - m) : at + 2 * decontam.BLOCK + m]
                order = decontam.common_length(masks[k], m, part) / m
                if order >= decontam.LCS_SURE or order >= decontam.LCS_ANSWER and decontam.common_length(decontam.places(np.array([number[x] for x in it[-4:]])), 4, part) / 4 >= decontam.ANSWER:
                    want[i].add(k)
                    break
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(it), " ".join(it[-4:])) for k, it in enumerate(items)], "item_id long, text string, answer string")
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontam.find(docs, bench).collect()}
    assert got == want and sum(map(bool, want.values())) > 60


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    assert len(pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).toArrow())
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(rows) <= set(before) and all(before[i] == t for i, t in rows.items())
        if name != "mix":
            assert docs.columns == columns
        if name == "near_duplicates":
            groups = brute_groups(list(before.items()), 80)
            assert set(rows) == {i for i, (_, c) in groups.items() if c == i}
    assert collections.Counter((r["doc_id"], r["draw"]) for r in docs.collect()).most_common(1)[0][1] == 1
    got = pipeline.run(spark, sf).drop("shards")
    assert {r["doc_id"] for r in got.collect()} == set(rows) and set(rows) <= ids
    assert sum(r["taken"] for r in got.collect()) == pytest.approx(sum(len(words(t)) for t in before.values()), abs=40)


def test_cosines_of_passages_with_repeated_words():
    """Lengths of passages against a direct count of their words, and cosines in a full-rank space against plain TF-IDF."""
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    many = [" ".join(rnd.choice(vocab[:5] if rnd.random() < 0.5 else vocab) for _ in range(rnd.choice([0, 1, 15, 16, 17, 33, 100]))) for _ in range(40)]
    raw = [t.encode() for t in many]
    h, first = decontam.tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    item = " ".join(rnd.choice(vocab[:12]) for _ in range(40)).encode()
    own = decontam.tokens(np.frombuffer(item, np.uint8), np.array([0, len(item)]))[0]
    idf = np.random.default_rng(1).random(decontam.DF_SLOTS).astype(np.float32) + 0.5
    space = decontam.Space([{"words": own, "answer": own[:3], "item_id": 1}], idf)
    _, _, inside, all_, last, base = space.passages(h, first)
    slot = lambda x: int(x) & (decontam.DF_SLOTS - 1)
    weigh = lambda ws: {w: n * float(idf[w]) for w, n in collections.Counter(map(slot, ws)).items()}
    known, k, want = weigh(own), 0, {}
    for t in range(len(many)):
        ws = h[first[t] : first[t + 1]]
        for at in range(0, len(ws), decontam.BLOCK):
            v = weigh(ws[at : at + 2 * decontam.BLOCK])
            assert all_[k] == pytest.approx(sum(x * x for x in v.values()), rel=1e-5)
            assert inside[k] == pytest.approx(sum(x * x for w, x in v.items() if w in known), rel=1e-5)
            dot = sum(x * known.get(w, 0) for w, x in v.items())
            want[t, at // decontam.BLOCK] = dot / np.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in known.values()))
            k += 1
    assert k == base[-1]
    finder = decontam.Finder(space, np.eye(len(space.vocab), dtype=np.float32), [{"words": own, "answer": own[:3], "item_id": 1}])
    got = {(t, at): c for _, t, _, c, at in finder.candidates(h, first)}
    assert got and max(got.values()) <= 1 + 1e-5
    for key, c in want.items():
        if c >= 0.501:
            assert got[key] == pytest.approx(c, abs=1e-4)
    assert set(got) <= {key for key, c in want.items() if c >= 0.499}


def test_f18_latent_space_of_every_document(spark):
    docs = spark.range(25_000).selectExpr("id doc_id", "'Alpha beta, gamma' text")
    word = lambda x: decontam.tokens(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]
    space = decontam.Space([{"words": word(b"alpha beta delta"), "answer": word(b"alpha"), "item_id": 1}], np.ones(decontam.DF_SLOTS, np.float32))
    got = decontam.sketched(docs, space, np.eye(3, dtype=np.float32))
    both = [space.dim[int(w) & (decontam.DF_SLOTS - 1)] for w in word(b"alpha beta")]
    assert all(got[i, j] == 25_000 for i in both for j in both) and got.sum() == 4 * 25_000
