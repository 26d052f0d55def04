"""Small tables with odd rows: nulls in any column, empty and long texts, ties, repeats, extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n string, key string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(seed=4, n=60):
    rnd = random.Random(seed)
    vocab = {"en": ["the", "and", "thing", "with", "house", "river", "stone", "of", "walk"], "de": ["der", "und", "über", "haus", "straße", "nicht", "fluß", "ein"], "fr": ["le", "été", "avec", "maison", "où", "rivière", "une", "ça"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(list(vocab))
        body = " ".join(rnd.choice(vocab[lang]) + rnd.choice(["", "", "", ".", ",", "\n", "x" * rnd.randint(0, 3)]) for _ in range(rnd.randint(1, 120)))
        rows.append([i, body, lang, f"s{i % 4}", len(body), None, None, "k"])
    rows[3][1] = rows[8][1] = rows[2][1]  # exact copies
    rows[9][1] = rows[2][1] + " tail"
    rows += [[10100, None, None, None, None, None, None, None], [10101, "", "en", "s0", 0, 0.5, "n", None], [10102, " \n\t", "de", None, 3, None, None, None], [10103, "x", "en", "s1", 1, None, None, None]]
    rows += [[10104, "the river of stone " * 4000, "en", "s1", 1, 1.0, None, None], [10105, "1234 $$$ \x00 \U0001f600", None, "s2", 1, None, None, None], [10105, "1234 $$$ \x00 \U0001f600", None, "s2", 1, None, None, None]]
    return [tuple(r) for r in rows]


def frame(spark, rows=None, parts=3):
    return spark.createDataFrame(texts() if rows is None else rows, SCHEMA).repartition(parts)
