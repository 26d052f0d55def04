"""Host-level quality rules, native: document rules, failure rates by host shrunk by an empirical beta prior, verdicts joined back.

All expressions are built-in functions; a document's words are handled inside its row, so nothing is exploded
and a host with a third of all rows costs only partial sums. The host of a document is its ``source``.

Nulls and odd rows: a null text has no word, so it fails the base rules; a null source is a host of its own;
rows that repeat are judged row by row; an empty table gives an empty result. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: The prior weighs as many documents as the spread of host rates supports, within these bounds.
PRIOR_WEIGHT = (2.0, 200.0)

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once for the row."""
    return F.transform(F.array(value), f)[0]


def _repeat_words(text: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, each word once."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of_hashes(h):
        window = lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i"))
        found = F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), window))
        return _let(F.array_sort(found), of_sorted)

    def of_sorted(s):
        twin = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        starts = F.transform(F.filter(s, lambda x, k: F.coalesce(twin(x, k), F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])
        return _let(F.array_sort(starts), covered)

    def covered(p):
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.coalesce(_let(hashes, of_hashes), F.lit(0)).cast("long")


def document_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base figures of each document."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    base = docs.select("doc_id", "source", text.alias("text")).select(
        "doc_id",
        "source",
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("text")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def host_rates(judged: DataFrame) -> tuple[DataFrame, int]:
    """Each host's documents, failures and shrunk failure rate, and the number of hosts.

    The prior is beta(m s, (1 - m) s): m is the mean and s comes from the variance of the hosts' rates.
    """
    hosts = judged.groupBy("source").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    seen = hosts.agg(F.count("*").alias("n"), F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    m = min(max(seen["m"] or 0.0, 1e-6), 1 - 1e-6)
    weight = m * (1 - m) / seen["v"] - 1 if seen["v"] else PRIOR_WEIGHT[1]
    weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    return hosts.withColumn("host_rate", (F.col("host_failed") + m * weight) / (F.col("host_docs") + weight)), seen["n"]


def judge(docs: DataFrame) -> DataFrame:
    """Base figures, the host's shrunk rate and kept: false if the document fails, or else if its host is rejected."""
    judged = cut(document_rules(docs))
    hosts, n = host_rates(judged)
    joined = lookup(judged, hosts.select("source", "host_rate"), ["source"], n, F.col("doc_id"))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= MAX_HOST_RATE))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op6_host_rules(spark, sf_dir) -> DataFrame:
    """Contract query: base figures and host verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


OP6_SQL = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text,'') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
win AS (SELECT doc_id, i, words[i:i+4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f GROUP BY 1),
p AS (SELECT least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS m, var_pop(k / n) AS v FROM h),
q AS (SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE {PRIOR_WEIGHT[1]} END, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]}) AS s FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (k + m * s) / (n + s) <= {MAX_HOST_RATE} AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, q
"""
