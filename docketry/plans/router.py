"""From a question to a plan by rules, and from a plan to a DataFrame.

A question is answered directly only if every word of it is understood: what a closed vocabulary leaves over, analysis
words and conditions all send it elsewhere. Planning is a pure function on the driver; execution is lazy.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import cards, graph

DIRECT = ("count_docs", "list_docs", "count_facts", "count_edges", "overview")
ACTIONS = (*DIRECT, "lookup_field", "recall_docs", "graph_traverse", "answer_from_common_sense", "clarify")


def residue(question: str, extra: tuple[str, ...] = ()) -> str:
    """What the vocabulary leaves of a question, the longest word first at each place; clause marks are left too."""
    words = sorted({w for w in (*L.VOCABULARY, *extra) if w}, key=len, reverse=True)
    known = re.compile("|".join(map(re.escape, words)) + "|[" + re.escape(L.IGNORED_MARKS) + "]")
    return known.sub("", question.strip())


def unsupported_condition(question: str) -> str:
    """A time span, threshold or state in the question that plain counts can't answer."""
    m = re.search(L.UNSUPPORTED, question or "")
    return m.group(0) if m else ""


def route(question: str) -> dict | None:
    """The action of a question that the rules understand in full, else None."""
    q = (question or "").strip()
    if not q or re.search(L.ANALYTIC_WORDS, q):
        return None
    counts, has = re.search(L.COUNT_WORDS, q), lambda p: re.search(p, q)
    plan = lambda action, **params: {"action": action, "params": params}
    if has(L.OVERVIEW_WORDS) and not residue(q):
        return plan("overview")
    if counts and has(L.EDGE_WORDS) and not residue(q):
        return plan("count_edges")
    if counts and has(L.FACT_WORDS) and not residue(q):
        return plan("count_facts")
    if counts and has(L.DOC_WORDS):
        category = next((c for c in ("合同", "发票", "付款", "扣款", "结算", "开票") if c in q), "")
        return plan("count_docs", category=category) if not residue(q, (category,)) else None
    if has(L.LIST_WORDS) and has(L.DOC_WORDS) and not residue(q):
        return plan("list_docs")
    return None


def parse_query(question: str, relations: list[str] | None = None) -> dict:
    """Codes, numbers, amounts, types, keywords and relations of a question."""
    q = (question or "").strip()
    codes = sorted({re.sub(r"[\[\]]|本公司·", "", m.group(0)) for m in re.finditer(L.QUESTION_CODE, q)})
    numbers = sorted({m.group(1) for m in re.finditer(L.QUESTION_DOC_NO, q)} - set(codes))
    amounts = sorted({m.group(1) for m in re.finditer(L.QUESTION_AMOUNT, q)})
    spent = [*codes, *numbers, *amounts, *L.TYPE_KEYWORDS, *(w for ws in L.RELATION_KEYWORDS.values() for w in ws)]
    rest = re.sub("|".join(map(re.escape, sorted(spent, key=len, reverse=True))), " ", q)
    found = [r for r, ws in L.RELATION_KEYWORDS.items() if any(w in q for w in ws)]
    return {
        "question": q,
        "codes": codes,
        "doc_nos": numbers,
        "amounts": amounts,
        "types": sorted({v for k, v in L.TYPE_KEYWORDS.items() if k in q}),
        "keywords": sorted({t for t in re.split(r"[\s，,。？?：:、的]+", rest) if len(t) >= 3}),
        "relations": list(relations or found or L.DEFAULT_RELATIONS),
        "reverse": any(h in q for h in L.REVERSE_HINTS),
    }


def field_words(question: str) -> list[str]:
    """Headers that a question asks for, synonyms spelt out."""
    named = [h for w in L.FIELD_WORDS if w in question for h in L.FIELD_ALIASES.get(w, (w,))]
    return list(dict.fromkeys(named + [h for k, hs in L.FIELD_ALIASES.items() if k in question for h in hs]))


def facts_like(facts: DataFrame, needle: str, limit: int = 60) -> DataFrame:
    """Facts whose value or normal form has the text, by fact id."""
    return facts.filter(F.col("value").ilike(f"%{needle}%") | F.col("value_norm").ilike(f"%{needle}%")).orderBy("fact_id").limit(limit)


def facts_by_header(facts: DataFrame, header: str, docs: list[str] | None = None, limit: int = 40) -> DataFrame:
    """Facts of a header, in some documents or all."""
    kept = facts.filter(F.col("header") == header)
    return (kept.filter(F.col("doc_key").isin(docs)) if docs else kept).orderBy("doc_key", "fact_id").limit(limit)


def lookup_field(facts: DataFrame, field: str, limit: int = 30) -> DataFrame:
    """Facts whose header has the words."""
    return facts.filter(F.col("header").contains(field)).orderBy("doc_key", "fact_id").limit(limit).select("doc_key", "header", "value")


def keyword_docs(documents: DataFrame, keywords: list[str]) -> DataFrame:
    """Documents whose key has all keywords, else the two longest, else at least two of them (J18): doc_key, tier."""
    words = [k for k in keywords if len(k) >= 2 and not k.endswith(("是多少", "有多少"))]
    if not words:
        return documents.select("doc_key", F.lit(0).alias("tier")).limit(0)
    has = lambda w: F.col("doc_key").contains(w)
    hits = sum((has(w).cast("int") for w in words), F.lit(0))
    long_ = sum((has(w).cast("int") for w in sorted(words, key=len, reverse=True)[:2]), F.lit(0))
    tier = F.when(hits == len(words), 1).when(long_ == min(2, len(words)), 2).when(hits >= 2, 3)
    ranked = documents.select("doc_key", tier.alias("tier")).filter("tier is not null")
    return ranked.join(F.broadcast(ranked.agg(F.min("tier").alias("tier"))), "tier").select("doc_key", "tier")


def locate(facts: DataFrame, documents: DataFrame, plan: dict, per_anchor: int = 6) -> DataFrame:
    """Anchors of a plan (G9): node, anchor_kind, anchor_value, doc_key, fact_id, anchor_confidence; the limit is the feature's."""
    parts = []

    def add(kind, value, found, node=None):
        at = found.orderBy("doc_key", "fact_id").limit(per_anchor)
        parts.append(at.select((node if node is not None else F.concat(F.lit("doc:"), "doc_key")).alias("node"), F.lit(kind).alias("anchor_kind"), F.lit(value).alias("anchor_value"), "doc_key", "fact_id", F.lit(L.ANCHOR_CONFIDENCE[kind]).alias("anchor_confidence")))

    holds = lambda v: facts.filter(F.col("value").contains(v) | F.col("value_norm").contains(v))
    for kind, values in (("code", plan["codes"]), ("doc_no", plan["doc_nos"]), ("project", plan["keywords"])):
        for v in values:
            add(kind, v, holds(v))
    for v in plan["doc_nos"]:
        add("doc_no", v, facts.filter(F.col("doc_key") == v))
    for v in plan["amounts"]:
        add("amount", v, facts.filter(F.replace("value", F.lit(","), F.lit("")).contains(v.replace(",", ""))))
    for v in plan["types"]:
        docs = documents.filter(F.col("category") == v).select("doc_key", F.lit(None).cast("string").alias("fact_id"))
        add("type", v, docs)
    for v in field_words(plan["question"]):
        add("field", v, facts.filter(F.col("header") == v))
    if not parts:
        return documents.select(F.lit("").alias("node"), F.lit("").alias("anchor_kind"), F.lit("").alias("anchor_value"), "doc_key", F.lit("").alias("fact_id"), F.lit(0.0).alias("anchor_confidence")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def overview(**tables: DataFrame) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def count_docs(documents: DataFrame, category: str = "") -> DataFrame:
    """Documents, of a category if one is named: the exact one, else all that have the word (A3)."""
    exact = F.count_if(F.col("category") == category)
    return documents.agg((F.count("*") if not category else F.when(exact > 0, exact).otherwise(F.count_if(F.col("category").contains(category)))).alias("n_docs"))


def list_docs(documents: DataFrame, limit: int = 60, category: str = "") -> DataFrame:
    """The newest documents, of categories that have the word."""
    kept = documents.filter(F.col("category").contains(category)) if category else documents
    return kept.orderBy(F.desc("doc_no")).limit(limit)


def execute(plan: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """The DataFrame of a plan over documents, facts, edges and cards."""
    action, p = plan["action"], plan.get("params", {})
    if action == "overview":
        return overview(**tables)
    if action == "count_docs":
        return count_docs(tables["documents"], p.get("category", ""))
    if action == "list_docs":
        return list_docs(tables["documents"], category=p.get("category", ""))
    if action == "count_facts":
        return tables["facts"].agg(F.count("*").alias("n_facts"))
    if action == "count_edges":
        return graph.count_edges(tables["edges"])
    if action == "lookup_field":
        return lookup_field(tables["facts"], p["field"])
    if action == "recall_docs":
        return cards.recall_by_class(tables["cards"], p["classes"])
    if action == "graph_traverse":
        return ask(p["question"], tables)
    raise ValueError(f"no execution for {action}: it needs a model or a person")


def ask(question: str, tables: dict[str, DataFrame], hypotheses: bool = False) -> DataFrame:
    """Chains of evidence for a question (G12): anchors, bounded paths, those of a wanted relation or type, the best of them.

    tables may have keep, a function that stores a small table: anchors and paths are then worked out once."""
    plan, keep = parse_query(question), tables.get("keep", lambda df: df)
    anchors = locate(tables["facts"], tables["documents"], plan).groupBy("node").agg(F.max("anchor_confidence").alias("anchor_confidence"))
    found = keep(graph.paths(tables["edges"], keep(anchors), hypotheses=hypotheses, keep=keep))
    return graph.best_chains(graph.wanted_chains(found, plan["relations"], plan["types"], tables["documents"]))


def unresolved(plan: dict, anchors: DataFrame) -> DataFrame:
    """Codes, numbers and amounts of a plan that no anchor was found for."""
    wanted = [(k, v) for k, key in (("code", "codes"), ("doc_no", "doc_nos"), ("amount", "amounts")) for v in plan[key]]
    asked = anchors.sparkSession.createDataFrame(wanted, "anchor_kind string, anchor_value string")
    return asked.join(anchors.select("anchor_kind", "anchor_value"), ["anchor_kind", "anchor_value"], "left_anti")


METHODS = ("graph", "rag")
#: Ways into the edge build, for listings.
ENTRY_POINTS = {"candidate_pairs": "all documents", "candidates_for": "new documents against stored ones", "row_candidates": "table rows against documents", "ingest_replies": "verdicts from outside"}


def retrieval_method(configured: str | None) -> str:
    """The configured method, graph unless it names another that there is."""
    return configured if configured in METHODS else METHODS[0]


def render_overview(rows: DataFrame) -> str:
    """The overview (table, n_rows; a handful of rows) as lines of text."""
    return "\n".join(f"{r['table']}: {r['n_rows']}" for r in rows.orderBy("table").collect())


def allowed_path(path, root: str):
    """Is a path inside the hub's root, without steps upwards (P44)?"""
    return path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")


__all__ = ["ask", "execute", "locate", "parse_query", "route"]
