"""Evidence graph: nodes, signals, candidate pairs by inverted index, locally computed confidences, bounded traversal.

All operators are native. Pairs come from an equi-join on (kind, value), so cost follows the pairs that share a signal and
never the square of the documents; AQE splits skewed values. A node carries all its signals to the join, so a pair is whole
where it is met and pairs are never shuffled; what is asked of a pair (edges, conflicts, the best relation) is answered there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scalar as S

KINDS = ("project", "counterparty", "tax", "amount", "doc_no")
#: Nodes with more signals than this don't carry them to the join: their pairs are grouped after it.
WIDE = 64
#: Where pairs are only counted: those of nodes with at most so many signals are not made (up to 2 ** MOST - 1 sets a node).
MOST = 6


def build_nodes(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """doc, table, row and entity nodes (G1): node_id, node_type, doc_key. Row 0, the header, is no node."""
    doc = documents.select(F.concat(F.lit("doc:"), "doc_key").alias("node_id"), F.lit("doc").alias("node_type"), "doc_key")
    cells = facts.filter("fact_kind = 'cell'")
    table = cells.select(F.concat(F.lit("table:"), "doc_key", F.lit("#t"), "table_index").alias("node_id"), F.lit("table").alias("node_type"), "doc_key").distinct()
    row = cells.filter("row_index > 0").select(row_node().alias("node_id"), F.lit("row").alias("node_type"), "doc_key").distinct()
    code = facts.select(F.explode(S.codes_in(F.col("value"))).alias("code")).distinct()
    entity = code.select(F.concat(F.lit("entity:"), "code").alias("node_id"), F.lit("entity").alias("node_type"), F.lit(None).cast("string").alias("doc_key"))
    return doc.unionByName(table).unionByName(row).unionByName(entity)


def row_node() -> Column:
    return F.concat(F.lit("row:"), "doc_key", F.lit("#t"), F.col("table_index").cast("string"), F.lit("r"), F.col("row_index").cast("string"))


def _cell_signals(header: Column, value: Column) -> Column:
    """The signals of one cell, an array of (kind, value) with nulls between. Zero amounts are no signal."""
    header, value = F.coalesce(header, F.lit("")), F.coalesce(value, F.lit(""))
    has = lambda words: S.any_contains(header, words)
    trimmed = S.trim_space(value)
    amount = F.round(S.number(value), 2).cast("decimal(18,2)")
    kinds = F.array(
        F.when(has(L.AMOUNT_HEADERS) & (F.abs(amount) > 0), F.struct(F.lit("amount").alias("kind"), amount.cast("string").alias("value"))),
        F.when(has(L.PROJECT_HEADERS) & (F.length(trimmed) >= 3), F.struct(F.lit("project").alias("kind"), trimmed.alias("value"))),
        F.when(has(L.NUMBER_HEADERS) & (F.length(trimmed) >= 3), F.struct(F.lit("doc_no").alias("kind"), trimmed.alias("value"))),
    )
    codes = F.transform(S.codes_in(value), lambda c: F.when(c.startswith("CO"), F.struct(F.lit("counterparty").alias("kind"), c.alias("value"))).when(c.startswith("TX"), F.struct(F.lit("tax").alias("kind"), c.alias("value"))))
    return F.concat(kinds, codes)


def signals(facts: DataFrame, by_row: bool = False) -> DataFrame:
    """(node, doc_key, kind, value) of documents, or of table rows (G2, A12). Zero amounts are no signal."""
    if by_row:
        facts = facts.filter("fact_kind = 'cell' and row_index > 0")
    node = row_node() if by_row else F.concat(F.lit("doc:"), "doc_key")
    each = facts.select(node.alias("node"), "doc_key", F.explode(_cell_signals(F.col("header"), F.col("value"))).alias("s")).filter("s is not null")
    return each.select("node", "doc_key", "s.kind", "s.value").distinct()


def profiles_of(sig: DataFrame) -> DataFrame:
    """Each node with all its signals: node, doc_key, signals ('kind=value', in order)."""
    return sig.groupBy("node", "doc_key").agg(F.sort_array(F.collect_set(F.concat_ws("=", "kind", "value"))).alias("signals"))


def profiles(documents: DataFrame, proofs: bool = False) -> DataFrame:
    """As profiles_of, from documents that come with their facts (doc_key, facts: fact_id, header, value), one row each: no shuffle.

    proofs adds for each signal the first fact of the document that holds its value (J10).
    """
    of = lambda f: F.transform(F.filter(_cell_signals(f["header"], f["value"]), lambda s: s.isNotNull()), lambda s: F.concat_ws("=", s["kind"], s["value"]))
    # As a generator's output signals are worked out once; as a projection they would be again in every filter pushed below it.
    out = documents.select(F.concat(F.lit("doc:"), "doc_key").alias("node"), "doc_key", F.explode(F.array(F.sort_array(F.array_distinct(F.flatten(F.transform("facts", of)))))).alias("signals"), *(["facts"] if proofs else []))
    if not proofs:
        return out
    holds = lambda s: lambda f: F.contains(F.replace(f["value"], F.lit(","), F.lit("")), F.substring_index(s, "=", -1))
    first = F.transform("signals", lambda s: F.array_min(F.transform(F.filter("facts", holds(s)), lambda f: f["fact_id"])))
    return out.withColumn("proofs", first).drop("facts")


def profiles_of_cells(table: DataFrame, doc_key: Column, cells, single: bool) -> DataFrame:
    """As profiles, from a table with the cells of a document in its rows, (header, value) columns; single: no document has two rows.

    Where headers are literals, they are told when the query is planned."""
    names = lambda h, v: F.transform(F.filter(_cell_signals(h, v), lambda s: s.isNotNull()), lambda s: F.concat_ws("=", s["kind"], s["value"]))
    own = table.select(doc_key.alias("doc_key"), F.explode(F.array(F.flatten(F.array(*[names(h, v) for h, v in cells])))).alias("s"))
    if not single:
        own = own.groupBy("doc_key").agg(F.flatten(F.collect_list("s")).alias("s"))
    return own.select(F.concat(F.lit("doc:"), "doc_key").alias("node"), "doc_key", F.explode(F.array(F.sort_array(F.array_distinct("s")))).alias("signals"))


def _kinds(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src", "dst", "src_doc", "dst_doc").agg(*[F.max((F.col("kind") == k)).alias(k) for k in KINDS], F.array_sort(F.collect_set(F.concat_ws("=", "kind", "value"))).alias("shared"))


def with_hints(pairs: DataFrame) -> DataFrame:
    """Pairs with the relations whose groups are all met."""
    met = lambda groups: reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.col(k) for k in g]) for g in groups])
    hints = F.filter(F.array(*[F.when(met(groups), F.lit(r)) for r, (groups, _) in L.RELATIONS.items() if r != "table_row_matches_doc"]), lambda r: r.isNotNull())
    return pairs.withColumn("hints", hints)


def _side(profiles: DataFrame, side: str, node: str, carry, wide: int | None) -> DataFrame:
    """A row for each signal of a node (__k), with all of them unless the node is wide."""
    whole = F.col("signals") if wide is None else F.when(F.size("signals") <= wide, F.col("signals"))
    return profiles.select(F.col("node").alias(node), F.col("doc_key").alias(f"{node}_doc"), whole.alias(f"__{side}"), *[F.col(c).alias(f"{node}_{c}") for c in carry], F.explode("signals").alias("__k"))


def _slim_side(profiles: DataFrame, side: str, node: str, carry=(), kind: str | None = None) -> DataFrame:
    """As _side where no node is wide, for _met_pairs: each signal (__k) with those before and after it, without the node's name
    where profiles have none, as that is told by doc_key. Both sides of one table are alike, so it is shuffled once."""
    at = lambda f: F.transform("signals", lambda s, i: F.struct(s.alias("k"), *f(i)))
    split = lambda i: (F.slice("signals", F.lit(1), i).alias("before"), F.slice("signals", i + 2, F.size("signals")).alias("after"))
    name = [F.col("node").alias(node)] if "node" in profiles.columns else []
    each = profiles.select(*name, F.col("doc_key").alias(f"{node}_doc"), *[F.col(c).alias(f"{node}_{c}") for c in carry], F.explode(at(split)).alias("__s"))
    if kind is not None:
        each = each.filter(F.substring_index("__s.k", "=", 1) == kind)
    return each.select(*[c for c in each.columns if c != "__s"], F.col("__s.k").alias("__k"), F.col("__s.before").alias(f"__{side}_before"), F.col("__s.after").alias(f"__{side}_after"))


def _met_pairs(joined: DataFrame, kind: str | None = None) -> DataFrame:
    """_whole_pairs of two slim sides: a pair is met at the first signal that it shares, of a kind where one is named."""
    if kind is None:
        met, earlier = joined.filter(~F.arrays_overlap("__a_before", "__b_before")), F.array().cast("array<string>")
    else:
        of_kind = lambda c: F.filter(c, lambda s: F.substring_index(s, "=", 1) == kind)
        met, earlier = joined.filter(~F.arrays_overlap(of_kind(F.col("__a_before")), of_kind(F.col("__b_before")))), F.array_intersect("__a_before", "__b_before")
    shared = F.concat(earlier, F.array("__k"), F.array_intersect("__a_after", "__b_after"))
    pairs = met.withColumn("shared", F.explode(F.array(shared))).drop("__a_before", "__a_after", "__b_before", "__b_after", "__k")
    return pairs.withColumns({x: F.concat(F.lit("doc:"), f"{x}_doc") for x in ("src", "dst") if x not in pairs.columns})


def _whole_pairs(joined: DataFrame) -> DataFrame:
    """Pairs out of the join of two sides, each where its first shared signal is met, with shared."""
    none = F.array().cast("array<string>")
    shared = F.array_intersect(F.coalesce("__a", none), F.coalesce("__b", none))
    return joined.withColumn("shared", F.explode(F.array(shared))).filter(F.get("shared", F.lit(0)) == F.col("__k")).drop("__a", "__b", "__k")


def _with_kinds(pairs: DataFrame) -> DataFrame:
    kinds = pairs.withColumn("__kinds", F.transform("shared", lambda s: F.substring_index(s, "=", 1)))
    return kinds.withColumns({k: F.array_contains("__kinds", k) for k in KINDS}).drop("__kinds")


def _spread(side: DataFrame, parts: int | None) -> DataFrame:
    """A side in parts of the join key; None leaves their number to the session."""
    return side if parts is None else side.repartition(parts, "__k")


def pairs_of(profiles: DataFrame, carry=(), wide: int | None = WIDE, parts: int | None = None, kind: str | None = None) -> DataFrame:
    """Node pairs that share a signal, each once, with shared signals, kinds and hints (G3, J5, U1); columns of the nodes named
    in carry come along as src_... and dst_.... wide None: no node has many signals, and profiles need no node where it is
    'doc:' and doc_key. There parts divides the join, so that no task sorts more than it can hold, and kind keeps to pairs that
    share a signal of one kind."""
    if wide is None:
        a, b = (_spread(_slim_side(profiles, *side, carry, kind), parts) for side in (("a", "src"), ("b", "dst")))
        return with_hints(_with_kinds(_met_pairs(a.join(b.hint("merge"), "__k").filter("src_doc < dst_doc"), kind)))
    a, b = _side(profiles, "a", "src", carry, wide), _side(profiles, "b", "dst", carry, wide)
    # Planners take sides for much smaller than they are and would broadcast them.
    pairs = _whole_pairs(a.join(b.hint("merge"), "__k").filter("src_doc < dst_doc"))
    few = profiles.select("node", "doc_key", "signals")
    w, other = _side(few.filter(F.size("signals") > wide), "w", "w", (), None), _side(few, "o", "o", (), wide)
    met = w.join(other, "__k").filter("w_doc != o_doc and (__o is not null or w_doc < o_doc)")
    first = F.col("w_doc") < F.col("o_doc")
    turned = met.select(*[F.when(first, F.col(f"w{c}")).otherwise(F.col(f"o{c}")).alias(f"src{c}") for c in ("", "_doc")], *[F.when(first, F.col(f"o{c}")).otherwise(F.col(f"w{c}")).alias(f"dst{c}") for c in ("", "_doc")], "__k")
    grouped = turned.groupBy("src", "dst", "src_doc", "dst_doc").agg(F.array_sort(F.collect_set("__k")).alias("shared"))
    for x in ("src", "dst") if carry else ():
        grouped = grouped.join(profiles.select(F.col("node").alias(x), F.col("doc_key").alias(f"{x}_doc"), *[F.col(c).alias(f"{x}_{c}") for c in carry]), [x, f"{x}_doc"])
    return with_hints(_with_kinds(pairs.unionByName(grouped)))


def pairs_at(profiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of pairs_of that touch the given nodes (column node), which are few: they are broadcast with their signals."""
    at = profiles.join(F.broadcast(nodes.select("node").distinct()), "node", "left_semi")
    a, b = F.broadcast(_side(at, "a", "here", (), None)), _side(profiles, "b", "there", (), None)
    met = _whole_pairs(b.join(a, "__k").filter("here_doc != there_doc"))
    first = F.col("here_doc") < F.col("there_doc")
    turned = met.select(*[F.when(first, F.col(f"here{c}")).otherwise(F.col(f"there{c}")).alias(f"src{c}") for c in ("", "_doc")], *[F.when(first, F.col(f"there{c}")).otherwise(F.col(f"here{c}")).alias(f"dst{c}") for c in ("", "_doc")], "shared")
    return with_hints(_with_kinds(turned.dropDuplicates(["src", "dst"])))


def candidate_pairs(sig: DataFrame) -> DataFrame:
    """Document pairs that share a signal, each once, with shared kinds, values and hints."""
    return pairs_of(profiles_of(sig))


def candidates_for(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs of new documents' signals with stored ones of other documents."""
    a = new.select(F.col("node").alias("src"), F.col("doc_key").alias("src_doc"), "kind", "value")
    b = stored.select(F.col("node").alias("dst"), F.col("doc_key").alias("dst_doc"), "kind", "value")
    return with_hints(_kinds(a.join(b, ["kind", "value"]).filter("src_doc != dst_doc")))


def candidates_of(new: DataFrame, stored: DataFrame, parts: int | None = None) -> DataFrame:
    """candidates_for of profiles, none with many signals: a pair is whole where it is met and is not shuffled."""
    a, b = _spread(_slim_side(new, "a", "src"), parts), _spread(_slim_side(stored, "b", "dst"), parts)
    return with_hints(_with_kinds(_met_pairs(a.join(b.hint("merge"), "__k").filter("src_doc != dst_doc"))))


def row_candidates(rows: DataFrame, docs: DataFrame, top: int = 2) -> DataFrame:
    """For each table row the documents with the most shared kinds (J6, W1): src, dst, n_kinds, rank. A document is one node."""
    none = F.lit(None).cast("string")
    members = profiles_of(rows).withColumnRenamed("node", "src").withColumn("dst", none).unionByName(profiles_of(docs).withColumnRenamed("node", "dst").withColumn("src", none))
    return row_candidates_of(members, F.col("src"), F.col("dst"), top)


def row_candidates_of(members: DataFrame, src: Column, dst: Column, top: int = 2, most: int = MOST, wide: DataFrame | None = None) -> DataFrame:
    """row_candidates of members (doc_key, signals and what src and dst name them by): rows have a src, documents a dst.

    Pairs aren't made: of the documents that hold a set of signals, one of a kind, a row with these signals takes the least
    top besides its own. All others that hold the set share as many kinds or more, so a document of the top is among those of
    the largest set that it shares. A set goes where its first signal goes and is made there. Pairs with a member of over most
    signals are made and ranked; wide: such members are few, are all in this part of members, and are broadcast.
    """
    known = members.filter("doc_key is not null")
    named = [c for c in members.columns if c != "signals"]
    kind = lambda s: F.substring_index(s, "=", 1)
    plain = lambda s: F.replace(F.replace(s, F.lit("\x1e"), F.lit("\x1e0")), F.lit("\x1f"), F.lit("\x1e1"))
    each = known.filter(F.size("signals").between(1, most)).select(*named, F.reverse("signals").alias("__s")).select(*named, "__s", F.posexplode("__s").alias("__i", "__first"))
    each = each.select(*named, "__first", F.filter(F.slice("__s", F.col("__i") + 2, F.lit(most)), lambda s: kind(s) != kind(F.col("__first"))).alias("__later")).repartition("__first")
    longer = lambda sets, s: F.transform(F.filter(sets, lambda x: ~F.array_contains(x["kinds"], kind(s))), lambda x: F.struct(F.concat(x["held"], F.lit("\x1f"), plain(s)).alias("held"), F.array_append(x["kinds"], kind(s)).alias("kinds")))
    start = F.array(F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("kinds")))
    sets = each.select(*named, "__first", F.explode(F.aggregate("__later", start, lambda sets, s: F.concat(sets, longer(sets, s)))).alias("__x"))
    sets = sets.select(*named, "__first", F.col("__x.held").alias("__held"), (F.size("__x.kinds") + 1).alias("__n"))
    least = Window.partitionBy("__first", "__held").orderBy(dst.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, top)
    doc = F.when(dst.isNotNull(), F.struct(dst.alias("dst"), F.col("doc_key")))
    held = sets.select(*named, "__n", F.array(*[F.nth_value(doc, i + 1).over(least) for i in range(top + 1)]).alias("__c")).filter(src.isNotNull())
    others = F.slice(F.filter("__c", lambda c: c["doc_key"] != F.col("doc_key")), 1, top)
    held = held.filter(F.get("__c", F.lit(1)).isNotNull() | (F.get("__c", F.lit(0))["doc_key"] != F.col("doc_key"))).select(*named, "__n", F.transform(others, lambda c: c["dst"]).alias("__c")).filter(F.size("__c") > 0)
    # Members of many signals: all their pairs, as rows and as documents.
    side = lambda df, s: df.select(*[F.col(c).alias(f"__{s}_{c}") for c in named], F.col("signals").alias(f"__{s}"), F.explode("signals").alias("__k"))
    w = side((known if wide is None else wide.filter("doc_key is not null")).filter(F.size("signals") > most), "a")
    met = _whole_pairs(side(known, "b").withColumn("__single", F.size("__b") <= most).join(w if wide is None else F.broadcast(w), "__k").filter("__a_doc_key != __b_doc_key"))
    at = lambda s: F.struct(*[F.col(f"__{s}_{c}").alias(c) for c in named])
    roles = F.array(F.struct(at("a").alias("row"), at("b").alias("doc")), F.when(F.col("__single"), F.struct(at("b").alias("row"), at("a").alias("doc"))))
    met = met.select(F.size(F.array_distinct(F.transform("shared", kind))).alias("__n"), F.explode(roles).alias("__r")).filter("__r is not null")
    met = met.select("__n", "__r.row.*", "__r.doc").filter(src.isNotNull()).select(F.col("__n"), F.struct(*named).alias("__row"), "doc.*").select("__n", "__row", dst.alias("__dst")).filter("__dst is not null")
    place = F.row_number().over(Window.partitionBy("__row").orderBy(F.desc("__n"), "__dst"))
    met = met.withColumn("__place", place).filter(F.col("__place") <= top).select("__row.*", "__n", F.array("__dst").alias("__c"))
    # Brought together before they are listed, as lists of the rows met so far would be larger than the rows.
    found = held.unionByName(met).repartition(*named).groupBy(*named).agg(F.collect_list(F.struct("__n", "__c")).alias("__f"))
    order = F.array_sort(F.flatten(F.transform("__f", lambda f: F.transform(f["__c"], lambda d: F.struct((-f["__n"]).alias("less"), d.alias("dst"))))))
    best = found.select(src.alias("src"), F.explode(F.array(order)).alias("__o"))
    best = best.select("src", "__o", F.posexplode(F.slice(F.array_distinct("__o.dst"), 1, top)).alias("__i", "dst"))
    n_kinds = -F.get(F.filter("__o", lambda o: o["dst"] == F.col("dst")), F.lit(0))["less"]
    return best.select("src", "dst", n_kinds.cast("long").alias("n_kinds"), (F.col("__i") + 1).alias("rank"))


def confidence(relation: str) -> tuple[Column, Column, Column]:
    """Confidence, status and number of missing groups of a pair for a relation."""
    groups, boosts = L.RELATIONS[relation]
    any_ = lambda g: reduce(lambda a, b: a | b, [F.col(k) for k in g])
    met = sum((any_(g).cast("int") for g in groups), F.lit(0))
    boost = sum((F.when(F.col(k), F.lit(w)).otherwise(F.lit(0.0)) for k, w in boosts.items()), F.lit(0.0))
    value = F.round(F.least(F.lit(L.MAX_CONFIDENCE), L.BASE_CONFIDENCE + L.GROUP_CONFIDENCE * met + boost / max(len(boosts), 1)), 3)
    status = F.when(met == len(groups), "validated").when(any_(boosts), "hypothesis").otherwise("rejected")
    return value, status, F.lit(len(groups)) - met


def edge_id(src: Column, dst: Column, relation: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", src, dst, relation)), 1, 20)


def pair_edges(pairs: DataFrame, *carried: str) -> DataFrame:
    """Pairs with the edges of every hinted relation (relation, confidence, status); rejected ones aren't stored.

    The rule judge stands in for a model's verdict: it proposes each hinted relation.
    """
    each = []
    for r in L.RELATIONS:
        value, status, _ = confidence(r)
        each.append(F.when(F.array_contains("hints", r) & (status != "rejected"), F.struct(F.lit(r).alias("relation"), value.alias("confidence"), status.alias("status"))))
    # As a generator's output edges are worked out once; as a projection they would be again in every filter pushed below it.
    return pairs.select("src", "dst", "src_doc", "dst_doc", *carried, F.explode(F.array(F.array_compact(F.array(*each)))).alias("edges"))


def _edge_rows(each: DataFrame, *carried: str) -> DataFrame:
    """Rows of pairs with one edge e as rows of edges."""
    return each.select(edge_id(F.col("src"), F.col("dst"), F.col("e.relation")).alias("edge_id"), "src", "dst", "src_doc", "dst_doc", "e.relation", "e.confidence", "e.status", *carried)


def judge(pairs: DataFrame, *carried: str) -> DataFrame:
    """An edge for every hinted relation of a pair, with confidence and status (G4, G6), and the columns named in carried."""
    return _edge_rows(pair_edges(pairs, *carried).select("src", "dst", "src_doc", "dst_doc", *carried, F.explode("edges").alias("e")), *carried)


def pair_classes(profiles: DataFrame, most: int = MOST, few: bool = False) -> DataFrame:
    """How many pairs of pairs_of share each set of kinds: KINDS, hints, n. Nodes are documents, one row each.

    Pairs aren't made: the nodes that hold a set of signals are counted, for all sets of a node's signals. Pairs that share the
    signals T are so met in each set within T; sets of odd size added and those of even size taken away give by inclusion and
    exclusion exactly the pairs of each set of kinds. Pairs with a node of over most signals are made and counted where they are
    met; few: such nodes are few and are broadcast.
    """
    known = profiles.filter("doc_key is not null")
    code = lambda s: F.coalesce(*[F.when(F.substring_index(s, "=", 1) == k, 1 << i) for i, k in enumerate(KINDS)])
    plain = lambda s: F.replace(F.replace(F.substr(s, F.locate("=", s) + 1), F.lit("\x1e"), F.lit("\x1e0")), F.lit("\x1f"), F.lit("\x1e1"))
    # The lists are a generator's output, worked out once for all sets of a node; sets are put together without lambdas.
    own = known.filter(F.size("signals").between(1, most)).select(F.explode(F.array(F.struct(F.transform("signals", lambda s: F.concat(F.chr(96 + code(s)), plain(s))).alias("s"), F.transform("signals", code).alias("bits")))).alias("x")).select("x.*")
    each = own.select("s", "bits", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("s")).cast("int") - 1)).alias("m"))
    inside = lambda c: [F.when(F.col("m").bitwiseAND(1 << i) != 0, F.get(c, F.lit(i))) for i in range(most)]
    held = each.select(F.concat_ws("\x1f", *inside("s")).alias("held"), reduce(lambda x, y: x.bitwiseOR(y), [F.coalesce(x, F.lit(0)) for x in inside("bits")], F.lit(0)).alias("kinds"), (F.bit_count("m") % 2).alias("odd"))
    sets = held.groupBy("held", "kinds", "odd").agg(F.count("*").alias("n")).withColumn("n", F.expr("if(odd = 1, 1, -1) * (n * (n - 1) div 2)"))
    met = sets.groupBy("kinds").agg(F.sum("n").alias("n")).select("kinds", "n", F.explode(F.sequence(F.lit(1), F.lit((1 << len(KINDS)) - 1))).alias("k")).filter("kinds & k = k")
    counted = met.groupBy("k").agg(F.sum(F.when(F.bit_count("k") % 2 == 1, F.col("n")).otherwise(-F.col("n"))).alias("n")).filter("n > 0")
    counted = counted.select(*[(F.col("k").bitwiseAND(1 << i) != 0).alias(k) for i, k in enumerate(KINDS)], "n")
    a = _side(known.filter(F.size("signals") > most), "a", "src", (), None)
    joined = _side(known, "b", "dst", (), None).join(F.broadcast(a) if few else a, "__k").filter((F.col("src_doc") != F.col("dst_doc")) & ((F.size("__b") <= most) | (F.col("src_doc") < F.col("dst_doc"))))
    made = _with_kinds(_whole_pairs(joined)).groupBy(*KINDS).agg(F.count("*").alias("n"))
    return with_hints(counted.unionByName(made).groupBy(*KINDS).agg(F.sum("n").alias("n")))


def edge_classes(profiles: DataFrame, most: int = MOST, few: bool = False) -> DataFrame:
    """judge of the pairs of profiles with like edges in one row: relation, confidence, status and n, their number."""
    none = {c: F.lit(None).cast("string") for c in ("src", "dst", "src_doc", "dst_doc")}
    each = pair_edges(pair_classes(profiles, most, few).withColumns(none), "n").select("n", F.explode("edges").alias("e"))
    return each.select("e.relation", "e.confidence", "e.status", "n")


def judge_best(pairs: DataFrame) -> DataFrame:
    """best_edges of judge where each undirected pair is one row: the best edge is told within the row."""
    order = F.transform("edges", lambda e: F.struct((-e["confidence"]).alias("less"), e["relation"].alias("relation"), e["confidence"].alias("confidence"), e["status"].alias("status")))
    return _edge_rows(pair_edges(pairs).filter(F.size("edges") > 0).withColumn("e", F.array_min(order)))


def judge_conflicts(pairs: DataFrame) -> DataFrame:
    """flag_conflicts of judge where each undirected pair is one row: conflicts are told within the row."""
    each = pair_edges(pairs).withColumn("conflict", F.size("edges") > 1)
    edges = _edge_rows(each.select("src", "dst", "src_doc", "dst_doc", "conflict", F.explode("edges").alias("e")), "conflict")
    return edges.withColumn("status", F.when(F.col("conflict") & (F.col("status") == "validated"), "hypothesis").otherwise(F.col("status")))


def best_edges(edges: DataFrame) -> DataFrame:
    """The most confident relation of each undirected pair; ties by name."""
    pair = (F.least("src", "dst"), F.greatest("src", "dst"))
    first = F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("confidence"), "relation", "src"))
    return edges.withColumn("__n", first).filter("__n = 1").drop("__n")


def flag_conflicts(edges: DataFrame) -> DataFrame:
    """Edges of a pair, either direction, that has several relations: conflict, and validated falls to hypothesis."""
    pair = edges.withColumns({"__a": F.least("src", "dst"), "__b": F.greatest("src", "dst")})
    over = Window.partitionBy("__a", "__b")
    conflict = F.min("relation").over(over) != F.max("relation").over(over)
    flagged = pair.withColumn("conflict", conflict).drop("__a", "__b")
    return flagged.withColumn("status", F.when(F.col("conflict") & (F.col("status") == "validated"), "hypothesis").otherwise(F.col("status")))


def pair_key(src: Column, dst: Column) -> Column:
    return F.concat_ws("\x1f", F.least(src, dst), F.greatest(src, dst))


def pair_signature(pairs: DataFrame) -> DataFrame:
    """pair_key and a hash of kinds, values and hints, to find earlier verdicts by."""
    parts = F.to_json(F.struct(pair_key(F.col("src"), F.col("dst")).alias("pair"), *KINDS, "shared", "hints"))
    return pairs.withColumns({"pair_key": pair_key(F.col("src"), F.col("dst")), "signature": F.sha1(parts)})


def request_id(kind: Column, src: Column, dst: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", kind, src, dst)), 1, 16)


def prepare_requests(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs without a cached verdict, with request ids, ready to be written as JSON lines."""
    open_ = pair_signature(pairs).join(cache.select("pair_key", "signature"), ["pair_key", "signature"], "left_anti")
    return open_.withColumn("request_id", request_id(F.lit("doc_doc"), F.col("src"), F.col("dst")))


def prepare_requests_of(profiles: DataFrame, cache: DataFrame, wide: int | None = WIDE, parts: int | None = None) -> DataFrame:
    """prepare_requests of the pairs of profiles: a cached verdict goes along with the first node of its pair, so pairs aren't joined."""
    # Of the few verdicts at one node, 64 bits tell which is meant.
    mark = lambda key, signature: F.xxhash64(key, signature)
    first = F.substring_index("pair_key", "\x1f", 1).alias("node")
    if "node" not in profiles.columns:
        first = F.substr(first, F.lit(5)).alias("doc_key")
    at = "node" if "node" in profiles.columns else "doc_key"
    own = cache.filter("pair_key is not null and signature is not null").groupBy(first).agg(F.collect_set(mark("pair_key", "signature")).alias("verdicts"))
    pairs = pair_signature(pairs_of(profiles.join(own, at, "left"), ["verdicts"], wide, parts))
    held = F.when(F.col("src") < F.col("dst"), F.col("src_verdicts")).otherwise(F.col("dst_verdicts"))
    known = F.when(held.isNull(), F.lit(False)).otherwise(F.array_contains(held, mark("pair_key", "signature")))
    return pairs.filter(~known).drop("src_verdicts", "dst_verdicts").withColumn("request_id", request_id(F.lit("doc_doc"), F.col("src"), F.col("dst")))


def ingest_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Edges from replies (request_id, relation), with confidences worked out here; unknown relations go."""
    said = replies.filter(F.col("relation").isin(list(L.RELATIONS))).select("request_id", F.col("relation").alias("said"))
    known = requests.join(said, "request_id")
    return judge(known.withColumn("hints", F.array("said")))


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both ends (J8): at, other, forward and the edge's columns."""
    end = lambda at, other, forward: F.struct(F.col(at).alias("at"), F.col(other).alias("other"), F.lit(forward).alias("forward"))
    return edges.select(*edges.columns, F.inline(F.array(end("src", "dst", True), end("dst", "src", False))))


def neighbours(edges: DataFrame, nodes: DataFrame, hypotheses: bool = True) -> DataFrame:
    """Edges at the given nodes (column node), from their side."""
    allowed = ["validated", "hypothesis"] if hypotheses else ["validated"]
    return symmetric(edges.filter(F.col("status").isin(allowed))).join(nodes.select(F.col("node").alias("at")).distinct(), "at", "left_semi")


def paths(edges, anchors: DataFrame, depth: int = L.MAX_DEPTH, most: int | None = L.MAX_PATHS, hypotheses: bool = True, keep=lambda df: df) -> DataFrame:
    """Simple paths of 1 to depth edges from anchors (node, anchor_confidence), with the relations met.

    Confidence is the anchor's times each edge's, hypotheses at a reduced weight. ``most`` caps the paths of one anchor in
    a fixed order (shorter, then by nodes), a bound of the traversal; None lists all. As longer paths come last, an anchor
    that has its paths is not followed further, so what is joined at a hop is bounded too. ``edges`` is a table, or a
    function that gives the edges at given nodes (column node), which is then asked once a hop for those at the front.
    ``keep`` stores the front of a hop, so that later hops don't work it out again.
    """
    weight = F.col("confidence") * F.when(F.col("status") == "hypothesis", L.HYPOTHESIS_WEIGHT).otherwise(1.0)
    allowed = F.col("status").isin(["validated", "hypothesis"] if hypotheses else ["validated"])
    steps = lambda e: symmetric(e.filter(allowed)).select(F.col("at").alias("__at"), F.col("other").alias("__other"), "edge_id", F.col("relation").alias("__relation"), weight.alias("__w"))
    none = F.array().cast("array<string>")
    front = anchors.select(F.col("node").alias("anchor"), F.col("node").alias("end_node"), F.array("node").alias("nodes"), none.alias("edges"), none.alias("relations"), F.col("anchor_confidence").cast("double").alias("chain"), F.lit(0).cast("long").alias("used"))
    out = None
    for _ in range(depth):
        at = edges(front.select(F.col("end_node").alias("node")).distinct()) if callable(edges) else edges
        grown = front.join(steps(at), F.col("end_node") == F.col("__at")).filter(~F.array_contains("nodes", F.col("__other")))
        more = {"nodes": "__other", "edges": "edge_id", "relations": "__relation"}
        front = grown.select("anchor", F.col("__other").alias("end_node"), *[F.concat(k, F.array(v)).alias(k) for k, v in more.items()], (F.col("chain") * F.col("__w")).alias("chain"), "used")
        if most is not None:
            own = Window.partitionBy("anchor")
            front = front.withColumn("__n", F.row_number().over(own.orderBy("nodes", "edges"))).filter((F.col("__n") <= most) & (F.col("__n") + F.col("used") <= most))
            front = front.withColumn("used", F.col("used") + F.count("*").over(own)).drop("__n")
        front = keep(front)
        out = front if out is None else out.unionByName(front)
        if most is not None:
            front = front.filter(F.col("used") < most)
    return out.withColumns({"hops": F.size("edges"), "confidence": F.round("chain", 4)}).drop("chain", "used")


def wanted_chains(found: DataFrame, relations, types, documents: DataFrame) -> DataFrame:
    """Paths with a wanted relation at any hop; where types are asked for, also those that end in a document of such a type."""
    kept = F.arrays_overlap("relations", F.array(*[F.lit(r) for r in relations]).cast("array<string>"))
    if not types:
        return found.filter(kept)
    ends = documents.filter(F.col("category").isin(list(types))).select(F.concat(F.lit("doc:"), "doc_key").alias("end_node"))
    ends = ends.join(found.select("end_node").distinct(), "end_node", "left_semi").select("end_node", F.lit(True).alias("__typed")).distinct()
    return found.join(ends, "end_node", "left").filter(kept | F.col("__typed")).select(*found.columns)


def best_chains(found: DataFrame, most: int = L.MAX_CHAINS) -> DataFrame:
    """Paths that differ in edges or ends, the most confident ones."""
    same = Window.partitionBy(F.array_sort("edges"), F.least("anchor", "end_node"), F.greatest("anchor", "end_node")).orderBy(F.desc("confidence"), "anchor")
    return found.withColumn("__n", F.row_number().over(same)).filter("__n = 1").drop("__n").orderBy(F.desc("confidence"), "end_node", "edges").limit(most)


def justify(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """For each edge and side the first fact that holds a shared value (J10); edges have column shared ('kind=value')."""
    each = edges.select("edge_id", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src_doc").alias("doc_key")), F.struct(F.lit("dst").alias("side"), F.col("dst_doc").alias("doc_key")))).alias("e"), "shared")
    wanted = each.select("edge_id", "e.side", "e.doc_key", F.explode(F.transform("shared", lambda v: F.substring_index(v, "=", -1))).alias("wanted"))
    hit = wanted.join(facts.select("doc_key", "fact_id", "header", "value"), "doc_key").filter(F.contains(F.replace("value", F.lit(","), F.lit("")), F.col("wanted")))
    first = F.row_number().over(Window.partitionBy("edge_id", "side").orderBy("fact_id", "wanted"))
    return hit.withColumn("__n", first).filter("__n = 1").drop("__n")


def judge_justified(profiles: DataFrame, relation: str, wide: int | None = WIDE) -> DataFrame:
    """justify of the judged edges of a relation: edge_id, side, fact_id; profiles have proofs, which nodes take along."""
    pairs = pairs_of(profiles, ["signals", "proofs"], wide)
    edges = judge(pairs, "shared", "src_signals", "src_proofs", "dst_signals", "dst_proofs").filter(F.col("relation") == relation)
    proof = lambda x: F.array_min(F.transform("shared", lambda s: F.get(f"{x}_proofs", F.array_position(f"{x}_signals", s).cast("int") - 1)))
    sides = F.array(*[F.struct(F.lit(x).alias("side"), proof(x).alias("fact_id")) for x in ("src", "dst")])
    return edges.select("edge_id", F.inline(sides)).filter("fact_id is not null")


def orphan_entities(registered: DataFrame, facts: DataFrame) -> DataFrame:
    """Registered codes (column code) that no fact mentions."""
    used = facts.select(F.explode(S.codes_in(F.col("value"))).alias("code")).distinct()
    return registered.join(used, "code", "left_anti")


def edge_owners(edges: DataFrame) -> DataFrame:
    """Edges of each document, an edge counted once for each distinct owner."""
    owner = F.explode(F.array_distinct(F.array(S.node_doc(F.col("src")), S.node_doc(F.col("dst")))))
    return edges.select(owner.alias("doc_key")).filter("doc_key is not null").groupBy("doc_key").agg(F.count("*").alias("n_edges"))


def count_edges(edges: DataFrame) -> DataFrame:
    """Edges by status, by relation and in all (A4); with a column n a row stands for n edges."""
    n = F.coalesce(F.sum("n"), F.lit(0)) if "n" in edges.columns else F.count("*")
    g = edges.groupingSets([["status"], ["relation"], []], "status", "relation").agg(n.alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "relation").otherwise("total")
    return g.select(dimension.alias("dimension"), F.coalesce("status", "relation", F.lit("all")).alias("name"), "n")


def count_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of each type, every type listed (A5): node_type, n."""
    g = nodes.agg(*[F.count_if(F.col("node_type") == t).alias(t) for t in ("doc", "table", "row", "entity")])
    return g.unpivot([], ["doc", "table", "row", "entity"], "node_type", "n")


def build_state(state: DataFrame) -> DataFrame:
    """Documents built and the time of the latest build (A5); state: doc_key, built_at."""
    return state.agg(F.count("*").alias("n_built"), F.max("built_at").alias("last_built"))


def with_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with the labels of their nodes at both ends, null where a node has none (J27); labels: node_id, label."""
    side = lambda x: labels.select(F.col("node_id").alias(x), F.col("label").alias(f"{x}_label"))
    return edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")


def judge_labelled(profiles: DataFrame, labels: DataFrame, wide: int | None = WIDE) -> DataFrame:
    """with_labels of the judged edges of profiles: nodes take their labels along, so edges aren't joined."""
    own = labels.groupBy(F.col("node_id").alias("node")).agg(F.collect_list(F.struct("label")).alias("labels"))
    pairs = pairs_of(profiles.join(own, "node", "left"), ["labels"], wide)
    edges = judge(pairs, "src_labels", "dst_labels")
    for x in ("src", "dst"):
        edges = edges.withColumn("__l", F.explode_outer(f"{x}_labels")).withColumn(f"{x}_label", F.col("__l.label")).drop("__l", f"{x}_labels")
    return edges


def set_status(edges: DataFrame, edge: str | Column, status: str) -> DataFrame:
    """A person's verdict on one edge."""
    return edges.withColumn("status", F.when(F.col("edge_id") == edge, status).otherwise(F.col("status")))


def fingerprint(facts: DataFrame) -> DataFrame:
    """A hash of each document's facts, to see what has changed."""
    ordered = F.sort_array(F.collect_list(F.concat_ws("\x1f", "fact_id", F.coalesce("value", F.lit("")))))
    return facts.groupBy("doc_key").agg(F.sha2(F.array_join(ordered, "\x1e"), 256).alias("fingerprint"))


def pending(documents: DataFrame, state: DataFrame) -> DataFrame:
    """Documents to build with the reason: never built, or changed since (J1, W14); both have doc_key and fingerprint."""
    both = documents.join(state.select("doc_key", F.col("fingerprint").alias("built")), "doc_key", "left")
    reason = F.when(F.col("built").isNull(), "new").when(F.col("built") != F.col("fingerprint"), "changed")
    return both.withColumn("reason", reason).filter("reason is not null").drop("built")


def evidence_text(chains: DataFrame, facts: DataFrame, blocks: int = 3, chars: int = 1200, window: int = 220, least: float = 0.6) -> DataFrame:
    """Short evidence of the best chains for a prompt, within a budget of characters (G14): place, text."""
    top = chains.filter(F.col("confidence") >= least).orderBy(F.desc("confidence"), "end_node").limit(blocks)
    at = top.select("anchor", "end_node", "confidence", S.node_doc(F.col("end_node")).alias("doc_key")).join(facts.select("doc_key", "fact_id", "header", "value"), "doc_key")
    line = F.concat_ws(": ", "header", "value")
    text = at.groupBy("anchor", "end_node", "confidence").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fact_id", line.alias("line")))), lambda x: x["line"]), "; "), 1, window).alias("text"))
    order = Window.orderBy(F.desc("confidence"), "end_node")
    used = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return text.withColumn("used", used).filter(F.col("used") <= chars).select(F.row_number().over(order).alias("place"), "anchor", "end_node", "confidence", "text")
