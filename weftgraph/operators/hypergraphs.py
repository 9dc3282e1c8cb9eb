"""Hypergraphs and hyperedge replacement grammars.

A hypergraph is a dict {"V": [{id, label}], "E": [{nodes, label}], "ext": [id]};
a grammar {"N", "T", "S", "vocab", "counts", "rules": [{"symbol", "rhs"}]}. As
DataFrame columns both travel as JSON strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.traversal import canonical


def hypergraph(internal: int, external: int, edges: list[tuple[list[str], str]]) -> dict:
    """Nodes n0.. and externals e0.., with edges."""
    ids = [f"n{k}" for k in range(internal)] + [f"e{k}" for k in range(external)]
    return {"V": [{"id": i, "label": "", "kwargs": {}} for i in ids], "E": [{"nodes": list(n), "label": x, "kwargs": {}} for n, x in edges], "ext": [f"e{k}" for k in range(external)]}


def replace(hg: dict, edge: int, rhs: dict) -> dict:
    """hg with one hyperedge replaced: the rule's externals are fused with the edge's nodes, its other nodes are new."""
    ends = hg["E"][edge]["nodes"]
    if len(ends) != len(rhs["ext"]):
        raise ValueError(f"the edge joins {len(ends)} nodes, the rule {len(rhs['ext'])}")
    used = [int(v["id"][1:]) for v in hg["V"] if v["id"][0] == "n"]
    fresh, name = max(used, default=-1) + 1, dict(zip(rhs["ext"], ends, strict=True))
    new = []
    for v in rhs["V"]:
        if v["id"] not in name:
            name[v["id"]] = f"n{fresh}"
            fresh += 1
            new.append({**v, "id": name[v["id"]]})
    edges = [{**e, "nodes": [name[n] for n in e["nodes"]]} for e in rhs["E"]]
    return {"V": hg["V"] + new, "E": hg["E"][:edge] + hg["E"][edge + 1 :] + edges, "ext": hg["ext"]}


def rewrite_first(hg: dict, rule: dict) -> dict:
    """The rule applied to the first edge with its symbol."""
    return replace(hg, next(k for k, e in enumerate(hg["E"]) if e["label"] == rule["symbol"]), rule["rhs"])


def laid(rule: dict, nonterminals: set, labels: list[str], sets: list[frozenset], every: list, edges: frozenset, ext: tuple) -> Iterator[tuple[dict, frozenset]]:
    """(nodes by name, edges used): the ways to lay a rule's terminal edges on some of edges, with its externals at ext."""
    rhs = rule["rhs"]
    terminal = [e for e in rhs["E"] if e["label"] not in nonterminals]
    inner = [v["id"] for v in rhs["V"] if v["id"] not in rhs["ext"]]
    outside = set(ext)
    domain = sorted({n for e in edges for n in sets[e]} - outside) if ext or len(edges) < len(labels) else [n for n in every if n not in outside]

    def nodes(k: int, at: dict, used: frozenset) -> Iterator[tuple[dict, frozenset]]:
        if k == len(terminal):
            yield from free([n for n in inner if n not in at], at, used)
            return
        want = terminal[k]
        for e in edges - used:
            if labels[e] == want["label"] and len(sets[e]) == len(set(want["nodes"])):
                for more in fits(list(dict.fromkeys(want["nodes"])), sets[e], at):
                    yield from nodes(k + 1, more, used | {e})

    def fits(names: list, have: frozenset, at: dict) -> Iterator[dict]:
        if not names:
            yield at
            return
        first, rest = names[0], names[1:]
        if first in at:
            if at[first] in have:
                yield from fits(rest, have - {at[first]}, at)
            return
        for n in have:
            if n not in outside and n not in at.values():
                yield from fits(rest, have - {n}, {**at, first: n})

    def free(names: list, at: dict, used: frozenset) -> Iterator[tuple[dict, frozenset]]:
        if not names:
            yield at, used
            return
        for n in domain:
            if n not in at.values():
                yield from free(names[1:], {**at, names[0]: n}, used)

    yield from nodes(0, dict(zip(rhs["ext"], ext, strict=True)), frozenset())


def parts(sets: list[frozenset], edges: frozenset, cut: set) -> list[tuple[frozenset, frozenset]]:
    """Edges joined through nodes outside cut, and the cut nodes that each part touches."""
    left, out = set(edges), []
    by_node: dict = {}
    for e in edges:
        for n in sets[e] - cut:
            by_node.setdefault(n, []).append(e)
    while left:
        part, front = set(), [left.pop()]
        while front:
            e = front.pop()
            part.add(e)
            for n in sets[e] - cut:
                for o in by_node[n]:
                    if o in left:
                        left.discard(o)
                        front.append(o)
        out.append((frozenset(part), frozenset().union(*(sets[e] for e in part)) & cut))
    return out


def derives(grammar: dict, hg: dict, symbol: str | None = None) -> bool:
    """Whether the grammar derives hg from its start symbol, exactly.

    A rule is laid on a set of edges: its terminal edges on distinct edges of the
    same label and node set, its other nodes on any. The edges left fall into parts
    that meet at the rule's nodes only, so each part belongs to one nonterminal
    edge whose ends it touches no more than; parts are dealt out in all ways, and
    each nonterminal is asked about its edges. Answers are kept by (symbol, edges, ends).
    """
    labels, ends_of = [e["label"] for e in hg["E"]], [tuple(e["nodes"]) for e in hg["E"]]
    sets = [frozenset(n) for n in ends_of]
    nonterminals = set(grammar["N"])
    if nonterminals & set(labels):
        return False
    every = [v["id"] for v in hg["V"]]

    known: dict[tuple, bool] = {}
    asked: dict[tuple, int] = {}

    def ask(symbol: str, edges: frozenset, ext: tuple) -> tuple[bool, int]:
        """The answer, and the depth of the outermost open question that it leans on."""
        key = (symbol, edges, ext)
        if key in known:
            return known[key], len(asked)
        if key in asked:  # a shortest derivation never asks this inside itself
            return False, asked[key]
        asked[key] = depth = len(asked)
        low = depth
        try:
            for rule in grammar["rules"]:
                if rule["symbol"] != symbol or len(rule["rhs"]["ext"]) != len(ext):
                    continue
                buckets = [e for e in rule["rhs"]["E"] if e["label"] in nonterminals]
                for at, used in laid(rule, nonterminals, labels, sets, every, edges, ext):
                    rest = edges - used
                    if not buckets:
                        if not rest:
                            known[key] = True
                            return True, depth
                        continue
                    split = parts(sets, rest, set(at.values()))
                    ends = [tuple(at[n] for n in b["nodes"]) for b in buckets]
                    options = [[k for k, own in enumerate(ends) if touched <= set(own)] for _, touched in split]
                    for chosen in product(*options) if all(options) else ():
                        owned = [frozenset().union(*(p for (p, _), c in zip(split, chosen, strict=True) if c == k)) for k in range(len(buckets))]
                        for b, o, x in zip(buckets, owned, ends, strict=True):
                            ok, leans = ask(b["label"], o, x)
                            low = min(low, leans)
                            if not ok:
                                break
                        else:
                            known[key] = True
                            return True, depth
        finally:
            del asked[key]
        if low >= depth:
            known[key] = False
        return False, low

    return ask(symbol or grammar["S"], frozenset(range(len(labels))), tuple(hg["ext"]))[0]


def membership(pairs: DataFrame) -> DataFrame:
    """pairs(id, grammar, hg) with JSON strings: id, member. Equal pairs are parsed once a batch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            known: dict = {}
            for g, h in zip(pdf.grammar, pdf.hg, strict=True):
                if (g, h) not in known:
                    known[g, h] = derives(json.loads(g), json.loads(h))
            yield pd.DataFrame({"id": pdf.id, "member": [known[k] for k in zip(pdf.grammar, pdf.hg, strict=True)]})

    return pairs.select("id", "grammar", "hg").mapInPandas(run, "id string, member boolean")


def incidence(hg: DataFrame) -> DataFrame:
    """hg_id, edge, label, pos, node of hypergraphs(hg_id, E): the bipartite projection."""
    return hg.select("hg_id", F.posexplode("E").alias("edge", "e")).select("hg_id", "edge", F.col("e.label").alias("label"), F.posexplode("e.nodes").alias("pos", "node"))


def canonical_hypergraph(hg: dict) -> str:
    """Equal for hypergraphs that are isomorphic with externals on externals, as a set."""
    labels = {("v", v["id"]): v.get("label") or "" for v in hg["V"]} | {("e", k): "=" + e["label"] for k, e in enumerate(hg["E"])}
    edges = [(("e", k), ("v", n), str(p)) for k, e in enumerate(hg["E"]) for p, n in enumerate(e["nodes"])]
    return canonical(labels, edges, tuple(("v", n) for n in hg["ext"]))


def merge_rules(rules: DataFrame) -> DataFrame:
    """rules(grammar_id, rule_id, symbol, form, count) of several grammars as one: rule_id, symbol, form, count.

    Equal rules are one, their counts summed; ids are dense in the order of (symbol, form).
    """
    one = rules.groupBy("symbol", "form").agg(F.sum("count").cast("long").alias("count"))
    before = one.groupBy("symbol").agg(F.count("*").alias("n"))
    return dense(one, before)


def dense(rules: DataFrame, per_symbol: DataFrame) -> DataFrame:
    """Dense ids without one task for all rules: numbered inside a symbol, from where the symbols before it end."""
    from pyspark.sql import Window as W

    start = per_symbol.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("symbol").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    nth = F.row_number().over(W.partitionBy("symbol").orderBy("form")) - 1
    return rules.join(start, "symbol").select((F.col("start") + nth).cast("long").alias("rule_id"), "symbol", "form", "count")


def arity_conflicts(vocab: DataFrame) -> DataFrame:
    """Symbols of vocab(symbol, arity) with more than one arity; a merge needs none."""
    return vocab.groupBy("symbol").agg(F.countDistinct(F.coalesce("arity", F.lit(-1))).alias("n")).where("n > 1").select("symbol")


def choices(edges: DataFrame, rules: DataFrame, salts: int = 64) -> DataFrame:
    """hg_id, edge, rule_id, weight: rules(rule_id, arity, form, count) that fit nonterminal edges(hg_id, edge, arity, form).

    weight is the rule's count shared by its matches, as a share of all of the hypergraph.
    Where each rule is one row, sums come from the classes (arity, form) before any
    choice is made, and each class is dealt by so many salts, so that choices are
    neither shuffled nor sorted and no task holds a class.
    """
    from pyspark.sql import Window as W

    total, many = F.sum("w").over(W.partitionBy("hg_id")), F.count("*").over(W.partitionBy("hg_id"))
    weight = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("many"))
    if not rules.groupBy("rule_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        found = edges.join(rules, ["arity", "form"]).withColumn("w", F.col("count") / F.count("*").over(W.partitionBy("hg_id", "rule_id")))
        return found.withColumns({"total": total, "many": many}).select("hg_id", "edge", "rule_id", weight.alias("weight"))
    classes = rules.groupBy("arity", "form").agg(F.sum("count").alias("s"), F.count("*").alias("k"))
    own = edges.join(classes, ["arity", "form"]).withColumn("m", F.count("*").over(W.partitionBy("hg_id", "arity", "form"))).withColumn("w", F.col("s") / F.col("m"))
    own = own.withColumns({"total": total, "many": F.sum("k").over(W.partitionBy("hg_id")), "salt": F.pmod(F.xxhash64("hg_id", "edge"), F.lit(salts)).cast("int")})
    dealt = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # so many partitions are kept: few bytes of edges and rules make many choices, and would be put in one task
    own = own.select("hg_id", "edge", "arity", "form", "m", "total", "many", "salt").repartition(salts, "arity", "form", "salt")
    found = own.join(dealt.repartition(salts, "arity", "form", "salt").hint("merge"), ["arity", "form", "salt"]).withColumn("w", F.col("count") / F.col("m"))
    return found.select("hg_id", "edge", "rule_id", weight.alias("weight"))
