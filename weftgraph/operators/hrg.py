"""Hyperedge replacement grammars over collections: learnt from tree decompositions, asked with a shared memo, and sampled by weight.

Hypergraphs are as in `hypergraphs`; a node's label is a terminal edge on that node alone.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.asking import Search
from weftgraph.operators.checkpoints import cut
from weftgraph.operators.traversal import canonical, per_graph, per_kind
from weftgraph.sources.views import Graphs, apart

START = "S"
#: Steps that a task searches for the answer to a question before it is left to further rounds.
AHEAD = 5_000
#: Rows that a task holds before it gives them.
ROWS = 10_000


def form_of(hg: dict) -> str:
    """Equal for hypergraphs that are isomorphic with each external on the external of the same place."""
    place = {n: k for k, n in enumerate(hg["ext"])}
    labels = {("v", v["id"]): f"ext{place[v['id']]}" if v["id"] in place else "" for v in hg["V"]} | {("e", k): "=" + e["label"] for k, e in enumerate(hg["E"])}
    return canonical(labels, [(("e", k), ("v", n), str(p)) for k, e in enumerate(hg["E"]) for p, n in enumerate(e["nodes"])])


def hypergraph_of(labels: dict, edges: list) -> dict:
    """A labelled graph as a hypergraph: an edge of one node for each label, edges as they are."""
    return {"V": [{"id": f"n{n}"} for n in labels], "E": [{"nodes": [f"n{n}"], "label": str(x)} for n, x in labels.items()] + [{"nodes": [f"n{a}", f"n{b}"], "label": str(x)} for a, b, x in edges], "ext": []}


def decomposition(nodes: list, links: list[frozenset]) -> tuple[list[frozenset], list[int | None]]:
    """Bags and the parent of each: a clique tree of a chordal completion; parents come first.

    Nodes go one by one, that of fewest neighbours first; the neighbours of one that goes are
    joined, which completes the graph, and with it make a bag. Bags inside a neighbouring bag are merged with it.
    """
    near: dict = {n: set() for n in nodes}
    for link in links:
        for n in link:
            near[n] |= link - {n}
    gone, bag, up = {}, {}, {}
    left = set(nodes)
    while left:
        n = min(left, key=lambda x: (len(near[x] & left), str(x)))
        left.discard(n)
        rest = near[n] & left
        bag[n], gone[n] = frozenset(rest | {n}), len(gone)
        for a in rest:
            near[a] |= rest - {a}
    for n, b in bag.items():
        later = sorted((b - {n}), key=gone.get)
        up[n] = later[0] if later else None
    order = sorted(bag, key=gone.get, reverse=True)  # parents first
    kept: list[frozenset] = []
    at: dict = {}
    parents: list[int | None] = []
    for n in order:
        p = None if up[n] is None else at[up[n]]
        if p is not None and kept[p] < bag[n]:  # the parent lies inside this bag and grows to it
            kept[p] = bag[n]
            at[n] = p
        elif p is not None and bag[n] <= kept[p]:
            at[n] = p
        else:
            at[n] = len(kept)
            kept.append(bag[n])
            parents.append(p)
    return kept, parents


def rules_of(hg: dict) -> list[tuple[str, dict]]:
    """(symbol, right side) of each bag of a hypergraph's decomposition.

    A bag's externals are the nodes that it shares with its parent; its symbol tells how many they
    are. Each edge belongs to the first bag that holds all its nodes; each child is a nonterminal
    edge over what it shares. Parts that nothing joins hang on the first bag by edges without nodes.
    """
    nodes = [v["id"] for v in hg["V"]]
    bags, parents = decomposition(nodes, [frozenset(e["nodes"]) for e in hg["E"]])
    if not bags:
        return [(START, {"V": [], "E": [], "ext": []})]
    parents = [None] + [0 if p is None else p for p in parents[1:]]
    shared = [[]] + [sorted(bags[k] & bags[p]) for k, p in enumerate(parents) if k]
    own: list[list[dict]] = [[] for _ in bags]
    for e in hg["E"]:
        own[next(k for k, b in enumerate(bags) if b >= set(e["nodes"]))].append(e)
    for k, p in enumerate(parents):
        if k:
            own[p].append({"nodes": shared[k], "label": f"N{len(shared[k])}"})
    out = []
    for k, bag in enumerate(bags):
        name = {n: f"e{j}" for j, n in enumerate(shared[k])}
        name |= {n: f"n{j}" for j, n in enumerate(sorted(bag - set(shared[k])))}
        rhs = {"V": [{"id": x} for x in name.values()], "E": [{"nodes": [name[n] for n in e["nodes"]], "label": e["label"]} for e in own[k]], "ext": [name[n] for n in shared[k]]}
        out.append((START if k == 0 else f"N{len(shared[k])}", rhs))
    return out


def hypergraphs(g: Graphs) -> DataFrame:
    """graph_id, form, hg (JSON) of each graph."""
    return per_graph(g, _formed, "form string, hg string")


def kinds(g: Graphs | DataFrame) -> DataFrame:
    """graph_id, form, hg, often: hypergraphs() of the least of those graphs that are equal, and how many are; enough for learn(). g as in per_kind()."""
    return per_kind(g, _formed, "form string, hg string")


def _formed(labels: dict, edges: list) -> Iterator[tuple]:
    hg = hypergraph_of(labels, edges)
    yield form_of(hg), json.dumps(hg)


def learn(collection: DataFrame) -> DataFrame:
    """symbol, arity, form, rhs, count, n_graphs: the rules of hypergraphs(graph_id, form, hg), or of kinds() of them, equal ones as one.

    Isomorphic graphs have equal rules, so each form is decomposed once, and counts are
    multiplied; count tells how often a rule is used, n_graphs in how many graphs.
    """
    often = F.sum("often") if "often" in collection.columns else F.count("*")
    forms = cut(collection.groupBy("form").agg(often.alias("often"), F.min("hg").alias("hg")))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(1 << 16)
        def form(rhs: str) -> str:
            return form_of(json.loads(rhs))

        for pdf in it:
            rows = []
            for hg, often in zip(pdf.hg, pdf.often, strict=True):
                used: dict[tuple, list[str]] = {}
                for symbol, rhs in rules_of(json.loads(hg)):
                    text = json.dumps(rhs)
                    used.setdefault((symbol, len(rhs["ext"]), form(text)), []).append(text)
                rows += [(*rule, min(texts), often * len(texts), often) for rule, texts in used.items()]
            yield pd.DataFrame(rows, columns=["symbol", "arity", "form", "rhs", "uses", "often"])

    used = apart(forms, "form").mapInPandas(run, "symbol string, arity int, form string, rhs string, uses long, often long")
    return used.groupBy("symbol", "arity", "form").agg(F.min("rhs").alias("rhs"), F.sum("uses").alias("count"), F.sum("often").alias("n_graphs"))


def grammar_of(rules: DataFrame) -> dict:
    """A grammar from rules(symbol, rhs, count); they come to the driver, as grammars travel whole."""
    rows = rules.select("symbol", "rhs", "count").orderBy("symbol", "rhs").collect()
    made = [{"symbol": r["symbol"], "rhs": json.loads(r["rhs"])} for r in rows]
    return {"N": sorted({r["symbol"] for r in rows} | {START}), "S": START, "rules": made, "counts": [r["count"] for r in rows]}


_ASKED = "parent string, way string, children array<struct<key:string,symbol:string,hg:string>>"


def members(collection: DataFrame, grammar: dict, most: int = 1000) -> DataFrame:
    """graph_id, member of hypergraphs(graph_id, form, hg): whether the grammar derives them from its start symbol, exactly.

    Questions are rows (symbol, form), each asked once whatever hypergraphs, rules or
    rounds it comes from. A task searches each for AHEAD steps, with the answers of all that it was given; for one that
    takes more it lays one rule and gives the ways that it may be true, each a set of further
    questions; those not asked before are the next round's. When none
    is left, truth spreads from ways without questions up. Nothing is gathered but the
    grammar itself. An edge with a nonterminal's label is no terminal, so such a hypergraph is no member.
    """
    roots = collection.groupBy("form").agg(F.min("hg").alias("hg")).select(F.concat(F.lit(grammar["S"] + "|"), "form").alias("key"), F.lit(grammar["S"]).alias("symbol"), "hg")
    shared, ahead = collection.sparkSession.sparkContext.broadcast(grammar), AHEAD

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(1 << 16)
        def key(symbol: str, hg: str) -> str:
            return f"{symbol}|{form_of(json.loads(hg))}"

        search, rows = Search(shared.value), []
        for pdf in it:
            for parent, symbol, text in zip(pdf.key, pdf.symbol, pdf.hg, strict=True):
                hg, seen = json.loads(text), set()
                rows.append((parent, None, []))  # asked, whatever comes of it
                answer = search.answer(symbol, hg, ahead)
                for left in [[]] if answer else search.ways(symbol, hg) if answer is None else []:
                    asked = {key(s, t): (s, t) for s, t in ((s, json.dumps(x)) for s, x in left)}
                    way = ",".join(sorted(asked))
                    if parent not in asked and way not in seen:  # a shortest derivation never asks this inside itself
                        seen.add(way)
                        rows.append((parent, hashlib.md5(way.encode()).hexdigest(), [{"key": k, "symbol": s, "hg": t} for k, (s, t) in asked.items()]))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=["parent", "way", "children"])
                        rows = []
        yield pd.DataFrame(rows, columns=["parent", "way", "children"])

    front = cut(roots)
    seen, ways = front.select("key"), None
    for _ in range(most):
        new = cut(apart(front, "key").mapInPandas(run, _ASKED))
        ways = new if ways is None else ways.unionByName(new)
        seen = cut(seen.unionByName(new.select(F.col("parent").alias("key"))).distinct())
        asked = new.select(F.explode("children").alias("c")).select("c.*").groupBy("key").agg(F.min("symbol").alias("symbol"), F.min("hg").alias("hg"))
        front = cut(asked.join(seen, "key", "left_anti"))
        if front.isEmpty():
            break
    else:
        raise RuntimeError(f"questions are left after {most} rounds")
    ways = cut(ways.where("way IS NOT NULL").select("parent", "way", F.transform("children", lambda c: c["key"]).alias("needs")).dropDuplicates(["parent", "way"]))
    true = cut(ways.where(F.size("needs") == 0).select(F.col("parent").alias("key")).distinct())
    fresh = true
    open_ways = ways.where(F.size("needs") > 0).select("parent", "way", F.size("needs").alias("n"), F.explode("needs").alias("key"))
    while not fresh.isEmpty():
        now = open_ways.join(true, "key").groupBy("parent", "way").agg(F.count("*").alias("k"), F.first("n").alias("n")).where("k = n").select(F.col("parent").alias("key")).distinct()
        fresh = cut(now.join(true, "key", "left_anti"))
        true = cut(true.unionByName(fresh))
    held = true.withColumn("true", F.lit(True))
    return collection.withColumn("key", F.concat(F.lit(grammar["S"] + "|"), "form")).join(held, "key", "left").select("graph_id", F.col("true").isNotNull().alias("member"))


def _draw(*what: object) -> float:
    """A fixed number in (0, 1)."""
    return (int.from_bytes(hashlib.blake2b(":".join(map(str, what)).encode(), digest_size=8).digest(), "big") + 1) / (2**64 + 2)


def grown(grammar: dict, seed: int, row: int, steps: int) -> tuple[dict | None, list[int]]:
    """A hypergraph by weighted choice of rules, and the rules used; None if nonterminals are left after so many steps.

    Each step replaces the first nonterminal edge. Of its rules the one with the least exponential
    key -ln(draw) / weight is taken, draws being fixed by seed, row, step and rule.
    """
    nonterminals, of = set(grammar["N"]), {}
    for k, r in enumerate(grammar["rules"]):
        of.setdefault((r["symbol"], len(r["rhs"]["ext"])), []).append(k)
    count, edges, open_edges, used = 0, [], [(grammar["S"], [])], []
    while open_edges:
        symbol, ends = open_edges.pop(0)
        fit = [k for k in of.get((symbol, len(ends)), []) if grammar["counts"][k] > 0]
        if not fit or len(used) == steps:
            return None, used
        k = min(fit, key=lambda k: (-math.log(_draw(seed, row, len(used), k)) / grammar["counts"][k], k))
        used.append(k)
        rhs = grammar["rules"][k]["rhs"]
        name = dict(zip(rhs["ext"], ends, strict=True))
        for v in rhs["V"]:
            if v["id"] not in name:
                name[v["id"]] = f"n{count}"
                count += 1
        for e in rhs["E"]:
            nodes = [name[n] for n in e["nodes"]]
            if e["label"] in nonterminals:
                open_edges.append((e["label"], nodes))
            else:
                edges.append({"nodes": nodes, "label": e["label"]})
    return {"V": [{"id": f"n{k}"} for k in range(count)], "E": edges, "ext": []}, used


def generate(session, grammar: dict, n: int, seed: int = 0, steps: int = 200, rounds: int = 20) -> DataFrame:
    """form, hg, row, used: n hypergraphs that differ, or fewer if the rounds find no more; the rows of least number are kept.

    Rows are numbered, and each row's draws depend on its number alone, so the result is the
    same however rows are dealt. Each round tries as many rows as are missing, at least a quarter
    of n, and keeps the first row of each form; rows whose derivation doesn't end within so many steps are left out.
    """
    shared = session.sparkContext.broadcast(grammar)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for row in pdf.id:
                hg, used = grown(shared.value, seed, int(row), steps)
                if hg is not None:
                    rows.append((form_of(hg), json.dumps(hg), row, used))
            yield pd.DataFrame(rows, columns=["form", "hg", "row", "used"])

    tried, known, have = 0, None, 0
    for _ in range(rounds):
        more = max(n - have, n // 4, 1)
        made = session.range(tried, tried + more).mapInPandas(run, "form string, hg string, row long, used array<int>")
        both = made if known is None else known.unionByName(made)
        known = cut(both.groupBy("form").agg(F.min(F.struct("row", "hg", "used")).alias("x")).select("form", "x.hg", "x.row", "x.used"))
        tried, have = tried + more, known.count()
        if have >= n:
            break
    return known.orderBy("row").limit(n)
