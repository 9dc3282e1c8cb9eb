"""Learning a grammar from a collection: frequent motifs are contracted again and again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut
from weftgraph.operators.primitives import with_labels
from weftgraph.operators.shapes import Shapes, named, shaped
from weftgraph.operators.traversal import canonical_forms
from weftgraph.sources.views import Graphs

#: A shape's row while a grammar is learnt.
STATE = ("ids", "names", "src", "dst", "kinds", "step", "a", "b")


def candidates(g: Graphs, nonterminal: str) -> DataFrame:
    """graph_id, src, dst, src_label, dst_label: edges that may be contracted. A graph that holds a nonterminal grows it, so that there is one at most."""
    e = with_labels(g).select("graph_id", "src", "dst", "src_label", "dst_label")
    holds = g.nodes.where(F.col("label") == nonterminal).select("graph_id", F.lit(True).alias("held")).distinct()
    e = e.join(holds, "graph_id", "left")
    nts = (F.col("src_label") == nonterminal).cast("int") + (F.col("dst_label") == nonterminal).cast("int")
    return e.where((F.col("held").isNull() & (nts == 0)) | (F.col("held") & (nts == 1))).drop("held")


def motifs(found: DataFrame) -> DataFrame:
    """src_label, dst_label, n_graphs of candidates."""
    return found.groupBy("src_label", "dst_label").agg(F.countDistinct("graph_id").alias("n_graphs"))



def reduced(labels: dict, edges: set, rules: dict[tuple[str, str], int], nonterminal: str) -> list[tuple[int, int, int]]:
    """Existing rules applied to one graph, in place, until none fits: (rule, src, dst) of each step.

    The earliest rule that fits goes first, on its least match; a match is contracted as by contract().
    """
    steps = []
    while True:
        held = nonterminal in labels.values()
        fit = [(rules[labels[a], labels[b]], a, b) for a, b in pairs(labels, edges, held, nonterminal) if (labels[a], labels[b]) in rules]
        if not fit:
            return steps
        step = min(fit)
        steps.append(step)
        new = min(step[1:])
        for n in step[1:]:
            del labels[n]
        labels[new] = nonterminal
        moved = {(new if a in step[1:] else a, new if b in step[1:] else b, x) for a, b, x in edges}
        edges.clear()
        edges.update(e for e in moved if e[0] != e[1])


def pairs(labels: dict, edges: set, held: bool, nonterminal: str) -> list[tuple]:
    """Edges of one graph that candidates() gives."""
    ok = lambda a, b: labels[a] is not None and labels[b] is not None and (labels[a] == nonterminal) + (labels[b] == nonterminal) == held
    return [(a, b) for a, b, _ in edges if ok(a, b)]


def compress(state: DataFrame, rules: dict[tuple[str, str], int], nonterminal: str) -> DataFrame:
    """state with every graph reduced by the rules; steps are added to those recorded, and what may be a rule next is listed."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for ids, names, src, dst, kinds, step, a, b in zip(*(pdf[c] for c in STATE), strict=True):
                labels, edges = dict(zip(map(int, ids), names, strict=True)), set(zip(map(int, src), map(int, dst), kinds, strict=True))
                done = reduced(labels, edges, rules, nonterminal)
                left = sorted(edges, key=str)
                motif = sorted({(labels[x], labels[y]) for x, y in pairs(labels, edges, nonterminal in labels.values(), nonterminal)})
                out.append((list(labels), list(labels.values()), *([e[k] for e in left] for k in range(3)), *([*old, *(d[k] for d in done)] for k, old in enumerate((step, a, b))), [m[0] for m in motif], [m[1] for m in motif]))
            frame = pd.DataFrame(out, columns=[*STATE, "src_labels", "dst_labels"])
            for k, c in enumerate(("graph_id", "often")):
                frame.insert(k, c, pdf[c].array)
            yield frame

    kind = lambda c: state.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"{c} {kind(c)}" for c in ("graph_id", "often", *STATE)), "src_labels array<string>", "dst_labels array<string>"])
    return state.select("graph_id", "often", *STATE).mapInPandas(run, schema)


def _packed(s: Shapes) -> DataFrame:
    """A row for each shape, with how many graphs have it: its nodes, edges and the steps taken so far, as arrays."""
    n = int(s.firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return s.firsts.repartition(n, "graph_id").select("graph_id", "often", F.col("cells.place").alias("ids"), F.col("cells.label").alias("names"), F.col("links.src").alias("src"), F.col("links.dst").alias("dst"), F.col("links.label").alias("kinds"), *[F.array().cast("array<int>").alias(c) for c in ("step", "a", "b")])


def _learnt(s: Shapes, nonterminal: str, rounds: int | None = None, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """The rules of learn(), and the state of each shape in the end."""
    rules: dict[tuple[str, str], int] = {}
    table = []
    state = cut(compress(_packed(s), rules, nonterminal))
    while True:
        found = state.select("often", F.explode(F.arrays_zip("src_labels", "dst_labels")).alias("m"))  # a motif once a graph
        best = found.groupBy(F.col("m.src_labels").alias("src_label"), F.col("m.dst_labels").alias("dst_label")).agg(F.sum("often").alias("n_graphs")).orderBy(F.desc("n_graphs"), "src_label", "dst_label").first()
        if not best or best["n_graphs"] < least:
            break
        if rounds is not None and len(rules) >= rounds:
            raise RuntimeError(f"motifs are left after {rounds} rounds")
        table.append((len(rules), best["src_label"], best["dst_label"], best["n_graphs"]))
        rules[best["src_label"], best["dst_label"]] = len(rules)
        state = cut(compress(state, rules, nonterminal))
    return s.firsts.sparkSession.createDataFrame(table, "rule_id int, src_label string, dst_label string, n_graphs long"), state


def _left(state: DataFrame) -> Graphs:
    """What is left of each shape."""
    nodes = state.select("graph_id", F.explode(F.arrays_zip("ids", "names")).alias("n")).select("graph_id", F.col("n.ids").alias("node_id"), F.col("n.names").alias("label"))
    edges = state.select("graph_id", F.explode(F.arrays_zip("src", "dst", "kinds")).alias("e")).select("graph_id", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), F.col("e.kinds").alias("label"))
    return Graphs(nodes, edges)


def learn(g: Graphs, nonterminal: str = "gray", rounds: int | None = None, least: int = 1) -> tuple[DataFrame, DataFrame, Graphs]:
    """rules(rule_id, src_label, dst_label, n_graphs), anno(graph_id, seq, rule_id, nodes), and what is left of g.

    Each round makes a rule of the motif that most graphs hold, and applies all
    rules to every graph until none fits, so that no motif comes twice; the loop
    ends when no motif is in at least so many graphs. That takes at most a round for
    each pair of labels; rounds bounds them further, and raises if motifs are left then.
    Graphs are small and travel as rows, those of one shape as one. The state is cut to shared storage each
    round, so plans stay short and a lost executor costs a round at most.
    """
    s = shaped(g)
    made, state = _learnt(s, nonterminal, rounds, least)
    anno = state.select("graph_id", F.posexplode(F.arrays_zip("step", "a", "b")).alias("seq", "s")).select("graph_id", "seq", "s.step", "s.a", "s.b")
    left = _left(state)
    return made, s.spread(anno).select("graph_id", "seq", F.col("step").alias("rule_id"), F.array(named("a"), named("b")).alias("nodes")), Graphs(
        s.spread(left.nodes).select("graph_id", named("node_id").alias("node_id"), "label"),
        s.spread(left.edges).select("graph_id", named("src").alias("src"), named("dst").alias("dst"), "label"),
    )


def terminate(forms: DataFrame) -> DataFrame:
    """form, n_graphs, first: a start rule for each kind of leftover graph, once however many graphs have it; forms(graph_id, form, often)."""
    one = forms.groupBy("form").agg(F.sum("often").alias("n_graphs"), F.min("graph_id").alias("first"))
    return one.select("form", "n_graphs", "first")


def grammar(g: Graphs, nonterminal: str = "gray") -> DataFrame:
    """rule_id, src_label, dst_label, form, n_graphs: the rules of learn(), then the start rules (form) of what is left, most frequent first."""
    rules, state = _learnt(shaped(g), nonterminal)
    n = rules.count()
    starts = terminate(canonical_forms(_left(state)).join(state.select("graph_id", "often"), "graph_id"))
    nth = F.row_number().over(W.orderBy(F.desc("n_graphs"), "form"))  # kinds of leftover graphs; few, as nothing more can be contracted
    return rules.select("rule_id", "src_label", "dst_label", F.lit(None).cast("string").alias("form"), "n_graphs").unionByName(
        starts.select((nth + n - 1).cast("int").alias("rule_id"), F.lit(None).cast("string").alias("src_label"), F.lit(None).cast("string").alias("dst_label"), "form", "n_graphs"))
