"""python -m weftgraph query NAME DIR | learn DIR OUT [ROUNDS] | generate N [SEED] | member GRAMMAR HYPERGRAPH"""

from __future__ import annotations

import json
import sys
from pathlib import Path


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    task, rest = args[0], args[1:]
    if task == "member":
        from weftgraph.operators.hypergraphs import derives

        print(derives(*(json.loads(Path(p).read_text()) for p in rest)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    from weftgraph.plans import fixtures, learning
    from weftgraph.plans.queries import QUERIES
    from weftgraph.sources import files, views

    if task == "query":
        QUERIES[rest[0]](spark, rest[1]).show(50, truncate=False)
    elif task == "learn":
        rules, anno, left = learning.learn(views.order_graphs(spark, rest[0]), rounds=int(rest[2]) if len(rest) > 2 else None)
        files.write_snapshot({"rules": rules, "anno": anno, "nodes": left.nodes, "edges": left.edges}, rest[1], rules.count())
    elif task == "generate":
        from weftgraph.operators.rewriting import generate

        generate(spark, fixtures.house_rules(), fixtures.NONTERMINALS, int(rest[0]), int(rest[1]) if len(rest) > 1 else 1).show(50)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
