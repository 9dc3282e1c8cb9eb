import hashlib
import itertools
import random
import re
import zlib

from weftgraph.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256().hexdigest()
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """Rows (conv, turn, role, text) after their faults, by conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out[conv] += [(turn, role, text)] * (2 if case == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def kinds(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not stripped else "duplicate" if (role, text) in seen else "" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, text) by trying every edit of every row with up to two inserted rows at each place."""
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for f in faults]
    places = [["", "u", "a", "ua", "au"]] * (len(rows) + 1)
    for edits in itertools.product(*choices):
        for ins in itertools.product(*places):
            audit, roles, lines, cost = "", "", [], 0
            for k in range(len(rows) + 1):
                for i in ins[k]:
                    audit, roles, cost = audit + "I", roles + i, cost + 3
                    lines.append({"u": "user", "a": "assistant"}[i] + ":")
                if k == len(rows):
                    break
                _, role, text = rows[k]
                audit += edits[k][0]
                if edits[k] == "D":
                    cost += 4
                    continue
                cost += (3 if faults[k] == "truncated" else 0) + (0 if edits[k] == "K" else 3)
                role = role if edits[k] == "K" else {"u": "user", "a": "assistant"}[edits[k][1]]
                roles += role[:1] or "?"
                lines.append(f"{role}:{text}")
            if GRAMMAR.fullmatch(roles):
                got = (cost, audit, "\n".join(lines))
                best = min(best or got, got)
    return best


def expected(rows):
    faults = kinds(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, text = cheapest(rows, faults)
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def results(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def some_rows(rng, n, longest=3):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    texts = ["Yes.", "No!", "and then", "", None, " \n", "Is it? ", "Well. \x0b", "ends here…", "Yes."]
    rows = []
    for c in range(n):
        turns = sorted(rng.choice([None, *range(6)]) or -1 for _ in range(rng.randrange(1, longest + 1)))
        rows += [(c, None if t == -1 else t, rng.choice(roles), rng.choice(texts)) for t in turns]
    return rows


def test_equals_trying_every_edit(spark):
    rows = some_rows(random.Random(2), 120)
    rows += [(None, 1, "user", "Hm."), (None, None, None, None)]
    got = results(repair.repair(table(spark, rows)))
    want = {c: expected(v) if v else (0, 0, 0, 0, 0, 0, "", EMPTY) for c, v in damage(rows).items()}
    assert got == want
    assert len({w[6] for w in want.values()}) > 30


def test_one_long_conversation_is_solved_in_pieces(spark):
    """Whole and in pieces alike: a conversation that fills several tasks, and small ones around it."""
    rng = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system"]
    rows = [(5, t, roles[rng.randrange(5)], rng.choice(["One.", "Two", "Three! ", "", f"own {t}."])) for t in range(3000) for _ in range(1 + (t % 50 == 0))]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(40) if c != 5 for t in range(6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = results(repair.repair(table(spark, rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for conv, kept in damage(rows).items():
        faults = kinds(kept)
        flat = [(t, r, x, 1, f == "duplicate") for (t, r, x), f in zip(kept, faults, strict=True)]
        assert got[conv] == repair.solve(conv, flat)[1:], conv
    assert len(got[5][6]) > 2500 and got[5][5] > 1000


def test_equal_rows_and_equal_turns(spark):
    rows = [(1, 3, "user", "Again and again.")] * 500 + [(1, 4, "assistant", "Yes.")] * 2 + [(2, None, None, None)] * 300
    got = results(repair.repair(table(spark, rows), damage=False))
    assert got[1] == (0, 0, 500, 0, 500, 2000, "K" + "D" * 499 + "KD", hashlib.sha256(b"user:Again and again.\nassistant:Yes.").hexdigest())
    assert got[2][:2] == (0, 300) and got[2][6] == "D" * 300 and got[2][7] == EMPTY


def test_empty_table_and_clashing_columns(spark):
    assert repair.repair(table(spark, [(1, 1, "user", "x")]).where("false")).count() == 0
    rows = some_rows(random.Random(3), 10)
    more = table(spark, rows)
    for c in ("n", "seen", "piece", "part", "case", "audit", "first", "id", "o", "c", "h"):
        more = more.selectExpr("*", f"'x' AS {c}")
    assert results(repair.repair(more)) == results(repair.repair(table(spark, rows)))


def test_arcs_are_made_as_rows_ask(spark):
    repair.arcs.cache_clear()
    repair.solve(1, [(1, "user", "Hm.", 1, False), (2, "assistant", "Yes.", 1, False)])
    assert repair.arcs.cache_info().currsize < 10
    assert dict((to, (c, x)) for c, to, x in repair.arcs(repair.START, "s", repair.FINE))[repair.SYSTEM] == (0, "K")
