"""Repair of damaged conversations by weighted finite-state composition.

Three machines are composed lazily. The input acceptor reads a conversation's rows in
order. The edit transducer keeps, reroles or deletes each row and inserts rows between
them. The grammar acceptor takes the role initials `(s?(ua)+)?`. A state of the
composition is (rows read, grammar state); arcs out of a state are made when a row of
their kind is first met. Weights are pairs (cost, label string) under the lexicographic order,
and the shortest path is found in the topological order of the rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut

#: Costs of edits; a row that ends in the middle of a sentence costs TRUNCATED unless it is deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: The grammar acceptor: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
STATES = 4
#: Inserted rows between two rows, at most: a third returns to a grammar state that was there before, at a higher cost.
INSERTS = 2
LEGAL = ("su", "ua", "au")
FINE, BROKEN, GONE = "", "truncated", "must go"
SPACE = "\x20\x09-\x0d"
_ENDS = re.compile(rf"[.!?][{SPACE}]*\Z")
_WORD = re.compile(rf"[^{SPACE}]")


@lru_cache(None)
def inserted(state: int) -> tuple[tuple[int, int], ...]:
    """(number, grammar state) after each number of inserted rows; only users and assistants are inserted."""
    out, now = [(0, state)], state
    for n in range(1, INSERTS + 1):
        now = next(to for initial, to in GRAMMAR[now].items() if initial != "s")
        out.append((n, now))
    return tuple(out)


@lru_cache(None)
def arcs(state: int, initial: str, kind: str) -> tuple[tuple[int, int, str], ...]:
    """(cost, grammar state after it, labels) of what can be done with one row, rows inserted before it included; the least for each end."""
    best: dict[int, tuple[int, str]] = {}
    more = TRUNCATED if kind == BROKEN else 0
    for n, now in inserted(state):
        step = [(DELETE, now, "D")]
        if kind != GONE:
            step += [(KEEP + more, to, "K") for i, to in GRAMMAR[now].items() if i == initial]
            step += [(REROLE + more, to, "R") for i, to in GRAMMAR[now].items() if i != "s"]
        for cost, to, label in step:
            weight = (cost + n * INSERT, "I" * n + label)
            best[to] = min(best.get(to, weight), weight)
    return tuple((cost, to, labels) for to, (cost, labels) in best.items())


@lru_cache(None)
def ending(state: int) -> tuple[int, str] | None:
    """The least weight of inserted rows that end in a final state."""
    return min(((n * INSERT, "I" * n) for n, now in inserted(state) if now in FINAL), default=None)


class Paths:
    """Least weights from one grammar state to all others over a run of rows, extended row by row.

    Label strings aren't kept: the strings that end at the same row all end in the label of
    that row and have as many such labels, so none is the beginning of another, and the order of two
    extensions is that of what they extend or else that of their last labels. Each state has the rank of its string.
    """

    def __init__(self, start: int, trace: bool = True) -> None:
        self.now, self.trace = {start: (0, 0)}, trace
        self.back: list[dict[int, tuple[int, str]]] = []

    def read(self, initial: str, kind: str) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, rank) in self.now.items():
            for more, to, labels in arcs(state, initial, kind):
                weight = (cost + more, rank, labels, state)
                if to not in best or weight < best[to]:
                    best[to] = weight
        order = {x: k for k, x in enumerate(sorted({w[1:3] for w in best.values()}))}
        self.now = {to: (w[0], order[w[1:3]]) for to, w in best.items()}
        if self.trace:
            self.back.append({to: (w[3], w[2]) for to, w in best.items()})

    def audit(self, end: int) -> str:
        out = []
        for step in reversed(self.back):
            end, labels = step[end]
            out.append(labels)
        return "".join(reversed(out))


def shortest(weights: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """(cost, state) of the least path to a final state."""
    return min((cost + e[0], rank, e[1], state) for state, (cost, rank) in weights.items() if (e := ending(state)) is not None)[::3]


def fault(text: str, seen: bool) -> str:
    """The first fault of a row; seen: whether its role and text occurred before."""
    if not _WORD.search(text):
        return "blank"
    return "duplicate" if seen else "" if _ENDS.search(text) else "truncated"


def repaired(rows: Iterator[tuple[str, str]], audit: str, state: int = START) -> Iterator[str]:
    """`role:text` of the repaired rows that audit makes of rows, from a grammar state on."""
    for label in audit:
        role, text = ("", "") if label == "I" else next(rows)
        if label == "D":
            continue
        if label != "K":
            role = ROLES["a" if state == USER else "u"]
        state = GRAMMAR[state][role[:1]]
        yield f"{role}:{text}"


def after(audit: str, initials: list[str], state: int) -> int:
    """The grammar state after audit."""
    at = iter(initials)
    for label in audit:
        initial = "" if label == "I" else next(at)
        if label != "D":
            state = GRAMMAR[state][initial if label == "K" else "a" if state == USER else "u"]
    return state


@dataclass
class Piece:
    """What is counted over a run of rows of one conversation, and how it begins and ends."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    least: int | None = None
    most: int | None = None
    first: str | None = None
    last: str | None = None
    rows: list[tuple[str, str]] = field(default_factory=list)

    def read(self, turn: int | None, role: str, what: str) -> None:
        if what:
            setattr(self, what, getattr(self, what) + 1)
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least

    def joined(self, other: Piece) -> Piece:
        """Of this run and the one behind it."""
        one = lambda a, b: a if b is None else b
        meet = self.last is not None and other.first is not None and self.last + other.first not in LEGAL
        again = self.most is not None and self.most == other.least
        counts = (getattr(self, c) + getattr(other, c) for c in ("blank", "duplicate", "truncated"))
        return Piece(*counts, self.illegal + other.illegal + meet, self.turns + other.turns - again, one(other.least, self.least), one(self.most, other.most), one(other.first, self.first), one(self.last, other.last))

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


_NUMBERS = ("conv_id", "turn", "n", "piece")
KINDS = {"": FINE, "truncated": BROKEN, "blank": GONE, "duplicate": GONE}
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text after the faults that crc32 of `conv_id:turn` gives; nulls are a space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat_ws(":", blank(id_col), blank(turn_col)).cast("binary")) % 20
    role = F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), case.alias("case")).where("case <> 0")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("case") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one")).drop("one")


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n, seen: equal rows as one with their number n; seen: whether role and text occur in an earlier turn.

    Equal rows are counted before any shuffle of them. The first turn of each role and text is
    an aggregate of hashes, joined back, where one side has a row for each key; so neither a
    repeated row nor a repeated text makes a hot task that can't be split.
    """
    equal = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    key = [F.coalesce(F.col("conv_id"), F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none"), F.sha2(F.concat(F.col("role"), F.lit("\x00"), F.col("text")), 256).alias("h")]
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = rows.select(*key, order.alias("o")).groupBy("c", "none", "h").agg(F.min("o").alias("first"))
    both = equal.select("*", *key, order.alias("o")).join(firsts, ["c", "none", "h"])
    return both.select("conv_id", "turn", "role", "text", "n", (F.col("o") > F.col("first")).alias("seen"))


def _runs(it: Iterator[pd.DataFrame], keys: tuple[str, ...] = ("conv_id",)) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conversation, rows of a run of equal keys) of a sorted stream; the rows are read before the next run."""

    def rows() -> Iterator[tuple]:
        for pdf in it:
            columns = [pdf[c].astype("Int64").astype(object).where(pdf[c].notna(), None).tolist() if c in _NUMBERS else pdf[c].tolist() for c in pdf.columns]
            which = [pdf.columns.get_loc(k) for k in keys]
            for r in zip(*columns, strict=True):
                yield tuple(r[k] for k in which), r

    for key, run in groupby(rows(), key=lambda x: x[0]):
        yield key[0], (r for _, r in run)


def _by_piece(fn):
    """fn over a stream of which each piece is a run."""
    return lambda it: fn(it, ("conv_id", "piece"))


def _answer(conv: int | None, piece: Piece, cost: int, audit: str, digest: str) -> tuple:
    return conv, piece.gaps, piece.blank, piece.duplicate, piece.truncated, piece.illegal, cost, audit, digest


def solve(conv: int | None, rows: list[tuple]) -> tuple:
    """The result of one conversation from its rows (turn, role, text, n, seen) in order."""
    piece, paths, plain = Piece(), Paths(START), []
    for turn, role, text, n, seen in rows:
        for k in range(n):
            what = fault(text, seen or k > 0)
            piece.read(turn, role, what)
            paths.read(role[:1], KINDS[what])
            plain.append((role, text))
    cost, end = shortest(paths.now)
    audit = paths.audit(end) + ending(end)[1]
    return _answer(conv, piece, cost, audit, hashlib.sha256("\n".join(repaired(iter(plain), audit)).encode()).hexdigest())


def _whole(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of the conversations inside a task; rows of its first and last one, with a number for each of the two runs."""
    part, held, number, out = None, None, 0, []

    def passed(rows: list[tuple], side: int) -> pd.DataFrame:
        return _frame([(*[None] * 9, *r[:6], 2 * part + side) for r in rows])

    for conv, run in _runs(it):
        rows = list(run)
        part = rows[0][6]
        if number == 1:
            yield passed(held, 0)
        elif number > 1:
            out.append((*solve(held[0][0], [r[1:6] for r in held]), *[None] * 7))
        if len(out) >= 1000:
            yield _frame(out)
            out = []
        held, number = rows, number + 1
    if out:
        yield _frame(out)
    if held is not None:
        yield passed(held, min(1, number - 1))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[x.split()[0] for x in f"{RESULT}, {_ROW}".split(", ")], dtype=object)
    numbers = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "row_conv", "turn", "n", "piece"]
    return df.astype({c: "Int64" for c in numbers} | {"seen": "boolean"})


_ROW = "row_conv long, turn long, role string, text string, n long, seen boolean, piece long"
_PIECE = "piece long, conv_id long, counts array<long>, least long, most long, first string, last string, matrix array<struct<start:int,end:int,cost:long,rank:int>>"


def _matrices(it: Iterator[pd.DataFrame], keys: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Counts of each run, and its least weights from each grammar state to each other."""
    for conv, run in _runs(it, keys):
        piece, paths = Piece(), [Paths(q, trace=False) for q in range(STATES)]
        for _, turn, role, text, n, seen, number in run:
            for k in range(n):
                what = fault(text, seen or k > 0)
                piece.read(turn, role, what)
                for p in paths:
                    p.read(role[:1], KINDS[what])
        matrix = [{"start": q, "end": e, "cost": c, "rank": r} for q, p in enumerate(paths) for e, (c, r) in p.now.items()]
        counts = [piece.blank, piece.duplicate, piece.truncated, piece.illegal, piece.turns]
        row = pd.DataFrame([(number, conv, counts, piece.least, piece.most, piece.first, piece.last, matrix)], columns=[x.split()[0] for x in _PIECE.split(", ")][:8])
        yield row.astype({"piece": "Int64", "conv_id": "Int64", "least": "Int64", "most": "Int64"})


_CHOICE = "piece long, start int, end int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _chosen(pdf: pd.DataFrame) -> pd.DataFrame:
    """The grammar states between which the shortest path of a conversation crosses each of its pieces; counts stand at the last piece."""
    pdf = pdf.sort_values("piece")
    now, back, every = {START: (0, 0)}, [], Piece()
    for r in pdf.itertuples():
        least, most = (None if pd.isna(x) else int(x) for x in (r.least, r.most))
        counts = [int(x) for x in r.counts]
        every = every.joined(Piece(*counts[:4], counts[4], least, most, r.first, r.last)) if back else Piece(*counts[:4], counts[4], least, most, r.first, r.last)
        best: dict[int, tuple] = {}
        for m in r.matrix:
            if m["start"] in now:
                cost, rank = now[m["start"]]
                weight = (cost + m["cost"], rank, m["rank"], m["start"])
                best[m["end"]] = min(best.get(m["end"], weight), weight)
        order = {x: k for k, x in enumerate(sorted({w[1:3] for w in best.values()}))}
        now = {e: (w[0], order[w[1:3]]) for e, w in best.items()}
        back.append({e: w[3] for e, w in best.items()})
    cost, end = shortest(now)
    rows, tail = [], ending(end)[1]
    for number, step in zip(reversed(pdf.piece.tolist()), reversed(back), strict=True):
        start = step[end]
        rows.append((number, start, end, tail, *((every.gaps, every.blank, every.duplicate, every.truncated, every.illegal, cost) if not rows else [None] * 6)))
        end, tail = start, ""
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _CHOICE.split(", ")]).astype(dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], "Int64"))


_LINES = "conv_id long, piece long, at long, labels string, lines string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _spelled(it: Iterator[pd.DataFrame], keys: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """For each row of a piece the labels up to it and the repaired lines that they make (null: none)."""
    for conv, run in _runs(it, keys):
        paths, rows = None, []
        for row in run:
            _, turn, role, text, n, seen, number, start, end, tail = row[:10]
            counts = row[10:]
            paths = paths or Paths(start)
            for k in range(n):
                paths.read(role[:1], KINDS[fault(text, seen or k > 0)])
                rows.append((role, text))
        labels, state, out = re.findall("I*[DKR]", paths.audit(end)), start, []
        for at, (mine, row) in enumerate(zip(labels, rows, strict=True)):
            mine += tail if at == len(rows) - 1 else ""
            lines = list(repaired(iter([row]), mine, state))
            state = after(mine, [row[0][:1]], state)
            out.append((conv, number, at, mine, "\n".join(lines) if lines else None, *(counts if at == len(rows) - 1 else [None] * 6)))
            if len(out) >= 1000 or at == len(rows) - 1:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in _LINES.split(", ")]).astype(dict.fromkeys(["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"], "Int64"))
                out = []


def _digested(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The result of each conversation from a stream of its lines."""
    for conv, run in _runs(it):
        audit, known, some, counts = [], hashlib.sha256(), False, None
        for _, _, _, labels, lines, *more in run:
            audit.append(labels)
            if lines is not None:
                known.update((("\n" if some else "") + lines).encode())
                some = True
            counts = counts if pd.isna(more[0]) else more
        yield pd.DataFrame([(conv, *map(int, counts), "".join(audit), known.hexdigest())], columns=[x.split()[0] for x in RESULT.split(", ")]).astype({"conv_id": "Int64"})


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows are dealt by ranges of (conversation, turn, role, text), so a conversation
    of any length is spread over tasks. One that lies within a task is solved there. Rows
    of the first and last conversation of each task may go on in the next: they are written to
    the shared folder, each run of them gives its matrix of least weights from every
    grammar state to every other, and the matrices of a conversation are multiplied in order. Its
    digest is then taken over its rows as they stream by, in order; a digest can't be
    split, so that pass alone is one task for each conversation.

    Null roles and texts are a space, null turns come first, and rows of one turn are
    ordered by role and text. A null conv_id is a conversation of its own. Roles that are none of
    the grammar's must be changed or deleted. Repeated rows are duplicates. With damage False
    the rows are repaired as they are. Further columns are ignored; a conversation of which nothing is left has zeros, an
    empty audit and the digest of nothing; an empty table gives no rows.
    """
    plain = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    keys = ["conv_id", "turn", "role", "text"]
    rows = ordered(damaged(conversations, id_col, turn_col, role_col, text_col) if damage else plain)
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"))
    parts = cut(dealt.mapInPandas(_whole, f"{RESULT}, {_ROW}"))
    results = [x.split()[0] for x in RESULT.split(", ")]
    inside = parts.where("piece IS NULL").select(*results)
    over = parts.where("piece IS NOT NULL").select(F.col("row_conv").alias("conv_id"), "turn", "role", "text", "n", "seen", "piece")

    def by(df: DataFrame, keys: list[str], order: list[str], fn, schema: str) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*order).mapInPandas(fn, schema)

    # a piece's number tells its conversation, and no conversation has two runs in a task
    order = ["conv_id", "piece", "turn", "role", "text"]
    pieces = cut(by(over, ["conv_id", "piece"], order, _by_piece(_matrices), _PIECE))
    choices = pieces.withColumn("none", F.col("conv_id").isNull()).groupBy("none", "conv_id").applyInPandas(lambda pdf: _chosen(pdf), _CHOICE)
    # two rows for each task at most
    spelled = over.join(F.broadcast(cut(choices)), "piece").select("conv_id", "turn", "role", "text", "n", "seen", "piece", "start", "end", "tail", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    lines = by(spelled, ["conv_id", "piece"], order, _by_piece(_spelled), _LINES)
    across = by(lines, ["conv_id"], ["conv_id", "piece", "at"], _digested, RESULT)

    ids = conversations.select(F.col(id_col).cast("long").alias("id")).distinct()
    out = ids.join(inside.unionByName(across), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(F.col("id").alias("conv_id"), *map(zero, results[1:7]), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
