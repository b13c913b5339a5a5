"""Conversation repair by weighted finite-state composition: an input acceptor, an edit transducer and a role grammar.

The input acceptor is a conversation's rows in order; a row's symbol is its role's initial, whether it has to go (blank, or
a repeat of an earlier row) and whether its text is cut off. The transducer keeps a row (0), gives it the role user or
assistant (1), deletes it (2) or inserts an empty row of either role (5); a cut-off row that stays costs 5 more. The grammar
accepts initials `(s?(ua)+)?`. Of the composed machine only states that are reached are built: the arcs that lead from a
grammar state over a symbol, with the inserts before it, are composed when first met. More than two inserts in a row come
back to a grammar state at a higher cost, so two are allowed and the machine has no cycle; its states are relaxed in the order
of rows. Weights are (cost, label string), compared lexicographically. Equal costs at one state never have labels of which one
begins the other (the longer would hold two more inserts), so the order of strings survives concatenation and the result is exact.

Each conversation flows by in order: rows are sorted within partitions by conversation and turn, what all surviving paths
agree on is hashed and dropped, so a task holds the undecided rows, not the conversation. Its hash is taken over all rows in
order, so one conversation is one task's work, whatever its length. Whether a row repeats an earlier one is found before, by an
aggregate and a join over digests of (conversation, role, text), which carry no text and spread a long conversation.

Null role and text count as one space; null conv_id and turn too where rows are damaged. A null conv_id is one conversation.
Null turns come first; rows of equal turn go by role and text, so repeated rows stand together and all but one are
duplicates. An empty role has the initial of a space. An empty table gives no rows; further columns aren't read."""

import functools
import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: The grammar's states: nothing yet, after s, after u, after a.
GRAMMAR = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FINAL = ("0", "a")
#: Rows after which what is decided is let go.
SETTLE = 64
_INK = re.compile(r"[^\x20\x09-\x0D]")


def edits(initial: str, gone: bool, cut: bool):
    """The transducer's arcs over a symbol: (label, output, cost)."""
    yield "D", "", DELETE
    if not gone:
        more = CUT if cut else 0
        yield "K", initial, more
        for to in ROLES:
            yield "R", to, REROLE + more


@functools.cache
def _inserted(state: str) -> tuple[tuple[str, int, str], ...]:
    """What inserts lead to from a grammar state: (labels, cost, state)."""
    out, here = [("", 0, state)], [("", 0, state)]
    for _ in range(2):
        here = [(labels + "I", cost + INSERT, GRAMMAR[at][to]) for labels, cost, at in here for to in ROLES if to in GRAMMAR[at]]
        out += here
    return tuple(out)


@functools.cache
def arcs(state: str, initial: str, gone: bool, cut: bool) -> tuple[tuple[str, int, str], ...]:
    """The composed machine's arcs from a grammar state over a symbol, inserts before it included: (labels, cost, state)."""
    out: dict[str, tuple[int, str]] = {}
    for before, cost, at in _inserted(state):
        for label, symbol, more in edits(initial, gone, cut):
            to = at if not symbol else GRAMMAR[at].get(symbol)
            if to is not None:
                way = (cost + more, before + label)
                out[to] = min(out.get(to, way), way)
    return tuple((labels, cost, to) for to, (cost, labels) in out.items())


class Repair:
    """One conversation's faults and cheapest repair; rows are fed in order."""

    def __init__(self):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.least, self.last_turn = 0, None, None
        self.paths, self.state, self.rows, self.audit = {"0": (0, "")}, "0", [], []
        self.last, self.hash, self.empty = None, hashlib.sha256(), True

    def feed(self, turn: int | None, role: str, text: str, repeat: bool) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last_turn
            self.last_turn = turn
        ink = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not _INK.search(text) else "duplicate" if repeat else "truncated" if ink[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        initial = role[:1] or " "
        if self.last is not None:
            self.counts["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if initial not in ("s", "u", "a"):
            initial = " "  # no grammar state takes it
        paths: dict[str, tuple[int, str]] = {}
        for state, (cost, labels) in self.paths.items():
            for more, extra, to in arcs(state, initial, fault in ("blank", "duplicate"), fault == "truncated"):
                way = (cost + extra, labels + more)
                if to not in paths or way < paths[to]:
                    paths[to] = way
        self.paths = paths
        self.rows.append((role, text))
        if len(self.rows) >= SETTLE and len(self.rows) % SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        """Lets go what all paths that can still win have in common."""
        if "a" in self.paths:  # after a, all that may follow a start or an s may follow too, but for an s that is kept, which costs a deletion
            for state, more in (("0", DELETE), ("s", 0)):
                if state in self.paths and self.paths["a"][0] + more < self.paths[state][0]:
                    del self.paths[state]
        common = os.path.commonprefix([labels for _, labels in self.paths.values()])
        self._write(common)
        self.paths = {state: (cost, labels[len(common) :]) for state, (cost, labels) in self.paths.items()}

    def _write(self, labels: str) -> None:
        taken = 0
        for label in labels:
            role, text = ("", "") if label == "I" else self.rows[taken]
            taken += label != "I"
            if label == "D":
                continue
            symbol = role[:1] if label == "K" else next(to for to in ROLES if to in GRAMMAR[self.state])
            self.state = GRAMMAR[self.state][symbol]
            self.hash.update(f"{'' if self.empty else chr(10)}{role if label == 'K' else ROLES[symbol]}:{text}".encode())
            self.empty = False
        self.audit.append(labels)
        del self.rows[:taken]

    def result(self) -> tuple:
        ways = [(cost + more, labels + extra) for state, (cost, labels) in self.paths.items() for extra, more, to in _inserted(state) if to in FINAL]
        cost, labels = min(ways)
        self._write(labels)
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.turns
        return (gaps, *self.counts.values(), cost, "".join(self.audit), self.hash.hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of `conv_id:turn` tells: a row may be dropped, emptied, stripped of stops, repeated, or become the user's."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(named.cast("binary")) % 20
    rows = rows.withColumn("_k", kind).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _key(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def _repeats(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, text: key) of rows whose role and text stand in an earlier turn already."""
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    keys = rows.select("conv_id", "turn", key.alias("key"))
    place = F.struct(F.col("turn").isNotNull(), "turn")  # nulls come first
    firsts = keys.groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    return keys.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where(place > F.col("first")).select("conv_id", "turn", "key").distinct()


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id and NAMES for each conversation of rows conv_id, turn, role, text; conversations need not keep a row after damage()."""
    whole = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = damage(whole)
    none = lambda kind: F.lit(None).cast(kind)
    marks = whole.select("conv_id").distinct().select("conv_id", none("long").alias("turn"), F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"))
    repeats = _repeats(rows).select("conv_id", "turn", F.lit(1).alias("kind"), F.lit("").alias("role"), F.col("key").alias("text"))
    dealt = marks.union(repeats).union(rows.select("conv_id", "turn", F.lit(2).alias("kind"), "role", "text"))
    return dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "kind", "role", "text").mapInArrow(_repaired, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _repaired(batches):
    here, now, before, again, out = None, None, None, set(), []

    def table():
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["conv_id", *NAMES])

    for batch in batches:
        for conv, turn, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:  # a conversation begins
                if now is not None:
                    out.append((here, *now.result()))
                here, now, before, again = conv, Repair(), None, set()
                continue
            if before is None or turn != before[0]:
                again, before = set(), (turn, None, None)
            if kind == 1:
                again.add(text)
                continue
            now.feed(turn, role, text, before[1:] == (role, text) or bool(again) and _key(role, text) in again)
            before = turn, role, text
        if out:
            yield table()
            out = []
    if now is not None:
        out.append((here, *now.result()))
        yield table()


def op13(conversations: DataFrame) -> DataFrame:
    return repair(conversations)
