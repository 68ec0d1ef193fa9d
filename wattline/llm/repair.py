"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A conversation becomes a word of row signatures: the role's initial and the fault, as far as edits care.
Words that end alike share their ends: one suffix-shared automaton (a DAWG built from the end) over the
distinct words of all conversations.  Read backwards in sorted order, a word keeps the nodes of the end
that it shares with the word before it, and only its other nodes are made.  A node gets, once for every
state of the grammar, the cost to go and the best audit of what follows, linked to the node after it.

Grammar of role initials: `(s?(ua)+)?`.  Edits: K keeps a row (0), R reroles it to user or assistant (2),
D deletes it (3; required for blank and duplicate rows), I inserts an empty user or assistant row (2); a
truncated row that stays adds 1.  Of the cheapest audits the least in ASCII wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import stored

# fixed values: blanks, ends of a sentence, legal neighbours, prices of the edits
BLANKS = " \t\n\x0b\x0c\r"
ENDS = [".", "!", "?"]
NEIGHBOURS = ["su", "ua", "au"]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: Grammar states: nothing yet, after s, after u, after a.  What R or I emit next, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}

#: A node: per grammar state the cost to go and the audit that follows as linked letters (letter, rest).
Node = list[tuple[int, tuple | None]]


def rows_of(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) of a table; null roles and texts become one space."""
    return df.select(
        F.col(key).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def faults(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (see `rows_of`): signature, gaps, and numbers of each fault.

    Rows go by turn, nulls first, ties by role and text.  One shuffle by conversation; a conversation is
    sorted with spill, and no more than a letter a row of it is gathered.
    """
    talk = Window.partitionBy("conv")
    line = talk.orderBy(*_order())
    ended = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    known = F.col("initial").isin("s", "u", "a")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(
        F.when(F.col("fault") == "truncated", F.upper(F.when(known, F.col("initial")).otherwise("o"))).otherwise(
            F.when(known, F.col("initial")).otherwise("o")
        )
    )
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("place")) > 1  # of equal rows the first place
    placed = (
        rows.withColumn("place", F.row_number().over(line))
        .withColumn("initial", initial)
        .withColumn("pair", F.concat(F.lag("initial").over(line), "initial"))
        .withColumn("step", F.col("turn").isNotNull() & ~F.lag("turn").over(line).eqNullSafe(F.col("turn")))
        .withColumn("seen", seen)
        .withColumn(
            "fault",
            F.when(ended == "", "blank").when(F.col("seen"), "duplicate").when(~F.substring(ended, -1, 1).isin(ENDS), "truncated"),
        )
        .select("conv", "turn", "place", "pair", "step", "fault", letter.alias("letter"))
    )
    count = lambda test: F.coalesce(F.sum(test.cast("bigint")), F.lit(0))
    return placed.groupBy("conv").agg(
        F.concat_ws("", F.array_sort(F.collect_list(F.struct("place", "letter")))["letter"]).alias("signature"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("step")), F.lit(0)).cast("bigint").alias("gaps"),
        *[count(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")],
        count(~F.col("pair").isin(NEIGHBOURS)).alias("illegal"),
    )


def _with_inserts(made: list[tuple[int, str, tuple | None]]) -> Node:
    """The best of each state, when it may also insert first.  No cheapest audit inserts two rows and is back
    in its state, so one look at the state after an insert is enough, taken in the order of dependence."""
    best: list = list(made)
    for state in (USER, ASSISTANT):
        cost, letter, rest = made[_NEXT[state]]
        best[state] = min(made[state], (cost + INSERT, "I", (letter, rest) if letter else None), key=lambda x: x[:2])
    for state in (START, SYSTEM):
        cost, letter, rest = best[_NEXT[state]]
        best[state] = min(made[state], (cost + INSERT, "I", (letter, rest) if letter else None), key=lambda x: x[:2])
    return [(cost, (letter, rest) if letter else None) for cost, letter, rest in best]


def end_node() -> Node:
    """After the last row: done where the grammar allows it, or inserts up to there."""
    never = 1 << 40
    return _with_inserts([(0, "", None), (never, "~", None), (never, "~", None), (0, "", None)])


def node(letter: str, after: Node) -> Node:
    """The node of a row's signature before what follows it."""
    made = []
    for state in range(4):
        cost, rest = after[state]
        options = [(cost + DELETE, "D", rest)]
        if letter != "x":
            extra = TRUNCATED if letter.isupper() else 0
            kept = _KEEPS.get((letter.lower(), state))
            if kept is not None:
                options.append((after[kept][0] + KEEP + extra, "K", after[kept][1]))
            cost, rest = after[_NEXT[state]]
            options.append((cost + REROLE + extra, "R", rest))
        made.append(min(options, key=lambda x: x[:2]))
    return _with_inserts(made)


def _letters(audit: tuple | None) -> str:
    out = []
    while audit is not None:
        out.append(audit[0])
        audit = audit[1]
    return "".join(out)


class Automaton:
    """The nodes of the end that the last word was made of; `made` counts nodes made."""

    def __init__(self):
        self.word, self.nodes, self.made = "", [end_node()], 0

    def best(self, word: str) -> tuple[int, str]:
        """Cost and audit of a word; words that come sorted from their ends share nodes."""
        shared = 0
        for mine, other in zip(reversed(word), reversed(self.word)):
            if mine != other:
                break
            shared += 1
        del self.nodes[shared + 1 :]
        for place in range(len(word) - shared - 1, -1, -1):
            self.nodes.append(node(word[place], self.nodes[-1]))
            self.made += 1
        self.word = word
        cost, audit = self.nodes[-1][START]
        return cost, _letters(audit)


def audits(words: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures of `words`.

    Signatures are sorted from their ends over range partitions, so words that share an end meet in one
    task; it holds the nodes of one word only.  Two neighbouring tasks may both make the end they share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            found = [automaton.best(word) for word in batch.column("signature").to_pylist()]
            costs = pa.array([cost for cost, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("signature"), costs, pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"]
            )

    distinct = words.select("signature").distinct().withColumn("end", F.reverse("signature"))
    placed = distinct.repartitionByRange("end").sortWithinPartitions("end").select("signature")
    return placed.mapInArrow(run, "signature string, cost bigint, audit string")


def find_repairs(rows: DataFrame) -> DataFrame:
    """`faults` of `rows` with the cost and the audit of the cheapest repair.

    Every conversation in `rows` gives one row, the null one too; an empty table gives none.
    """
    found = stored(faults(rows), "talk-faults")
    plans = stored(audits(found), "talk-audits")
    return found.join(plans, "signature")


def _edited(batch: pa.RecordBatch, state: dict) -> Iterator[tuple]:
    """(conversation, edit, role, text, turn) of the rows that a batch leaves, edits taken from the audits.

    A conversation starts with its audit; `state` goes on in the next batch.  (conversation, None) says
    that one is over.
    """
    columns = [batch.column(c).to_pylist() for c in ("conv", "audit", "turn", "role", "text")]
    for conv, audit, turn, role, text in zip(*columns):
        if audit is not None:
            yield from _finish(state)
            state.update(conv=conv, audit=audit, place=0, last="", open=True)
            continue
        yield from _inserted(state)
        edit = state["audit"][state["place"]]
        state["place"] += 1
        if edit != "D":
            role = role if edit == "K" else _expected(state)
            state["last"] = role[:1]
            yield conv, edit, role, text, turn


def _expected(state: dict) -> str:
    return "assistant" if state["last"] == "u" else "user"


def _inserted(state: dict) -> Iterator[tuple]:
    while state["audit"][state["place"] : state["place"] + 1] == "I":
        role = _expected(state)
        state["last"] = role[0]
        state["place"] += 1
        yield state["conv"], "I", role, "", None


def _finish(state: dict) -> Iterator[tuple]:
    if state.get("open"):
        yield from _inserted(state)
        state["open"] = False
        yield state["conv"], None, None, None, None


def _lined_up(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Rows of each conversation in order behind its audit, each conversation in one task, sorted with spill."""
    audit = repairs.select(
        "conv", F.lit(0).alias("kind"), "audit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
    )
    line = rows.select("conv", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    return audit.unionByName(line).repartition("conv").sortWithinPartitions("conv", "kind", *_order()).drop("kind")


def apply_repairs(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, place from 0, edit K, R or I, role, text, turn; inserted rows have no turn).

    `repairs` are those `find_repairs` found for the same rows.  A task streams over its conversations; of one
    it remembers the audit and its place.
    """
    lined = _lined_up(rows, repairs)
    conv, turn = (lined.schema[c].dataType.simpleString() for c in ("conv", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, place, types = {}, 0, None
        for batch in batches:
            types = [batch.schema.field(c).type for c in ("conv", "turn")]
            out = []
            for who, edit, role, text, when in _edited(batch, state):
                if edit is None:
                    place = 0
                    continue
                out.append((who, place, edit, role, text, when))
                place += 1
            yield _batch(out, types)
        if state:
            rest = [(w, place + k, e, r, t, n) for k, (w, e, r, t, n) in enumerate(x for x in _finish(state) if x[1])]
            yield _batch(rest, types)

    return lined.mapInArrow(run, f"conv {conv}, place bigint, edit string, role string, text string, turn {turn}")


def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    kinds = [types[0], pa.int64(), pa.string(), pa.string(), pa.string(), types[1]]
    columns = zip(*rows) if rows else [[]] * 6
    names = ["conv", "place", "edit", "role", "text", "turn"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def repaired_digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the hash of the repaired `role:text`, joined by newlines, fed row by row."""
    lined = _lined_up(rows, repairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, digest, first, kind = {}, hashlib.sha256(), True, None

        def take(steps: Iterator[tuple]) -> Iterator[tuple]:
            nonlocal digest, first
            for who, edit, role, text, _ in steps:
                if edit is None:
                    yield who, digest.hexdigest()
                    digest, first = hashlib.sha256(), True
                else:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False

        for batch in batches:
            kind = batch.schema.field("conv").type
            yield _pairs(list(take(_edited(batch, state))), kind)
        if state:
            yield _pairs(list(take(_finish(state))), kind)

    return lined.mapInArrow(run, f"conv {lined.schema['conv'].dataType.simpleString()}, repaired_sha256 string")


def _pairs(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    convs, digests = zip(*found) if found else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(list(convs), kind), pa.array(list(digests), pa.string())], names=["conv", "repaired_sha256"])
