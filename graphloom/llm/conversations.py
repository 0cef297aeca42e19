"""Repair of conversations through signatures: each distinct sequence of roles and faults is solved once.

1. Every row gets its first fault: blank, a repetition of an earlier row of its conversation, or cut off in the middle of a sentence.
2. A conversation's signature is one character a row, of role and fault. Conversations are many, distinct signatures are few.
3. Each distinct signature is solved by a memoised recursion over (row, state of the output): the cheapest edits whose roles read
   ``(s?(ua)+)?``. Of equally cheap ones the least in ASCII order is taken. The result, the audit, has the initials of the edits in order.
4. Audits are joined back, and replayed over the rows.

Only keys, flags and digests are shuffled to make the signatures; texts are shuffled once, for the replay, which streams over rows sorted by
conversation and holds one batch and one audit. A signature or audit has a byte a row and is put together in blocks of ``BLOCK`` rows. One
conversation is read by one task, as its digest must be, but never held.

Defined cases: a null role, text or part of the damage's key reads as one space; a null conversation is a conversation; rows go by turn, null
turns first, then by role and text (its first 64 characters, then its digest), so repeated rows and ties have an order; roles but for
their first letter mean nothing; an empty table gives no rows; columns beyond the four are left out of the result, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Workspace, joined_by_key

#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
BLOCK = 8_192
#: Rows that the recursion goes down at once.
DEPTH = 64
DELETE, INSERT, KEEP, REROLE = 3, 2, 0, 2
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with made faults, and ``dropped``; see the contract of the query."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", one("conv_id"), one("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    out = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), (k == 0).alias("dropped"), k.alias("__k"))
    return out.withColumn("__twice", F.explode(F.when(F.col("__k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__k", "__twice")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest")]


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with what orders them inside a turn."""
    return rows.withColumns({"head": F.substring("text", 1, 64), "digest": F.unhex(F.substring(F.sha2("text", 256), 1, 32))})


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of rows (conv_id, turn, role, text, dropped), one for every conversation.

    A character is the role's initial if it is one of s, u, a, else ``o``, in capitals if the text is cut off; ``x`` is blank or repeated.
    """
    from pyspark.sql import Window

    body = F.rtrim(F.col("text"), F.lit(SPACE))
    tail = F.right(body, F.lit(1))
    narrow = _keyed(rows).select("conv_id", "turn", "role", "dropped", "head", "digest", (body == "").alias("blank"), (~tail.isin(".", "!", "?")).alias("cut"))
    narrow = narrow.repartition("conv_id")
    # Rows of one order are equal, so it doesn't matter which of them comes first; dropped ones come last.
    own = Window.partitionBy("conv_id").orderBy("dropped", *_order())
    again = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy("pos")
    initial = F.substring("role", 1, 1)
    rows = narrow.withColumn("pos", F.row_number().over(own) - 1).withColumn("before", F.lag(initial).over(own))
    rows = rows.withColumn("repeat", F.row_number().over(again) > 1)
    fault = F.when(F.col("blank"), "b").when(F.col("repeat"), "d").when(F.col("cut"), "t").otherwise("")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    rows = rows.withColumn("fault", fault).withColumn("code", F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(known)).otherwise(known))
    live = ~F.col("dropped")
    told = lambda f: F.count_if(live & (F.col("fault") == f)).alias(f)
    odd = F.count_if(live & F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au"))
    # Turns come in order, so a turn is new where it differs from the row's before.
    new_turn = F.count_if(live & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")))
    rows = rows.withColumn("turn_before", F.lag("turn").over(own))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(live, F.struct("pos", "code")))), lambda x: x["code"]), "")
    blocks = rows.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(codes.alias("part"), told("b"), told("d"), told("t"), odd.alias("illegal"), F.min(F.when(live, F.col("turn"))).alias("lo"), F.max(F.when(live, F.col("turn"))).alias("hi"), new_turn.alias("turns"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "")
    gaps = F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum("turns"), F.lit(0)).cast("long")
    return blocks.groupBy("conv_id").agg(whole.alias("signature"), gaps.alias("gaps"), F.sum("b").alias("blank"), F.sum("d").alias("duplicate"), F.sum("t").alias("truncated"), F.sum("illegal").alias("illegal"))


# States of the output: nothing, a system row only, ended by user, ended by assistant. What may follow, by the role's initial.
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
_NEVER = 1 << 60


def solved(signature: str) -> tuple[int, str]:
    """(cost, audit) of a signature."""
    n = len(signature)
    memo: dict[tuple[int, int], tuple[int, str]] = {}

    def edits(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(initial, cost, next row, next state) in the order of the initials, inserts left out."""
        code = signature[i]
        out = [("D", DELETE, i + 1, state)]
        if code != "x":
            late = int(code.isupper())
            if (to := _AFTER[state].get(code.lower())) is not None:
                out.append(("K", KEEP + late, i + 1, to))
            out += [("R", REROLE + late, i + 1, to) for role, to in _AFTER[state].items() if role != "s"]
        return out

    def best(i: int, state: int, inserts: int = 0) -> tuple[int, str]:
        """The least cost from here on, and the initial of the first edit. A third insert in a row would only come back to an earlier state."""
        if not inserts and (i, state) in memo:
            return memo[i, state]
        found = (0, "") if i == n and state in _ENDS else (_NEVER, "")
        if inserts < 2:
            to = _AFTER[state].get("u") or _AFTER[state]["a"]
            found = min(found, (INSERT + best(i, to, inserts + 1)[0], "I"))
        if i < n:
            found = min(found, *((cost + best(j, to)[0], name) for name, cost, j, to in edits(i, state)))
        if not inserts:
            memo[i, state] = found
        return found

    for i in range(n - n % DEPTH, -1, -DEPTH):  # so that the recursion never goes deep
        for state in range(4):
            best(i, state)
    cost, out, i, state = best(0, 0)[0], [], 0, 0
    while (first := best(i, state)[1]) or i < n:
        out.append(first)
        if first == "I":
            state = _AFTER[state].get("u") or _AFTER[state]["a"]
        else:
            _, _, i, state = next(e for e in edits(i, state) if e[0] == first)
    return cost, "".join(out)


def audits(found: DataFrame) -> DataFrame:
    """(signature, n, cost, audit) of each distinct ``signature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [solved(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a[0] for a in answers], pa.int64()), pa.array([a[1] for a in answers], pa.string())], ["signature", "n", "cost", "audit"])

    return found.groupBy("signature").agg(F.count("*").alias("n")).mapInArrow(run, "signature string, n long, cost long, audit string")


class _Replay:
    """A conversation's rows, one by one, against its audit; hashes what stays."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.user, self.some, self.sha = audit, 0, True, False, hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * self.some}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some = True

    def turn(self) -> str:
        """The role that must come next."""
        role = "user" if self.user else "assistant"
        self.user = not self.user
        return role

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.put(self.turn(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            if role[:1] != "s":
                self.turn()
            self.put(role, text)
        elif edit == "R":
            self.put(self.turn(), text)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


RESULT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def repaired(rows: DataFrame, space: Workspace | None = None) -> DataFrame:
    """One row of audit and digest for each conversation of rows (conv_id, turn, role, text, dropped)."""
    spark = rows.sparkSession
    space = space or Workspace(spark, "conversations")
    found = space.table(signatures(rows), "signatures")
    answers = space.table(audits(found), "audits")
    total = found.count()
    heads = joined_by_key(found, answers, ["signature"], "n", total)
    # Each conversation's audit goes before its rows.
    live = _keyed(rows.where("not dropped")).select("conv_id", F.lit(1).alias("after"), "turn", "role", "head", "digest", "text", *[F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in _FIELDS])
    first = heads.select("conv_id", F.lit(0).alias("after"), *[F.lit(None).cast(live.schema[c].dataType).alias(c) for c in ("turn", "role", "head", "digest", "text")], *_FIELDS)
    stream = first.unionByName(live).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), "after", *_order()).select("conv_id", "after", "role", "text", *_FIELDS)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay: _Replay | None = None
        head: list = []

        def packed(out: list[list]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = [conv_kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *_FIELDS, "repaired_sha256"])

        conv_kind = pa.int64()
        for batch in batches:
            conv_kind = batch.schema.field("conv_id").type
            out = []
            for conv, after, role, text, *fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if after == 0:
                    if replay:
                        out.append([*head, replay.digest()])
                    head, replay = [conv, *fields], _Replay(fields[-1])
                else:
                    replay.row(role, text)
            if out:
                yield packed(out)
        if replay:
            yield packed([[*head, replay.digest()]])

    return stream.mapInArrow(run, RESULT.format(kind))
