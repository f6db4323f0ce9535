"""Least-cost repair of conversations whose rows do not alternate.

A repaired conversation is empty or an optional system row and then pairs of a user's and an assistant's row. Rows are kept (no
cost), given the role user or assistant (3), deleted (4; blank rows and repeated ones must be), and empty rows of either
role are put in anywhere (3). A truncated row that stays costs 3 more.

What the rest of a conversation costs depends on what has been read so far only by four states, so it is a
vector of four numbers; taken from its least, few vectors exist. For every vector and every block of ``BLOCK`` kinds of rows the
vector before the block is tabulated once. A conversation is then read from its end by one lookup a
block; its edits are found from its start, each block being expanded backward from the vector at its end, and of equally cheap edits
the one whose letter comes first is taken.

Rows are ordered by turn (nulls first), then role and text, all by value. Null roles and texts are one space; rows without a
``conv_id`` are one conversation. Repeated rows count as often as they occur, other columns are not read. Roles are known by
their first character; others than s, u and a can only be deleted or replaced. Tables without rows give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..session import settle
from .text import only

KEEP, REPLACE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = " \t\n\v\f\r"
#: Kinds of rows: 0 must go; 1 + 2 * role + truncated, roles in this order and then all others.
INITIALS = "sua"
KINDS = 1 + 2 * (len(INITIALS) + 1)
BLOCK = 4
START, SYSTEM, USER, PAIR = range(4)
#: The state after an inserted or replaced row, and the role that it gets.
NEXT = (USER, USER, PAIR, USER)
ROLE = ("user", "user", "assistant", "user")
#: The state after a kept row, by its role's place in ``INITIALS``.
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, PAIR: USER}, {USER: PAIR}, {})
#: What a conversation costs that has no more rows, by state.
END = (0, 2 * INSERT, INSERT, 0)

COUNTS = ["blank", "duplicate", "truncated", "illegal"]
FOUND = ["gaps", *COUNTS, "cost"]
PIECE = (
    "conv_id {id}, part int, kinds binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first string, last string, low bigint, high bigint, turns bigint"
)


def before(after: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """Costs by state before a row of this kind, from those after it."""
    late = TRUNCATED if kind and kind % 2 == 0 else 0
    taken = []
    for state in range(4):
        cost = [DELETE + after[state]]
        if kind:
            cost.append(REPLACE + late + after[NEXT[state]])
            if state in (kept := KEPT[(kind - 1) // 2]):
                cost.append(KEEP + late + after[kept[state]])
        taken.append(min(cost))
    once = [min(taken[s], INSERT + taken[NEXT[s]]) for s in range(4)]
    return tuple(min(once[s], INSERT + once[NEXT[s]]) for s in range(4))


class Tables:
    """Vectors less their least number, and what stands before each of them, by kind and by block of kinds."""

    def __init__(self) -> None:
        low = min(END)
        self.vectors = [tuple(c - low for c in END)]
        self.end_low = low
        number, rows, at = {self.vectors[0]: 0}, [], 0
        while at < len(self.vectors):
            row = []
            for kind in range(KINDS):
                raw = before(self.vectors[at], kind)
                plain = tuple(c - min(raw) for c in raw)
                if plain not in number:
                    number[plain] = len(self.vectors)
                    self.vectors.append(plain)
                row.append((number[plain], min(raw)))
            rows.append(row)
            at += 1
        self.step = np.array(rows)
        vector = np.arange(len(rows))[:, None] + np.zeros(KINDS**BLOCK, int)
        cost = np.zeros_like(vector)
        code = np.arange(KINDS**BLOCK)
        for k in range(BLOCK):  # the last row of a block is the lowest digit of its code
            kind = code // KINDS**k % KINDS
            found = self.step[vector, kind]
            vector, cost = found[..., 0], cost + found[..., 1]
        self.block, self.block_cost = vector, cost
        self.walks: dict[tuple[int, int, bytes], tuple[str, int]] = {}

    def walk(self, state: int, right: int, kinds: bytes) -> tuple[str, int]:
        """Letters of the edits of a block from ``state`` on, and the state after it; ``right`` is the vector after the block."""
        key = state, right, kinds
        if key not in self.walks:
            inner = [right]
            for kind in reversed(kinds):
                inner.append(int(self.step[inner[-1], kind, 0]))
            inner.reverse()
            letters = []
            for i, kind in enumerate(kinds):
                after = self.vectors[inner[i + 1]]
                here = before(after, kind)
                late = TRUNCATED if kind and kind % 2 == 0 else 0
                kept = KEPT[(kind - 1) // 2] if kind else {}
                while here[state] != DELETE + after[state] and here[state] == INSERT + here[NEXT[state]]:
                    letters.append("I")
                    state = NEXT[state]
                if here[state] == DELETE + after[state]:
                    letters.append("D")
                elif state in kept and here[state] == KEEP + late + after[kept[state]]:
                    letters.append("K")
                    state = kept[state]
                else:
                    letters.append("R")
                    state = NEXT[state]
            self.walks[key] = "".join(letters), state
        return self.walks[key]

    def audit(self, kinds: bytes) -> tuple[str, int]:
        """The letters of the cheapest edits, the least such text, and their cost."""
        full = len(kinds) // BLOCK * BLOCK
        vector, cost = 0, self.end_low
        for kind in reversed(kinds[full:]):
            vector, low = map(int, self.step[vector, kind])
            cost += low
        blocks = np.frombuffer(kinds[:full], np.uint8).reshape(-1, BLOCK).astype(int)
        codes = (blocks @ (KINDS ** np.arange(BLOCK)[::-1])).tolist()
        rights = []
        for code in reversed(codes):
            rights.append(vector)
            cost += int(self.block_cost[vector, code])
            vector = int(self.block[vector, code])
        cost += self.vectors[vector][START]
        letters, state = [], START
        for k, right in enumerate(reversed(rights)):
            some, state = self.walk(state, right, kinds[k * BLOCK : (k + 1) * BLOCK])
            letters.append(some)
        some, state = self.walk(state, 0, kinds[full:])
        return "".join([*letters, some]) + "I" * (END[state] // INSERT), cost


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by crc32 of ``conv_id:turn``, modulo 20.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes
    its role user. Nulls are one space, also in the hashed text; a null turn stays null.
    """
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    found = only(rows, "conv_id", "turn", "role", "text").withColumn("_kind", kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace(text_of("text"), "[.!?]", ""))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")
    return found.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, F.lit("user")).otherwise(text_of("role")).alias("role"),
        text.otherwise(text_of("text")).alias("text"),
        copies,
    ).drop("_copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation with ``copies``, ``again`` (seen at an earlier turn), ``blank`` and ``cut``."""
    space = F.lit(" ")
    rows = only(rows, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    keyed = rows.withColumn("_conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    keyed = keyed.withColumn("_said", F.sha2(said, 256)).withColumn("_at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    repeated = keyed.groupBy("_conv", "_said").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = attach(keyed, repeated, ["_conv", "_said"], "left")
    columns = ["conv_id", "turn", "role", "text"]
    once = joined.where("_first is null").select(*columns, F.lit(1).cast("bigint").alias("copies"), F.lit(False).alias("again"))
    often = joined.where("_first is not null").groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"), F.max(F.col("_at") > F.col("_first")).alias("again"))
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    cut = ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    return settle(once.unionByName(often).withColumn("blank", trimmed == "").withColumn("cut", cut))


ORDER = ["conv_id", "turn", "role", "text"]


def _pieces(marked: DataFrame, kind_of_id: str) -> DataFrame:
    """A row for each conversation and range of rows: its kinds in order, and what is counted of it."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None
        for batch in parts:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["conv_id"]:
                    now = {"conv_id": row["conv_id"], "part": row["part"], "kinds": bytearray(), "first": row["initial"], "last": None}
                    now |= dict.fromkeys(COUNTS, 0) | {"low": None, "high": None, "turns": 0}
                    out.append(now)
                n, initial = row["copies"], row["initial"]
                gone = row["blank"] or row["again"]
                now["blank"] += n if row["blank"] else 0
                now["duplicate"] += 0 if row["blank"] else n - 1 + row["again"]
                now["truncated"] += not gone and row["cut"]
                if now["last"] is not None:
                    now["illegal"] += now["last"] + initial not in ("su", "ua", "au")
                now["illegal"] += n - 1
                now["last"] = initial
                kind = 0 if gone else 1 + 2 * (INITIALS.index(initial) if initial and initial in INITIALS else len(INITIALS)) + row["cut"]
                now["kinds"] += bytes([kind]) + bytes(n - 1)
                if row["turn"] is not None:
                    now["turns"] += row["turn"] != now["high"]
                    now["low"] = row["turn"] if now["low"] is None else now["low"]
                    now["high"] = row["turn"]
            done, out = out[:-1], out[-1:]
            if done:
                yield pa.RecordBatch.from_pylist(_plain(done), schema)
        if out:
            yield pa.RecordBatch.from_pylist(_plain(out), schema)

    def _plain(rows: list[dict]) -> list[dict]:
        return [r | {"kinds": bytes(r["kinds"])} for r in rows]

    names = ["conv_id", "part", "turn", "initial", "copies", "again", "blank", "cut"]
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = marked.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("initial", F.left("role", F.lit(1)))
    id_type = pa.string() if kind_of_id == "string" else pa.int64()
    schema = pa.schema(
        [("conv_id", id_type), ("part", pa.int32()), ("kinds", pa.binary()), *[(c, pa.int64()) for c in COUNTS]]
        + [("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("low", "high", "turns")]]
    )
    return ranged.select(*names).mapInArrow(task, PIECE.format(id=kind_of_id))


def joined_pieces(pieces: list[dict]) -> dict:
    """Counts, cost and audit of a conversation, of its pieces in order."""
    whole = dict.fromkeys(COUNTS, 0)
    last, low, high, turns = None, None, None, 0
    for p in pieces:
        for c in COUNTS:
            whole[c] += p[c]
        if p["first"] is not None:
            if last is not None:
                whole["illegal"] += last + p["first"] not in ("su", "ua", "au")
            last = p["last"]
        if p["low"] is not None:
            turns += p["turns"] - (p["low"] == high)
            low = p["low"] if low is None else low
            high = p["high"]
    audit, cost = tables().audit(b"".join(p["kinds"] for p in pieces))
    return whole | {"gaps": 0 if low is None else high - low + 1 - turns, "cost": cost, "audit": audit}


def _id_type(rows: DataFrame) -> str:
    return "string" if rows.schema["conv_id"].dataType.simpleString() == "string" else "bigint"


def _audits(marked: DataFrame, ids: DataFrame, kind_of_id: str) -> DataFrame:
    names = ["conv_id", *FOUND, "audit"]

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in parts:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    out.append({"conv_id": held[0]["conv_id"]} | joined_pieces(held))
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([{"conv_id": held[0]["conv_id"]} | joined_pieces(held)], schema)

    id_type = pa.string() if kind_of_id == "string" else pa.int64()
    schema = pa.schema([("conv_id", id_type), *[(c, pa.int64()) for c in FOUND], ("audit", pa.string())])
    pieces = _pieces(marked, kind_of_id)
    nothing = {"part": F.lit(-1), "kinds": F.lit(b""), **{c: F.lit(0) for c in [*COUNTS, "turns"]}}
    empty = only(ids, "conv_id").distinct()
    empty = empty.select(
        F.col("conv_id").cast(kind_of_id).alias("conv_id"),
        *[nothing.get(c, F.lit(None)).cast(pieces.schema[c].dataType).alias(c) for c in pieces.columns[1:]],
    )
    dealt = pieces.unionByName(empty).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return settle(dealt.mapInArrow(task, "conv_id {}, {}, audit string".format(kind_of_id, ", ".join(f"{c} bigint" for c in FOUND))).select(*names))


def _with_audits(marked: DataFrame, audits: DataFrame, kind_of_id: str) -> DataFrame:
    """Each conversation's audit and then its rows in order, a partition at a time."""
    rows = marked.select(F.col("conv_id").cast(kind_of_id).alias("conv_id"), "turn", "role", "text", "copies")
    both = audits.withColumn("_row", F.lit(0)).unionByName(rows.withColumn("_row", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_row", "turn", "role", "text")


def edited(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, int | None, str, str]]]]:
    """Each conversation's audit row, and its repaired rows: edit, turn, role, text. Both are to be read in order."""
    rows = (row for batch in parts for row in batch.to_pylist())
    ahead = next(rows, None)

    def repaired(head: dict) -> Iterator[tuple[str, int | None, str, str]]:
        nonlocal ahead
        audit, at, state = head["audit"], 0, START
        while ahead is not None and ahead["_row"]:
            for _ in range(ahead["copies"]):
                while audit[at] == "I":
                    yield "I", None, ROLE[state], ""
                    state, at = NEXT[state], at + 1
                letter, at = audit[at], at + 1
                if letter == "K":
                    state = KEPT[INITIALS.index(ahead["role"][0])][state]
                    yield "K", ahead["turn"], ahead["role"], ahead["text"]
                elif letter == "R":
                    yield "R", ahead["turn"], ROLE[state], ahead["text"]
                    state = NEXT[state]
            ahead = next(rows, None)
        for _ in audit[at:]:
            yield "I", None, ROLE[state], ""
            state = NEXT[state]

    while ahead is not None:
        head, ahead = ahead, next(rows, None)
        yield head, repaired(head)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place`` (from 0), ``edit`` (K kept, R role replaced, I put in), ``turn, role, text``."""
    kind_of_id = _id_type(rows)
    names = ["conv_id", "place", "edit", "turn", "role", "text"]

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for head, found in edited(parts):
            for place, (edit, turn, role, text) in enumerate(found):
                held.append((head["conv_id"], place, edit, turn, role, text))
                if len(held) == 5000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema)
                    held = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema)

    id_type = pa.string() if kind_of_id == "string" else pa.int64()
    schema = pa.schema(list(zip(names, [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()])))
    marked = _marked(rows)
    audits = _audits(marked, marked, kind_of_id)
    return _with_audits(marked, audits, kind_of_id).mapInArrow(
        task, f"conv_id {kind_of_id}, place bigint, edit string, turn bigint, role string, text string"
    )


def repair_digests(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """What was wrong with each conversation of ``ids``, its edits and their cost, and a digest of its repaired rows.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. A conversation without rows has
    zeros, an empty audit and the digest of an empty text. A digest is made row by row, so that a long conversation is streamed
    through one task and not gathered.
    """
    kind_of_id = _id_type(rows)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for head, found in edited(parts):
            digest = hashlib.sha256()
            for place, (_, _, role, text) in enumerate(found):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            held.append({c: head[c] for c in ["conv_id", *FOUND, "audit"]} | {"repaired_sha256": digest.hexdigest()})
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    id_type = pa.string() if kind_of_id == "string" else pa.int64()
    schema = pa.schema([("conv_id", id_type), *[(c, pa.int64()) for c in FOUND], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    marked = _marked(rows)
    audits = _audits(marked, ids, kind_of_id)
    numbers = ", ".join(f"{c} bigint" for c in FOUND)
    return _with_audits(marked, audits, kind_of_id).mapInArrow(
        task, f"conv_id {kind_of_id}, {numbers}, audit string, repaired_sha256 string"
    )
