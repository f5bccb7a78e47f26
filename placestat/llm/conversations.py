"""Conversation structure repair: a grammar-compressed dynamic program.

A conversation is a sequence of symbols, one a row, of the row's role and fault. Deleting, keeping and changing the role of
rows and inserting empty ones turns it into one that follows the pattern (s?(ua)+)?; the cheapest edits are a path
through the pattern's four states. A symbol is a min-plus matrix over (state before, state after) whose entries hold the
least cost and, as a rope, the ASCII-least edits of that cost. Re-Pair rules, learned from all sequences together, replace frequent
pairs of symbols; each rule's matrix is made once from those of its two parts and serves every conversation.

Entries stay exact under products: all edits of one entry have the same letters but for inserts, and those of one cost as
many inserts, so none is a proper prefix of another and the least prefix always leads to the least whole.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placestat.llm.common import sized_broadcast, stored

BLANKS = " \t\n\u000b\f\r"
#: Costs of the edits; a truncated row that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Pattern states: nothing yet, after s, after u, after a. Each role's moves; what may end is nothing or after a.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
STATES = range(4)
#: Rows of a chunk, the most that are put in one string.
CHUNK = 4096


class Rope:
    """Text joined without copying; two of equal length and hash count as equal."""

    __slots__ = ("left", "right", "text", "length", "hash", "power")
    MOD, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            h = 0
            for c in text:
                h = (h * self.BASE + ord(c)) % self.MOD
            self.length, self.hash, self.power = len(text), h, pow(self.BASE, len(text), self.MOD)
        else:
            self.length = left.length + right.length
            self.hash = (left.hash * right.power + right.hash) % self.MOD
            self.power = left.power * right.power % self.MOD

    def __add__(self, other: Rope) -> Rope:
        return other if not self.length else self if not other.length else Rope("", self, other)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            r = stack.pop()
            if r.left is None:
                yield r.text
            else:
                stack += [r.right, r.left]

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or (x.length == y.length and x.hash == y.hash):
                continue
            if x.left is None and y.left is None:
                n = min(x.length, y.length)
                if x.text[:n] != y.text[:n]:
                    return x.text[:n] < y.text[:n]
                if x.length > n:
                    a.append(Rope(x.text[n:]))
                if y.length > n:
                    b.append(Rope(y.text[n:]))
            elif y.left is None or (x.left is not None and x.length >= y.length):
                b.append(y)
                a += [x.right, x.left]
            else:
                a.append(x)
                b += [y.right, y.left]
        return bool(b) and not a


#: (cost, edits) by (state before, state after); what is missing can't be reached.
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def better(cell: tuple[int, Rope], than: tuple[int, Rope] | None) -> bool:
    return than is None or cell[0] < than[0] or (cell[0] == than[0] and cell[1] < than[1])


def times(m: Matrix, n: Matrix) -> Matrix:
    """The min-plus product."""
    out: Matrix = {}
    after: dict[int, list[tuple[int, tuple[int, Rope]]]] = {}
    for (j, k), cell in n.items():
        after.setdefault(j, []).append((k, cell))
    for (i, j), (c, r) in m.items():
        for k, (d, s) in after.get(j, ()):
            old = out.get((i, k))
            if old is None or c + d <= old[0]:
                cell = (c + d, r + s)
                if better(cell, old):
                    out[i, k] = cell
    return out


def inserts() -> Matrix:
    """Cheapest insertions from state to state."""
    out: Matrix = {(i, i): (0, Rope()) for i in STATES}
    step: Matrix = {(i, j): (INSERT, Rope("I")) for c in "ua" for i, j in MOVES[c].items()}
    for _ in STATES:
        for key, cell in times(out, step).items():
            if better(cell, out.get(key)):
                out[key] = cell
    return out


def row_matrix(symbol: str) -> Matrix:
    """``x`` is blank or a duplicate, s u a o are initials (o any other), in capitals if truncated. Insertions come before the row."""
    out: Matrix = {(i, i): (DELETE, Rope("D")) for i in STATES}
    if symbol != "x":
        extra, initial = TRUNCATED * symbol.isupper(), symbol.lower()
        for edit, cost, roles in (("K", 0, initial), ("R", REROLE, "ua")):
            for c in roles:
                for i, j in MOVES.get(c, {}).items():
                    cell = (cost + extra, Rope(edit))
                    if better(cell, out.get((i, j))):
                        out[i, j] = cell
    return times(inserts(), out)


class Grammar:
    """Re-Pair rules in order (pairs of symbols; rule k is the character ``name(k)``) with a matrix for every symbol and rule."""

    def __init__(self):
        self.rules: list[str] = []
        self.matrices: dict[str, Matrix] = {c: row_matrix(c) for c in "xsuaoSUAO"}
        self.insert = inserts()

    @staticmethod
    def name(k: int) -> str:
        return chr(0xE000 + k)

    def add(self, pair: str) -> None:
        """Bottom-up: both parts have their matrices already."""
        self.matrices[self.name(len(self.rules))] = times(self.matrices[pair[0]], self.matrices[pair[1]])
        self.rules.append(pair)

    def compress(self, sequences: list[str]) -> list[str]:
        text = "\n".join(sequences)
        for k, pair in enumerate(self.rules):
            text = text.replace(pair, self.name(k))
        return text.split("\n")

    def matrix(self, compressed: str) -> Matrix:
        out: Matrix = {(i, i): (0, Rope()) for i in STATES}
        for c in compressed:
            out = times(out, self.matrices[c])
        return out

    def best(self, m: Matrix) -> tuple[int, str]:
        """Cost and edits of a whole conversation with that matrix."""
        found = None
        for (i, j), cell in times({k: v for k, v in m.items() if k[0] == 0}, self.insert).items():
            if i == 0 and j in ENDS and better(cell, found):
                found = cell
        return found[0], str(found[1])


def learn_grammar(sequences: DataFrame, column: str = "seq", max_rules: int = 256, rounds: int = 8) -> Grammar:
    """Re-Pair over all rows of ``sequences``: in each round the pairs are counted in the tasks and the most frequent become rules.

    A round takes pairs that don't overlap each other's. At most ``max_rules`` pair counts come to the driver a round; any rules give
    the same results, at another cost.
    """
    g = Grammar()
    for _ in range(rounds):
        shared = sequences.sparkSession.sparkContext.broadcast(g)

        def pairs(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            n: Counter = Counter()
            for b in batches:
                for s in shared.value.compress(b.column(0).to_pylist()):
                    n.update(map("".join, zip(s, s[1:], strict=False)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["pair", "n"])

        counted = sequences.select(column).mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(max_rules).collect()
        firsts, seconds, new = set(), set(), 0
        for r in top:
            x, y = r["pair"]
            if len(g.rules) < max_rules and x not in seconds and y not in firsts and 8 * r["n"] >= top[0]["n"]:
                firsts.add(x)
                seconds.add(y)
                g.add(r["pair"])
                new += 1
        shared.unpersist()
        if not new:
            break
    return g


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by a hash of conversation and turn, to measure the repair; a null is read as one space.

    Of twenty hash values 0 drops the row, 1 empties its text, 2 takes its end marks away, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


def chunk_symbols(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, seq, blank, duplicate, truncated, illegal, turns, lo, hi) of each ``chunk`` rows of a conversation, in order.

    One shuffle by conversation; a conversation of any length is sorted with spilling and never held as a whole.
    """
    w = Window.partitionBy("conv_id").orderBy(*_order())
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy("pos")
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    r = rows.withColumns({"digest": F.md5(F.col("text").cast("binary")), "end": end, "initial": F.substring("role", 1, 1)})
    r = r.withColumns({"pos": F.row_number().over(w), "last_turn": F.lag("turn").over(w), "before": F.lag("initial").over(w)}).drop("text")
    r = r.withColumn("again", F.row_number().over(seen) > 1)
    fault = F.when(F.col("end") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise("")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    r = r.withColumn("fault", fault)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    pair_ok = F.concat("before", "initial").isin("su", "ua", "au")
    return r.groupBy("conv_id", F.floor((F.col("pos") - 1) / chunk).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", symbol.alias("s")))), lambda x: x["s"]), "").alias("seq"),
        *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
        F.count_if(F.col("before").isNotNull() & ~pair_ok).alias("illegal"),
        F.count_if(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))).alias("turns"),
        F.min("turn").alias("lo"),
        F.max("turn").alias("hi"),
    )


def _cells(m: Matrix) -> list[tuple[int, int, int, str]]:
    return [(i, j, c, str(r)) for (i, j), (c, r) in m.items()]


def solve(sequences: DataFrame, grammar: Grammar, whole: bool) -> DataFrame:
    """Distinct (seq) with cost and edits of a whole conversation, or else with the matrix of a part of one."""
    shared = sequences.sparkSession.sparkContext.broadcast(grammar)
    kind = "seq string, cost long, audit string" if whole else "seq string, cells array<struct<i:int,j:int,cost:long,audit:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for pdf in batches:
            ms = [g.matrix(c) for c in g.compress(pdf["seq"].tolist())] if len(pdf) else []
            if whole:
                found = [g.best(m) for m in ms]
                yield pd.DataFrame({"seq": pdf["seq"], "cost": pd.Series([c for c, _ in found], dtype="int64"), "audit": pd.Series([a for _, a in found], dtype=object)})
            else:
                yield pd.DataFrame({"seq": pdf["seq"], "cells": pd.Series([[{"i": i, "j": j, "cost": c, "audit": a} for i, j, c, a in _cells(m)] for m in ms], dtype=object)})

    return sequences.select("seq").distinct().mapInPandas(run, kind)


def join_parts(parts: DataFrame) -> DataFrame:
    """(id, cost, audit) of conversations from the cells (chunk, i, j, cost, audit) of their chunks' matrices, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar()
        for b in batches:
            found = []
            for every in b.column(1).to_pylist():
                m: Matrix = {(0, 0): (0, Rope())}
                for _, cells in itertools.groupby(every, lambda x: x["chunk"]):
                    m = times(m, {(x["i"], x["j"]): (x["cost"], Rope(x["audit"])) for x in cells})
                found.append(g.best(m))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["id", "cost", "audit"])

    kind = parts.schema["id"].dataType.simpleString()
    return parts.select("id", "cells").mapInArrow(run, f"id {kind}, cost long, audit string")


def plan_edits(rows: DataFrame, ids: DataFrame | None = None, chunk: int = CHUNK, max_rules: int = 256) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``rows`` and of ``ids`` (conv_id)."""
    chunks = stored(chunk_symbols(rows, chunk), "conversation-symbols")
    total = chunks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("chunk").alias("last"))
    total = total.withColumn("gaps", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)))
    sequences = stored(chunks.select("seq").distinct(), "conversation-sequences")
    grammar = learn_grammar(sequences, max_rules=max_rules)
    sized = chunks.withColumn("id", F.col("conv_id")).join(total.select(F.col("conv_id").alias("of"), "last"), F.col("id").eqNullSafe(F.col("of"))).select("id", "chunk", "seq", "last")
    one, many = sized.where("last = 0"), sized.where("last > 0")
    single = one.join(sized_broadcast(solve(one, grammar, True)), "seq").select("id", "cost", "audit")
    parts = many.join(solve(many, grammar, False), "seq").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk", "cells"))).alias("p"))
    cells = F.flatten(F.transform("p", lambda x: F.transform(x["cells"], lambda c: F.struct(x["chunk"].alias("chunk"), c["i"].alias("i"), c["j"].alias("j"), c["cost"].alias("cost"), c["audit"].alias("audit")))))
    joined = join_parts(parts.select("id", cells.alias("cells")))
    out = total.join(single.unionByName(joined), F.col("conv_id").eqNullSafe(F.col("id")))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    if ids is None:
        return out.select("conv_id", *names, "audit")
    every = ids.select(F.col("conv_id").alias("asked")).distinct()
    found = every.join(out, F.col("asked").eqNullSafe(F.col("conv_id")), "left")
    return found.select(F.col("asked").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in names], F.coalesce("audit", F.lit("")).alias("audit"))


class Replay:
    """The edits of one conversation applied to its rows, in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.made = audit, 0, 0
        self.length = len(audit) - audit.count("D")

    def role(self) -> str:
        return "user" if (self.made - self.length % 2) % 2 == 0 else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = self.role()
            self.at += 1
            self.made += 1
            yield "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = self.role() if edit == "R" else role
            self.made += 1
            yield edit, role, text


def _heads_and_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's plan before its rows, sorted within one partition."""
    both = plan.withColumn("head", F.lit(0)).unionByName(rows.select("conv_id", "turn", "role", "text").withColumn("head", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "head", *_order())


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None, chunk: int = CHUNK, max_rules: int = 256) -> DataFrame:
    """``plan_edits`` with ``repaired_sha256``, the digest of the repaired conversation (``role:text`` lines).

    ``rows`` has conv_id, turn, role and text, others are ignored; null roles and texts count as one space. Rows are taken by turn, nulls first,
    then role and text. A row is blank (no character but ASCII blanks), else a duplicate (role and text seen earlier), else truncated
    (its last such character is none of .!?). Keeping costs 0, changing the role to user or assistant 1, deleting 2 (blank and duplicate rows
    must go), inserting an empty row of either 5; truncated rows that stay cost 5 more. ``audit`` is the ASCII-least of the
    cheapest edits (D, I, K, R). A null conv_id is a conversation like any other. Texts are hashed as a stream, row by row.
    """
    rows = _clean(rows)
    plan = plan_edits(rows, ids, chunk, max_rules)
    names = plan.columns
    stream = _heads_and_rows(rows, plan).select(*names, "head", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, replay, digest, started = None, None, None, False

        def close() -> tuple:
            add(replay.inserted())
            return (*head, digest.hexdigest())

        def add(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal started
            for _, role, text in made:
                digest.update((("\n" if started else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                started = True

        for b in batches:
            done = []
            for *values, is_row, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if is_row:
                    add(replay.row(role, text))
                else:
                    if head is not None:
                        done.append(close())
                    head, replay, digest, started = tuple(values), Replay(values[-1]), hashlib.sha256(), False
            yield _batch(done, out)
        if head is not None:
            yield _batch([close()], out)

    schema = plan.schema.add("repaired_sha256", "string")
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    return stream.mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, chunk: int = CHUNK, max_rules: int = 256) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired rows of every conversation, see ``repair_conversations``."""
    rows = _clean(rows)
    plan = plan_edits(rows, None, chunk, max_rules).select("conv_id", "audit")
    stream = _heads_and_rows(rows, plan).select("conv_id", "audit", "head", "role", "text")
    kind = plan.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, replay = None, None
        for b in batches:
            made: list[tuple] = []
            for c, audit, is_row, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not is_row:
                    if replay is not None:
                        made += [(conv, replay.made, *x) for x in replay.inserted()]
                    conv, replay = c, Replay(audit)
                else:
                    made += [(conv, replay.made, *x) for x in replay.row(role, text)]
            yield _batch(made, out)
        if replay is not None:
            yield _batch([(conv, replay.made, *x) for x in replay.inserted()], out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType().add("conv_id", kind).add("position", "long").add("edit", "string").add("role", "string").add("text", "string")
    out = to_arrow_schema(schema)
    return stream.mapInArrow(run, schema)


def _clean(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def _batch(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*made, strict=True)) if made else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
