"""Conversation structure repair: the cheapest edits to the form system? (user assistant)+, by a square-root checkpointed dynamic programme."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenvec.llm.common import materialize, maybe_broadcast, small_batches
from lumenvec.llm.turns import in_order

#: Fixed value: ASCII white space.
WHITE = " \t\n\x0b\x0c\r"
#: Costs of a new role, a deletion, an insertion and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a conversation that are walked in one piece: 2 ** 12.
BLOCK_BITS = 12
FAR = 1 << 40
#: States: nothing yet, after system, after user, after assistant. The state that the next role asked for leads to, and the letter of its insertion and new role.
NEXT, INSERTED, REROLED = (2, 2, 3, 2), "iiji", "rrqr"
#: What the rows that are left cost where there are none: insertions up to the end of an answer.
END = (0, 2 * INSERT, INSERT, 0)
END_MOVES = ("", "ij", "j", "")
#: Where a row that is kept leads from each state, by the initial of its role: s, u, a, other; -1 is nowhere.
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
#: Letters of moves: K and D, and by role i, j for inserted user and assistant, r, q for a new role user and assistant.
LETTERS, AUDIT = "ijrq", "IIRR"


@lru_cache(maxsize=1 << 16)
def back(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Costs from each state before a row, given those after it, as (differences to the least, least).

    ``code`` is initial + 4 * fault: 0 none, 1 truncated, 2 blank, 3 duplicate. Costs repeat up to a constant, so few are ever computed.
    """
    initial, fault = code % 4, code // 4
    here = []
    for q in range(4):
        best = DELETE + after[q]
        if fault < 2:
            best = min(best, REROLE + fault * TRUNCATED + after[NEXT[q]])
            if KEPT[initial][q] >= 0:
                best = min(best, fault * TRUNCATED + after[KEPT[initial][q]])
        here.append(best)
    closed = [min(here[q], INSERT + here[NEXT[q]], 2 * INSERT + here[NEXT[NEXT[q]]]) for q in range(4)]
    least = min(closed)
    return tuple(min(c - least, FAR) for c in closed), least


@lru_cache(maxsize=1 << 16)
def move(after: tuple[int, ...], code: int, state: int) -> tuple[str, int, int]:
    """(moves, next state, cost) of the ASCII-least of the cheapest ways past a row: deletion, insertion, keeping, a new role."""
    costs, least = back(after, code)
    initial, fault = code % 4, code // 4
    moves, cost, q = "", 0, state
    while True:
        want = costs[q] + least
        if DELETE + after[q] == want:
            return moves + "D", q, cost + DELETE
        if INSERT + costs[NEXT[q]] + least == want:
            moves, cost, q = moves + INSERTED[q], cost + INSERT, NEXT[q]
        elif KEPT[initial][q] >= 0 and fault * TRUNCATED + after[KEPT[initial][q]] == want:
            return moves + "K", KEPT[initial][q], cost + fault * TRUNCATED
        else:
            return moves + REROLED[q], NEXT[q], cost + REROLE + fault * TRUNCATED


def before(codes: bytes, after: tuple[int, ...]) -> tuple[int, ...]:
    """The costs from each state before rows, given those after them."""
    base = min(after)
    v = tuple(a - base for a in after)
    for code in reversed(codes):
        v, least = back(v, code)
        base += least
    return tuple(min(x + base, FAR) for x in v)


def walk(codes: bytes, after: tuple[int, ...], starts: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """(moves, last state, cost) from each of ``starts``: cost vectors are kept at every square root of the rows and made again block by block."""
    n = len(codes)
    step = max(1, isqrt(n))
    v = tuple(a - min(after) for a in after)
    kept = {n: v}
    for i in range(n - 1, -1, -1):
        v, _ = back(v, codes[i])
        if i % step == 0:
            kept[i] = v
    ways: list[tuple[list[str], int, int]] = [([], q, 0) for q in starts]
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        block = [kept[hi]]
        for i in range(hi - 1, lo, -1):
            block.append(back(block[-1], codes[i])[0])
        for k, (moves, q, cost) in enumerate(ways):
            for i in range(lo, hi):
                m, q, c = move(block[hi - 1 - i], codes[i], q)
                moves.append(m)
                cost += c
            ways[k] = (moves, q, cost)
    return [("".join(moves), q, cost) for moves, q, cost in ways]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's codes in order, its role pairs that aren't legal, and its turn numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(2)
        at = rows.offsets.to_numpy()
        flat = rows.flatten()
        at = at - at[0]
        codes = flat.field("code").to_numpy(zero_copy_only=False).astype(np.uint8)
        turn = flat.field("turn")
        known = np.asarray(turn.is_valid())
        turns = turn.fill_null(0).to_numpy(zero_copy_only=False)
        pair = np.r_[3, codes[:-1] % 4] * 4 + codes % 4
        bad = ~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
        new = known & ~(np.r_[False, known[:-1]] & (np.r_[0, turns[:-1]] == turns))
        bad[at[:-1]], new[at[:-1]] = False, known[at[:-1]]
        first = flat.field("pos").to_numpy(zero_copy_only=False)[at[:-1]]
        total = lambda mask: pa.array(np.add.reduceat(mask.astype(np.int64), at[:-1]))
        lows = [int(turns[a:b][known[a:b]][0]) if known[b - 1] else None for a, b in zip(at[:-1], at[1:], strict=True)]  # nulls come first
        highs = [int(turns[b - 1]) if known[b - 1] else None for b in at[1:]]
        raw = codes.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(first), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())]
            + [total(codes // 4 == 2), total(codes // 4 == 3), total(codes // 4 == 1), total(bad), total(new), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())],
            ["conv_id", "block", "first_pos", "codes", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high"],
        )


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ways = []
        for codes, after, first in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("codes", "after", "first")], strict=True):
            found = walk(codes, END if after is None else tuple(after), (0,) if first else (0, 1, 2, 3))
            ways.append([(m + END_MOVES[q], q, c + END[q]) if after is None else (m, q, c) for m, q, c in found])
        out = [pa.array([[w[i] for w in x] for x in ways], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["conv_id", "block", "moves", "exits", "costs"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs of a block from each state to each, column by column."""
    for batch in batches:
        cells = [[x for r in range(4) for x in before(codes, tuple(0 if q == r else FAR for q in range(4)))] for codes in batch.column(2).to_pylist()]
        ends = [[codes[0] % 4, codes[-1] % 4] for codes in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32())), batch.column(3), batch.column(4)], ["conv_id", "block", "cells", "ends", "low", "high"])


def _chain(blocks: pd.DataFrame) -> pd.DataFrame:
    """From the last block to the first: the costs after each; illegal pairs and repeated turn numbers where blocks meet."""
    blocks = blocks.sort_values("block").reset_index(drop=True)
    v, after, n = np.array(END, np.int64), [None] * len(blocks), len(blocks)
    for i in range(n - 1, 0, -1):
        v = np.minimum((np.asarray(blocks.cells[i]).reshape(4, 4).T + v).min(axis=1), FAR)
        after[i - 1] = v.tolist()
    bad, same = [0] * n, [0] * n
    for i in range(1, n):
        bad[i] = int((blocks.ends[i - 1][1], blocks.ends[i][0]) not in ((0, 1), (1, 2), (2, 1)))
        same[i] = int(pd.notna(blocks.low[i]) and blocks.low[i] == blocks.high[i - 1])
    return pd.DataFrame({"conv_id": blocks.conv_id, "block": blocks.block, "after": after, "first": [i == 0 for i in range(n)], "bad": bad, "same": same})


def _starts(blocks: pd.DataFrame) -> pd.DataFrame:
    blocks = blocks.sort_values("block").reset_index(drop=True)
    state, starts = 0, []
    for exits in blocks.exits:
        starts.append(state)
        state = int(exits[state])
    return pd.DataFrame({"conv_id": blocks.conv_id, "block": blocks.block, "start": starts})


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, code) of rows ``in_order``: initial of the role and the first fault, as ``back`` reads it."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    keyed = rows.select("conv_id", "pos", "turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), F.expr("locate(substring(role, 1, 1), 'sua')").alias("at"), F.length(F.substring("role", 1, 1)).alias("named"), (trimmed == "").alias("blank"), F.substring(trimmed, -1, 1).alias("end"))
    seen = materialize(keyed.where("not blank").groupBy(F.col("conv_id").alias("__conv"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "seen")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))
    marked = keyed.join(maybe_broadcast(seen, seen.count()), same, "left")
    fault = F.when(F.col("blank"), 2).when(F.col("pos") > F.col("first"), 3).when(~F.col("end").isin(".", "!", "?"), 1).otherwise(0)
    initial = F.when((F.col("named") == 0) | (F.col("at") == 0), 3).otherwise(F.col("at") - 1)
    return marked.select("conv_id", "pos", "turn", (initial + 4 * fault).cast("int").alias("code"))


def repair(turns: DataFrame, block_bits: int = BLOCK_BITS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, messages) of conversations after their cheapest repair.

    report: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row per conversation of ``turns``.
    messages: (conv_id, pos, step, role, text), the repaired messages in the order of pos and step.

    Rows go by turn, then role, then text, nulls first; a null role or text is one space. The first fault of a row counts: blank (only ASCII
    white space), duplicate (role and text came before), truncated (doesn't end in ``.``, ``!`` or ``?`` before white space). A row is kept
    (0), gets the role user or assistant (2) or is deleted (3; blank and duplicate rows must be); empty messages of either may be put in
    anywhere (2); a truncated row that stays adds 1. Initials of the roles must then read ``(s?(ua)+)?``. ``audit`` has the initials of the
    cheapest edits in order, Keep, Rerole, Delete, Insert, the ASCII-least of them. ``gaps`` counts numbers missing between the least and
    the greatest turn; ``illegal`` counts neighbours that aren't su, ua or au.

    The order is made by ranges, and runs of at most 2 ** ``block_bits`` rows of a conversation are walked in one piece: backwards, keeping
    the costs from each state only at checkpoints a square root of the rows apart, then forwards, with the costs between two checkpoints
    made again. A longer conversation's pieces are tied together by 4 x 4 tables of costs from state to state, so that no task holds it; only
    these tables, one for each piece, meet. Its audit is one string, as asked.

    A null conv_id is one more conversation; repeated rows are rows, all but the first duplicates; an empty table gives empty results; other
    columns are not looked at.
    """
    spark = turns.sparkSession
    small_batches(spark)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = materialize(in_order(turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))), "rows")
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    shape = lambda rest: T.StructType([conv, *T.StructType.fromDDL(rest).fields])
    held = faults(rows).groupBy("conv_id", F.shiftright("pos", block_bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "code", "turn"))).alias("rows"))
    counts = ["blank", "duplicate", "truncated", "illegal", "turns"]
    blocks = materialize(held.mapInArrow(_summaries, shape("block long, first_pos long, codes binary, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long")), "blocks")
    longs = materialize(blocks.groupBy(F.col("conv_id").alias("__conv")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "longs")
    several = longs.count()
    pieces = blocks.withColumn("after", F.lit(None).cast("array<long>")).withColumn("first", F.lit(True)).withColumn("bad", F.lit(0)).withColumn("same", F.lit(0))
    if several:
        is_long = F.col("conv_id").eqNullSafe(F.col("__conv"))
        tables = blocks.join(maybe_broadcast(longs, several), is_long, "left_semi").select("conv_id", "block", "codes", "low", "high").mapInArrow(_matrices, shape("block long, cells array<long>, ends array<int>, low long, high long"))
        links = materialize(tables.groupBy("conv_id").applyInPandas(_chain, shape("block long, after array<long>, first boolean, bad int, same int")), "links")
        tied = links.select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), F.col("after").alias("__after"), F.col("first").alias("__first"), F.col("bad").alias("__bad"), F.col("same").alias("__same"))
        joined = blocks.join(maybe_broadcast(tied, links.count()), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b")), "left")
        pieces = joined.select(*blocks.columns, F.col("__after").alias("after"), F.coalesce("__first", F.lit(True)).alias("first"), F.coalesce("__bad", F.lit(0)).alias("bad"), F.coalesce("__same", F.lit(0)).alias("same"))
    pieces = materialize(pieces, "pieces")
    ways = materialize(pieces.select("conv_id", "block", "codes", "after", "first").mapInArrow(_walks, shape("block long, moves array<string>, exits array<int>, costs array<long>")), "ways")
    start = F.lit(0)
    if several:
        starts = materialize(ways.join(maybe_broadcast(longs, several), is_long, "left_semi").groupBy("conv_id").applyInPandas(_starts, shape("block long, start int")), "starts")
        ways = ways.join(maybe_broadcast(starts.select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), "start"), starts.count()), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b")), "left")
        start = F.coalesce("start", F.lit(0))
    chosen = ways.select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), F.element_at("moves", start + 1).alias("moves"), F.element_at("costs", start + 1).alias("cost"))
    done = materialize(pieces.drop("codes", "after").join(chosen, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b"))).drop("__c", "__b"), "done")
    audit = F.translate(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "moves"))), lambda x: x["moves"]), ""), LETTERS, AUDIT)
    sums = done.groupBy(F.col("conv_id").alias("__c")).agg((F.max("high") - F.min("low") + 1 - F.sum("turns") + F.sum("same")).alias("gaps"), *[F.sum(c).alias(c) for c in counts[:3]], F.sum(F.col("illegal") + F.col("bad")).alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    every = turns.select(F.col(conv_col).alias("conv_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = every.join(sums, F.col("conv_id").eqNullSafe(F.col("__c")), "left").select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"))
    return report, _messages(rows, done)


def _messages(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The repaired messages: each row's moves, found by its place, say what is put in before it and what becomes of it."""
    moves = done.select(F.col("conv_id").alias("__c"), F.col("first_pos"), F.posexplode(F.regexp_extract_all("moves", F.lit("[ij]*[KrqD]|[ij]+$"), F.lit(0))).alias("k", "moves"))
    moves = moves.where("moves != 'D'").select("__c", (F.col("first_pos") + F.col("k")).alias("__pos"), "moves")
    held = moves.join(rows.select("conv_id", "pos", "role", "text"), F.col("__c").eqNullSafe(F.col("conv_id")) & (F.col("__pos") == F.col("pos")), "left")
    steps = held.select(F.col("__c").alias("conv_id"), F.col("__pos").alias("pos"), "role", "text", F.posexplode(F.split("moves", "")).alias("step", "move")).where("move not in ('', 'D')")
    role = F.when(F.col("move").isin("i", "r"), "user").when(F.col("move").isin("j", "q"), "assistant").otherwise(F.col("role"))
    return steps.select("conv_id", "pos", "step", role.alias("role"), F.when(F.col("move").isin("i", "j"), "").otherwise(F.col("text")).alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, current, kind = None, None, pa.int64()
    for batch in batches:
        kind, ids, sums = batch.column(0).type, [], []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or conv != current:
                if state is not None:
                    ids.append(current)
                    sums.append(state.hexdigest())
                state, current = hashlib.sha256(line.encode()), conv
            else:
                state.update(b"\n" + line.encode())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of each conversation's ``role:text`` lines. A conversation streams through one task, as its digest asks for; none is held."""
    lines = messages.select("conv_id", "pos", "step", F.concat_ws(":", "role", "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step")
    return lines.select("conv_id", "line").mapInArrow(_digests, T.StructType([T.StructField("conv_id", messages.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())]))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by a hash of conversation and turn (nulls: one space), for tests of the repair: a twentieth
    each is dropped, emptied, loses its marks of sentence ends, comes twice, is the user's. Null roles and texts become one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
