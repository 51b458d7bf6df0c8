"""Conversation structure repair: the cheapest edits that make a conversation alternate, by prefix-doubling path ranking.

A conversation is a path through (row, state) nodes, where the state says which roles were met: nothing, system, user, assistant.
Keeping, deleting and re-roling lead to the next row, inserting stays before the same row; a letter leads from a node to one node
only. The costs to the end are summed backwards; the arcs on cheapest paths remain. The nodes of these arcs are ranked by the first
1, 2, 4, ... letters of the least audit that starts there (the rank of a length is the rank of the pair of half-length ranks, here and
at the doubled pointer), and the path takes the arc of least letter and rank at every node, listed through doubled pointers.

Rows are range partitioned in the order of their conversation, so a conversation of any length spreads over slices. A slice that holds
a piece only hands on a 4 x 4 table of costs from state to state; those tables, one or two a slice, are combined per conversation to
the cost behind each piece, and in the same way the states in which the pieces are entered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.skew import join_groups
from caselog.session import durable

SLICE_ROWS = 131_072

# Costs, edit letters in ASCII order, faults, states and their moves.
DELETE, INSERT, RENAME, CUT = 3, 2, 2, 1
LETTERS = "DIKR"
FINE, TRUNCATED, BLANK, REPEATED = range(4)
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
AFTER = [USER, USER, ASSISTANT, USER]  # where an inserted or re-roled row leads
KEEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60

SPACE = r"\x20\x09-\x0D"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn`` modulo 20; a null counts as one space.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user; others stay.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    hurt = rows.filter(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), copies.alias("_copy"))
    return hurt.drop("_copy")


# --- one slice, in a task --------------------------------------------------------------------------------------------


def closed(costs: list[int]) -> list[int]:
    """Costs of the four states when rows may be inserted first; more than two insertions lead nowhere new."""
    out = []
    for s in range(4):
        a, b = AFTER[s], AFTER[AFTER[s]]
        out.append(min(costs[s], INSERT + costs[a], 2 * INSERT + costs[b]))
    return out


END = closed([0, FAR, FAR, 0])


def row_arcs(initial: str, fault: int, s: int) -> list[tuple[int, int, int]]:
    """(letter, cost, next state) of the edits that take state s past a row."""
    arcs = [(0, DELETE, s)]
    if fault < BLANK:
        cut = CUT if fault == TRUNCATED else 0
        if initial in KEEP[s]:
            arcs.append((2, cut, KEEP[s][initial]))
        arcs.append((3, RENAME + cut, AFTER[s]))
    return arcs


def costs_to_end(initials: list[str], faults: list[int], end: list[int]) -> list[list[int]]:
    """Cheapest cost from every (row, state) to what lies behind the piece; ``end`` is the cost from there on, by state."""
    out = [end]
    for initial, fault in zip(reversed(initials), reversed(faults)):
        after = out[-1]
        out.append(closed([min(c + after[t] for _, c, t in row_arcs(initial, fault, s)) for s in range(4)]))
    return out[::-1]


def optimal_arcs(initials: list[str], faults: list[int], costs: list[list[int]], last: bool, base: int) -> list[list[int]]:
    """Target of each letter's arc out of each node (4 * row + state, from ``base``), -1 where it isn't on a cheapest path."""
    out = []
    for i, here in enumerate(costs):
        for s in range(4):
            arcs = [-1, -1, -1, -1]
            if here[s] < FAR:
                if i < len(initials):
                    for letter, c, t in row_arcs(initials[i], faults[i], s):
                        if c + costs[i + 1][t] == here[s]:
                            arcs[letter] = base + 4 * (i + 1) + t
                if (i < len(initials) or last) and INSERT + here[AFTER[s]] == here[s]:
                    arcs[1] = base + 4 * i + AFTER[s]
            out.append(arcs)
    return out


def ranked(arcs: np.ndarray) -> np.ndarray:
    """Rank of every node by the least audit from it, from ranks of audits of 1, 2, 4, ... letters; the empty audit has rank 0."""
    nodes = np.arange(len(arcs))
    valid = arcs >= 0
    first = valid.argmax(axis=1)
    ends = ~valid.any(axis=1)
    rank = np.where(ends, 0, first + 1)
    pointer = np.where(ends, nodes, arcs[nodes, first])
    while not ends[pointer].all():
        pair = rank * (rank.max() + 1) + rank[pointer]
        kinds, rank = np.unique(pair, return_inverse=True)
        rank += int(kinds[0] > 0)
        pointer = pointer[pointer]
    pair = rank * (rank.max() + 1) + rank[pointer]
    return np.unique(pair, return_inverse=True)[1]


def least_paths(arcs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, node, letter) of every step of the least path from each start, in order."""
    if len(starts) == 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    nodes, rank = np.arange(len(arcs)), ranked(arcs)
    order = np.where(arcs >= 0, np.arange(4) * (rank.max() + 1) + rank[arcs], np.iinfo(np.int64).max)
    choice, ends = order.argmin(axis=1), (arcs < 0).all(axis=1)
    pointers, steps = [np.where(ends, nodes, arcs[nodes, choice])], (~ends).astype(np.int64)
    while not ends[pointers[-1]].all():
        steps = steps + steps[pointers[-1]]
        pointers.append(pointers[-1][pointers[-1]])
    steps = steps + steps[pointers[-1]]
    lengths = steps[starts]
    path = np.repeat(np.arange(len(starts)), lengths)
    step = np.arange(len(path)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    node = np.repeat(starts, lengths)
    for j, pointer in enumerate(pointers):
        node = np.where(step >> j & 1, pointer[node], node)
    return path, node, choice[node]


class Piece(NamedTuple):
    conv: object
    lo: int
    hi: int


def pieces_of(convs: list) -> list[Piece]:
    """Runs of one conversation in an ordered slice."""
    cuts = [i for i in range(len(convs)) if i == 0 or convs[i] != convs[i - 1]] + [len(convs)]
    return [Piece(convs[a], a, b) for a, b in zip(cuts, cuts[1:])]


def whole_slice(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def piece_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last piece of a slice, which other slices may continue: costs from state to state, first and last initial."""
    table = whole_slice(batches)
    if table is None:
        return
    convs, initials, faults = (table.column(c).to_pylist() for c in ("conv_id", "initial", "fault"))
    found = pieces_of(convs)
    rows = []
    for p in found if len(found) < 2 else (found[0], found[-1]):
        cells = [costs_to_end(initials[p.lo : p.hi], faults[p.lo : p.hi], [0 if t == u else FAR for u in range(4)])[0] for t in range(4)]
        rows.append((p.conv, table.column("slice")[0].as_py(), [min(cells[t][s], FAR) for s in range(4) for t in range(4)], initials[p.lo], initials[p.hi - 1]))
    kind = pa.schema([("conv_id", table.schema.field("conv_id").type), ("slice", pa.int32()), ("costs", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string())])
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def costs_behind(pieces: pa.Table) -> pa.Table:
    """For each piece of a conversation that spans slices: the costs behind it by state, whether it is the last, the initial before it."""
    rows = sorted(zip(*(pieces.column(c).to_pylist() for c in ("slice", "costs", "last"))))
    conv, out, costs = pieces.column("conv_id")[0].as_py(), [], END
    for i in range(len(rows) - 1, -1, -1) if len(rows) > 1 else ():
        out.append((conv, rows[i][0], costs, i == len(rows) - 1, i == 0, rows[i - 1][2] if i else None))
        costs = [min(min(rows[i][1][4 * s + t] + costs[t] for t in range(4)), FAR) for s in range(4)]
    kind = pa.schema([("conv_id", pieces.schema.field("conv_id").type), ("slice", pa.int32()), ("behind", pa.list_(pa.int64())), ("is_last", pa.bool_()),
                      ("is_first", pa.bool_()), ("before", pa.string())])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 6, kind)], schema=kind)


def states_entered(pieces: pa.Table) -> pa.Table:
    """For each piece of a conversation that spans slices: the state in which the least path enters it."""
    rows = sorted(zip(pieces.column("slice").to_pylist(), pieces.column("exits").to_pylist()))
    conv, out, state = pieces.column("conv_id")[0].as_py(), [], NOTHING
    for at, exits in rows:
        out.append((conv, at, state))
        state = exits[state]
    kind = pa.schema([("conv_id", pieces.schema.field("conv_id").type), ("slice", pa.int32()), ("entry", pa.int32())])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)


def slice_paths(table: pa.Table, chosen: list[Piece], entries: list[list[int]]):
    """Least paths through pieces of a slice: (pieces with their node base, path, node, letter), one path per entry state."""
    convs, initials, faults, behind, is_last = (table.column(c).to_pylist() for c in ("conv_id", "initial", "fault", "behind", "is_last"))
    arcs, starts, owners, bases = [], [], [], []
    for p, states in zip(chosen, entries):
        whole = behind[p.lo] is None
        base = len(arcs)
        costs = costs_to_end(initials[p.lo : p.hi], faults[p.lo : p.hi], END if whole else behind[p.lo])
        arcs += optimal_arcs(initials[p.lo : p.hi], faults[p.lo : p.hi], costs, whole or is_last[p.lo], base)
        starts += [base + s for s in states]
        owners += [p] * len(states)
        bases += [base] * len(states)
    return owners, bases, *least_paths(np.array(arcs, dtype=np.int64).reshape(-1, 4), np.array(starts, dtype=np.int64))


def piece_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pieces of conversations that span slices: the state in which the least path leaves, by the state in which it enters."""
    table = whole_slice(batches)
    if table is None:
        return
    behind = table.column("behind")
    chosen = [p for p in pieces_of(table.column("conv_id").to_pylist()) if behind[p.lo].is_valid]
    owners, bases, path, node, letter = slice_paths(table, chosen, [[0, 1, 2, 3]] * len(chosen))
    rows = []
    for k, p in enumerate(chosen):
        exits = []
        for s in range(4):
            mine = np.flatnonzero(path == 4 * k + s)
            state = s
            for i in mine[np.isin(letter[mine], (0, 2, 3))][-1:]:  # the arc past the last row gives the state
                at, here = divmod(int(node[i]) - bases[4 * k], 4)
                initial = table.column("initial")[p.lo + at].as_py()
                state = here if letter[i] == 0 else KEEP[here][initial] if letter[i] == 2 else AFTER[here]
            exits.append(state)
        rows.append((p.conv, table.column("slice")[0].as_py(), exits))
    kind = pa.schema([("conv_id", table.schema.field("conv_id").type), ("slice", pa.int32()), ("exits", pa.list_(pa.int32()))])
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 3, kind)], schema=kind)


def slice_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per edit of the least path: letter, new role, and the row it concerns."""
    table = whole_slice(batches)
    if table is None:
        return
    found = pieces_of(table.column("conv_id").to_pylist())
    entry, initials, before = (table.column(c).to_pylist() for c in ("entry", "initial", "before"))
    owners, bases, path, node, letter = slice_paths(table, found, [[entry[p.lo] or NOTHING] for p in found])
    base = np.array(bases, dtype=np.int64)[path] if len(path) else path
    at, state = np.divmod(node - base, 4)
    row = np.array([p.lo for p in owners], dtype=np.int64)[path] + at if len(path) else path
    concerns = pa.array(row, mask=letter == 1)
    after = np.array(AFTER)[state]
    renamed = pa.array(np.where(after == USER, "user", "assistant").astype(object), pa.string(), mask=(letter != 1) & (letter != 3))
    illegal = [0 if (prev := before[i] if i == p.lo else initials[i - 1]) is None else int(prev + initials[i] not in LEGAL) for p in found for i in range(p.lo, p.hi)]
    columns = {
        "conv_id": pa.array([p.conv for p in owners], table.schema.field("conv_id").type).take(pa.array(path)),
        "slice": pa.array(np.full(len(path), table.column("slice")[0].as_py(), dtype=np.int32)),
        "step": pa.array(np.arange(len(path), dtype=np.int64)),
        "edit": pa.array(np.array(list(LETTERS), dtype=object)[letter], pa.string()),
        "new_role": renamed,
        **{c: table.column(c).combine_chunks().take(concerns) for c in ("turn", "sig", "fault")},
        "illegal": pa.array(illegal, pa.int32()).take(concerns),
    }
    out = pa.table(columns)
    yield from out.to_batches(max_chunksize=10_000)


# --- conversations on the cluster ------------------------------------------------------------------------------------


def ordered_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of (conv_id, turn, role, sig, fault, initial) in order, cut in slices; texts by (conv_id, turn, sig))."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lines = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    lines = lines.withColumn("sig", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    texts = lines.groupBy("conv_id", "turn", "sig").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    ends = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    fault = F.when(ends == "", BLANK).when(~ends.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    faces = durable(lines.withColumn("fault", fault).groupBy("conv_id", "turn", "role", "sig", "fault").agg(F.count(F.lit(1)).alias("n")))
    key = F.concat(F.to_json(F.struct("conv_id")), F.lit("/"), "sig")
    faces = faces.withColumn("key", key)
    firsts = faces.groupBy("key").agg(F.min(F.struct("turn")).alias("turn"), F.count(F.lit(1)).alias("faces")).filter("faces > 1")
    marked = join_groups(faces, durable(firsts), "key", "faces", F.xxhash64("turn", "key"), "_f_")
    later = F.coalesce(F.struct("turn") > F.col("_f_turn"), F.lit(False))
    # in steps of 1024, so that no list of copies is long
    many = marked.withColumn("later", later).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1024))))
    many = many.withColumn("copy", F.explode(F.sequence(F.col("_b") * 1024, F.least(F.col("n"), (F.col("_b") + 1) * 1024) - 1)))
    repeated = (F.col("fault") != BLANK) & (F.col("later") | (F.col("copy") > 0))
    each = many.select("conv_id", "turn", "role", "sig", "copy", F.when(repeated, REPEATED).otherwise(F.col("fault")).cast("int").alias("fault"),
                       F.substring("role", 1, 1).alias("initial"))
    total = faces.agg(F.sum("n")).first()[0] or 0
    order = ["conv_id", "turn", "role", "sig", "copy"]
    slices = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SLICE_ROWS))
    return durable(each.repartitionByRange(slices, *order).sortWithinPartitions(*order)), texts


def null_safe(a: DataFrame, b: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """Join on columns of one name, null with null; ``b``'s are dropped."""
    other = b.select(*[F.col(c).alias(f"_b_{c}" if c in names else c) for c in b.columns])
    met = F.lit(True)
    for c in names:
        met = met & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return a.join(other, met, how).drop(*[f"_b_{c}" for c in names])


def cheapest_edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits without texts, texts). Edits: (conv_id, slice, step, edit, new_role, turn, sig, fault, illegal), a written table."""
    ordered, texts = ordered_rows(rows)
    placed = ordered.withColumn("slice", F.spark_partition_id())
    conv = placed.schema["conv_id"].dataType.simpleString()
    parts = placed.select("conv_id", "slice", "initial", "fault")
    pieces = parts.mapInArrow(piece_costs, f"conv_id {conv}, slice int, costs array<long>, first string, last string")
    behind = durable(pieces.groupBy("conv_id").applyInArrow(
        costs_behind, f"conv_id {conv}, slice int, behind array<long>, is_last boolean, is_first boolean, before string"))  # a slice has two pieces at most
    known = null_safe(placed, F.broadcast(behind), ["conv_id", "slice"])  # two rows a slice of SLICE_ROWS at most
    exits = known.filter("behind is not null").select("conv_id", "slice", "initial", "fault", "behind", "is_last").mapInArrow(
        piece_exits, f"conv_id {conv}, slice int, exits array<int>")
    entered = durable(exits.groupBy("conv_id").applyInArrow(states_entered, f"conv_id {conv}, slice int, entry int"))
    known = null_safe(known, F.broadcast(entered), ["conv_id", "slice"])
    kind = f"conv_id {conv}, slice int, step long, edit string, new_role string, turn long, sig string, fault int, illegal int"
    edits = known.select("conv_id", "slice", "turn", "sig", "initial", "fault", "behind", "is_last", "before", "entry").mapInArrow(slice_edits, kind)
    return durable(edits), texts


def summaries(edits: DataFrame) -> DataFrame:
    """Counts and cost of each conversation from its edits."""
    undeleted_cut = (F.col("fault") == TRUNCATED) & F.col("edit").isin("K", "R")
    price = F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "I", INSERT).when(F.col("edit") == "R", RENAME).otherwise(0) + undeleted_cut.cast("int")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    turns = edits.filter("turn is not null").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    sums = edits.groupBy("conv_id").agg(
        count(F.col("fault") == BLANK)("blank"), count(F.col("fault") == REPEATED)("duplicate"), count(F.col("fault") == TRUNCATED)("truncated"),
        count(F.col("illegal"))("illegal"), count(price)("cost"))
    return null_safe(sums, gaps, ["conv_id"]).withColumn("gaps", F.coalesce("gaps", F.lit(0)))


class Repair(NamedTuple):
    edits: DataFrame
    summary: DataFrame


def repair_conversations(rows: DataFrame) -> Repair:
    """Edits with their texts, and a summary per conversation, of (conv_id, turn, role, text).

    ``edits``: (conv_id, slice, step, edit, turn, role, text, fault), in the order of slice and step; role and text are those after the edit and
    null for deleted rows, an inserted row has an empty text. ``summary``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost).
    Rows go by turn, nulls first, rows of one turn by role and then by a hash of role and text. A null role or text is one space, rows without
    a conv_id are one conversation, repeated rows are duplicates of the first, and other columns are not looked at. An empty table gives
    empty tables. Every slice of ``SLICE_ROWS`` rows or fewer is worked on by itself, however long its conversation.
    """
    edits, texts = cheapest_edits(rows)
    kept = edits.filter(F.col("edit").isin("K", "R"))
    written = null_safe(kept, texts, ["conv_id", "turn", "sig"], "inner").withColumn("role", F.coalesce("new_role", "role"))
    others = edits.filter(~F.col("edit").isin("K", "R")).withColumns({"role": F.col("new_role"), "text": F.when(F.col("edit") == "I", "")})
    columns = ["conv_id", "slice", "step", "edit", "turn", "role", "text", "fault"]
    return Repair(written.select(*columns).unionByName(others.select(*columns)), summaries(edits))


def digest_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and SHA-256 of conversations that come in order; only the audit of the present one is held."""
    conv, audit, sha, some, open_ = None, [], None, False, False
    kind = None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([conv], kind[0].type), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], schema=kind)

    for batch in batches:
        kind = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for c, edit, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "edit", "role", "text"))):
            if not open_ or c != conv:
                if open_:
                    yield done()
                conv, audit, sha, some, open_ = c, [], hashlib.sha256(), False, True
            audit.append(edit)
            if edit != "D":
                sha.update((("\n" if some else "") + f"{role}:{text}").encode())
                some = True
    if open_:
        yield done()


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256). A hash is a chain over its text, so a conversation's rows pass one task, in a sorted stream."""
    conv = edits.schema["conv_id"].dataType.simpleString()
    streamed = edits.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "step").select("conv_id", "edit", "role", "text")
    return streamed.mapInArrow(digest_stream, f"conv_id {conv}, audit string, repaired_sha256 string")


def repair_report(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``, with what the repair of its ``damaged`` rows found; zeros and nothing where none is left."""
    repaired = repair_conversations(damaged)
    found = null_safe(repaired.summary, digests(repaired.edits), ["conv_id"])
    every = null_safe(rows.select("conv_id").distinct(), found, ["conv_id"])
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
