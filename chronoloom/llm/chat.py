"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation; it
may end with either. Dynamic programming over this automaton chooses, for each turn, the role it
gets: keeping it is free, relabelling, merging into the turn before and inserting an empty turn
cost what COSTS says. Steps of the automaton are min-plus matrices, so a conversation can be cut
anywhere: all turns are sorted together into parts, runs of a conversation inside a part are cut into
blocks, and the blocks' matrices are folded side by side. A conversation that is one block is
repaired at once; for the others the states at the borders follow from the folds, first over
parts, then over the blocks of a part, and each block is then traced by itself. No conversation has
to fit in one task, whatever its turn numbers are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import small, stash

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "developer": "system"}
#: Costs in integer units: relabelling between user and assistant, to or from system, an unknown role; a merge; an empty turn.
COSTS = {"relabel": 6, "system": 8, "unknown": 2, "merge": 3, "insert": 5}
BLOCK_TURNS = 64
INFINITE = 1 << 40

#: State 0 is the start; 1 to 3 follow a turn of ROLES.
STATES = 4
_LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


def role_of(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return role if role in ROLES else None


def _relabel(role: str | None, to: str) -> int:
    if role == to:
        return 0
    if role is None:
        return COSTS["unknown"]
    return COSTS["system"] if "system" in (role, to) else COSTS["relabel"]


def _steps() -> dict:
    """For each role: from state s to state t, (cost, inserted roles, merged)."""
    out = {}
    for role in (*ROLES, None):
        for s in range(STATES):
            for t in range(1, STATES):
                best = None
                if s == t:
                    best = (COSTS["merge"], (), True)
                elif t in _LEGAL[s]:
                    best = (0, (), False)
                for mid in _LEGAL[s]:
                    if t in _LEGAL[mid] and (best is None or COSTS["insert"] < best[0]):
                        best = (COSTS["insert"], (ROLES[mid - 1],), False)
                if best is not None:
                    out[role, s, t] = (best[0] + _relabel(role, ROLES[t - 1]), *best[1:])
    return out


STEPS = _steps()
#: Codes of roles: 0 to 2 as in ROLES, 3 for any other; -1 pads a block.
UNKNOWN = len(ROLES)
_ROLE_CODES = {r: k for k, r in enumerate((*ROLES, None))}
#: Costs by role, state before, state after; what is inserted (a role's code, -1 for nothing) and whether the turn is merged.
_COST = np.full((4, STATES, STATES), INFINITE, np.int64)
_INSERT, _MERGE = np.full((4, STATES, STATES), -1, np.int64), np.zeros((4, STATES, STATES), bool)
for (_r, _s, _t), (_c, _mid, _merged) in STEPS.items():
    _COST[_ROLE_CODES[_r], _s, _t], _MERGE[_ROLE_CODES[_r], _s, _t] = _c, _merged
    if _mid:
        _INSERT[_ROLE_CODES[_r], _s, _t] = ROLES.index(_mid[0])
_NOTHING = np.where(np.eye(STATES, dtype=bool), 0, INFINITE)
ACTIONS = ("keep", "relabel", "merge", "insert")
#: Characters by which texts are ordered where turns tie; they are sampled for the borders of parts.
TIE_CHARS = 256
#: Salts that let a range of equal turns be split.
SALTS = 1024

TURN_SCHEMA = "conv_id long, part long, block long, nth int, turn long, role string, text string, code int, state int, action int, cost long"


def fold(codes: np.ndarray) -> np.ndarray:
    """The least cost from each state to each state over the turns of each block; a row of codes a block."""
    total = np.broadcast_to(_NOTHING, (len(codes), STATES, STATES))
    for k in range(codes.shape[1]):
        live = codes[:, k] >= 0
        step = np.where(live[:, None, None], _COST[codes[:, k]], _NOTHING)
        total = np.minimum((total[:, :, :, None] + step[:, None]).min(axis=2), INFINITE)
    return total


def trace(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each turn on the cheapest path of each block; ties to the lowest state before."""
    n, most = codes.shape
    best = np.full((n, STATES), INFINITE, np.int64)
    best[np.arange(n), start] = 0
    back = np.zeros((most, n, STATES), np.int64)
    for k in range(most):
        live = codes[:, k] >= 0
        every = best[:, :, None] + np.where(live[:, None, None], _COST[codes[:, k]], _NOTHING)
        back[k], best = every.argmin(axis=1), np.minimum(every.min(axis=1), INFINITE)
    before, after, now = np.zeros((n, most), np.int64), np.zeros((n, most), np.int64), stop.copy()
    for k in reversed(range(most)):
        after[:, k] = now
        now = back[k][np.arange(n), now]
        before[:, k] = now
    return before, after


def _grid(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The codes of each block as a row, padded with -1."""
    out = np.full((len(sizes), int(sizes.max(initial=0))), -1, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(codes)) - starts[row]] = codes
    return out


def _paths(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """trace() of blocks that lie one after another in codes, as flat as they came; blocks of like size go together."""
    before, after = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for low in (0, 4, 16):
        pick = np.flatnonzero((sizes > low) & (sizes <= (4, 16, 1 << 40)[(0, 4, 16).index(low)]))
        if len(pick):
            n = sizes[pick]
            row = np.repeat(np.arange(len(pick)), n)
            inner = np.arange(int(n.sum())) - (np.cumsum(n) - n)[row]
            flat = starts[pick][row] + inner
            grid = np.full((len(pick), int(n.max())), -1, np.int64)
            grid[row, inner] = codes[flat]
            b, a = trace(grid, start[pick], stop[pick])
            before[flat], after[flat] = b[row, inner], a[row, inner]
    return before, after


def _steps_taken(codes: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each turn: its action's code, and the role inserted before it or -1."""
    merged = _MERGE[codes, before, after]
    action = np.where(merged, 2, np.where(codes == after - 1, 0, 1))
    return action, _INSERT[codes, before, after]


def _codes(roles: pa.Array) -> np.ndarray:
    """The code of each role; each different spelling is looked at once."""
    coded = (roles.combine_chunks() if isinstance(roles, pa.ChunkedArray) else roles).dictionary_encode()
    table = np.array([*(_ROLE_CODES[role_of(r)] for r in coded.dictionary.to_pylist()), UNKNOWN], np.int64)
    return table[coded.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in blocks; a conversation that a batch holds whole in one block is repaired already."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv_id")
        same = conv.slice(1).equals(conv.slice(0, n - 1)) if n > 1 else True
        ids, none = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
        fresh = np.ones(n, bool)
        if n > 1:
            fresh[1:] = False if same else (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
        first = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        inner = np.arange(n) - first[run]
        cut = fresh | (inner % BLOCK_TURNS == 0)
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, n))
        block = np.cumsum(cut) - 1
        codes = _codes(batch.column("role"))
        # the first and the last conversation of a batch may go on outside it
        blocks_of = np.bincount(run[starts], minlength=len(first))
        alone = blocks_of[run[starts]] == 1
        alone[run[starts] == 0] = alone[run[starts] == len(first) - 1] = False
        costs = np.full(len(starts), INFINITE, np.int64)
        stop = np.zeros(len(starts), np.int64)
        state, action, cost = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if alone.any():
            whole = _whole_costs(codes, starts, sizes)
            stop[alone], costs[alone] = whole[alone].argmin(axis=1), whole[alone].min(axis=1)
            before, after = _paths(codes, starts, np.where(alone, sizes, 0), np.zeros(len(starts), np.int64), stop)
            mine = alone[block]
            act, put = _steps_taken(codes, before, np.maximum(after, 1))
            # a turn's own action in the low digits, the role inserted before it above
            state[mine], action[mine], cost[mine] = after[mine], act[mine] + 4 * (put[mine] + 1), costs[block][mine]
        cols = [conv, pa.array(np.full(n, part, np.int64)), pa.array(block + at), pa.array((np.arange(n) - starts[block]).astype(np.int32)), batch.column("turn"), batch.column("role"), batch.column("text"), pa.array(codes.astype(np.int32)), pa.array(state.astype(np.int32)), pa.array(action.astype(np.int32)), pa.array(cost)]
        at += len(starts)
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in TURN_SCHEMA.split(", ")])


def _whole_costs(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least cost from the start state to each state over each block."""
    out = np.full((len(sizes), STATES), INFINITE, np.int64)
    for low, high in ((0, 4), (4, 16), (16, 1 << 40)):
        pick = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(pick):
            flat = np.concatenate([codes[s : s + n] for s, n in zip(starts[pick].tolist(), sizes[pick].tolist())])
            out[pick] = fold(_grid(flat, np.cumsum(sizes[pick]) - sizes[pick], sizes[pick]))[:, 0]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of equal keys over the sorted rows of a partition; of bounded size, a row a block or a part."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != now:
                yield rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield rows


def _fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            lists = batch.column("codes")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            costs = fold(_grid(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes) - sizes, sizes))
            cols = [batch.column(c) for c in ("conv_id", "part", "block")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(costs.reshape(len(sizes), -1).tolist(), pa.list_(pa.int64()))], ["conv_id", "part", "block", "cost"])


def _merge_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of all blocks that a conversation has in a part."""
    for rows in _runs(batches, ["conv_id", "part"]):
        total = _NOTHING
        for r in rows:
            total = np.minimum((total[:, :, None] + np.array(r["cost"], np.int64).reshape(STATES, STATES)[None]).min(axis=1), INFINITE)
        yield pa.RecordBatch.from_pylist([{"conv_id": rows[0]["conv_id"], "part": rows[0]["part"], "cost": total.ravel().tolist()}], pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("cost", pa.list_(pa.int64()))]))


def _borders(keys: list[str], each: str, ends: bool):
    """States around each row's matrix on the cheapest way through a run of them; ends: the run's own are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, keys):
            mats = [np.array(r["cost"], np.int64).reshape(STATES, STATES) for r in rows]
            ahead = [np.zeros(STATES, np.int64)]  # the least cost from a state before a matrix to the end
            ahead[0][0] = INFINITE
            if ends:
                ahead[0][:] = INFINITE
                ahead[0][rows[0]["stop"]] = 0
            for m in reversed(mats):
                ahead.append(np.minimum((m + ahead[-1][None]).min(axis=1), INFINITE))
            ahead.reverse()
            state = rows[0]["start"] if ends else 0
            states = [state]
            for k, m in enumerate(mats):
                state = int(np.argmin(m[state] + ahead[k + 1]))
                states.append(state)
            total = rows[0]["total"] if ends else int(ahead[0][0])
            n = len(rows)
            cols = [pa.array([r[c] for r in rows], pa.int64()) for c in ("conv_id", "part", each)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()), pa.array([total] * n, pa.int64())], ["conv_id", "part", each, "start", "stop", "total"])

    return run


def _trace_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            lists = batch.column("codes")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            before, after = _paths(codes, np.cumsum(sizes) - sizes, sizes, *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop")))
            action, put = _steps_taken(codes, before, after)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            inner = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[rows]
            cols = [batch.column(c).take(pa.array(rows)) for c in ("part", "block")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(inner.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array((action + 4 * (put + 1)).astype(np.int32)), batch.column("total").take(pa.array(rows))], ["part", "block", "nth", "state", "action", "cost"])


def _joined_blocks(turns: DataFrame) -> DataFrame:
    """(part, block, nth, state, action, cost) of the turns whose conversation is not one block of one batch."""
    blocks = turns.groupBy("conv_id", "part", "block").agg(F.sort_array(F.collect_list(F.struct("nth", "code"))).alias("turns"))
    blocks = stash(blocks.select("conv_id", "part", "block", F.col("turns.code").alias("codes")), "blocks")
    costs = stash(blocks.mapInArrow(_fold_blocks, "conv_id long, part long, block long, cost array<long>"), "folds")
    conv = F.col("conv_id").asc_nulls_first()
    in_part = costs.repartition("conv_id", "part").sortWithinPartitions(conv, "part", "block")
    parts = stash(in_part.mapInArrow(_merge_folds, "conv_id long, part long, cost array<long>"), "parts")
    over_parts = parts.withColumn("whole", F.lit(0).cast("long")).repartition("conv_id").sortWithinPartitions(conv, "part")
    ends = over_parts.mapInArrow(_borders(["conv_id"], "whole", False), "conv_id long, part long, whole long, start int, stop int, total long")
    ends = stash(ends.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "start", "stop", "total"), "ends")
    given = costs.join(small(ends), costs.conv_id.eqNullSafe(ends.c) & (costs.part == ends.p)).drop("c", "p")
    given = given.repartition("conv_id", "part").sortWithinPartitions(conv, "part", "block")
    borders = given.mapInArrow(_borders(["conv_id", "part"], "block", True), "conv_id long, part long, block long, start int, stop int, total long")
    met = blocks.drop("conv_id").join(borders.drop("conv_id"), ["part", "block"])
    return met.mapInArrow(_trace_blocks, "part long, block long, nth int, state int, action int, cost long")


def escaped(text: Column) -> Column:
    """text in which no turn can begin: "<|" becomes "<\\|", and each such run of backslashes one longer."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def repair_roles(turns: DataFrame) -> DataFrame:
    """One row for each turn that is kept, relabelled, merged or inserted, in the repaired order.

    turns: conv_id, turn, role, text. Result: conv_id, block, nth and part (which order the rows of a
    conversation), turn (of the input row it stands for or precedes), role (repaired), text, action,
    merged (it continues the turn before), cost (of the whole conversation), rendered. Turns are
    ordered by turn, nulls first, ties by role and text, of texts that begin with the same TIE_CHARS characters by
    a hash, so that the order does not follow files; rows that repeat are turns of their own. A
    null conv_id is a conversation of its own; null texts are empty; a null or unknown role costs
    less to relabel. Rendered texts of any length cannot begin a turn: see escaped(). Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.substring("text", 1, TIE_CHARS).asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order, salt).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    cut = stash(placed.mapInArrow(_cut, TURN_SCHEMA), "turns")
    later = cut.where("state < 0")
    if later.limit(1).count():
        found = _joined_blocks(later.select("conv_id", "part", "block", "nth", "code"))
        later = later.drop("state", "action", "cost").join(found, ["part", "block", "nth"]).select(cut.columns)
    done = cut.where("state >= 0").unionByName(later)
    code, put = F.col("action") % 4, F.floor(F.col("action") / 4).cast("int")
    name = lambda k: F.element_at(F.array(*map(F.lit, ROLES)), k)
    own = F.struct(F.lit(1).alias("part"), name(F.col("state")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.element_at(F.array(*map(F.lit, ACTIONS)), code + 1).alias("action"), (code == 2).alias("merged"))
    extra = F.struct(F.lit(0).alias("part"), name(F.greatest(put, F.lit(1))).alias("role"), F.lit("").alias("text"), F.lit("insert").alias("action"), F.lit(False).alias("merged"))
    both = F.array_compact(F.array(F.when(put > 0, extra), own))
    out = done.select("conv_id", (F.shiftleft(F.col("part"), 32) + F.col("block")).alias("block"), F.col("nth").cast("long").alias("nth"), "turn", "cost", F.explode(both).alias("r"))
    head = F.when(F.col("r.merged"), F.lit("")).otherwise(F.concat(F.lit("<|"), F.col("r.role"), F.lit("|>\n")))
    return out.select("conv_id", "block", "nth", "r.part", "turn", "r.role", "r.text", "r.action", "r.merged", "cost", F.concat(head, escaped(F.col("r.text")), F.lit("\n")).alias("rendered"))


def rendered(repaired: DataFrame) -> DataFrame:
    """(conv_id, n_turns, cost, text): the rendered pieces of each conversation in order.

    For conversations that fit a row; longer ones stay in the pieces of repair_roles().
    """
    piece = F.sort_array(F.collect_list(F.struct("block", "nth", "part", "rendered")))
    whole = repaired.groupBy("conv_id").agg(F.count_if(~F.col("merged")).alias("n_turns"), F.max("cost").alias("cost"), piece.alias("pieces"))
    return whole.select("conv_id", "n_turns", "cost", F.array_join(F.transform("pieces", lambda p: p.rendered), "").alias("text"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
