"""Repair of a conversation's structure at the least cost, by layers of cost.

A repaired conversation is empty or an optional system turn, then user and assistant turns in pairs.
Its grammar has four states; for every turn and every cost, in increasing order, a bitset holds
the states from which the rest can be finished at exactly that cost. A layer follows from lower
ones by table look-ups on whole sets, for many conversations at once. The first layer that holds the
start state at the first turn is the least cost; from there the bits are traced forward, taking the
least letter whose state lies in the layer that is left.

Turns are sorted together into parts; a conversation that lies inside a part is repaired at once.
One that crosses a border or is very long is cut into chunks: sets of state pairs give each chunk's
least costs from state to state, a pass over chunks in reverse carries the costs to the end, each
chunk tells where it leads from each state, and a pass forward carries the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import hot_join, stash

DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = np.frombuffer(b"DIKR", np.uint8)
COST_DELETE, COST_INSERT, COST_REROLE, COST_TRUNCATED = 2, 5, 1, 5
#: Faults of a turn; a GONE row is no turn, but its conversation is reported.
SOUND, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
#: States: the start, after a system, a user, an assistant turn. The turn of an initial (s, u, a, other) leads from each state to NEXT or nowhere.
STATES, ENDS = 4, 0b1001
_KEPT = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
#: The state after a user or assistant turn that the grammar allows, whatever its role was.
_PUT = np.array([2, 2, 3, 2])
_KEEP_TO = np.full((4, STATES), -1)
for _role, _moves in _KEPT.items():
    for _s, _t in _moves.items():
        _KEEP_TO[_role, _s] = _t
#: Neighbouring initials that a sound conversation may have.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
INFINITE = 1 << 40
#: Turns of a block, of a chunk, and bytes of text at which a chunk ends; the longest conversation that is repaired in one piece.
BLOCK, CHUNK_TURNS, CHUNK_BYTES, WHOLE = 16, 4096, 1 << 22, 64
#: Rows of repeated turns up to which they are sent to all tasks.
REPEATED_ROWS = 200_000


def _before(moves: np.ndarray, pairs: int) -> np.ndarray:
    """For each set of (state, end) bits the set of those that one move leads into it; pairs ends side by side."""
    sets = np.arange(1 << STATES * pairs)
    out = np.zeros(len(sets), np.uint16)
    for end in range(pairs):
        for s, t in enumerate(moves.tolist()):
            if t >= 0:
                out |= ((sets >> (end * STATES + t) & 1) << (end * STATES + s)).astype(np.uint16)
    return out


_PRE_PUT = {n: _before(_PUT, n) for n in (1, STATES)}
_PRE_KEEP = {n: np.stack([_before(m, n) for m in _KEEP_TO]) for n in (1, STATES)}


def layers(grid: np.ndarray, first: np.ndarray, most: int, until: int | None = None) -> np.ndarray:
    """sets[turn, cost, row]: the states (or, of 16 bits, the state pairs) from which a row's rest costs exactly that.

    grid: a row's turns as 4 x class + initial (class 0 sound, 1 truncated, 2 to be deleted), -1 for
    padding at its end; first[cost, row]: the sets after the last turn. Stops at cost most, or where
    each row's first set has held the state until.
    """
    rows, turns = grid.shape
    pairs = STATES if first.dtype == np.uint16 else 1
    put, keep = _PRE_PUT[pairs], _PRE_KEEP[pairs]
    kind = np.uint16 if pairs > 1 else np.uint8
    put, keep = put.astype(kind), keep.astype(kind)
    sets = np.zeros((turns + 1, most + 1, rows), kind)
    none = np.zeros(rows, kind)
    cls, role, pad = grid >> 2, grid & 3, grid < 0
    done = np.zeros(rows, bool)
    truncated = [bool((cls[:, i] == 1).any()) for i in range(turns)]
    padded = [bool(pad[:, i].any()) for i in range(turns)]
    for c in range(most + 1):
        at = lambda i, k: sets[i, c - k] if c >= k else none  # noqa: E731, B023
        sets[turns, c] = (first[c] if c < len(first) else none) | put[at(turns, COST_INSERT)]
        for i in reversed(range(turns)):
            stay, moved = at(i + 1, 0), at(i + 1, COST_REROLE)
            if truncated[i]:
                late = cls[:, i] == 1
                stay, moved = np.where(late, at(i + 1, COST_TRUNCATED), stay), np.where(late, at(i + 1, COST_TRUNCATED + COST_REROLE), moved)
            used = keep[role[:, i], stay] | put[moved]
            used[cls[:, i] == 2] = 0
            new = used | at(i + 1, COST_DELETE) | put[at(i, COST_INSERT)]
            sets[i, c] = np.where(pad[:, i], sets[i + 1, c], new) if padded[i] else new
        if until is not None:
            done |= (sets[0, c] >> until & 1).astype(bool)
            if done.all():
                return sets[:, : c + 1]
    return sets


def trace(grid: np.ndarray, sets: np.ndarray, first: np.ndarray, state: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, turns, states after, last state) of each row's least audit at exactly its cost; a column a step, -1 where a row is done."""
    rows = np.arange(len(grid))
    size = (grid >= 0).sum(axis=1)
    i, state, cost = np.zeros(len(grid), np.int64), state.astype(np.int64), cost.astype(np.int64)
    held = lambda i, c, s: (c >= 0) & (s >= 0) & (sets[i, np.clip(c, 0, sets.shape[1] - 1), rows] >> np.maximum(s, 0) & 1).astype(bool)
    steps = []
    while True:
        live = (i < size) | ~((cost < len(first)) & (first[np.minimum(cost, len(first) - 1), rows] >> state & 1).astype(bool))
        if not live.any():
            break
        inside = i < size
        code = np.where(inside, grid[rows, np.minimum(i, grid.shape[1] - 1)] if grid.shape[1] else 0, 8)
        more = np.minimum(i + 1, sets.shape[0] - 1)
        late = np.where(code >> 2 == 1, COST_TRUNCATED, 0)
        use, put, kept = inside & (code < 8), _PUT[state], _KEEP_TO[code & 3, state]
        letter = np.where(use & held(more, cost - late, kept), KEEP, REROLE)
        letter = np.where(held(i, cost - COST_INSERT, put), INSERT, letter)
        letter = np.where(inside & held(more, cost - COST_DELETE, state), DELETE, letter)
        after = np.choose(letter, [state, put, kept, put])
        price = np.choose(letter, [np.full_like(cost, COST_DELETE), np.full_like(cost, COST_INSERT), late, late + COST_REROLE])
        steps.append((np.where(live, letter, -1), i.copy(), after))
        state, cost = np.where(live, after, state), np.where(live, cost - price, cost)
        i = np.where(live & (letter != INSERT), i + 1, i)
    if not steps:
        empty = np.zeros((len(grid), 0), np.int64)
        return empty, empty, empty, state
    return *(np.stack(x, axis=1) for x in zip(*steps)), state


def _grid(codes: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of codes that lie one after another, padded to width."""
    out = np.full((len(sizes), width), -1, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = codes
    return out


def whole_rows(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cost of each row, then of all steps in order: row, letter, turn of the row, state after) of rows of WHOLE turns at most."""
    costs, found = np.zeros(len(sizes), np.int64), []
    starts = np.cumsum(sizes) - sizes
    low = -1
    for high in (0, 2, 4, 8, 16, 32, WHOLE):
        pick = np.flatnonzero((sizes > low) & (sizes <= high))
        low = high
        if not len(pick):
            continue
        n = sizes[pick]
        flat = np.repeat(starts[pick] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        grid = _grid(codes[flat], n, high)
        first = np.full((1, len(pick)), ENDS, np.uint8)
        sets = layers(grid, first, COST_DELETE * high, 0)
        costs[pick] = ((sets[0] & 1) > 0).argmax(axis=0)
        letter, turn, after, _ = trace(grid, sets, first, np.zeros(len(pick), np.int64), costs[pick])
        r, s = np.nonzero(letter >= 0)
        found.append((pick[r], letter[r, s], turn[r, s], after[r, s]))
    row, letter, turn, after = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (zip(*found) if found else [()] * 4))
    order = np.argsort(row, kind="stable")
    return costs, row[order], letter[order], turn[order], after[order]


def _blocks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.full(-(-len(codes) // BLOCK), BLOCK)
    if len(codes) % BLOCK:
        sizes[-1] = len(codes) % BLOCK
    grid = _grid(codes, sizes, BLOCK)
    most = COST_DELETE * BLOCK + 2 * COST_INSERT
    first = np.full((1, len(sizes)), sum(1 << (STATES * s + s) for s in range(STATES)), np.uint16)
    sets = layers(grid, first, most)[0]
    bits = (sets[:, :, None] >> np.arange(STATES * STATES)[None, None] & 1).astype(bool)
    cost = np.where(bits.any(axis=0), bits.argmax(axis=0), INFINITE).reshape(len(sizes), STATES, STATES)
    return grid, cost.transpose(0, 2, 1)


def fold(codes: np.ndarray) -> np.ndarray:
    """The least cost from each state to each state over a chunk's turns."""
    total = np.where(np.eye(STATES, dtype=bool), 0, INFINITE)
    for m in _blocks(codes)[1] if len(codes) else ():
        total = np.minimum((total[:, :, None] + m[None]).min(axis=1), INFINITE)
    return total


def chunk_steps(codes: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, list]:
    """Where a chunk leads from each state on the least audit, if states after it cost ahead to the end; and for each start its (letters, turns, states)."""
    if not len(codes):
        return np.arange(STATES), [(np.zeros(0, np.int64),) * 3] * STATES
    grid, costs = _blocks(codes)
    n = len(grid)
    after = np.empty((n, STATES), np.int64)
    now = np.minimum(ahead, INFINITE)
    for k in reversed(range(n)):
        after[k] = now
        now = np.minimum((costs[k] + now[None]).min(axis=1), INFINITE)
    base = after.min(axis=1)
    spread = np.where(after < INFINITE, after - base[:, None], -1)
    first = np.zeros((int(spread.max()) + 1, n), np.uint8)
    for s in range(STATES):
        ok = spread[:, s] >= 0
        first[spread[ok, s], np.flatnonzero(ok)] |= np.uint8(1 << s)
    sets = layers(grid, first, COST_DELETE * BLOCK + 2 * COST_INSERT + len(first))
    cost = np.minimum((costs + after[:, None]).min(axis=2), INFINITE) - base[:, None]
    every = []
    for s in range(STATES):
        can = cost[:, s] < sets.shape[1]
        pick = np.flatnonzero(can)
        got = trace(grid[pick], sets[:, :, pick], first[:, pick], np.full(len(pick), s), cost[pick, s])
        every.append((dict(zip(pick.tolist(), range(len(pick)))), got))
    ends, steps = np.full(STATES, -1), []
    for s in range(STATES):
        state, parts = s, []
        for k in range(n):
            where, (letter, turn, to, last) = every[state]
            if k not in where:
                state = -1
                break
            r = where[k]
            mine = letter[r] >= 0
            parts.append((letter[r][mine], turn[r][mine] + k * BLOCK, to[r][mine]))
            state = int(last[r])
        ends[s] = state
        steps.append(tuple(np.concatenate(x) for x in zip(*parts)) if parts and state >= 0 else (np.zeros(0, np.int64),) * 3)
    return ends, steps


# ---- Spark ---------------------------------------------------------------------------------------

STATS = "turns long, low long, high long, numbers long, blank long, duplicate long, truncated long, illegal long"
CUT_SCHEMA = f"conv_id long, part long, chunk long, whole boolean, {STATS}, cost long, audit string, roles array<string>, texts array<string>, codes binary, fold array<long>, head int, tail int, first_turn long, last_turn long"
_NAMES = [c.split()[0] for c in CUT_SCHEMA.split(", ")]


def _repaired(roles: pa.Array, texts: pa.Array, counts: np.ndarray, letter: np.ndarray, at: np.ndarray, after: np.ndarray):
    """Audits, roles and texts of the repaired turns as Arrow arrays; at: the input row of each step."""
    raw = LETTERS[letter].tobytes()
    steps = np.concatenate(([0], np.cumsum(counts)))
    audit = pa.StringArray.from_buffers(len(counts), pa.py_buffer(steps.astype(np.int32)), pa.py_buffer(raw))
    kept = letter != DELETE
    n = len(roles)
    role = np.where(letter == KEEP, at, n + (after == 3))[kept]
    text = np.where(letter == INSERT, n, at)[kept]
    ends = np.concatenate(([0], np.cumsum(kept)))[steps].astype(np.int32)
    pick = lambda col, extra, index: pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([col, pa.array(extra, pa.string())]).take(pa.array(index)))
    return audit, pick(roles, ["user", "assistant"], role), pick(texts, [""], text)


class _Turns:
    """Sorted turns of one Arrow table as arrays, and their runs of one conversation each."""

    def __init__(self, table: pa.Table):
        batch = table.combine_chunks()
        col = lambda name: batch.column(name).chunk(0) if batch.num_rows else pa.array([], batch.schema.field(name).type)
        self.conv, turn, self.roles, self.texts = col("conv_id"), col("turn"), col("role"), col("text")
        self.fault = col("fault").to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(self.fault)
        ids, none = self.conv.fill_null(0).to_numpy(zero_copy_only=False), self.conv.is_null().to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
        self.starts = np.flatnonzero(new)
        self.stops = np.append(self.starts[1:], n)
        self.turn, self.numbered = turn.fill_null(0).to_numpy(zero_copy_only=False), turn.is_valid().to_numpy(zero_copy_only=False)
        coded = self.roles.dictionary_encode()
        initial = {"s": 0, "u": 1, "a": 2}
        table = np.array([*(initial.get((r or " ")[:1], 3) for r in coded.dictionary.to_pylist()), 3])
        self.initial = table[coded.indices.to_numpy(zero_copy_only=False)] if n else np.zeros(0, np.int64)
        self.codes = self.initial + 4 * np.select([self.fault == SOUND, self.fault == TRUNCATED], [0, 1], 2)

    def stats(self, rows: np.ndarray, sizes: np.ndarray) -> dict[str, list | np.ndarray]:
        """STATS of runs of rows that follow one another, with the first and last initials and turns."""
        n = len(sizes)
        group = np.repeat(np.arange(n), sizes)
        count = lambda mask: np.bincount(group[mask], minlength=n)
        fault, turn, ok, initial = self.fault[rows], self.turn[rows], self.numbered[rows], self.initial[rows]
        same = np.zeros(len(rows), bool)
        same[1:] = group[1:] == group[:-1]
        fresh = ok.copy()
        fresh[1:] &= ~(same[1:] & ok[:-1] & (turn[1:] == turn[:-1]))
        broken = same.copy()
        broken[1:] &= ~_LEGAL[initial[:-1], initial[1:]]
        low, high = np.full(n, INFINITE << 20), np.full(n, -(INFINITE << 20))
        np.minimum.at(low, group[ok], turn[ok])
        np.maximum.at(high, group[ok], turn[ok])
        none = pa.array(count(ok) == 0)
        first = np.minimum(np.cumsum(sizes) - sizes, max(len(rows) - 1, 0))
        last = np.maximum(np.cumsum(sizes) - 1, 0)
        some = sizes > 0
        edge = lambda at: pa.array(turn[at] if len(rows) else np.zeros(n, np.int64), mask=~(some & ok[at]) if len(rows) else ~some)
        code = lambda at: pa.array(np.where(some, initial[at], -1) if len(rows) else np.full(n, -1)).cast(pa.int32())
        empty = lambda values: pa.array(values, mask=none.to_numpy(zero_copy_only=False))
        return {"turns": pa.array(sizes), "low": empty(low), "high": empty(high), "numbers": pa.array(count(fresh)), "blank": pa.array(count(fault == BLANK)), "duplicate": pa.array(count(fault == DUPLICATE)), "truncated": pa.array(count(fault == TRUNCATED)), "illegal": pa.array(count(broken)), "head": code(first), "tail": code(last), "first_turn": edge(first), "last_turn": edge(last)}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations repaired where a part holds them whole, chunks of the others."""
    part, chunk = TaskContext.get().partitionId(), 0
    rest, crossing = None, True  # crossing: the first run may have begun before

    def rows(t: _Turns, runs: np.ndarray, open_: bool):
        """Output for runs: each run a row, or if open each run's chunks."""
        nonlocal chunk
        inside = np.concatenate([np.arange(t.starts[r], t.stops[r]) for r in runs] or [np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(runs)), t.stops[runs] - t.starts[runs])
        live = t.fault[inside] != GONE
        inside, owner = inside[live], owner[live]
        sizes = np.bincount(owner, minlength=len(runs))
        conv = t.conv.take(pa.array(t.starts[runs]))
        if open_:
            cuts = []
            wide = pc.binary_length(t.texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, n in enumerate(sizes.tolist()):
                size = np.cumsum(wide[inside[owner == k]])
                at, done = 0, 0
                while at < n or n == 0:
                    stop = min(n, at + CHUNK_TURNS, max(at + 1, int(np.searchsorted(size, done + CHUNK_BYTES, "right"))))
                    cuts.append((k, stop - at))
                    if n == 0:
                        break
                    done, at = int(size[stop - 1]), stop
            of, sizes = (np.array(x, np.int64) for x in zip(*cuts))
            conv = conv.take(pa.array(of))
        n = len(sizes)
        out = t.stats(inside, sizes)
        roles, texts = t.roles.take(pa.array(inside)), t.texts.take(pa.array(inside))
        codes = t.codes[inside]
        starts = np.cumsum(sizes) - sizes
        if open_:
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            out |= {"cost": pa.nulls(n, pa.int64()), "audit": pa.nulls(n, pa.string()), "roles": pa.ListArray.from_arrays(ends, roles), "texts": pa.ListArray.from_arrays(ends, texts)}
            mine = [codes[s : s + m] for s, m in zip(starts.tolist(), sizes.tolist())]
            out |= {"codes": pa.array([m.astype(np.uint8).tobytes() for m in mine], pa.binary()), "fold": pa.array([fold(m).ravel().tolist() for m in mine], pa.list_(pa.int64()))}
        else:
            costs, row, letter, turn, after = whole_rows(codes, sizes)
            audit, roles, texts = _repaired(roles, texts, np.bincount(row, minlength=n), letter, np.where(letter == INSERT, 0, starts[row] + turn), after)
            out |= {"cost": pa.array(costs), "audit": audit, "roles": roles, "texts": texts, "codes": pa.nulls(n, pa.binary()), "fold": pa.nulls(n, pa.list_(pa.int64()))}
        out |= {"conv_id": conv, "part": pa.array(np.full(n, part, np.int64)), "chunk": pa.array(np.arange(chunk, chunk + n)), "whole": pa.array(np.full(n, not open_))}
        chunk += n
        return pa.RecordBatch.from_pydict({name: out[name] for name in _NAMES})

    def flush(t: _Turns, runs: np.ndarray, crossed: list[int]):
        cut = np.isin(runs, crossed) | (t.stops[runs] - t.starts[runs] > WHOLE)
        for pick, open_ in ((runs[~cut], False), (runs[cut], True)):
            if len(pick):
                yield rows(t, pick, open_)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        t = _Turns(table)
        runs = np.arange(len(t.starts))
        last = len(runs) - 1
        if len(runs) > 1:
            yield from flush(t, runs[:-1], [0] if crossing else [])
            crossing = False
        rest = table.slice(int(t.starts[last]))
        if rest.num_rows > CHUNK_TURNS or rest.nbytes > 4 * CHUNK_BYTES:
            yield from flush(t, runs[-1:], [last])
            rest, crossing = None, True  # what follows may belong to it
    if rest is not None and rest.num_rows:
        t = _Turns(rest)
        yield from flush(t, np.arange(1), [0])


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows one by one, and whether one begins a conversation."""
    now: object = batches  # no id
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            yield row["conv_id"] != now, row
            now = row["conv_id"]


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks in reverse order: what each state after them costs to the end."""
    end = np.where([ENDS >> s & 1 for s in range(STATES)], 0, [0, 2 * COST_INSERT, COST_INSERT, 0])
    for new, r in _ordered(batches):
        now = end if new else now  # noqa: F821
        yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]]), "chunk": pa.array([r["chunk"]]), "ahead": pa.array([now.tolist()], pa.list_(pa.int64()))})
        now = np.minimum((np.array(r["fold"]).reshape(STATES, STATES) + now[None]).min(axis=1), INFINITE)


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, r in _ordered(batches):
        ends, _ = chunk_steps(np.frombuffer(r["codes"], np.uint8).astype(np.int64), np.array(r["ahead"]))
        yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]]), "chunk": pa.array([r["chunk"]]), "ends": pa.array([ends.tolist()], pa.list_(pa.int64()))})


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks in order: the state before each, and what its border with the chunk before adds to the counts."""
    for new, r in _ordered(batches):
        if new:
            state, tail, turn = 0, -1, None
        broken = r["turns"] > 0 and tail >= 0 and not _LEGAL[tail, r["head"]]
        again = r["turns"] > 0 and turn is not None and turn == r["first_turn"]
        yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]]), "chunk": pa.array([r["chunk"]]), "start": pa.array([state], pa.int64()), "broken": pa.array([int(broken)]), "again": pa.array([int(again)])})
        state = r["ends"][state]
        if r["turns"]:
            tail, turn = r["tail"], r["last_turn"]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            value = lambda name: batch.column(name)[k]  # noqa: E731, B023
            start = value("start").as_py()
            codes = np.frombuffer(value("codes").as_py(), np.uint8).astype(np.int64)
            _, steps = chunk_steps(codes, np.array(value("ahead").as_py()))
            letter, turn, after = steps[start]
            late = np.where(codes[np.where(letter == INSERT, 0, turn)] >> 2 == 1, COST_TRUNCATED, 0) if len(codes) else letter
            cost = np.choose(letter, [np.full(len(letter), COST_DELETE), np.full(len(letter), COST_INSERT), late, late + COST_REROLE]).sum() if len(letter) else 0
            audit, roles, texts = _repaired(value("roles").values, value("texts").values, np.array([len(letter)]), letter, np.where(letter == INSERT, 0, turn), after)
            yield pa.RecordBatch.from_pydict({"part": batch.column("part").slice(k, 1), "chunk": batch.column("chunk").slice(k, 1), "cost": pa.array([int(cost)]), "audit": audit, "roles": roles, "texts": texts})


def _finished(cut: DataFrame) -> DataFrame:
    """The chunks of cut that are no whole conversations, repaired."""
    keys, conv = ["part", "chunk"], F.col("conv_id").asc_nulls_first()
    held = cut.where(~F.col("whole"))
    back = held.select("conv_id", *keys, "fold").repartition("conv_id").sortWithinPartitions(conv, F.desc("part"), F.desc("chunk"))
    ahead = stash(back.mapInArrow(_ahead, "part long, chunk long, ahead array<long>"), "ahead")
    leads = held.select("conv_id", *keys, "codes").join(ahead, keys).mapInArrow(_leads, "part long, chunk long, ends array<long>")
    facts = held.select("conv_id", *keys, "turns", "head", "tail", "first_turn", "last_turn").join(leads, keys)
    forth = facts.repartition("conv_id").sortWithinPartitions(conv, *keys)
    starts = stash(forth.mapInArrow(_starts, "part long, chunk long, start long, broken long, again long"), "starts")
    given = held.select(*keys, "codes", "roles", "texts").join(ahead, keys).join(starts.select(*keys, "start"), keys)
    done = given.mapInArrow(_finish, "part long, chunk long, cost long, audit string, roles array<string>, texts array<string>")
    facts = held.drop("cost", "audit", "roles", "texts").join(starts.drop("start"), keys).withColumn("illegal", F.col("illegal") + F.col("broken")).withColumn("numbers", F.col("numbers") - F.col("again"))
    return facts.join(done, keys).select(PIECES)


PIECES = ["conv_id", "part", "chunk", "whole", *(c.split()[0] for c in STATS.split(", ")), "cost", "audit", "roles", "texts"]


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, gone) with fault, where and key: what each row's first fault is and how rows are ordered.

    A duplicate is told by a digest of conversation, role and text: rows of one digest are counted, and all but the
    first by turn of those that repeat are duplicates. A digest that very many rows share is not shuffled into one task.
    """
    last = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    digest = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("|"), F.length("role").cast("string"), F.lit("|"), "role", "text"), 256))
    rows = turns.withColumn("trimmed", last).withColumn("live", ~F.col("gone") & (F.col("trimmed") != "")).withColumn("key", F.when(F.col("live"), digest))
    rows = rows.withColumn("where", F.monotonically_increasing_id())
    number = F.coalesce("turn", F.lit(-(1 << 63)))
    again = rows.where("live").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("where", number).alias("first")).where("n > 1")
    again = stash(again, "repeated")
    if again.count() <= REPEATED_ROWS:
        rows = rows.join(F.broadcast(again), "key", "left")
    else:
        rows = hot_join(rows, again, ["key"], "n")
    fault = F.when(F.col("gone"), GONE).when(F.col("trimmed") == "", BLANK).when(F.col("first") != F.col("where"), DUPLICATE)
    fault = fault.when(~F.substring("trimmed", -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return rows.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "fault", "key", "where")


def repair_structure(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """Repaired conversations of turns (conv_id, turn, role, text) in pieces; most conversations are one piece.

    Each piece: conv_id; part and chunk (which order the pieces of a conversation); whole (it is all of it);
    turns, low, high and numbers (turns, least and highest number, different numbers), blank, duplicate,
    truncated, illegal (counts); cost and audit of the least edits (D, I, K, R); roles and texts of the
    repaired turns. Turns are ordered by number, nulls first, ties by role and by a digest of role and text;
    rows that repeat are turns of their own, all but one of them duplicates. Null roles and texts are one
    space; a null conv_id is a conversation of its own. Very long conversations and texts are several
    pieces. gone: a boolean column; its rows are no turns, but a conversation of such rows alone is
    reported as an empty one. Other columns are ignored; an empty table gives an empty result.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    flag = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    rows = faults(turns.select("conv_id", "turn", space("role"), space("text"), flag.alias("gone")))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "key")] + [F.col("fault") == DUPLICATE, F.col("where")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("key", "where")
    cut = stash(placed.mapInArrow(_cut, CUT_SCHEMA), "conversations")
    done = cut.where("whole").select(PIECES)
    return done.unionByName(_finished(cut)) if cut.where("not whole").limit(1).count() else done


def damaged(turns: DataFrame) -> DataFrame:
    """turns with the damage that the crc32 of conv_id:turn names, nulls being one space; gone marks dropped rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces in order; texts go through the digest piece by piece."""
    now = None

    def row():
        gaps = now["high"] - now["low"] + 1 - now["numbers"] if now["high"] is not None else 0
        cols = {"conv_id": pa.array([now["conv_id"]], pa.int64()), "gaps": pa.array([gaps], pa.int64())}
        cols |= {c: pa.array([now[c]], pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
        return pa.RecordBatch.from_pydict(cols | {"audit": pa.array(["".join(now["audit"])], pa.string()), "repaired_sha256": pa.array([now["sha"].hexdigest()])})

    for batch in batches:
        for k in range(batch.num_rows):
            r = {name: batch.column(name)[k] for name in batch.schema.names}
            roles, texts = r.pop("roles").as_py(), r.pop("texts").as_py()
            r = {name: v.as_py() for name, v in r.items()}
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    yield row()
                now = r | {"audit": [], "sha": hashlib.sha256(), "any": False, "low": None, "high": None} | dict.fromkeys(("numbers", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
            for c in ("numbers", "blank", "duplicate", "truncated", "illegal", "cost"):
                now[c] += r[c]
            for c, f in (("low", min), ("high", max)):
                now[c] = f(x for x in (now[c], r[c]) if x is not None) if (now[c], r[c]) != (None, None) else None
            now["audit"].append(r["audit"])
            for role, text in zip(roles, texts):
                now["sha"].update(("\n" if now["any"] else "").encode() + f"{role}:{text}".encode())
                now["any"] = True
    if now is not None:
        yield row()


def report(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, counts, cost, audit, repaired_sha256) of each conversation from repair_structure().

    A conversation of several pieces goes through one task in order, piece by piece, as a digest of its whole text asks.
    """
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("numbers"), F.lit(0))
    said = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda r: F.concat(r["roles"], F.lit(":"), r["texts"])), "\n")
    one = pieces.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.encode(said, "UTF-8"), 256).alias("repaired_sha256"))
    more = pieces.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "chunk")
    return one.unionByName(more.mapInArrow(_report, REPORT))


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(repair_structure(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone="gone"))
