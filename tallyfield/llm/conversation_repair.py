"""Repair of the turn structure of conversations by cheapest edits.

A conversation is well formed if its role initials are ``(s?(ua)+)?``: nothing, or a system turn at most and then pairs of
user and assistant. Rows are taken by turn (nulls first), ties by role and digest of the text, and edited: Keep costs 0, Rerole
to user or assistant 2, Delete 3, Insert of an empty user or assistant turn 2; a truncated row that stays adds 1. Blank and duplicate rows must
go. The audit is the string of the edits' initials; of all cheapest edits those with the ASCII-least audit are taken.

Method. A node is (rows consumed, role state). A cost pass from the end finds every node's cheapest cost and its optimal arcs.
Then nodes are ranked by prefix doubling: rank k orders the audits of length 2^k, from pairs of ranks of the length before, and
each node's pointer is doubled along; the least path is read from the doubled pointers, all its places at once.

Rows are sorted by ranges of (conv_id, turn, role, text), so a conversation of any length is spread over tasks. One that lies inside a
task is solved there. Others are cut to pieces of at most ``PIECE`` rows. A piece is solved for all pairs of entry and exit
state; because the letters of arcs out of a node differ and a piece's audit ends with a consumed row, the ranks of the first
nodes tell which exit is least among equally cheap ones. Costs and ranks are composed per task, then per conversation over tasks,
and the chosen states come back the same way. The hash of a repaired conversation is one running SHA-256, fed piece by piece.

Null roles and texts are one space (so such texts are blank). Null ids are one conversation. Repeated rows are duplicates, also
when id and turn are null. Rows with ``copies`` 0 only say that their conversation exists. Extra columns stay away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.session import stored

PIECE = 512
TAIL = 4096  # rows of one conversation that a task holds back before it cuts
TAIL_BYTES = 1 << 24
INF = 1 << 40
# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; role kinds: 0 system, 1 user, 2 assistant, 3 other
_KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
_NEXT = np.array([2, 2, 3, 2])
_CLOSED = np.array([[0, 4, 2, 0]])
_LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)


@dataclass
class Solved:
    """Nodes by (place, end, state): cost to the end, first letter of the least audit, rank of it, its length, doubled pointers."""

    cost: np.ndarray
    letter: np.ndarray
    rank: np.ndarray
    steps: np.ndarray
    pointers: list[np.ndarray]
    first: np.ndarray  # place 0 of each piece

    def path(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes on the least paths from the nodes ``start``, and where each path begins among them."""
        bounds = np.concatenate([[0], np.cumsum(self.steps[start])])
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], self.steps[start])
        node = np.repeat(start, self.steps[start])
        for k, pointer in enumerate(self.pointers):
            node = np.where(place >> k & 1, pointer[node], node)
        return node, bounds


def solve(role: np.ndarray, forced: np.ndarray, truncated: np.ndarray, bounds: np.ndarray, closed: bool) -> Solved:
    """Least paths of pieces. ``closed`` ones end well formed, others in each of the four states (one end a state)."""
    n = np.diff(bounds)
    first = bounds[:-1] + np.arange(len(n))
    last = first + n
    ends = _CLOSED if closed else np.where(np.eye(4, dtype=bool), 0, INF)
    shape = (int(bounds[-1]) + len(n), len(ends), 4)
    cost = np.full(shape, INF, dtype=np.int64)
    letter = np.zeros(shape, dtype=np.int64)
    to = np.arange(np.prod(shape)).reshape(shape)
    state, end = np.arange(4)[None, None, :], np.arange(len(ends))[None, :, None]
    cost[last] = ends
    if closed:  # what is missing at the end is inserted
        letter[last[:, None], 0, [1, 2]] = 2
        to[last[:, None], 0, [1, 2]] = to[last[:, None], 0, [2, 3]]
    longest = np.argsort(-n, kind="stable")
    for k in range(1, int(n.max(initial=0)) + 1):
        active = longest[: int((n >= k).sum())]
        at, row = last[active] - k, bounds[1:][active] - k
        after, gone = cost[at + 1], forced[row][:, None, None]
        more = truncated[row].astype(np.int64)[:, None, None]
        kept = np.broadcast_to(_KEEP[role[row]][:, None, :], after.shape)
        delete = after + 3
        rerole = np.where(gone, INF, after[:, :, _NEXT] + 2 + more)
        keep = np.where(gone | (kept == 4), INF, np.take_along_axis(after, np.minimum(kept, 3), 2) + more)
        best = np.minimum(np.minimum(delete, rerole), keep)
        f = best.copy()
        f[..., 2] = np.minimum(best[..., 2], best[..., 3] + 2)
        f[..., 3] = np.minimum(best[..., 3], best[..., 2] + 2)
        f[..., :2] = np.minimum(best[..., :2], f[..., 2:3] + 2)
        insert = f[:, :, _NEXT] + 2
        code = np.select([f >= INF, delete == f, insert == f, keep == f], [0, 1, 2, 3], 4)
        cost[at], letter[at] = np.minimum(f, INF), code
        place = np.where(code == 2, at[:, None, None], at[:, None, None] + 1)
        goes = np.choose(code, [state + 0 * kept, state + 0 * kept, _NEXT[state] + 0 * kept, np.minimum(kept, 3), _NEXT[state] + 0 * kept])
        to[at] = np.where(code == 0, to[at], (place * len(ends) + end) * 4 + goes)
    letter, pointer = letter.ravel(), to.ravel()
    rank, steps, pointers = letter, (letter > 0).astype(np.int64), [pointer]
    while letter[pointer].any():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)[1].ravel()
        steps = steps + steps[pointer]
        pointer = pointer[pointer]
        pointers.append(pointer)
    rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[pointer], return_inverse=True)[1].ravel() if len(rank) else rank
    return Solved(cost, letter, rank, steps, pointers, first)


def compose(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(costs, ranks) by (entry, exit) of two stretches one after the other; ranks order the exits of one entry."""
    total = a[0][:, :, None] + b[0][None, :, :]
    tied = np.where(total == total.min(axis=1, keepdims=True), a[1][:, :, None], INF)
    via = tied.argmin(axis=1)
    entry, leave = np.arange(4)[:, None], np.arange(4)[None, :]
    key = a[1][entry, via] * INF + b[1][via, leave]
    return np.minimum(total.min(axis=1), INF), np.stack([np.unique(row, return_inverse=True)[1] for row in key])


def resolve(stretches: list[tuple[np.ndarray, np.ndarray]], entry: int, ends: np.ndarray) -> list[int]:
    """States after each stretch on the least cheapest way from ``entry``; ``ends`` are the costs of the last state."""
    rest = [ends]
    for costs, _ in stretches[:0:-1]:
        rest.append(np.minimum((costs + rest[-1][None, :]).min(axis=1), INF))
    out = []
    for (costs, ranks), after in zip(stretches, rest[::-1]):
        total = costs[entry] + after
        entry = int(np.where(total == total.min(), ranks[entry], INF).argmin())
        out.append(entry)
    return out


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32(conv_id:turn) % 20: 0 drops, 1 empties, 2 removes ``[.!?]``, 3 repeats, 4 sets role user."""
    d = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        F.when(d == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"),
    )


def _rows(turns: DataFrame) -> DataFrame:
    """Rows sorted by ranges of (conv_id, turn, role, digest of the text); before the first of equal role and text stands a row of kind 0."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    base = base.withColumns({"h": F.unhex(F.md5("text")), "row": F.monotonically_increasing_id()})  # equal rows differ by their number, so they too can be dealt
    key = ["conv_id", "turn", "role", "h", "row"]
    rows = base.select(
        *key,
        F.lit(1).alias("kind"),
        "copies",
        F.when(F.col("copies") > 0, F.col("text")).alias("text"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    )
    first = base.where("copies > 0").groupBy("conv_id", "role", "h").agg(F.min(F.struct(F.col("turn").isNotNull().alias("dated"), "turn", "row")).alias("at"))
    marks = first.select("conv_id", "at.turn", "role", "h", "at.row", F.lit(0).alias("kind"), F.lit(0).alias("copies"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("blank"), F.lit(False).alias("cut"))
    order = [F.col(c).asc_nulls_first() for c in key]
    return rows.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "kind").withColumn("part", F.spark_partition_id())


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_PIECES = (
    "part int, seq long, head long, closed boolean, "
    + ", ".join(f"{c} long" for c in _COUNTS)
    + ", n long, first_role int, last_role int, min_turn long, max_turn long, n_turns long, cost long, audit string, "
    + "turns array<struct<role string, text string>>, costs array<long>, ranks array<long>, audits array<string>"
)
_ROLE_NAMES = np.array([3, 3, 0, 1])  # of the target state, as a place behind the rows' own roles: user, assistant


def _strings(letters: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(_LETTERS[letters].tobytes())).cast(pa.string())


def _turn_lists(role: pa.Array, text: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([role, text], ["role", "text"]))


class _Task:
    """One sorted range of rows: cuts it to conversations and pieces and solves them."""

    def __init__(self, piece: int) -> None:
        self.piece, self.part = piece, 0
        self.seq, self.head, self.inside = 0, -1, True  # inside: the first conversation may have begun before these rows
        self.cut = pa.nulls(0)  # the id of a conversation that this task has cut

    def emit(self, rows: pa.Table, starts: np.ndarray, open_end: bool) -> Iterator[pa.RecordBatch]:
        """``starts``: where conversations begin. The first is open while ``inside``, the last if ``open_end``."""
        kind, copies = rows["kind"].to_numpy(), rows["copies"].to_numpy()
        marked = np.concatenate([[False], kind[:-1] == 0])
        index = np.repeat(np.arange(len(kind)), copies)
        again = np.concatenate([[False], index[1:] == index[:-1]])
        blank = rows["blank"].to_numpy(zero_copy_only=False)[index]
        duplicate = ~blank & (again | ~marked[index])
        truncated = ~blank & ~duplicate & rows["cut"].to_numpy(zero_copy_only=False)[index]
        role_text, text = rows["role"].combine_chunks().take(pa.array(index)), rows["text"].combine_chunks().take(pa.array(index))
        initial = pc.utf8_slice_codeunits(role_text, 0, 1)
        role = pc.fill_null(pc.index_in(initial, pa.array(["s", "u", "a"])), 3).to_numpy().astype(np.int64)
        turn = rows["turn"].combine_chunks().take(pa.array(index))

        live = np.concatenate([[0], np.cumsum(copies)])
        edge = live[np.concatenate([starts, [len(kind)]])]
        ids = rows["conv_id"].combine_chunks()
        goes_on = len(self.cut) > 0 and self.cut.equals(ids[:1])
        is_open = np.zeros(len(starts), dtype=bool)
        is_open[0] = goes_on or (self.inside and not len(self.cut))
        is_open[-1] |= open_end
        bounds, own, heads = [], [], []
        for i in range(len(starts)):
            cuts = [*range(edge[i], edge[i + 1], self.piece)] if is_open[i] and edge[i + 1] > edge[i] else [edge[i]]
            if i or not goes_on:
                self.head = self.seq + len(bounds)
            bounds += [(a, b) for a, b in zip(cuts, [*cuts[1:], edge[i + 1]])]
            own += [i] * len(cuts)
            heads += [self.head] * len(cuts)
        self.inside, self.cut = open_end, ids[-1:] if open_end else ids[:0]
        bounds, own = np.array(bounds, dtype=np.int64).reshape(-1, 2), np.array(own)
        ids = ids.take(pa.array(starts[own]))
        begin, end = bounds[:, 0], bounds[:, 1]

        def summed(flag: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flag)])
            return total[end] - total[begin]

        legal = np.zeros(16, dtype=bool)
        legal[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True
        bad = np.zeros(len(role), dtype=bool)
        bad[1:] = ~legal[role[:-1] * 4 + role[1:]]
        head = np.zeros(len(role), dtype=bool)
        head[begin[begin < end]] = True
        t, dated = turn.fill_null(0).to_numpy(), turn.is_valid().to_numpy(zero_copy_only=False)
        new = dated.copy()
        new[1:] &= (t[1:] != t[:-1]) | ~dated[:-1] | head[1:]
        n, n_dated = end - begin, summed(dated)
        some = n_dated > 0
        ends_at = np.minimum(np.maximum(end - 1, 0), max(len(t) - 1, 0))
        from_at = np.minimum(np.maximum(end - n_dated, 0), max(len(t) - 1, 0))
        closed = ~is_open[own]
        both = []
        for which in (True, False):
            sel = np.flatnonzero(closed == which)
            if len(sel):
                both.append((sel, self._solved(sel, begin, end, role, blank | duplicate, truncated, role_text, text, which)))
        order = np.argsort(np.concatenate([sel for sel, _ in both]), kind="stable")
        fields = [pa.concat_arrays([cols[k] for _, cols in both]).take(pa.array(order)) for k in range(6)]
        pick = lambda values, ok: pa.array(np.asarray(values), mask=~ok)
        safe = lambda values, at: values[at] if len(values) else np.zeros(len(at), dtype=np.int64)
        counts = [summed(blank), summed(duplicate), summed(truncated), summed(bad & ~head)]
        columns = [
            ids, pa.array(np.full(len(own), self.part), pa.int32()), pa.array(self.seq + np.arange(len(own))), pa.array(heads, pa.int64()), pa.array(closed), *[pa.array(c) for c in counts], pa.array(n),
            pick(safe(role, np.minimum(begin, max(len(role) - 1, 0))).astype(np.int32), n > 0), pick(safe(role, ends_at).astype(np.int32), n > 0),
            pick(safe(t, from_at), some), pick(safe(t, ends_at), some), pa.array(summed(new)), *fields,
        ]
        self.seq += len(own)
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", *[x.strip().split(" ")[0] for x in _PIECES.split(", ") if not x.startswith("text")]])

    @staticmethod
    def _solved(sel, begin, end, role, forced, truncated, role_text, text, closed) -> list[pa.Array]:
        """cost, audit, turns, costs, ranks, audits of the pieces ``sel``; turns are repaired if closed, else as they came."""
        n = (end - begin)[sel]
        bounds = np.concatenate([[0], np.cumsum(n)])
        rows = np.repeat(begin[sel] - bounds[:-1], n) + np.arange(bounds[-1])
        s = solve(role[rows], forced[rows], truncated[rows], bounds, closed)
        none = lambda kind: pa.nulls(len(sel), kind)
        longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        if not closed:
            # entries outer, exits inner; the node of (place 0, end, state)
            start = (s.first[:, None, None] * 4 + np.arange(4)[None, None, :]) * 4 + np.arange(4)[None, :, None]
            node, cuts = s.path(start.ravel())
            sixteen = pa.array(np.arange(len(sel) + 1) * 16, pa.int32())
            flat = [pa.array(s.cost.ravel()[start.ravel()]), pa.array(s.rank[start.ravel()]), _strings(s.letter[node], cuts)]
            stay = pc.if_else(pa.array(~forced[rows]), text.take(pa.array(rows)), "")
            return [none(pa.int64()), none(pa.string()), _turn_lists(role_text.take(pa.array(rows)), stay, bounds), *[pa.ListArray.from_arrays(sixteen, x) for x in flat]]
        start = s.first * 4
        node, cuts = s.path(start)
        letter = s.letter[node]
        piece = np.repeat(np.arange(len(sel)), np.diff(cuts))
        row = node // 4 - piece
        stays = letter != 1
        name = np.where(letter == 3, row, len(rows) + _ROLE_NAMES[_NEXT[node % 4]])[stays]
        names = pa.concat_arrays([role_text.take(pa.array(rows)), pa.array(["user", "assistant"])]).take(pa.array(name))
        texts = text.take(pa.array(rows)).take(pa.array(row[stays], mask=(letter == 2)[stays])).fill_null("")
        total = np.concatenate([[0], np.cumsum(stays)])
        return [pa.array(s.cost[s.first, 0, 0]), _strings(letter, cuts), _turn_lists(names, texts, total[cuts]), none(longs), none(longs), none(strings)]


def _cutter(piece: int, tail: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = _Task(piece), None
        for batch in batches:
            if not len(batch):
                continue
            task.part = batch.column("part")[0].as_py()
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            ids = rows["conv_id"].combine_chunks()
            void = ids.is_null().to_numpy(zero_copy_only=False)
            same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (void[1:] & void[:-1])
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
            last = int(starts[-1])
            if last:
                yield from task.emit(rows.slice(0, last), starts[:-1], False)
            held = rows.slice(last)
            if len(held) > tail or held.nbytes > TAIL_BYTES:
                end = len(held) - (held["kind"][len(held) - 1].as_py() == 0)  # a mark stays with its row
                if end:
                    yield from task.emit(held.slice(0, end), np.zeros(1, dtype=np.int64), True)
                    held = held.slice(end) if end < len(held) else None
        if held is not None and len(held):
            yield from task.emit(held, np.zeros(1, dtype=np.int64), True)

    return run


def _matrix(costs, ranks) -> tuple[np.ndarray, np.ndarray]:
    return np.array(costs, dtype=np.int64).reshape(4, 4), np.array(ranks, dtype=np.int64).reshape(4, 4)


def _composed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("seq")
    found = None
    for costs, ranks in zip(group.costs, group.ranks):
        found = compose(found, _matrix(costs, ranks)) if found else _matrix(costs, ranks)
    return group.iloc[:1][["conv_id", "part", "head"]].assign(costs=[found[0].ravel()], ranks=[found[1].ravel()])


def _states(group: pd.DataFrame, by: list[str], entry: int, ends: np.ndarray) -> pd.DataFrame:
    group = group.sort_values(by)
    after = resolve([_matrix(c, r) for c, r in zip(group.costs, group.ranks)], entry, ends)
    return group.assign(entry=np.array([entry, *after[:-1]], dtype=np.int32), leave=np.array(after, dtype=np.int32))


def _chosen(pieces: DataFrame) -> DataFrame:
    """(part, seq, entry, leave) of the open pieces."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    light = pieces.select("conv_id", "part", "head", "seq", "costs", "ranks")
    joined = light.groupBy("part", "head").applyInPandas(_composed, f"conv_id {kind}, part int, head long, costs array<long>, ranks array<long>")

    def over_parts(group: pd.DataFrame) -> pd.DataFrame:
        return _states(group, ["part"], 0, _CLOSED[0])[["part", "head", "entry", "leave"]]

    def over_pieces(group: pd.DataFrame) -> pd.DataFrame:
        ends = np.where(np.arange(4) == group.stop.iloc[0], 0, INF)
        return _states(group, ["seq"], int(group.start.iloc[0]), ends)[["part", "seq", "entry", "leave"]]

    parts = joined.groupBy("conv_id").applyInPandas(over_parts, "part int, head long, entry int, leave int")
    placed = light.join(parts.select("part", "head", F.col("entry").alias("start"), F.col("leave").alias("stop")), ["part", "head"])
    return placed.groupBy("part", "head").applyInPandas(over_pieces, "part int, seq long, entry int, leave int")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pieces with their entry and exit state: cost, audit and repaired turns."""
    for batch in batches:
        out = []
        for r in batch.select(["turns", "costs", "audits", "entry", "leave"]).to_pylist():
            at, state, row, turns = r["entry"] * 4 + r["leave"], r["entry"], 0, []
            for letter in (audit := r["audits"][at]):
                to = state if letter == "D" else _NEXT[state]
                if letter == "K":
                    to = _KEEP["sua".find(r["turns"][row]["role"][:1]), state]
                if letter != "D":
                    own = {"role": "", "text": ""} if letter == "I" else r["turns"][row]
                    turns.append(own if letter == "K" else {"role": "assistant" if to == 3 else "user", "text": own["text"]})
                row, state = row + (letter != "I"), to
            out.append((r["costs"][at], audit, turns))
        new = dict(zip(["cost", "audit", "turns"], [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], batch.schema.field("turns").type)]))
        yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)


def repair(turns: DataFrame, piece: int = PIECE, tail: int = TAIL) -> DataFrame:
    """Repaired pieces of all conversations; ``turns`` holds conv_id, turn, role, text and perhaps copies.

    One row a piece: conv_id, its place (part, seq), the number of faulty rows of each sort, cost and audit of its edits and the
    repaired turns. What is missing after a conversation's last piece follows from ``leave``: 1 asks for an empty
    user and assistant turn, 2 for an assistant turn (each 2 more). A conversation without rows has a piece without turns.
    """
    rows = _rows(turns).select("conv_id", "part", "turn", "role", "kind", "copies", "text", "blank", "cut")
    kind = turns.schema["conv_id"].dataType.simpleString()
    pieces = stored(rows.mapInArrow(_cutter(piece, tail), f"conv_id {kind}, {_PIECES}"), "conversation-pieces")
    whole = pieces.where("closed").withColumns({"entry": F.lit(0), "leave": F.lit(3)})
    cut = pieces.where("not closed")
    edited = cut.join(_chosen(cut), ["part", "seq"]).select(*whole.columns)
    return whole.unionByName(edited.mapInArrow(_edited, edited.schema)).drop("head", "costs", "ranks", "audits")


def _lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place, to one row a conversation; only one conversation's counts and audit are held."""
    names = None
    key, now = object(), None

    def done() -> list:
        for role in {1: ["user", "assistant"], 2: ["assistant"]}.get(now["leave"], []):
            now["hash"].update((b"\n" if now["any"] else b"") + f"{role}:".encode())
            now["any"] = True
            now["cost"] += 2
            now["audit"].append("I")
        gaps = now["max"] - now["min"] + 1 - now["n_turns"] if now["max"] is not None else 0
        return [key, gaps, *[now[c] for c in _COUNTS], now["cost"], "".join(now["audit"]), now["hash"].hexdigest()]

    for batch in batches:
        names, out = batch.schema.field("conv_id").type, []
        for r in batch.to_pylist():
            if now is None or r["conv_id"] != key:
                if now is not None:
                    out.append(done())
                key, now = r["conv_id"], dict.fromkeys([*_COUNTS, "cost", "n_turns"], 0) | {"hash": hashlib.sha256(), "any": False, "audit": [], "last": None, "min": None, "max": None, "leave": 0}
            for c in (*_COUNTS, "cost", "n_turns"):
                now[c] += r[c]
            if r["n"]:
                if now["last"] is not None and (now["last"], r["first_role"]) not in ((0, 1), (1, 2), (2, 1)):
                    now["illegal"] += 1
                now["last"] = r["last_role"]
            if r["min_turn"] is not None:
                now["n_turns"] -= now["max"] == r["min_turn"]
                now["min"] = r["min_turn"] if now["min"] is None else now["min"]
                now["max"] = r["max_turn"]
            if r["some"]:
                now["hash"].update((b"\n" if now["any"] else b"") + r["lines"].encode())
                now["any"] = True
            now["audit"].append(r["audit"])
            now["leave"] = r["leave"]
        if out:
            yield _digests(out, names)
    if now is not None:
        yield _digests([done()], names)


_DIGEST = ["gaps", *_COUNTS, "cost"]


def _digests(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * len(_DIGEST), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), types)], ["conv_id", *_DIGEST, "audit", "repaired_sha256"])


def digest(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation."""
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0))
    whole = pieces.where("closed").select("conv_id", gaps.alias("gaps"), *_COUNTS, "cost", "audit", F.sha2(_lines(F.col("turns")), 256).alias("repaired_sha256"))
    cut = pieces.where("not closed").select("conv_id", "part", "seq", *_COUNTS, "n", "first_role", "last_role", "min_turn", "max_turn", "n_turns", "cost", "audit", "leave", (F.size("turns") > 0).alias("some"), _lines(F.col("turns")).alias("lines"))
    kind = pieces.schema["conv_id"].dataType.simpleString()
    runs = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.unionByName(runs.mapInArrow(_one_by_one, f"conv_id {kind}, {', '.join(f'{c} long' for c in _DIGEST)}, audit string, repaired_sha256 string"))
