"""Best-fit packing of token sequences, improved by exchanges between underfull bins.

Pieces of at most ``capacity`` tokens go into sequences. They are dealt into shards of about
``shard_pieces`` by a hash of their running number, and every shard is packed by itself: a shard wastes at most
about one sequence in thousands, and no task sees more than a shard. In a shard, best fit
in descending order comes first. Then a local search exchanges one piece for one, two for
one, or moves one, between bins with room, whenever the sum of squared fills grows; that
drains the emptier bins until some are empty. It ends as soon as the number of bins is the
least possible, or when no exchange helps: every bin has the sizes that it can give and
those that it can take as sets of bits, so one look compares a bin with all others.

Defined results: a null text counts as empty and is one piece, the end id; an empty table
gives no rows; repeated rows are packed each by itself; ids may be null; other columns are
never looked at. A longer document is cut so that only its first piece is short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import group_in_arrow, in_arrow, stored
from marketlake.llm.tokens import encoder

CAPACITY = 1024
END_ID = 2
SHARD_PIECES = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, place long"


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short."""
    first = (length - 1) % capacity + 1
    starts = [0, *range(first, length, capacity)]
    return list(zip(starts, [first, *[capacity] * (len(starts) - 1)], strict=True))


# --- packing of one shard -----------------------------------------------------------------


class Bins:
    """Bins of one shard. ``content[b]`` has the piece numbers, ``fill[b]`` their length."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.content: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it.

        ``rooms`` is a set of bits: room r is set if a bin has just that room left.
        """
        at: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0
        for piece in sorted(range(len(self.lengths)), key=lambda p: -self.lengths[p]):
            size = self.lengths[piece]
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                b = at[room].pop()
                if not at[room]:
                    rooms &= ~(1 << room)
            else:
                b, room = len(self.fill), self.capacity
                self.content.append([])
                self.fill.append(0)
            self.content[b].append(piece)
            self.fill[b] += size
            at[room - size].append(b)
            rooms |= 1 << (room - size)

    def least(self) -> int:
        return -(-sum(self.lengths) // self.capacity)

    def _apply(self, a: int, b: int, give: list[int], take: list[int]) -> None:
        for piece in give:
            self.content[a].remove(piece)
        for piece in take:
            self.content[b].remove(piece)
        self.content[a] += take
        self.content[b] += give
        moved = sum(self.lengths[p] for p in give) - sum(self.lengths[p] for p in take)
        self.fill[a] -= moved
        self.fill[b] += moved

    def _distinct(self, pieces: list[int], times: int) -> list[int]:
        """Pieces in ascending order of length, of equal ones no more than ``times``."""
        out: list[int] = []
        for p in sorted(pieces, key=self.lengths.__getitem__):
            if len(out) < times or self.lengths[out[-times]] != self.lengths[p]:
                out.append(p)
        return out

    def _exchange(self, a: int, b: int) -> bool:
        """Bring as much as fits from bin a into bin b, which is at least as full."""
        size = self.lengths.__getitem__
        room = self.capacity - self.fill[b]
        mine, theirs = self._distinct(self.content[a], 2), self._distinct(self.content[b], 2)
        best, move = 0, None
        for i, p in enumerate(mine):
            if best < size(p) <= room:
                best, move = size(p), ([p], [])
            for j, q in enumerate(theirs):
                gain = size(p) - size(q)
                if gain <= best:
                    break
                if gain <= room:
                    best, move = gain, ([p], [q])
                for r in theirs[j + 1 :]:  # one for two
                    if gain - size(r) <= best:
                        break
                    if gain - size(r) <= room:
                        best, move = gain - size(r), ([p], [q, r])
            for r in mine[i + 1 :]:
                for q in theirs:  # two for one
                    gain = size(p) + size(r) - size(q)
                    if gain <= best:
                        break
                    if gain <= room:
                        best, move = gain, ([p, r], [q])
            if best == room:
                break
        if move is None:
            return False
        self._apply(a, b, *move)
        return True

    def _gives_and_takes(self, b: int) -> tuple[int, int]:
        """Sizes that a bin can give, and those by which what it gets may be as large.

        Sets of bits, the sizes of single pieces below those of two pieces. A bin takes one
        piece for none, one or two of its own, or two for one, if it grows by 1 to its room.
        """
        wide = 64 * (self.capacity // 64 + 1)
        within = (1 << (self.capacity + 1)) - 1
        ones = more = twos = 0
        for p in self.content[b]:
            bit = 1 << self.lengths[p]
            more |= ones & bit
            ones |= bit
        for size in {self.lengths[p] for p in self.content[b]}:
            bit = 1 << size
            twos |= (ones & ~bit | more & bit) << size
        room = self.capacity - self.fill[b]

        def grown(sizes: int) -> int:
            out, have = sizes << 1, 1
            while have < room:
                step = min(have, room - have)
                out |= out << step
                have += step
            return out & within if room else 0

        return ones | twos << wide, grown(1 | ones | twos) | grown(ones) << wide

    def search(self, exchanges: int | None = None) -> None:
        """Exchange until no fewer bins are possible or nothing helps.

        What moves goes from the emptier to the fuller bin, so squared fill grows with
        every step. Emptier bins are drained first. A bin that found no partner is compared
        only with those that changed since. A number of exchanges ends the search earlier.
        """
        spare = sum(f > 0 for f in self.fill) - self.least()
        bins = [b for b, f in enumerate(self.fill) if 0 < f < self.capacity]
        size = 16 * (self.capacity // 64 + 1)
        gives, takes = np.zeros((2, len(bins), size // 8), "<u8")
        fill = np.array([self.fill[b] for b in bins], np.int64)

        def note(i: int) -> None:
            give, take = self._gives_and_takes(bins[i])
            gives[i] = np.frombuffer(give.to_bytes(size, "little"), "<u8")
            takes[i] = np.frombuffer(take.to_bytes(size, "little"), "<u8")
            fill[i] = self.fill[bins[i]]

        if spare > 0:
            for i in range(len(bins)):
                note(i)
        changes: list[int] = []
        seen = [-1] * len(bins)  # changes that a bin knows; -1 if it has to look at all bins
        every = np.arange(len(bins))
        changed = True
        while changed and spare > 0:
            changed = False
            for a in np.argsort(fill, kind="stable").tolist():
                while fill[a] and seen[a] < len(changes):
                    others = every if seen[a] < 0 else np.unique(changes[seen[a] :])
                    others = others[(fill[others] >= fill[a]) & (others != a)]
                    others = others[(takes[others] & gives[a]).any(axis=1)]
                    seen[a] = len(changes)
                    for b in others[np.argsort(-fill[others], kind="stable")].tolist():
                        if exchanges is not None and exchanges <= 0:
                            return
                        if not self._exchange(bins[a], bins[b]):
                            continue
                        exchanges = None if exchanges is None else exchanges - 1
                        note(a)
                        note(b)
                        changes += [a, b]
                        seen[a] = seen[b] = -1
                        changed = True
                        if not fill[a]:
                            spare -= 1
                            break
                if spare <= 0:
                    return


def pack_lengths(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for pieces in filter(None, bins.content):
        at = 0
        for piece in pieces:
            where[piece], offset[piece] = used, at
            at += lengths[piece]
        used += 1
    return where, offset


# --- over a table -------------------------------------------------------------------------


def _cut_batches(
    batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool
) -> Iterator[pa.RecordBatch]:
    tokenizer = encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    place = TaskContext.get().partitionId() << 40
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = memoryview(tokenizer.encode(text) + end)
            for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + length)]
                rows.append((key, piece, start, length, zlib.crc32(own), bytes(own) if keep_ids else None, place))
                place += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "place"]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Stored table of all pieces; their ids as bytes too if asked for.

    ``place`` numbers the rows. It may differ when a task runs again, so what uses it starts
    from the stored table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return stored(
        in_arrow(rows, lambda b: _cut_batches(b, tokenizer_path, capacity, end_id, keep_ids), PIECES),
        "pieces",
    )


def _pack_shard(rows: pa.Table, capacity: int) -> pa.Table:
    order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
    rows = rows.sort_by([*order, ("ids_crc32", "ascending")])
    where, offset = pack_lengths(rows.column("length").to_pylist(), capacity)
    shard = rows.column("_shard").to_numpy()
    rows = rows.drop_columns(["_shard"])
    return rows.append_column("sequence_id", pa.array((shard << 32) + where)).append_column(
        "offset", pa.array(offset)
    )


def place(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give each stored piece its sequence and its offset there."""
    shards = max(1, -(-cut.count() // shard_pieces))
    narrow = cut.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.pmod(F.xxhash64("place"), F.lit(shards)).alias("_shard"),
    )
    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
    return group_in_arrow(narrow, ["_shard"], lambda rows: _pack_shard(rows, capacity), schema)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(pieces(docs, tokenizer_path, id_col, text_col))


def sequences(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, and the ids of its pieces in order.

    A sequence has at most ``capacity`` pieces. Repeated rows have equal ids, so any of
    them may stand for another.
    """
    cut = pieces(docs, tokenizer_path, id_col, text_col, capacity, keep_ids=True)
    placed = place(cut, capacity)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = cut.groupBy(*same).agg(F.first("ids").alias("ids"))
    on = [placed[c].eqNullSafe(ids[c]) for c in same]
    both = placed.join(ids, on).select("sequence_id", "offset", placed["length"], "ids")
    whole = both.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"),
    )
    return whole.select(
        "sequence_id",
        "n_tokens",
        F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
