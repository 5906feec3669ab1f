"""Toxicity by a small convolutional classifier over hashed word embeddings.

A word is the mean of the vectors of its hashed parts: the word itself and its runs of
three to six bytes, ends marked. Filters over one, two and three words slide over the
text, each keeps its largest value, and a logistic layer weighs these. One bad word in a
long text is thus seen as well as in a short one. Everything is trained in numpy, by
Adagrad; gradients reach only the windows that were largest.

Every labelled text is learnt from, whole, whatever the number and length of texts. They are
stored in files of about ``ROWS`` texts, and each task that reads some is a trainer: it starts
from the network so far, passes over its texts and gives what it changed. The changes of all
trainers are averaged block by block of the table, each number over the trainers that moved
it, and ``ROUNDS`` such rounds are made; texts that fit one trainer need one. Of a text over
``RUN`` words a trainer keeps, slice by slice, the windows that are largest when its round
begins. Only the network, whose size is fixed, comes to the driver.

A fourth of the labelled texts is kept apart to calibrate: one cut for all, which becomes a
score of ``CUT``, and one for each language with enough labels, otherwise the common one. All
of them count, in cells of ``1 / GRID`` of a logit. The score reads the text alone; languages
only choose among thresholds, which are a column of their own.

Defined results: a null text is empty, and texts without a word have one score; a null
language has the common threshold; labels other than 0 and 1 and those of a null id are
none; of several labels of one id the largest counts; without labels of both kinds all
scores are the share of label 1 (0 without labels); repeated rows have equal scores; words
are cut at ``WIDTH`` bytes for their runs, not for the word itself; a text of any length is
read in slices; an empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from marketlake.llm.shared import group_in_arrow, in_arrow, stored, whole

CUT = 0.3
MIN_POSITIVE = 20

BUCKETS = 1 << 18
DIM = 12
FILTERS = 8
SPANS = (1, 2, 3)
RUNS = (3, 4, 5, 6)
WIDTH = 24
BATCH, RATE = 32, 0.05
ROUNDS, STEPS = 3, 500  # at least so many of each; few texts are seen more often
ROWS = 8_192  # texts a trainer holds at once, of at most CHUNK words and some HELD different ones
CHUNK = 4_000_000
BLOCK = 1_024  # parts whose changes are averaged together
GRID = 256
HELD = 200_000
SLICE = 1 << 20
WORDS_AT_ONCE = 1_024
RUN = 40_000
SEED = 7

# Bytes between words: ASCII that is neither letter nor digit.
SIGNS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


# --- words -------------------------------------------------------------------------------


def words_of(text: str) -> Iterator[list[bytes]]:
    """Words in lower case as UTF-8, in lists of bounded size."""
    spaced, at = text.lower().encode().translate(SIGNS), 0
    while len(spaced) - at > SLICE:
        cut = spaced.find(b" ", at + SLICE)
        if cut < 0:
            break
        yield spaced[at:cut].split()
        at = cut + 1
    yield spaced[at:].split()


def parts_of(words: list[bytes]) -> np.ndarray:
    """Buckets of each word's parts; places without a part hold ``BUCKETS``."""
    marked = [b"<" + w[: WIDTH - 2] + b">" for w in words]
    signs = np.frombuffer(b"".join(m.ljust(WIDTH, b"\0") for m in marked), np.uint8)
    signs = signs.reshape(len(words), WIDTH).astype(np.uint64)
    length = np.array([len(m) for m in marked])
    out = [np.array([zlib.crc32(w) % BUCKETS for w in words], np.int32)[:, None]]
    for n in RUNS:
        at = np.arange(WIDTH - n + 1)
        mixed = np.full((len(words), len(at)), n, np.uint64)
        for i in range(n):
            mixed = mixed * np.uint64(0x100000001B3) + signs[:, i : i + len(at)]
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)
        out.append(np.where(at + n <= length[:, None], mixed, BUCKETS).astype(np.int32))
    return np.hstack(out)


# --- the network -------------------------------------------------------------------------


@dataclass
class Network:
    """Vectors of parts (the last is zero), filters by span, the logistic layer, the scale."""

    table: np.ndarray
    filters: list[np.ndarray]  # span, FILTERS, DIM
    bias: np.ndarray
    weights: np.ndarray
    base: float = 0.0
    slope: float = 1.0
    middle: float = 0.0
    common: float = CUT
    by_lang: dict[str, float] = field(default_factory=dict)

    def vectors(self, parts: np.ndarray) -> np.ndarray:
        out = np.empty((len(parts), DIM), np.float32)
        for a in range(0, len(parts), WORDS_AT_ONCE):
            some = parts[a : a + WORDS_AT_ONCE]
            real = some < BUCKETS
            size = real.sum(axis=1)  # one at least, the word itself
            starts = np.cumsum(size) - size
            out[a : a + WORDS_AT_ONCE] = np.add.reduceat(self.table[some[real]], starts, axis=0) / size[:, None]
        return out

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """What each word gives every filter at every place in its window."""
        return vectors @ np.vstack([f.reshape(-1, DIM) for f in self.filters]).T

    def windows(self, given: np.ndarray) -> Iterator[np.ndarray]:
        """Filter values at every window of each span, from projected words in order.

        A window may hang over the end by up to its span less one.
        """
        at = 0
        for span in SPANS:
            held = given[:, at : at + FILTERS].copy()
            for i in range(1, span):
                held[:-i] += given[i:, at + i * FILTERS : at + (i + 1) * FILTERS]
            at += span * FILTERS
            yield held

    def largest(self, given: np.ndarray) -> np.ndarray:
        return np.concatenate([w.max(axis=0) for w in self.windows(given)])

    def logit(self, largest: np.ndarray) -> np.ndarray:
        return np.maximum(largest + self.bias, 0) @ self.weights + self.base

    def score(self, logit: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the common cut of the calibration is ``CUT``."""
        z = self.slope * (logit - self.middle) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _count(found: np.ndarray, docs: list[np.ndarray], y: np.ndarray, parts: np.ndarray) -> None:
    """Add to each label's places the texts that have the part."""
    for ids, label in zip(docs, y, strict=True):
        found[label, np.unique(parts[np.unique(ids)])] += 1


def _first(found: np.ndarray, of_label: np.ndarray, draw: np.random.Generator) -> Network:
    """Small random numbers; the first place of a part's vector is how much more often texts of
    label 1 have it.
    """
    shares = (found + 1) / (of_label[:, None] + 2)
    table = draw.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    table[:, 0] = np.log(shares[1] / shares[0])
    table[BUCKETS] = 0
    net = Network(
        table,
        [draw.normal(0, 0.1, (s, FILTERS, DIM)).astype(np.float32) for s in SPANS],
        np.zeros(len(SPANS) * FILTERS, np.float32),
        draw.normal(0, 0.1, len(SPANS) * FILTERS).astype(np.float32),
    )
    for f in net.filters:
        f[0, : FILTERS // 2, 0] = 1.0  # half of the filters begin by looking at the first place
    net.weights[[i for s in range(len(SPANS)) for i in range(s * FILTERS, s * FILTERS + FILTERS // 2)]] = 0.3
    net.base = -1.0
    return net


class Trainer:
    """A network and what Adagrad remembers of it."""

    def __init__(self, net: Network):
        self.net = net
        self.past_table = np.full(BUCKETS + 1, 1e-2)
        self.small = [*net.filters, net.bias, net.weights]
        self.past = [np.full(a.shape, 1e-2) for a in self.small]
        self.past_base = 1e-2

    def numbers(self) -> np.ndarray:
        """All numbers but those of parts."""
        ends = np.array([self.net.base, self.past_base])
        return np.concatenate([*[a.ravel() for a in [*self.small, *self.past]], ends]).astype(np.float64)

    def set_numbers(self, numbers: np.ndarray) -> None:
        at = 0
        for a in [*self.small, *self.past]:
            a[...] = numbers[at : at + a.size].reshape(a.shape)
            at += a.size
        self.net.base, self.past_base = map(float, numbers[at:])

    def pass_over(self, docs: list[np.ndarray], y: np.ndarray, parts: np.ndarray, draw: np.random.Generator) -> None:
        """One step for every few texts, in random order; texts are given as word numbers and
        ``parts`` has the buckets of each word. A number below zero stands between words.
        """
        usable = np.array([i for i, d in enumerate(docs) if len(d)], int)
        draw.shuffle(usable)
        gap = max(SPANS) - 1  # words of zeros between texts, so that no window spans two
        # a batch ends at BATCH texts, or after RUN words
        filled, chosen = 0, []
        for i in usable:
            chosen.append(i)
            filled += len(docs[i]) + gap
            if len(chosen) == BATCH or filled >= RUN:
                self._step([docs[i] for i in chosen], y[chosen], parts, gap)
                filled, chosen = 0, []
        if chosen:
            self._step([docs[i] for i in chosen], y[chosen], parts, gap)

    def _step(self, docs: list[np.ndarray], y: np.ndarray, parts: np.ndarray, gap: int) -> None:
        net = self.net
        flat = np.concatenate([np.append(d, [-1] * gap) for d in docs])
        stops = np.cumsum([len(d) + gap for d in docs])
        starts = stops - [len(d) + gap for d in docs]
        words, place = np.unique(flat, return_inverse=True)
        vectors = net.vectors(parts[words])
        vectors[words < 0] = 0
        given = net.projected(vectors)[place]
        at, top = [], []
        for held in net.windows(given):
            for b, e in zip(starts, stops - gap, strict=True):
                at.append(b + held[b:e].argmax(axis=0))
            top.append(np.array([held[i, range(FILTERS)] for i in at[-len(docs) :]]))
        top = np.hstack(top)
        active = np.maximum(top + net.bias, 0)
        off = 1 / (1 + np.exp(-np.clip(active @ net.weights + net.base, -30, 30))) - y
        slope = off[:, None] * net.weights * (active > 0)
        grads = [np.zeros_like(f) for f in net.filters]
        moved: list[tuple[np.ndarray, np.ndarray]] = []
        for k, span in enumerate(SPANS):
            where = np.array(at[k * len(docs) : (k + 1) * len(docs)])
            here = slope[:, k * FILTERS : (k + 1) * FILTERS]
            for i in range(span):
                used = place[np.minimum(where + i, len(place) - 1)]
                grads[k][i] = np.einsum("bf,bfd->fd", here, vectors[used])
                moved.append((used.ravel(), (here[:, :, None] * net.filters[k][i]).reshape(-1, DIM)))
        step = np.zeros((len(words), DIM))
        np.add.at(step, np.concatenate([m[0] for m in moved]), np.concatenate([m[1] for m in moved]))
        touched = np.flatnonzero(np.abs(step).sum(axis=1) * (words >= 0))
        if len(touched):
            buckets = parts[words[touched]]
            real = buckets < BUCKETS
            size = real.sum(axis=1)
            spread = np.repeat(step[touched] / size[:, None], size, axis=0)
            flat_buckets = buckets[real]
            order = np.argsort(flat_buckets, kind="stable")
            hit, first = np.unique(flat_buckets[order], return_index=True)
            change = np.add.reduceat(spread[order], first, axis=0)
            self.past_table[hit] += (change**2).mean(axis=1)
            net.table[hit] -= (RATE * change / np.sqrt(self.past_table[hit])[:, None]).astype(np.float32)
        for array, was, g in zip(self.small, self.past, [*grads, slope.sum(axis=0), off @ active], strict=True):
            was += g**2
            array -= (RATE * g / np.sqrt(was)).astype(np.float32)
        self.past_base += off.sum() ** 2
        net.base -= RATE * off.sum() / np.sqrt(self.past_base)


def passes_for(rows: float, rounds: int = 1) -> int:
    """Passes of each round over that many texts of a trainer."""
    return -(-max(ROUNDS, -(-STEPS * BATCH // max(int(rows), 1))) // rounds)


def fit(docs: list[np.ndarray], y: np.ndarray, parts: np.ndarray, seed: int = SEED) -> Network:
    """What one trainer makes of texts given as word numbers; ``parts`` has the buckets of each word."""
    draw = np.random.default_rng(seed)
    found = np.zeros((2, BUCKETS + 1))
    _count(found, docs, y, parts)
    trainer = Trainer(_first(found, np.array([(y == 0).sum(), (y == 1).sum()]), draw))
    for _ in range(passes_for(sum(len(d) > 0 for d in docs))):
        trainer.pass_over(docs, y, parts, draw)
    return trainer.net


# --- training by all tasks ---------------------------------------------------------------


def _winners(net: Network, words: list[bytes]) -> list[bytes | None]:
    """The words of the windows that are largest for some filter; None stands between windows."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    given = net.projected(net.vectors(parts_of(list(numbers))))
    held = given[np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))]
    keep = np.zeros(len(words), bool)
    for span, values in zip(SPANS, net.windows(held), strict=True):
        for i in values.argmax(axis=0):
            keep[i : i + span] = True
    kept: list[bytes | None] = []
    last = -1
    for i in np.flatnonzero(keep):
        if i != last + 1:
            kept.append(None)
        kept.append(words[i])
        last = i
    return [*kept, None]


def _unseen(seen: np.ndarray, words: list[bytes]) -> list[bytes]:
    """Words with a part that is not seen yet."""
    fresh = list(dict.fromkeys(words))
    parts = parts_of(fresh)
    new = ~seen[parts].all(axis=1)
    seen[parts[new]] = True
    return [w for w, n in zip(fresh, new, strict=True) if n]


def _read(text: str, net: Network | None) -> list[bytes | None]:
    """A text's words; of a text over ``RUN`` words those that a network, or a count, can use."""
    kept: list[bytes | None] = []
    waiting: list[bytes] = []
    seen = None
    for words in words_of(text):
        waiting += words
        while len(waiting) > RUN:
            if net is not None:
                kept += _winners(net, waiting[:RUN])
            else:
                if seen is None:
                    seen = np.zeros(BUCKETS + 1, bool)
                    seen[BUCKETS] = True
                kept += _unseen(seen, waiting[:RUN])
            waiting = waiting[RUN - max(SPANS) + 1 :]  # no window is lost between slices
    return kept + waiting


def _chunks(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Texts as word numbers, their labels and the words' parts, in chunks of bounded memory."""
    numbers: dict[bytes, int] = {}
    docs: list[np.ndarray] = []
    y: list[int] = []
    n = 0

    def chunk() -> tuple[list, np.ndarray, np.ndarray]:
        words = list(numbers) or [b""]
        parts = np.vstack([parts_of(words[a : a + 65_536]) for a in range(0, len(words), 65_536)])
        return docs, np.array(y), parts

    for batch in batches:
        for text, label in zip(batch.column("_text").to_pylist(), batch.column("_y").to_pylist(), strict=True):
            words = _read(text, net)
            ids = [-1 if w is None else numbers.setdefault(w, len(numbers)) for w in words]
            docs.append(np.array(ids, np.int32))
            y.append(label)
            n += len(ids)
            if len(docs) >= ROWS or n > CHUNK or len(numbers) > HELD:
                yield chunk()
                numbers, docs, y, n = {}, [], [], 0
    if docs:
        yield chunk()


BLOCKS = "_block int, _given binary"


def _as_rows(given: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(given), 32):
        some = given[at : at + 32]
        columns = [pa.array([b for b, _ in some], pa.int32()), pa.array([g for _, g in some], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["_block", "_given"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each label have each part, one row for each block of parts."""
    found = np.zeros((2, BUCKETS + 1), np.int64)
    for docs, y, parts in _chunks(batches, None):
        _count(found, docs, y, parts)
    if found.any():
        blocks = found[:, :BUCKETS].reshape(2, -1, BLOCK)
        yield from _as_rows([(b, blocks[:, b].tobytes()) for b in range(blocks.shape[1]) if blocks[:, b].any()])


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(g, np.int64) for g in table.column("_given").to_pylist())
    return pa.table({"_block": table.column("_block")[:1].cast(pa.int32()), "_given": pa.array([total.tobytes()], pa.binary())})


def _trained(batches: Iterator[pa.RecordBatch], shared, passes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """What a trainer changed: for each block the texts seen, the parts moved and by how much.

    Block -1 has the numbers that are not of parts.
    """
    before = shared.value
    trainer, rows = copy.deepcopy(before), 0
    for docs, y, parts in _chunks(batches, before.net):
        draw = np.random.default_rng([seed, rows, len(parts)])
        for _ in range(passes):
            trainer.pass_over(docs, y, parts, draw)
        rows += len(docs)
    if not rows:
        return
    given = [(-1, np.append(rows, trainer.numbers() - before.numbers()).tobytes())]
    for b in range(BUCKETS // BLOCK):
        some = slice(b * BLOCK, (b + 1) * BLOCK)
        past = trainer.past_table[some] - before.past_table[some]
        ids = np.flatnonzero(past)
        if len(ids):
            table = (trainer.net.table[some] - before.net.table[some])[ids]
            moves = np.column_stack([table, past[ids]]).astype(np.float32)
            given.append((b, _packed(rows, ids, moves)))
    yield from _as_rows(given)


def _packed(rows: int, ids: np.ndarray, moves: np.ndarray) -> bytes:
    return np.array([rows, len(ids)], np.int64).tobytes() + ids.astype(np.int16).tobytes() + moves.tobytes()


def _unpacked(given: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    rows, n = np.frombuffer(given, np.int64, 2)
    ids = np.frombuffer(given, np.int16, n, 16)
    return int(rows), ids, np.frombuffer(given, np.float32, n * (DIM + 1), 16 + 2 * n).reshape(n, DIM + 1)


def _averaged(table: pa.Table) -> pa.Table:
    """The mean change of a block, trainers weighed by their texts; in an order of their own."""
    block, given = table.column("_block")[0].as_py(), sorted(table.column("_given").to_pylist())
    if block < 0:
        all_ = np.array([np.frombuffer(g, np.float64) for g in given])
        out = np.append(all_[:, 0].sum(), all_[:, 0] @ all_[:, 1:] / all_[:, 0].sum()).tobytes()
    else:
        total, weight = np.zeros((BLOCK, DIM + 1)), np.zeros(BLOCK)
        for rows, ids, moves in map(_unpacked, given):
            total[ids] += rows * moves.astype(np.float64)
            weight[ids] += rows
        ids = np.flatnonzero(weight)
        out = _packed(int(weight.max()), ids, (total[ids] / weight[ids][:, None]).astype(np.float32))
    return pa.table({"_block": pa.array([block], pa.int32()), "_given": pa.array([out], pa.binary())})


def _merge(trainer: Trainer, rows: list) -> None:
    """Put the averaged changes of a round into the network of the driver."""
    for block, given in rows:
        if block < 0:
            trainer.set_numbers(trainer.numbers() + np.frombuffer(given, np.float64)[1:])
        else:
            _, ids, moves = _unpacked(given)
            at = block * BLOCK + ids.astype(np.int64)
            trainer.net.table[at] += moves[:, :DIM]
            trainer.past_table[at] += moves[:, DIM]


def _learn_network(rows: DataFrame, of_label: np.ndarray, trainers: int) -> Network:
    """A network trained on all rows of _text and _y, which lie in one file for each trainer."""
    found = np.zeros((2, BUCKETS + 1))
    for block, given in group_in_arrow(in_arrow(rows, _counted, BLOCKS), ["_block"], _summed, BLOCKS).collect():
        found[:, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(given, np.int64).reshape(2, BLOCK)
    trainer = Trainer(_first(found, of_label, np.random.default_rng(SEED)))
    rounds = 1 if trainers == 1 else ROUNDS
    passes = passes_for(of_label.sum() / trainers, rounds)
    context = rows.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast(trainer)
        seed = SEED + turn
        moved = in_arrow(rows, lambda b, shared=shared, seed=seed: _trained(b, shared, passes, seed), BLOCKS)
        changes = group_in_arrow(moved, ["_block"], _averaged, BLOCKS).collect()
        shared.unpersist()
        _merge(trainer, changes)
    return trainer.net


# --- calibration -------------------------------------------------------------------------


def best_cut(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap at which the F1 of label 1 is largest."""
    order = np.argsort(-value, kind="stable")
    value, y, weight = value[order], y[order], weight[order]
    right, called = np.cumsum(weight * y), np.cumsum(weight)
    f1 = 2 * right / (called + (weight * y).sum())
    f1[:-1][value[:-1] == value[1:]] = -1  # no cut between equal values
    k = int(f1.argmax())
    return float((value[k] + (value[k + 1] if k + 1 < len(value) else value[k] - 1)) / 2)


def _cells(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The cell of each text's logit, with its language and label."""
    scorer = Scorer(shared.value)
    for batch in batches:
        logits = scorer.logits(batch.column("_text").to_pylist()) if batch.num_rows else np.zeros(0)
        cell = np.floor(np.clip(logits * GRID, -(1 << 15), (1 << 15) - 1)).astype(np.int32)
        columns = [batch.column("_lang"), pa.array(cell), batch.column("_y")]
        yield pa.RecordBatch.from_arrays(columns, ["_lang", "_cell", "_y"])


def _cut_of(cell: np.ndarray, of_label: np.ndarray) -> float:
    """The best cut between cells that hold so many texts of either label."""
    value = np.repeat((cell + 0.5) / GRID, 2)
    y, weight = np.tile([0, 1], len(cell)), of_label.ravel().astype(float)
    return best_cut(value[weight > 0], y[weight > 0], weight[weight > 0])


def _cut_by_lang(table: pa.Table) -> pa.Table:
    table = table.sort_by("_cell")
    of_label = np.column_stack([table.column("_n0").to_numpy(), table.column("_n1").to_numpy()])
    enough = MIN_POSITIVE <= of_label[:, 1].sum() < of_label.sum()
    cut = [_cut_of(table.column("_cell").to_numpy(), of_label)] if enough else []
    return pa.table({"_lang": table.column("_lang")[: len(cut)], "_cut": pa.array(cut, pa.float64())})


def calibrate(net: Network, rows: DataFrame) -> None:
    """Set the scale of scores and the thresholds of languages by rows of _text, _lang and _y."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    cells = in_arrow(rows, lambda b: _cells(b, shared), "_lang string, _cell int, _y int")
    counts = [F.sum((F.col("_y") == label).cast("long")).alias(f"_n{label}") for label in (0, 1)]
    cells = stored(cells.groupBy("_lang", "_cell").agg(*counts), "toxicity_cells")
    # at most 2 ** 16 rows, whatever the texts
    common = cells.groupBy("_cell").agg(F.sum("_n0"), F.sum("_n1")).orderBy("_cell").collect()
    cell, of_label = np.array([r[0] for r in common]), np.array([r[1:] for r in common])
    net.middle = _cut_of(cell, of_label)
    mean = of_label.T @ ((cell + 0.5) / GRID) / of_label.sum(axis=0)
    net.slope = float(np.clip(6 / max(mean[1] - mean[0], 1e-3), 0.2, 20))
    by_lang = group_in_arrow(cells.filter("_lang IS NOT NULL"), ["_lang"], _cut_by_lang, "_lang string, _cut double")
    net.by_lang = {r["_lang"]: float(net.score(np.array([r["_cut"]]))[0]) for r in by_lang.orderBy("_lang").collect()}


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A network fitted to all rows of _id, _text, _lang that have a label, of rows _id, _y; or
    one share.
    """
    known = labels.filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    total = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if not total:
        return 0.0
    apart = F.floor(F.crc32(F.col("_id").cast("string")) / 4) % 4 == 0
    trainers = -(-sum(total.values()) // ROWS)
    # texts are shuffled once, for the join and for the trainers
    texts = docs.filter(F.col("_id").isNotNull() & ~held_out(F.col("_id"))).repartition(trainers, "_id")
    rows = texts.join(known.repartition(trainers, "_id").hint("merge"), "_id").withColumn("_apart", apart)
    # Spark may join in more parts than asked for
    placed = rows.coalesce(trainers).sortWithinPartitions(F.xxhash64("_id"), "_id", "_text", "_lang")
    rows = stored(placed.select("_text", "_lang", "_y", "_apart"), "toxicity_labelled")
    counts = np.zeros((2, 2), int)
    for r in rows.groupBy("_apart", "_y").count().collect():
        counts[int(r["_apart"]), r["_y"]] = r["count"]
    if not counts.sum(axis=0).all():
        return total.get(1, 0) / sum(total.values())
    if counts.all():
        net = _learn_network(rows.filter("NOT _apart"), counts[0], trainers)
        calibrate(net, rows.filter("_apart"))
    else:
        net = _learn_network(rows, counts.sum(axis=0), trainers)
        calibrate(net, rows)
    return net


# --- scoring -----------------------------------------------------------------------------


def _nothing() -> np.ndarray:
    """Largest values of a text without words: below what any bias lifts over zero."""
    return np.full(len(SPANS) * FILTERS, -1e6)


class Scorer:
    """Scores of texts, with a bounded memory of words."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        # row 0 stands between texts
        self.given = np.zeros((1024, sum(SPANS) * FILTERS), np.float32)

    def _learn(self, fresh: list[bytes]) -> None:
        known, needed = len(self.numbers) + 1, len(self.numbers) + 1 + len(fresh)
        self.numbers.update(zip(fresh, range(known, needed), strict=True))
        if needed > len(self.given):
            self.given = np.vstack([self.given, np.zeros_like(self.given, shape=(needed, self.given.shape[1]))])
        for a in range(0, len(fresh), WORDS_AT_ONCE):
            some = fresh[a : a + WORDS_AT_ONCE]
            self.given[known + a : known + a + len(some)] = self.net.projected(self.net.vectors(parts_of(some)))

    def _raise_tops(self, tops: np.ndarray, runs: list[tuple[int, list[bytes], bool]]) -> None:
        """Lift the largest values of texts by runs of their words.

        A run that the text goes on after gives no window that would hang over its end.
        """
        if len(self.numbers) > HELD:
            self._forget()
        words = [w for _, run, _ in runs for w in run]
        fresh = [w for w in dict.fromkeys(words) if w not in self.numbers]
        if fresh:
            self._learn(fresh)
        sizes, gap = np.array([len(run) for _, run, _ in runs]), max(SPANS) - 1
        starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
        flat = np.zeros(int((sizes + gap).sum()), np.int64)
        place = np.arange(len(words)) + np.repeat(np.arange(len(runs)) * gap, sizes)
        flat[place] = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        ends = starts + sizes - np.array([0 if last else gap for _, _, last in runs])
        edges = np.column_stack([starts, ends]).ravel()
        held = self.net.windows(self.given[flat])
        best = np.hstack([np.maximum.reduceat(w, edges, axis=0)[::2] for w in held])
        np.maximum.at(tops, [text for text, _, _ in runs], best)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.net.score(self.logits(texts))

    def logits(self, texts: list[str]) -> np.ndarray:
        tops, runs, n, gap = np.tile(_nothing(), (len(texts), 1)), [], 0, max(SPANS) - 1

        def add(text: int, words: list[bytes], last: bool) -> None:
            nonlocal runs, n
            runs.append((text, words, last))
            n += len(words)
            if n >= RUN:
                self._raise_tops(tops, runs)
                runs, n = [], 0

        for i, text in enumerate(texts):
            waiting: list[bytes] = []
            for words in words_of(text):
                if words and len(waiting) > gap:
                    add(i, waiting, False)
                    waiting = waiting[-gap:]
                waiting = waiting + words
            if waiting:
                add(i, waiting, True)
        if runs:
            self._raise_tops(tops, runs)
        return self.net.logit(tops)


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(shared.value)
    at_text = None
    for batch in batches:
        at_text = batch.schema.get_field_index("_text") if at_text is None else at_text
        scores = scorer.scores(batch.column(at_text).to_pylist()) if batch.num_rows else np.zeros(0)
        langs = batch.column("_lang").to_pylist()
        cuts = [shared.value.by_lang.get(x, shared.value.common) for x in langs]
        rest = batch.drop_columns(["_text", "_lang"])
        yield rest.append_column("score", pa.array(scores, pa.float64())).append_column(
            "threshold", pa.array(cuts, pa.float64())
        )


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted by the one cut, and the
    threshold of the language with the verdict by it.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), whole(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    )
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    net = train(rows, known)
    if isinstance(net, float | int):
        scored = rows.select("_id", F.lit(float(net)).alias("score"), F.lit(CUT).alias("threshold"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(net)
        out = StructType([rows.schema["_id"]]).add("score", DoubleType()).add("threshold", DoubleType())
        scored = in_arrow(rows, lambda b: _score_batches(b, shared), out)
    return scored.select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        "threshold",
        (F.col("score") >= F.col("threshold")).alias("toxic"),
    )
