"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens.

Every document becomes its ids and one end id; only documents longer than a sequence are cut. The
histogram of piece lengths (at most `capacity` numbers, however many documents) poses a
configuration linear program: cover each length's count with as few sequences as possible, a
configuration being a multiset of lengths that fits one. Multiplicative weights solve it: in each
round a knapsack dynamic program prices out the most valuable configuration at the current weights,
which then fall for the lengths it covers. The program takes lengths rounded up to a multiple of
`UNIT`, so a configuration always fits. The fractional solution is rounded down to whole copies;
what remains is placed best-fit by decreasing length, again on the histogram, with copies of equal
patterns kept as one entry. The driver so handles patterns, never documents. Pieces find their slot
by their rank among the pieces of equal length: the rank within the task that made them, plus the
counts of the tasks before it. No key gathers the pieces of a length in one task.

Defined results: a null or empty text is the end id alone; a row with a null doc_id is packed like
any other, ids keep their type; repeated rows are packed once each; an empty table packs into nothing; other columns of
the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import cut, spread, table
from lexmill.session import ship

CAPACITY = 2048
END_ID = 0
#: Most rounds of the multiplicative weights, and the share of the tightest size that one round covers.
ROUNDS, STEP = 4000, 0.1
#: The program takes lengths rounded up to a multiple of UNIT. Rounding uses a share of its solution, so
#: that the pieces held back can fill, best-fit, the room that is left; of these the best share counts.
UNIT, SHARES = 8, (0.75, 0.5, 0.25)


# --- the plan over the histogram ------------------------------------------------------------------


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration (length index to copies) of the largest total price that fits."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    order = np.arange(len(lengths))
    for c in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        value = best[c - lengths[:k]] + prices[:k]
        j = int(order[:k][value.argmax()])
        if value[j] > best[c - 1]:
            best[c], pick[c] = value[j], j
        else:
            best[c] = best[c - 1]
    found: dict[int, int] = {}
    c = capacity
    while c > 0:
        if (j := int(pick[c])) < 0:
            c -= 1
        else:
            found[j] = found.get(j, 0) + 1
            c -= int(lengths[j])
    return found


def configurations(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[dict[int, int], float]]:
    """The fractional solution: configurations (size to copies) and how often each is used.

    counts[k] is the number of pieces of size k. A round's weights are exp(-covered share / step), its
    prices weight / count; the configuration of the largest price is used until the tightest of its
    sizes has gained `step` of its count.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return []
    number, covered = counts[sizes].astype(float), np.zeros(len(sizes))
    used: dict[tuple, float] = {}
    for _ in range(rounds):
        if covered.min() >= 1:
            break
        weights = np.exp((covered.min() - covered) / step)
        found = knapsack(weights / number, sizes, capacity)
        at, copies = np.array(list(found)), np.array(list(found.values()), float)
        amount = step * float((number[at] / copies).min())
        covered[at] += amount * copies / number[at]
        key = tuple(sorted(found.items()))
        used[key] = used.get(key, 0.0) + amount
    scale = 1 / max(covered.min(), step)
    return [({int(sizes[j]): n for j, n in key}, x * scale) for key, x in used.items()]


class Stock:
    """The pieces of one size class that are still to place: (length, number), the longest first."""

    def __init__(self, left: np.ndarray, low: int, high: int):
        self.runs = [[k, int(left[k])] for k in range(high, low - 1, -1) if left[k]]

    def take(self, n: int, copies: int) -> tuple[tuple[tuple[int, int], ...], int]:
        """n pieces for one sequence, and how many sequences alike (at most `copies`) could have them."""
        if self.runs[0][1] >= n:
            return ((self.runs[0][0], n),), min(copies, self.runs[0][1] // n)
        got = []
        for length, number in self.runs:
            got.append((length, min(n, number)))
            n -= got[-1][1]
            if not n:
                break
        return tuple(got), 1

    def drop(self, items: tuple[tuple[int, int], ...], copies: int) -> None:
        for _, n in items:
            self.runs[0][1] -= n * copies
            if not self.runs[0][1]:
                self.runs.pop(0)


class Open:
    """Patterns under way, by the room left in them; equal ones are one entry with a number of copies."""

    def __init__(self) -> None:
        self.by_room: dict[int, list[list]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, pattern: tuple, copies: int) -> None:
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append([pattern, copies])

    def best(self, length: int) -> int | None:
        i = bisect_left(self.rooms, length)
        return self.rooms[i] if i < len(self.rooms) else None

    def take(self, room: int, most: int) -> tuple[tuple, int]:
        entry = self.by_room[room][-1]
        n = min(most, entry[1])
        entry[1] -= n
        if not entry[1]:
            self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms.remove(room)
        return entry[0], n


def rounded(hist: np.ndarray, lp: list[tuple[dict[int, int], float]], capacity: int, unit: int, share: float) -> list[tuple[tuple, int]]:
    """Patterns from `share` of the fractional solution, completed best-fit by decreasing length."""
    left, opened = hist.astype(np.int64).copy(), Open()
    units = capacity // unit
    stock = {k: Stock(left, (k - 1) * unit + 1, capacity if k == units else k * unit) for k in range(1, units + 1)}
    for config, x in lp:
        todo, smallest = int(x * share), min(config)
        config = {k: n - (k == smallest) for k, n in config.items() if n > (k == smallest)}  # best fit chooses the last piece
        while todo and config and all(sum(n for _, n in stock[k].runs) >= c for k, c in config.items()):
            parts, copies = [], todo
            for k, c in config.items():
                items, copies = stock[k].take(c, copies)
                parts.append((k, items))
            for k, items in parts:
                stock[k].drop(items, copies)
                for length, n in items:
                    left[length] -= n * copies
            pattern = tuple(sorted((x for _, items in parts for x in items), reverse=True))
            opened.add(capacity - sum(k * n for k, n in pattern), pattern, copies)
            todo -= copies
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            room = opened.best(length)
            if room is None:
                fit = min(capacity // length, n)
                opened.add(capacity - fit * length, ((length, fit),), n // fit)
                n %= fit
            else:
                pattern, copies = opened.take(room, n)
                last = pattern[-1]
                grown = (*pattern[:-1], (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
                opened.add(room - length, grown, copies)
                n -= copies
    return [(p, n) for entries in opened.by_room.values() for p, n in entries]


def plan(hist: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, unit: int = UNIT, shares: tuple[float, ...] = SHARES) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, copies), ...) and how many sequences follow each; together exactly the histogram."""
    left = hist.astype(np.int64).copy()
    full = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    unit = max(1, min(unit, capacity // 64))
    units = capacity // unit
    classes = np.minimum(-(-np.arange(capacity + 1) // unit), units)
    lp = configurations(np.bincount(classes, left, units + 1), units, rounds)
    return full + min((rounded(left, lp, capacity, unit, x) for x in shares), key=lambda p: sum(n for _, n in p))


class Slots:
    """Where the r-th piece of a length goes; arrays that pack into a few bytes per pattern entry."""

    def __init__(self, patterns: list[tuple[tuple[tuple[int, int], ...], int]]):
        rows, base, seen = [], 0, {}
        for pattern, copies in patterns:
            offset = 0
            for length, n in pattern:
                start = seen.get(length, 0)
                rows.append((length << 48 | start, start, n, offset, base))
                seen[length] = start + n * copies
                offset += n * length
            base += copies
        self.key, self.start, self.each, self.offset, self.base = np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5).T.copy()

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length.astype(np.int64) << 48) | rank, "right") - 1
        instance, turn = np.divmod(rank - self.start[at], self.each[at])
        return self.base[at] + instance, self.offset[at] + turn * length


# --- the pieces of all documents ------------------------------------------------------------------

_pieces: dict = {}


def ids_of(path: str | None):
    """This worker's lookup; it outlives a task, so later tasks find most pre-tokens known."""
    from lexmill.llm.pretokens import Pieces

    if path not in _pieces:
        _pieces.clear()
        _pieces[path] = Pieces(path)
    return _pieces[path].ids


def cut_pieces(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, CRC-32) of each piece of a document's little-endian ids."""
    n = len(ids) // 4
    return [(s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for s in range(0, n, capacity)]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str | None) -> DataFrame:
    end = END_ID.to_bytes(4, "little")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`"))
    schema = T.StructType([rows.schema.fields[0], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long, part int, nth long").fields])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ids, part, seen = ids_of(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc, text in enumerate(batch.column(1)):
                for k, (start, length, crc) in enumerate(cut_pieces(ids(text.as_py()) + end, capacity)):
                    rows.append((doc, k, start, length, crc, part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
            at, *rest = (pa.array(c, t) for c, t in zip(columns, types, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *rest], names)

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    made = cut(pieces(docs, id_col, text_col, capacity, path))
    counts = made.groupBy("part", "length").count()
    hist = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        hist[row["length"]] = row["n"]
    slots = spark.sparkContext.broadcast(Slots(plan(hist, capacity, rounds)))  # a few rows per pattern, not per document
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = made.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    out = ranked.withColumnRenamed("rank", "sequence_id").withColumn("offset", F.col("sequence_id"))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            sequence, offset = slots.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], batch.schema.names)

    return out.mapInArrow(place, out.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
