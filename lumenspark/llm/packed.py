"""Finding keys that several owners share, with keys and owners in packed arrays.

Millions of (key, owner) pairs travel as a few thousand binary rows, so the JVM never sees them one by one. Each task
sorts its pairs first; a key that repeats there is known to be shared at once, its pairs are spread over all tasks, and
one flagged entry of it goes on to be counted. The entries of one key therefore never number more than the flushes of all
tasks, however many owners it has. The counting side sorts its entries and compares neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm import textops
from lumenspark.llm.shared import tidy

SMALL_ROWS = 4096
FLUSH = 1 << 19
BITS_EACH = 128
MOST_BITS = 28

_PAIR = [("k", np.uint64), ("o", np.int64)]


def _pack(pairs: np.ndarray) -> bytes:
    """Sorted keys by byte planes (their high bytes repeat, so Spark's compression takes them), owners as places in a table."""
    owners, place = np.unique(pairs["o"], return_inverse=True)
    planes = np.ascontiguousarray(np.ascontiguousarray(pairs["k"]).view(np.uint8).reshape(-1, 8).T)
    short = np.uint16 if len(owners) < 1 << 16 else np.uint32
    return np.array([len(pairs), len(owners)], np.int64).tobytes() + planes.tobytes() + owners.tobytes() + place.astype(short).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    out = np.empty(n, _PAIR)
    out["k"] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 16).reshape(8, -1).T).view(np.uint64).ravel()
    owners = np.frombuffer(raw, np.int64, m, 16 + 8 * n)
    out["o"] = owners[np.frombuffer(raw, np.uint16 if m < 1 << 16 else np.uint32, n, 16 + 8 * n + 8 * m)]
    return out


def small_batches(batches, column: str = "text"):
    """Batches of about half a MB of text and at most ``SMALL_ROWS`` rows."""
    for batch in textops.batches_by_bytes(batches, column):
        for at in range(0, batch.num_rows, SMALL_ROWS):
            yield batch.slice(at, SMALL_ROWS)


def shared_pairs(df: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], parts: int, buckets: int = 0) -> DataFrame:
    """(key, owner) of all keys that at least two owners have, once each.

    ``keys_of`` gives the unsigned keys (64 bits; the fewer are used the less is shuffled) and the owners of a batch of
    ``df``, which has a column text. Keys are dealt into ``buckets`` (two a partition), and a counting task holds one bucket at a time: Spark sorts its rows by bucket,
    and spills them if it must.
    """
    buckets = buckets or 2 * parts

    def emit(batches):
        waiting: list[np.ndarray] = []
        held = turn = 0

        def flush():
            nonlocal waiting, held, turn
            if not waiting:
                return
            pairs = np.concatenate(waiting)
            waiting, held = [], 0
            pairs = pairs[np.lexsort((pairs["o"], pairs["k"]))]
            pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
            k = pairs["k"]
            first = np.concatenate(([True], k[1:] != k[:-1]))
            many = ~first
            many[:-1] |= ~first[1:]
            goes = np.flatnonzero(first)
            to = (k[goes] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            goes = goes[order]
            cuts = np.searchsorted(to[order], np.arange(buckets + 1)).tolist()
            rows = [(p, _pack(pairs[goes[cuts[p] : cuts[p + 1]]]), np.packbits(many[goes[cuts[p] : cuts[p + 1]]]).tobytes(), b"") for p in range(buckets) if cuts[p + 1] > cuts[p]]
            known = pairs[many]
            for x in np.array_split(known, 1 + len(known) // 4096):
                if len(x):
                    rows.append((int(textops.mix(x["k"][:1] + np.uint64(turn))[0] % np.uint64(buckets)), b"", b"", x.tobytes()))
                    turn += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=["p", "counted", "flags", "known"])

        for batch in small_batches(batches):
            keys, owners = keys_of(batch)
            if len(keys):
                x = np.empty(len(keys), _PAIR)
                x["k"], x["o"] = keys, owners
                waiting.append(x)
                held += len(x)
            if held >= FLUSH:
                yield from flush()
        yield from flush()

    def out_of(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x["k"]).view(np.int64)), pa.array(np.ascontiguousarray(x["o"]))], names=["key", "owner"])

    def count(batches):
        at, entries, flags = -1, [], []
        for batch in batches:
            for p, counted, flag, known in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if p != at:
                    yield from shared_of(entries, flags)
                    at, entries, flags = p, [], []
                if known:
                    yield out_of(np.frombuffer(known, _PAIR))
                if counted:
                    x = _unpack(counted)
                    entries.append(x)
                    flags.append(np.unpackbits(np.frombuffer(flag, np.uint8), count=len(x)).astype(bool))
        yield from shared_of(entries, flags)
        entries, flags = [], []
        textops.return_memory()

    def shared_of(entries: list[np.ndarray], flags: list[np.ndarray]):
        """Entries of a bucket whose key another owner has too."""
        if not entries:
            return
        x, flag = np.concatenate(entries), np.concatenate(flags)
        order = np.argsort(x["k"], kind="stable")
        k = x["k"][order]
        same = k[1:] == k[:-1]
        many = np.zeros(len(k), bool)
        many[1:] |= same
        many[:-1] |= same
        # Neighbours of one owner only are no sharing, unless one of them is flagged.
        if many.any():
            run = np.cumsum(np.concatenate(([True], ~same))) - 1
            o, f = x["o"][order], flag[order]
            start = np.flatnonzero(np.concatenate(([True], ~same)))
            low, high, flagged = np.minimum.reduceat(o, start), np.maximum.reduceat(o, start), np.maximum.reduceat(f, start)
            many &= ((low != high) | flagged)[run]
            use = order[many & ~f]
            for at in range(0, len(use), 1 << 16):
                yield out_of(x[use[at : at + (1 << 16)]])

    packed = df.mapInArrow(emit, "p int, counted binary, flags binary, known binary")
    return packed.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(count, "key long, owner long").distinct()


def _array(c) -> np.ndarray:
    """Numbers as they are; binary values as an array of objects."""
    return c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy()


def runs(batches, keys: int):
    """Sorted batches as (columns, starts): whole groups (equal first ``keys`` columns) only, many at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(keys)]
        if last == [batch.column(i)[0].as_py() for i in range(keys)] == ends:  # one group still: no copy of what is held
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        columns = [_array(c) for c in table.columns]
        starts = _starts(columns[:keys], table.num_rows)
        if len(starts) > 1:
            yield [c[: starts[-1]] for c in columns], starts[:-1]
        held, last = table.slice(int(starts[-1])).to_batches(), ends
    if held:
        columns = [_array(c) for c in pa.Table.from_batches(held).combine_chunks().columns]
        yield columns, _starts(columns[:keys], len(columns[0]))
    textops.return_memory()


def _starts(columns: list[np.ndarray], n: int) -> np.ndarray:
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def groups(batches, keys: int):
    """Rows of sorted batches as column lists, one group (equal first ``keys`` columns) at a time."""
    for columns, starts in runs(batches, keys):
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(columns[0])], strict=True):
            yield [c[a:b] for c in columns]


class BitTable:
    """Which 64-bit values may be among those of a column: ``BITS_EACH`` bits a value, from 2^16 to 2^MOST_BITS (32 MB).

    Beyond 2^MOST_BITS / BITS_EACH values the table fills up and lets more through; what it lets through is always joined
    exactly afterwards, so it only saves shuffling. 256 rows of it reach the driver.
    """

    def __init__(self, df: DataFrame, column: str):
        spark = df.sparkSession
        with tidy(spark):
            n = df.count()
            self.bits = bits = min(MOST_BITS, max(16, (BITS_EACH * max(n, 1) - 1).bit_length()))
            place = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
            bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{column}`), {64 - bits}) & 63 as int))")
            words = df.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
            per_slice = 1 << (bits - 6 - 8)

            def slices(batches):
                """The words of each slice of the table as one binary row."""
                held: dict[int, np.ndarray] = {}
                for batch in batches:
                    word, value = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    for i in np.unique(word // per_slice).tolist():
                        mine = word // per_slice == i
                        held.setdefault(i, np.zeros(per_slice, np.int64))[word[mine] % per_slice] = value[mine]
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slice", "words"])

            dealt = words.repartition(min(256, 4 * spark.sparkContext.defaultParallelism), F.expr(f"word div {per_slice}"))
            table = np.zeros(1 << (bits - 6), np.int64)
            for row in dealt.mapInArrow(slices, "slice long, words binary").collect():
                table[row["slice"] * per_slice : (row["slice"] + 1) * per_slice] = np.frombuffer(row["words"], np.int64)
        self._table = spark.sparkContext.broadcast(table)

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        place = (xxhash64_of_longs(values) >> np.uint64(64 - self.bits)).astype(np.int64)
        return ((self._table.value[place >> 6] >> (place & 63)) & 1).astype(bool)


def xxhash64_of_longs(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of a column of longs (the published XXH64 of one 8-byte block)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + p5 + np.uint64(8)
        h = h ^ (turn(values.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))
