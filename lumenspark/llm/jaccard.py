"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Sets are put in bands by size; two sets with a similarity
of ``num / den`` or more that meet in a band differ in at most ``k`` elements. The feature domain is parted into about
``(k + 1) / 2`` parts, of which one has at most one difference, and each part into three cells, of which two have none
then. Every choice of two cells of a part is a signature (their whole content): similar sets share at least one. A set of
a band's upper end also gets the next band's signatures, so pairs across a border meet.

1. Documents with equal sets form a class, known by a 64-bit hash of the set; only classes are joined.
2. Signatures travel as packed arrays. A signature met once stops there; one repeated within a task is known to be shared
   at once, and only one entry of it goes on to be counted, so frequent signatures are pre-aggregated.
3. Each signature's classes are compared inside its task by sizes and by parity sketches, which give a lower bound of the
   difference. What leaves the task is a spanning forest of the pairs that fit. Its components are families: a link never
   leaves one.
4. Each family's sets are brought together once, in blocks of ``FAMILY_ELEMENTS`` elements; a task of two blocks counts all
   intersections exactly and again gives a spanning forest, now of links. Its components are the result.
5. Every document gets its class's component.

So no step makes a row for each pair. The rows shuffled grow with the signatures and with sets times the blocks of their
family; work inside tasks grows with the square of a signature's classes, or of a family beyond one block. Signatures of few
elements (two cells of about three each) also meet by chance, which the sketches sort out; the number of such meetings grows
faster than the input, their rows do not. The only thing broadcast is a bit table of bounded size that keeps other sets from
being shuffled. Shingles are compared by 52-bit hashes, so results are exact but for collisions of hashes.

Edge cases: null and empty texts have no set and are linked with nothing; a text of fewer words than a shingle is one
shingle; rows with one id are rows of their own (each with the component of its text); a null id gets its component but
is no candidate for the smallest id; ids may be of any type that has an order; other columns play no part; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenspark.llm import textops
from lumenspark.llm.packed import SMALL_ROWS, BitTable, groups, runs, shared_pairs, small_batches
from lumenspark.llm.shared import components, free, fresh, keep, width

BITS = 52
LEAST_CELLS = 64
MOST_CELLS = 4096
BLOCK = 2048
FAMILY_ELEMENTS = 1 << 20
FAMILY_BLOCK = 1024
_MASK = np.uint64((1 << BITS) - 1)
assert SMALL_ROWS <= 1 << (64 - BITS)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order (52 bits), and row offsets. At most ``SMALL_ROWS`` texts."""
    t = textops.tokenize_column(texts, lower=True)
    n = len(t.row_start) - 1
    window, first = textops.row_windows(t, k)
    row = np.searchsorted(t.row_start, first, "right") - 1
    for i in np.flatnonzero((np.diff(t.row_start) > 0) & (np.diff(t.row_start) < k)).tolist():
        whole = textops.windows(t.hashes[t.row_start[i] : t.row_start[i + 1]], int(t.row_start[i + 1] - t.row_start[i]))
        window, row = np.append(window, textops.mix(whole + np.uint64(t.row_start[i + 1] - t.row_start[i]))), np.append(row, i)
    keys = np.sort((row.astype(np.uint64) << np.uint64(BITS)) | (window >> np.uint64(64 - BITS)))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    offsets = np.searchsorted(keys, np.arange(n, dtype=np.uint64) << np.uint64(BITS))
    return keys & _MASK, np.append(offsets, len(keys))


def _wrapping_sums(values: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """Sum of 64-bit values by cell, modulo 2^64 (both halves are summed exactly as doubles)."""
    low = np.bincount(cell, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(cell, (values >> np.uint64(32)).astype(np.float64), n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def set_hashes(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hash of each set (as signed integers, as Spark has them)."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    return textops.mix(_wrapping_sums(textops.mix(sets + np.uint64(1)), row, n) + np.diff(offsets).astype(np.uint64)).view(np.int64)


@lru_cache(8)
def bands(num: int, den: int, widths: int = 3) -> np.ndarray:
    """Largest size of each band. A band spans ``widths`` times the ratio that similar sets may differ by."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = lo
        for _ in range(widths):
            hi = hi * den // num
        out.append(hi)
        lo = hi + 1
    return np.array(out, np.int64)


def signatures(sets: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all sets. Bands in which similar means equal give none: equal sets are one class already."""
    tops = bands(num, den)
    size = np.diff(offsets)
    band = np.searchsorted(tops, size)
    found, rows = [], []
    for step in (0, 1):
        instance = band + step
        # The next band matters if a similar set can be larger than this band's top.
        use = (size > 0) & (np.ones(len(size), bool) if step == 0 else size * den >= num * (tops[band] + 1))
        k = 2 * tops[instance] * (den - num) // (den + num)
        use &= k > 0
        groups = (k + 2) // 2
        cells = 3 * groups
        row = np.flatnonzero(use)
        if not len(row):
            continue
        base = np.zeros(len(size), np.int64)
        base[row] = np.cumsum(cells[row]) - cells[row]
        at = textops.ragged(offsets[:-1][row], size[row])
        owner = np.repeat(row, size[row])
        h = textops.mix(sets[at] + np.uint64(0x5851F42D4C957F2D))
        cell = ((h >> np.uint64(32)) * cells[owner].astype(np.uint64)) >> np.uint64(32)
        total = int(cells[row].sum())
        sums = _wrapping_sums(h, base[owner] + cell.astype(np.int64), total)
        index = np.arange(total) - np.repeat(base[row], cells[row])
        salt = textops.mix((np.repeat(instance[row], cells[row]).astype(np.uint64) << np.uint64(40)) + index.astype(np.uint64))
        content = textops.mix(sums ^ salt).reshape(-1, 3)
        # The cell of the same place that a choice leaves out is told by the salts of the two that it has.
        found.append(textops.mix(content * np.uint64(0xA24BAED4963EE407) + content[:, [1, 2, 0]]).ravel())
        rows.append(np.repeat(row, cells[row]))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(rows)


def _of_classes(texts: DataFrame, classes: DataFrame, k: int, column: str, blobs_of) -> DataFrame:
    """(class, n, column) of the classes asked for, once each; ``blobs_of`` makes the column from sets and the rows to take."""
    table = BitTable(classes, "class")

    def emit(batches):
        seen: set[int] = set()
        for batch in small_batches(batches):
            sets, offsets = shingle_sets(batch.column(0), k)
            h = set_hashes(sets, offsets)
            use = []
            for i in np.flatnonzero(table.may_hold(h) & (np.diff(offsets) > 0)).tolist():
                if int(h[i]) not in seen:
                    seen.add(int(h[i]))
                    use.append(i)
            if len(seen) > 50_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(h[use]), pa.array(np.diff(offsets)[use]), pa.array(blobs_of(sets, offsets, use), pa.binary())], names=["class", "n", column])

    found = texts.mapInArrow(emit, f"class long, n long, {column} binary").groupBy("class").agg(F.first("n").alias("n"), F.first(column).alias(column))
    return found.join(classes, "class", "left_semi")


def cells_of(n: np.ndarray) -> np.ndarray:
    """Cells of a set's sketch: a power of two, as many as it has elements or more (``LEAST_CELLS`` to ``MOST_CELLS``)."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_CELLS, MOST_CELLS)


def sketches_of(sets: np.ndarray, offsets: np.ndarray, use: list[int]) -> list[bytes]:
    """Parity of the number of elements in each cell, as bits: two sets differ by at least as many elements as their
    parities differ in bits. Halves of a sketch, added modulo two, are the sketch of half as many cells."""
    n = np.diff(offsets)[use]
    cells = cells_of(n)
    ends = np.cumsum(cells)
    at = textops.ragged(offsets[:-1][use], n)
    cell = (textops.mix(sets[at]) & np.repeat(cells - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(ends - cells, n)
    bits = np.packbits(np.bincount(cell, minlength=int(ends[-1]) if len(ends) else 0) & 1).tobytes()
    return [bits[a:b] for a, b in zip(((ends - cells) // 8).tolist(), (ends // 8).tolist(), strict=True)]


def _words(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(len(blobs), -1)


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches of ``width`` words from wider ones."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


class Sketches:
    """Classes of one group: which of them sizes and parities allow to be similar to a given one."""

    def __init__(self, n: np.ndarray, bits, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.width = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
        widths = np.unique(self.width).tolist()
        # at[w] holds the sketches of w words of all that have so many or more.
        self.at: dict[int, np.ndarray] = {}
        for w in widths:
            self.at[w] = np.zeros((len(n), w), np.uint64)
            for own in widths:
                rows = np.flatnonzero(self.width == own)
                if own >= w:
                    self.at[w][rows] = _folded(_words([bits[i] for i in rows.tolist()]), w)

    def fit(self, x: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(self.n[x], self.n[others]), np.maximum(self.n[x], self.n[others])
        others = others[small * self.den >= large * self.num]
        width = np.minimum(self.width[x], self.width[others])
        apart = np.empty(len(others), np.int64)
        for w in np.unique(width).tolist():
            mine = width == w
            apart[mine] = np.bitwise_count(self.at[w][others[mine]] ^ self.at[w][x]).sum(1, dtype=np.int64)
        return others[apart * (self.den + self.num) <= (self.n[x] + self.n[others]) * (self.den - self.num)]


def fitting_forest(sketches: Sketches, side: np.ndarray | None) -> list[tuple[int, np.ndarray]]:
    """Spanning forest of the pairs that fit (between the two sides, if given): a class, and those that it reaches first."""
    m = len(sketches.n)
    left = np.ones(m, bool)
    out = []
    for start in range(m):
        if not left[start]:
            continue
        left[start] = False
        waiting = [start]
        while waiting:
            x = waiting.pop()
            others = np.flatnonzero(left if side is None else left & (side != side[x]))
            if not len(others):
                if side is None:
                    return out
                continue
            found = sketches.fit(x, others)
            if len(found):
                left[found] = False
                out.append((x, found))
                waiting.extend(found.tolist())
    return out


def _blocks(q: str = "q"):
    """Each row's pairs of blocks (i, j), of ``q`` blocks, that its own block ``mine`` is part of."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.col(q) - 1), lambda x: F.struct(F.least("mine", x).alias("i"), F.greatest("mine", x).alias("j")))).alias("ij")


def families(shared: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(class, component) of classes that chains of fitting pairs connect, each pair within a signature.

    Of signatures that the same classes have one is enough. Classes are compared inside the signature's task, as arrays, and
    a spanning forest leaves it, never pairs of all; a signature of many classes is dealt into blocks, and each pair of
    blocks is a task's.
    """
    mark = [F.bit_xor(F.xxhash64("class", F.lit(i))).alias(f"x{i}") for i in range(2)]
    found = shared.groupBy("sig").agg(F.count("*").alias("m"), *mark)
    chosen = keep(found.groupBy("m", "x0", "x1").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("q")))
    rows = shared.join(chosen, "sig").withColumn("mine", F.pmod(F.xxhash64("class"), F.col("q")).cast("int"))
    dealt = rows.join(sketches, "class").select("sig", _blocks(), "mine", "class", "n", "bits").select("sig", "ij.i", "ij.j", "mine", "class", "n", "bits")

    def run(batches):
        out: list[np.ndarray] = []
        held = 0
        for (_, i, j, mine, classes, n, bits), starts in runs(batches, 3):
            ends = np.append(starts[1:], len(n))
            two = np.flatnonzero((ends - starts == 2) & (i[starts] == j[starts]))
            if len(two):
                out.append(_fitting_twos(starts[two], classes, n, bits, num, den))
                held += len(out[-1])
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a < 2 or b - a == 2 and i[a] == j[a]:
                    continue
                for x, others in fitting_forest(Sketches(n[a:b], bits[a:b], num, den), None if i[a] == j[a] else mine[a:b] == i[a]):
                    out.append(np.stack((np.full(len(others), classes[a + x]), classes[a + others]), 1))
                    held += len(others)
                    if held >= 1 << 16:
                        yield _edges(out)
                        out, held = [], 0
        if out:
            yield _edges(out)

    order = dealt.repartition(width(shared.sparkSession), "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    out = components(order.mapInArrow(run, "a long, b long"))
    free(chosen)
    renamed = out.withColumnRenamed("id", "class")
    renamed._kept = out._kept
    return renamed


def _fitting_twos(first: np.ndarray, classes: np.ndarray, n: np.ndarray, bits: np.ndarray, num: int, den: int) -> np.ndarray:
    """The fitting ones of pairs (first, first + 1), as classes."""
    small, large = np.minimum(n[first], n[first + 1]), np.maximum(n[first], n[first + 1])
    first = first[small * den >= large * num]
    size = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
    got = []
    for w, v in {*zip(size[first].tolist(), size[first + 1].tolist(), strict=True)}:
        at = first[(size[first] == w) & (size[first + 1] == v)]
        least = min(w, v)
        apart = np.bitwise_count(_folded(_words(bits[at].tolist()), least) ^ _folded(_words(bits[at + 1].tolist()), least)).sum(1, dtype=np.int64)
        got.append(at[apart * (den + num) <= (n[at] + n[at + 1]) * (den - num)])
    at = np.concatenate([*got, np.empty(0, np.int64)])
    return np.stack((classes[at], classes[at + 1]), 1)


def _edges(parts: list[np.ndarray]) -> pa.RecordBatch:
    got = np.unique(np.sort(np.concatenate(parts), 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(got[:, i].copy()) for i in (0, 1)], names=["a", "b"])


def _planes(elements: np.ndarray) -> bytes:
    """Sorted numbers by byte planes: their high bytes repeat, so Spark's compression takes them."""
    return np.ascontiguousarray(np.ascontiguousarray(elements).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of each left set with each right one.

    Elements that a tenth of the sets hold are counted by products of 0-1 matrices, the others by their pairs of holders.
    """
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
    holders = np.diff(np.append(start, len(element)))
    place_l, place_r = np.full(m, -1), np.full(m, -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)  # counts below 2^24 are exact
    often = np.flatnonzero((holders > 1) & (holders * 10 >= m))
    step = max(64, (1 << 21) // m)
    for at in range(0, len(often), step):
        use = often[at : at + step]
        rows = owner[textops.ragged(start[use], holders[use])]
        column = np.repeat(np.arange(len(use)), holders[use])
        grid = np.zeros((m, len(use)), np.float32)
        grid[rows, column] = 1
        out += grid[left] @ grid[right].T
    rare = np.flatnonzero((holders > 1) & (holders * 10 < m))
    for p in np.unique(holders[rare]).tolist():
        use = rare[holders[rare] == p]
        for at in range(0, len(use), max(1, (1 << 21) // (p * p))):
            held = owner[start[use[at : at + max(1, (1 << 21) // (p * p))]][:, None] + np.arange(p)[None]]
            a = np.broadcast_to(place_l[held][:, :, None], (len(held), p, p)).ravel()
            b = np.broadcast_to(place_r[held][:, None, :], (len(held), p, p)).ravel()
            ok = (a >= 0) & (b >= 0)
            place, count = np.unique(a[ok] * len(right) + b[ok], return_counts=True)
            out.reshape(-1)[place] += count
    return out


def linked_forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the similar pairs between left and right sets (all sets, if both are the same)."""
    if len(sets) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if den * shared >= num * (len(sets[0]) + len(sets[1]) - shared) else []
    same = len(left) == len(right) == len(sets)
    shared = intersections(sets, left, right)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    link = np.empty(shared.shape, bool)
    for i, size in enumerate(n[left].tolist()):
        row = shared[i].astype(np.int64)
        link[i] = den * row >= num * (size + n[right] - row)
    open_l, open_r, out = np.ones(len(left), bool), np.ones(len(right), bool), []
    for root in range(len(left)):
        if not open_l[root]:
            continue
        rows, open_l[root] = np.array([root]), False
        if same:
            open_r[root] = False
        while len(rows):
            columns = np.flatnonzero(link[rows].any(0) & open_r)
            open_r[columns] = False
            out += [(int(left[root]), int(right[c])) for c in columns.tolist()]
            if same:
                rows, open_l[columns] = columns, False
            else:
                rows = np.flatnonzero(link[:, columns].any(1) & open_l)
                open_l[rows] = False
                out += [(int(left[root]), int(left[r])) for r in rows.tolist()]
    return out


def class_components(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(class, component) of all classes that are linked with another one; the component is a class as well. Kept."""
    spark = texts.sparkSession

    def keys(batch):
        sets, offsets = shingle_sets(batch.column(0), k)
        found, row = signatures(sets, offsets, num, den)
        # 48 bits: signatures that meet by chance are told apart by what follows, like any others.
        return found >> np.uint64(16), set_hashes(sets, offsets)[row]

    shared = keep(shared_pairs(texts, keys, width(spark)).withColumnsRenamed({"key": "sig", "owner": "class"}))
    sketches = keep(_of_classes(texts, shared.select("class").distinct(), k, "bits", sketches_of))
    family = families(shared, sketches, num, den)
    free(shared)
    sized = family.join(sketches.select("class", "n"), "class")
    blocks = F.greatest(F.ceil(F.sum("n") / FAMILY_ELEMENTS), F.ceil(F.count("*") / FAMILY_BLOCK)).cast("int").alias("q")
    placed = keep(family.join(sized.groupBy("component").agg(blocks), "component"))
    free(sketches)
    sets = _of_classes(texts, placed, k, "elements", lambda sets, offsets, use: [_planes(sets[offsets[i] : offsets[i + 1]]) for i in use])
    rows = sets.join(placed, "class").withColumn("mine", F.pmod(F.xxhash64("class"), F.col("q")).cast("int"))
    dealt = rows.select("component", _blocks(), "mine", "class", "elements").select("component", "ij.i", "ij.j", "mine", "class", "elements")

    def run(batches):
        out, held = [], 0
        for _, i, j, mine, classes, blobs in groups(batches, 3):
            left = np.flatnonzero(mine == i[0])
            right = np.flatnonzero(mine == j[0])
            if not len(left) or not len(right) or len(classes) < 2:
                continue
            got = linked_forest([_from_planes(x) for x in blobs], left, right, num, den)
            if got:
                out.append(classes[np.array(got)])
                held += len(got)
            if held >= 1 << 16:
                yield _edges(out)
                out, held = [], 0
        if out:
            yield _edges(out)

    order = dealt.repartition(width(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = components(order.mapInArrow(run, "a long, b long")).withColumnRenamed("id", "class")
    free(family, placed)
    return found


def document_sets(docs: DataFrame, k: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, class of every document."""

    def run(batches):
        for batch in small_batches(batches, "text"):
            sets, offsets = shingle_sets(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(set_hashes(sets, offsets))], names=["doc_id", "n_shingles", "class"])

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_shingles long, class long")


def _labelled(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, class of every document, and class, component_id of every class that has a shingle. Both kept."""
    base = keep(document_sets(docs, k))
    labels = class_components(docs.select(F.col("text").cast("string").alias("text")), k, num, den)
    full = base.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    of_class = keep(full.join(labels, "class", "left").select("class", "least", F.coalesce("component", "class").alias("of")))
    least = of_class.groupBy("of").agg(F.min("least").alias("component_id"))
    return base, keep(of_class.join(least, "of").select("class", "component_id"))


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every document."""
    base, of_class = _labelled(docs, k, num, den)
    alone = base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = base.where("n_shingles > 0").join(of_class, "class").select("doc_id", "n_shingles", "component_id")
    return linked.union(alone)


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of near copies: of its smallest id the text of the smallest class, and of rows alike in both the
    first by text and all other columns. Rows without words are linked with nothing: one of each id stays. An id on texts
    of several groups stays once in each that it is the smallest of. Rows with a null id stay."""
    base, of_class = _labelled(docs, k, num, den)
    known = base.where("doc_id is not null").join(of_class, "class", "left")
    # Copies of an id are counted, so that only ids that repeat are ever compared row by row.
    mine = known.where("component_id is null or doc_id = component_id").groupBy("doc_id", "component_id", "class").agg(F.count("*").alias("rows"))
    first = mine.groupBy("doc_id", "component_id").agg(F.min("class").alias("class"), F.min_by("rows", "class").alias("rows"))
    id_name, class_name, its_id, its_class = (fresh(docs, x) for x in ("_id", "_class", "_its_id", "_its_class"))
    chosen = keep(first.select(F.col("doc_id").alias(its_id), F.col("class").alias(its_class), "rows"))

    def rows_of(wanted: DataFrame) -> DataFrame:
        table = BitTable(wanted, its_class)

        def mark(batches):
            for batch in small_batches(batches):
                h = set_hashes(*shingle_sets(batch.column(batch.schema.get_field_index("text")), k))
                use = pa.array(table.may_hold(h))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h)], names=[*batch.schema.names, class_name]).filter(use)

        schema = StructType([*docs.schema.fields, StructField(class_name, LongType())])
        marked = docs.mapInArrow(mark, schema).withColumn(id_name, F.col("doc_id"))
        return marked.join(wanted, (F.col(id_name) == F.col(its_id)) & (F.col(class_name) == F.col(its_class)), "left_semi")

    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = rows_of(chosen.where("rows = 1")).select(*columns)
    if chosen.where("rows > 1").limit(1).count():
        row = F.struct(*columns)
        least = rows_of(chosen.where("rows > 1")).groupBy(id_name, class_name).agg(F.min_by(row, F.struct(F.col("text").cast("string"), F.to_json(row))).alias("_row"))
        out = out.union(least.select("_row.*"))
    return out.union(docs.where(F.col("doc_id").isNull()))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS sh FROM d),
c AS (SELECT doc_id, len(sh)::BIGINT AS n, sh, min(doc_id) OVER (PARTITION BY list_sort(sh)) AS rep FROM s),
x AS (SELECT doc_id, n, unnest(sh) AS g FROM c WHERE doc_id = rep AND n > 0),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT c.doc_id, c.n AS n_shingles, CASE WHEN c.n = 0 THEN c.doc_id ELSE least(c.rep, coalesce(m.m, c.rep)) END AS component_id
FROM c LEFT JOIN m ON m.a = c.rep
"""
