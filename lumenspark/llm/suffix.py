"""Suffix-array dedup over sparse suffixes.

Only suffixes at content-selected positions are kept: in every window of ``LENGTH`` words the leftmost minimum among the
hashes of its ``HEAD``-word runs (a minimiser). Two equal passages of LENGTH words choose the same position in them, so a
repeated passage always holds a kept suffix on both sides. A kept suffix and the windows that chose it make a stretch.

1. Suffixes whose head (first HEAD words) no other document has go, by sorting packed heads (see ``packed``). Stretches that
   are equal as a whole are one from here on, with the smallest and the largest document that has them.
2. Where different stretches share a head, their suffixes are sorted by their words over all partitions (the sparse suffix
   array; a word counts as its 32-bit hash) and each is compared with its neighbours: the longer common prefix says how far
   any match extends to the right. Windows that it does not fill are unique and go.
3. What is left is extended to the left word by word: equal windows of LENGTH words are brought together by content, which
   gives the exact ends of each passage and the smallest and largest of all its holders.
4. Repeated windows of a document that touch or overlap are one span.

Words are runs of other than white space, case matters. Repetition is across documents: rows with one id are one document.
``within`` also reports what a document repeats only in itself.

Scale: heads are counted in buckets, suffixes are dealt by ranges (a head that a third of all documents share spreads over
many tasks; a range's first and last suffix count as matched, which only saves less), and everything else is pre-aggregated
or joined by splittable sort-merge joins. A passage that many documents share costs each of them a few rows and no task all
of them.

Edge cases: null, empty and shorter texts hold no passage; rows with a null id take no part and are never cut; ids may be of
any type that has an order; other columns stay whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.llm import textops
from lumenspark.llm.packed import BitTable, shared_pairs, small_batches
from lumenspark.llm.shared import free, fresh, keep, width

LENGTH = 50
HEAD = 16

_M = 0x2545F4914F6CDD1D
_M_INV = pow(_M, -1, 1 << 64)


def kept_suffixes(t: textops.Tokens, length: int = LENGTH, head: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept suffixes of tokenised rows: hash of the head, its word, and first and last window that chose it (words over
    all rows). Windows of one row that follow each other and choose one suffix make one entry."""
    heads = textops.windows(t.hashes, head)
    window = textops.ragged(t.row_start[:-1], np.maximum(np.diff(t.row_start) - (length - 1), 0))
    if not len(window):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    span = length - head + 1
    chosen = np.empty(len(window), np.int64)
    step = 1 << 22
    for at in range(0, len(window), step):
        w = window[at : at + step]
        lo = int(w[0])
        part = heads[lo : int(w[-1]) + span]
        # The position in the low bits makes the leftmost of equal heads win.
        low = (part & ~np.uint64((1 << 24) - 1)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        chosen[at : at + step] = (low[w - lo] & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
    new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return heads[chosen[first]], chosen[first], window[first], window[last]


def _prefix_sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums that give the hash of any stretch of words by two look-ups, and the inverse powers that go with them."""
    power = np.full(len(h), _M, np.uint64)
    inverse = np.full(len(h) + 1, _M_INV, np.uint64)
    if len(h):
        power[0] = 1
    inverse[0] = 1
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * np.cumprod(power, dtype=np.uint64), out=sums[1:])
    return sums, np.cumprod(inverse, dtype=np.uint64)


def _stretch(sums: np.ndarray, inverse: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return textops.mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))


def _rows_of(words: np.ndarray, t: textops.Tokens) -> np.ndarray:
    return np.searchsorted(t.row_start, words, "right") - 1


def _short(h: np.ndarray) -> np.ndarray:
    """32 bits of word hashes, never 0 (which stands for no word)."""
    return np.maximum(h >> np.uint64(32), np.uint64(1)).astype(np.uint32)


def _padded(words: np.ndarray, first: np.ndarray, count: np.ndarray, to_right: bool, width: int) -> np.ndarray:
    """Words first .. first + count - 1 of each entry as a row of ``width``, at its left or right end."""
    out = np.zeros((len(first), width), np.uint32)
    column = textops.ragged((width - count) if to_right else np.zeros(len(count), np.int64), count)
    out[np.repeat(np.arange(len(first)), count), column] = words[textops.ragged(first, count)]
    return out


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Words that each row shares with the one before it (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        same = (rows[1:] == rows[:-1]) & (rows[1:] > 0)
        out[1:] = np.where(same.all(1), rows.shape[1], (~same).argmax(1))
    return out


def repeated_windows(docs: DataFrame, length: int = LENGTH, head: int = HEAD, within: bool = False) -> DataFrame:
    """(doc_id, first, end, low, high): stretches of words [first, end) whose windows of ``length`` words other documents
    have, and the smallest and largest document that has them. Stretches of one document may overlap."""
    spark = docs.sparkSession
    source = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("owner"), F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    reach = length - head

    def head_keys(batch):
        t = textops.tokenize_column(batch.column(2))
        h, at, _, _ = kept_suffixes(t, length, head)
        row = _rows_of(at, t)
        owner = batch.column(1).to_numpy()[row]
        if within:  # each place counts, not each document
            owner = textops.mix(owner.view(np.uint64) + (at - t.row_start[row]).astype(np.uint64) * np.uint64(_M)).view(np.int64)
        return h, owner

    shared = keep(shared_pairs(source, head_keys, width(spark)).select("key").distinct())
    table = BitTable(shared, "key")

    def stretches_of(batch, table):
        """Kept suffixes that the table lets through: tokens, head, place, first and last window, row, hash of the stretch."""
        t = textops.tokenize_column(batch.column(2))
        h, at, first, last = kept_suffixes(t, length, head)
        use = table.may_hold(h.view(np.int64))
        h, at, first, last = h[use], at[use], first[use], last[use]
        sums, inverse = _prefix_sums(t.hashes)
        return t, h, at, first, last, _rows_of(at, t), _stretch(sums, inverse, first, last + length)

    def places(batches):
        for batch in small_batches(batches):
            t, h, _, first, last, row, whole = stretches_of(batch, table)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), *(pa.array(x) for x in (h.view(np.int64), whole.view(np.int64), (first - t.row_start[row]).astype(np.int32), (last + length - t.row_start[row]).astype(np.int32)))],
                names=["doc_id", "key", "whole", "first", "end"],
            )

    # The bit table lets few others through; the join makes it exact.
    found = source.mapInArrow(places, f"doc_id {kind}, key long, whole long, first int, end int")
    found = keep(found.join(shared, "key", "left_semi"))
    free(shared)
    repeated = F.expr("low != high or n > 1" if within else "low != high")
    wholes = keep(found.groupBy("key", "whole").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")))
    # Where all stretches around a head are one, that settles its windows.
    contested = keep(wholes.groupBy("key").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a != b").select("key"))
    contested_table = BitTable(contested, "key")

    def contexts(batches):
        seen: set[int] = set()
        for batch in small_batches(batches):
            t, h, at, first, last, _, whole = stretches_of(batch, contested_table)
            use = []
            for i, x in enumerate(whole.tolist()):
                if x not in seen:
                    seen.add(x)
                    use.append(i)
            if len(seen) > 500_000:
                seen.clear()
            words = _short(t.hashes)
            h, at, first, last, whole = (x[use] for x in (h, at, first, last, whole))
            right = _padded(words, at, last + length - at, False, length).astype(">u4")  # its bytes have the order of its words
            left = _padded(words, first, at - first, True, reach)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(whole.view(np.int64)), pa.array([x.tobytes() for x in right], pa.binary()), pa.array([x.tobytes() for x in left], pa.binary()), pa.array((last - first + 1).astype(np.int32))], names=["key", "whole", "right", "left", "windows"])

    each = source.mapInArrow(contexts, "key long, whole long, right binary, left binary, windows int")
    each = each.groupBy("key", "whole").agg(*(F.first(c).alias(c) for c in ("right", "left", "windows")))
    suffixes = each.join(wholes.join(contested, "key", "left_semi"), ["key", "whole"])
    array = keep(suffixes.repartitionByRange(width(spark), "key", "right", "left").sortWithinPartitions("key", "right", "left"))
    free(contested)

    def compare(batches):
        """Windows that the longer common prefix with a neighbour fills, with a hash of their words."""
        held, edge = None, True  # the last row waits for the next one

        def windows(t: pa.Table, before: bool, after: bool):
            """Of all rows but the first and last, which only are neighbours; ``before`` and ``after``: they are, too."""
            key = t["key"].to_numpy()
            right = np.frombuffer(b"".join(t["right"].to_pylist()), ">u4").reshape(len(key), length).astype(np.uint32)
            lcp = common_prefixes(right)
            lcp[1:][key[1:] != key[:-1]] = 0
            most = np.maximum(lcp, np.append(lcp[1:], 0))
            if before:
                most[0] = length
            if after:
                most[-1] = length
            rows = np.arange(0 if before else 1, len(key) if after else len(key) - 1)
            words = np.concatenate((np.frombuffer(b"".join(t["left"].to_pylist()), "<u4").reshape(len(key), reach), right), 1)
            own = (words[:, :reach] > 0).sum(1)
            sums, inverse = _prefix_sums_of_rows(words)
            n = t["windows"].to_numpy()
            for back in range(reach + 1):
                at = own - back
                mine = rows[((at >= 0) & (at < n) & (length - back <= most))[rows]]
                if len(mine):
                    h = textops.mix((sums[mine, reach - back + length] - sums[mine, reach - back]) * inverse[reach - back])
                    h = textops.mix(h ^ key[mine].view(np.uint64))
                    part = t.select(["key", "whole", "low", "high", "n"]).take(pa.array(mine))
                    part = part.append_column("at", pa.array(at[mine].astype(np.int32))).append_column("window", pa.array(h.view(np.int64)))
                    yield from part.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            if t.num_rows > 2:
                yield from windows(t, edge, False)
                held, edge = t.slice(t.num_rows - 2), False
            else:
                held = t
        if held is not None:
            yield from windows(held, edge, True)

    low_kind = f"low {kind}, high {kind}"
    candidates = keep(array.mapInArrow(compare, f"key long, whole long, {low_kind}, n long, at int, window long"))
    free(array)
    passages = candidates.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where(repeated).drop("n")
    matched = candidates.select("key", "whole", "at", "window").join(passages, "window")
    # Windows that follow each other and have the same holders become one; a stretch has LENGTH - HEAD + 1 at most.
    order = Window.partitionBy("key", "whole", "low", "high").orderBy("at")
    joined = matched.withColumn("run", F.col("at") - F.row_number().over(order)).groupBy("key", "whole", "low", "high", "run").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    matches = keep(joined.select("key", "whole", "low", "high", "a", "b"))
    free(candidates)
    settled = found.join(wholes.where(repeated), ["key", "whole"]).select("doc_id", "first", "end", "low", "high")
    extended = found.join(matches, ["key", "whole"]).select("doc_id", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b") + length).alias("end"), "low", "high")
    return settled.union(extended).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("first", "end")), "low", "high")


def _prefix_sums_of_rows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_prefix_sums``, for each row of a matrix."""
    power = np.full(words.shape[1], _M, np.uint64)
    power[0] = 1
    inverse = np.full(words.shape[1] + 1, _M_INV, np.uint64)
    inverse[0] = 1
    sums = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    np.cumsum(textops.mix(words.astype(np.uint64)) * np.cumprod(power, dtype=np.uint64), axis=1, out=sums[:, 1:])
    return sums, np.cumprod(inverse, dtype=np.uint64)


def merge_spans(stretches: DataFrame) -> DataFrame:
    """Joins stretches of a document that overlap or touch: doc_id, first_word, end_word, least_doc, greatest_doc."""
    order = Window.partitionBy("doc_id").orderBy("first", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = stretches.withColumn("_new", F.when(F.col("first") <= before, 0).otherwise(1))
    numbered = opens.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "_span").agg(F.min("first").alias("first_word"), F.max("end").alias("end_word"), F.min("low").alias("least_doc"), F.max("high").alias("greatest_doc")).drop("_span")


def repeated_passages(docs: DataFrame, length: int = LENGTH, within: bool = False) -> DataFrame:
    """Maximal spans of words of each document that lie in passages of ``length`` words or more shared with others (or, with
    ``within``, found elsewhere in the same document)."""
    return merge_spans(repeated_windows(docs, length, within=within)).withColumn("n_words", F.col("end_word") - F.col("first_word"))


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents without the passages that a document of a smaller id has too; those left without words go.

    The smallest document that holds a passage keeps it. White space beside a cut passage stays on its left only.
    """
    cuts = merge_spans(repeated_windows(docs, length).where("low < doc_id"))
    columns, id_name, cuts_name = docs.columns, fresh(docs, "_id"), fresh(docs, "_cuts")
    lists = keep(cuts.groupBy(F.col("doc_id").alias(id_name)).agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias(cuts_name)))

    def cut(batches):
        for batch in small_batches(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at)
            cut_lists = batch.column(batch.schema.get_field_index(cuts_name)).to_pylist()
            t = textops.tokenize_column(texts)
            data, offsets = textops.text_buffers(texts)
            raw = data.tobytes()
            out, stays = texts.to_pylist(), [True] * batch.num_rows
            for i, spans in enumerate(cut_lists):
                if not spans:
                    continue
                a, b = int(t.row_start[i]), int(t.row_start[i + 1])
                text, parts, begin = raw[int(offsets[i]) : int(offsets[i + 1])], [], 0
                gone = 0
                for s in spans:
                    first, end = s["first_word"], min(s["end_word"], b - a)
                    gone += end - first
                    parts.append(text[begin : int(t.start[a + first])])
                    begin = int(t.start[a + end]) if end < b - a else len(text)
                out[i] = b"".join([*parts, text[begin:]]).decode()
                stays[i] = gone < b - a
            kept = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).filter(pa.array(stays))
            yield kept.select(columns)

    marked = docs.withColumn(id_name, F.col("doc_id")).join(lists, id_name, "left").select(*(f"`{c}`" for c in columns), cuts_name)
    return marked.mapInArrow(cut, docs.schema)
