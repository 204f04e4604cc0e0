"""Token-id files compressed by Re-Pair grammars, with random access.

Documents are encoded by the tokenizers library, get an end id, are dealt by ranges of ids, and are cut in ascending id
order into shards of about ``SHARD_TOKENS`` ids. In each shard the most frequent pairs of neighbouring symbols are
replaced by nonterminals, round after round, as long as a round saves more bytes than its rules take; a round takes the
``PAIRS`` most frequent pairs at once, the more frequent first where they overlap, and of these the ones whose uses save more
than their rule takes. A shard is one row of a Parquet file (written by Spark's committer, so lost tasks leave nothing behind):

    part, shard        position of the shard; (part, shard) ascends with the documents
    doc_ids            ids of its documents in order
    doc_starts         where each begins among the shard's ids, and their number at the end
    rounds             first nonterminal of each round, and one past the last
    rules              left and right symbol of each nonterminal (little-endian unsigned 32 bits)
    lengths            ids that each nonterminal stands for (the same)
    symbols            the compressed sequence (unsigned 16 bits if all symbols fit, else 32)

``decode_range`` finds any stretch of ids from the expansion lengths and expands only the symbols that cover it.

Scale: texts are encoded where they are read, and ids are dealt by the quantiles of doc_id, one part a range; a task holds
the ids of one shard, or of one longer document. Null ids are one part, as the order of the files asks.

Edge cases: a null text counts as empty and has the end id only; null ids come first; equal ids are ordered by their
tokens, so repeated rows are documents of their own; ids are integers (others raise); a text of any length stays in one
shard; other columns are ignored; an empty table writes no shard and reads back no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm import textops
from lumenspark.llm.bpe import Memo
from lumenspark.llm.shared import keep, new_folder, numbered, width

SHARD_TOKENS = 1 << 20
MEMO = 1_200_000
SMALL_TABLE = 100_000
PAIRS = 2048
LEAST = 4
RULE_BYTES = 12
SYMBOL_BYTES = 2  # that one use of a rule saves at least
END_ID = 2

SCHEMA = "part int, shard int, doc_ids array<long>, doc_starts array<long>, n_tokens long, base int, rounds array<int>, rules binary, lengths binary, wide boolean, symbols binary"


@lru_cache(2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_PLAIN = np.zeros(256, bool)
_IS_PLAIN[[*range(48, 58), *range(97, 123)]] = True
_IS_STOP = np.zeros(256, bool)
_IS_STOP[list(b",.;:!?")] = True


def _foldable(path: str) -> bool:
    """Whether the file folds case and drops white space, so that what stands between spaces can be encoded alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) and t["content"].startswith("<|") for t in spec["added_tokens"])
    return steps == ["NFC", "Replace", "Lowercase"] and bool(splits) and splits[0]["type"] == "Split" and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and plain and bool(spec["added_tokens"])


class LibraryEncoder:
    """Ids by the tokenizers library. Whole texts go to it, but for tokenizers that fold case, drop white space and part
    letters from punctuation (``_foldable``):

    As no piece reaches over a space, a text is the sum of what stands between its spaces; the library is asked once for
    each distinct such string (within the memo's bounds). Before, A-Z are folded and a space is set between a letter or
    digit of ASCII and a punctuation mark, which leaves fewer distinct strings; a batch with combining marks (they could
    join a letter before it is folded) or with what may be a special token is left as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = _library(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.foldable = _foldable(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.special[-1]
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.memo = Memo(self._ask, MEMO)

    def _ask(self, words: list[str]) -> list[bytes]:
        """Asks for many strings at once, parted by a special token."""
        text = "\n".join(words)
        odd = [w for w in words if any(x in w for x in self.special)] if any(x in text for x in self.special) else []
        asked = {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, self.kind).tobytes() for w in odd}
        plain = [w for w in words if w not in asked] if odd else words
        out: list[bytes] = []
        for at in range(0, len(plain), 1024):
            # Without the places of ids in the text, which take about a quarter of its time.
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(plain[at : at + 1024])], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(ids == self.mark_id) * self.kind.itemsize
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(cut + self.kind.itemsize).tolist()], [*cut.tolist(), len(raw)], strict=True)]
        if not odd:
            return out
        asked.update(zip(plain, out, strict=True))
        return [asked[w] for w in words]

    def encode(self, texts: pa.Array) -> list[bytes]:
        if not self.foldable:
            return [np.array(self.tokenizer.encode(x or "", add_special_tokens=False).ids, self.kind).tobytes() for x in texts.to_pylist()]
        data, offsets = textops.text_buffers(texts)
        raw = data.tobytes()
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.translate(_FOLD)
            data = np.frombuffer(raw, np.uint8)
            at = np.flatnonzero(_IS_STOP[data[1:]] & _IS_PLAIN[data[:-1]]) + 1
            raw = np.insert(data, at, 32).tobytes()
            offsets = offsets + np.searchsorted(at, offsets)
        # One split for all texts, with a space between them: a text has one string more than spaces.
        raw = np.insert(np.frombuffer(raw, np.uint8), offsets[1:-1], 32).tobytes().replace(b"\n", b" ")
        offsets = offsets + np.maximum(np.arange(len(offsets)) - 1, 0)
        offsets[-1] = len(raw)
        ends = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), np.append(offsets[1:-1] , len(raw)), "left") + 1
        found = self.memo.look_up(raw.decode().split(" "))
        cuts = [0, *ends.tolist()]
        return [b"".join(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(2)
def encoder_of(path: str) -> LibraryEncoder:
    """One for each worker process, so that tasks share its memo."""
    return LibraryEncoder(path)


def compress(ids: np.ndarray, base: int, pairs: int = PAIRS, least: int = LEAST, exhaust: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Re-Pair grammar of a sequence: symbols, rules (n x 2), expansion lengths, and round bounds.

    Rounds go on while their rules together make the file smaller, and rules that do not are left out; with ``exhaust``, until no
    pair occurs ``least`` times."""
    symbols = ids.astype(np.uint32)
    rules, lengths, bounds = [np.empty((0, 2), np.uint32)], np.empty(0, np.int64), [base]
    cost = lambda symbols, rules: len(symbols) * (2 if base + rules <= 1 << 16 else 4) + RULE_BYTES * rules
    while len(symbols) > 1:
        narrow = bounds[-1] + pairs < 1 << 16
        old, old_lengths = symbols.copy(), lengths
        key = (symbols[:-1] << np.uint32(16)) | symbols[1:] if narrow else (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        ordered = np.sort(key)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        if len(often) > pairs:
            often = often[np.argpartition(-counts[often], pairs)[:pairs]]
        often = np.sort(often)
        top = ordered[first[often]]
        place = np.empty(len(top), np.int32)
        place[np.lexsort((top, -counts[often]))] = np.arange(len(top))
        # A hash table of one slot each finds the pairs; of two in a slot one waits for the next round.
        short = (lambda x: (x * np.uint32(2654435761)) >> np.uint32(16)) if narrow else (lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
        table = np.full(1 << 16, -1, np.int32)
        table[short(top)] = np.arange(len(top), dtype=np.int32)
        at = table[short(key)]
        maybe = np.flatnonzero(at >= 0)
        at = at[maybe]
        hit = top[at] == key[maybe]
        maybe, at = maybe[hit], at[hit]
        none = np.int32(len(top))
        rank = np.full(len(key) + 2, none, np.int32)
        mine = place[at]
        rank[maybe + 1] = mine
        take = (mine < rank[maybe]) & (mine <= rank[maybe + 2])
        maybe, at = maybe[take], at[take]
        uses, last = np.bincount(at, minlength=len(top)), False
        if not exhaust:
            # The round in which all rules together do not pay is the last one. Rules that are used too seldom to make up for
            # their own bytes are not made in any.
            each = SYMBOL_BYTES if bounds[-1] + np.count_nonzero(uses) <= 1 << 16 else 2 * SYMBOL_BYTES
            last = len(at) * each <= RULE_BYTES * np.count_nonzero(uses)
            uses[uses * SYMBOL_BYTES <= RULE_BYTES] = 0
            pays = uses[at] > 0
            maybe, at = maybe[pays], at[pays]
            if not len(at):
                break
        used = np.flatnonzero(uses)
        rule = (np.cumsum(uses > 0) - 1)[at]
        left, right = top[used] >> (16 if narrow else 32), top[used] & (0xFFFF if narrow else 0xFFFFFFFF)
        size = lambda x: np.where(x < base, 1, lengths[np.maximum(x.astype(np.int64) - base, 0)] if len(lengths) else 1)  # noqa: E731, B023
        lengths = np.concatenate((lengths, size(left) + size(right)))
        rules.append(np.stack((left, right), 1).astype(np.uint32))
        symbols[maybe] = (bounds[-1] + rule).astype(np.uint32)
        stay = np.ones(len(symbols), bool)
        stay[maybe + 1] = False
        symbols = symbols[stay]
        if not exhaust and cost(symbols, bounds[-1] + len(used) - base) >= cost(old, bounds[-1] - base):
            symbols, lengths = old, old_lengths
            rules.pop()
            break
        bounds.append(bounds[-1] + len(used))
        if last:
            break
    return symbols, np.concatenate(rules), lengths, bounds


def expand(symbols: np.ndarray, rules: np.ndarray, bounds: list[int]) -> np.ndarray:
    """The ids that symbols stand for. Each nonterminal is expanded once, its round after the earlier ones."""
    base = bounds[0]
    flat = [np.arange(base, dtype=np.uint32)]
    start, length, total = np.zeros(base + len(rules), np.int64), np.ones(base + len(rules), np.int64), base
    start[:base] = np.arange(base)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        pair = rules[lo - base : hi - base].astype(np.int64).ravel()
        known = np.concatenate(flat)
        length[lo:hi] = length[pair].reshape(-1, 2).sum(1)
        start[lo:hi] = total + np.cumsum(length[lo:hi]) - length[lo:hi]
        flat = [known, known[textops.ragged(start[pair], length[pair])]]
        total += len(flat[1])
    return np.concatenate(flat)[textops.ragged(start[symbols], length[symbols])]


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2").astype(np.uint32)
    return symbols, np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64)


def expand_only(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """As ``expand``, but only the rules that these symbols need are ever looked at, level by level."""
    out = symbols.astype(np.int64)
    while (nonterminal := out >= base).any():
        at = np.cumsum(np.where(nonterminal, 2, 1)) - np.where(nonterminal, 2, 1)
        wide = np.empty(int(at[-1]) + (2 if nonterminal[-1] else 1), np.int64)
        wide[at[~nonterminal]] = out[~nonterminal]
        pair = rules[out[nonterminal] - base]
        wide[at[nonterminal]], wide[at[nonterminal] + 1] = pair[:, 0], pair[:, 1]
        out = wide
    return out.astype(np.uint32)


def decode_range(row: dict, start: int, end: int) -> np.ndarray:
    """Ids start .. end - 1 of a shard (one row of its file), expanding only the symbols that cover them."""
    symbols, rules, lengths = _unpack(row)
    base = row["rounds"][0]
    size = np.ones(len(symbols), np.int64)
    nonterminal = symbols >= base
    size[nonterminal] = lengths[symbols[nonterminal].astype(np.int64) - base]
    ends = np.cumsum(size)
    start, end = max(start, 0), min(end, int(ends[-1]) if len(ends) else 0)
    if start >= end:
        return np.empty(0, np.uint32)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, end, "left")) + 1
    before = int(ends[a] - size[a])
    return expand_only(symbols[a:b], rules, base)[start - before : end - before]


def _shard(part: int, number: int, ids: list[int | None], packed: list[bytes], kind: np.dtype, base: int) -> dict:
    starts = np.zeros(len(packed) + 1, np.int64)
    np.cumsum([len(x) // kind.itemsize for x in packed], out=starts[1:])
    symbols, rules, lengths, bounds = compress(np.frombuffer(b"".join(packed), kind), base)
    wide = bounds[-1] > 1 << 16
    return {
        "part": part, "shard": number, "doc_ids": ids, "doc_starts": starts.tolist(), "n_tokens": int(starts[-1]), "base": base, "rounds": bounds,
        "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "wide": wide, "symbols": symbols.astype("<u4" if wide else "<u2").tobytes(),
    }


_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("base", pa.int32()), ("rounds", pa.list_(pa.int32())), ("rules", pa.binary()), ("lengths", pa.binary()), ("wide", pa.bool_()), ("symbols", pa.binary())])


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the shard files to ``folder``."""
    spark = docs.sparkSession
    n = width(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    # Cuts between the parts: as many numbers as there are partitions.
    cuts = np.unique(np.array(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else [], np.float64)).astype(np.int64)

    # A hash partitioner would put two parts in one partition and none in another: each part gets a key that falls into its own.
    tried = spark.range(32 * n).select(F.col("id").cast("int").alias("slot"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part")).groupBy("part").agg(F.min("slot").alias("slot"))
    slot_of = dict(tried.collect())  # one row a partition
    slots = np.array([slot_of.get(i, i) for i in range(n)], np.int32)

    def encode(batches):
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in textops.batches_by_bytes(batches, "text", 2 << 20):
            packed = [x + end for x in encoder.encode(batch.column(1))]
            known = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            part = np.searchsorted(cuts, known, "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), pa.array(packed, pa.binary()), pa.array(slots[part])], names=["part", "doc_id", "ids", "slot"])

    def pack(batches):
        tokenizer = _library(tokenizer_path)
        base = tokenizer.get_vocab_size(with_added_tokens=True)
        kind = np.dtype("<u2") if base <= 1 << 16 else np.dtype("<u4")
        part, number, docs_here, packed, size = None, 0, [], [], 0
        for batch in batches:
            for p, doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if packed and (p != part or size >= shard_tokens):
                    yield pa.RecordBatch.from_pylist([_shard(part, number, docs_here, packed, kind, base)], _ARROW)
                    number, docs_here, packed, size = number + 1, [], [], 0
                if p != part:
                    part, number = p, 0
                docs_here.append(doc)
                packed.append(blob)
                size += len(blob) // kind.itemsize
        if packed:
            yield pa.RecordBatch.from_pylist([_shard(part, number, docs_here, packed, kind, base)], _ARROW)

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "part int, doc_id long, ids binary, slot int")
    dealt = coded.repartition(n, "slot").drop("slot").sortWithinPartitions("part", "doc_id", "ids")
    dealt.mapInArrow(pack, SCHEMA).write.parquet(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.schema(SCHEMA).parquet(folder)
    starts = keep(numbered(shards.select("part", "shard", "n_tokens"), [F.col("part"), F.col("shard")], "before", "n_tokens").select("part", "shard", "before"))
    if starts.count() <= SMALL_TABLE:  # three numbers a row; beyond, a sort-merge join
        starts = F.broadcast(starts)

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules, _ = _unpack(row)
                raw = expand(symbols, rules, row["rounds"]).astype("<u4").tobytes()
                at = row["doc_starts"]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                start = np.array(at[:-1], np.int64) + row["before"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.drop("n_tokens").join(starts, ["part", "shard"]).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    folder = new_folder(docs.sparkSession, "token-files")
    write_files(docs, folder, tokenizer_path)
    return read_files(docs.sparkSession, folder)
