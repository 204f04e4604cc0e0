"""BPE encoding and decoding with batched numpy merge rounds.

All words that are not yet known lie in one flat array of symbols. A round finds the rank of every pair of neighbours by
binary search over the sorted pair keys, takes each word's lowest rank, and merges all its occurrences (from the left,
where they overlap). Words in which nothing merges leave the array. As a merge's product can only take part in merges of
a higher rank, a round does what one-at-a-time merging does. A word of more than ``LONG`` bytes has rounds of its own that
look only at pairs beside the last merges, so its time is in proportion to its length, not to its square.

Scale: one pass, no shuffle; a task holds a batch of about half a MB of text and the memo of known words, which is bounded by
words and by bytes (when it is full, those of the batch at hand stay).

Tokenizer files: byte-level BPE with the pattern of ``fst``, no normalizer, added tokens without flags; ``Vocabulary`` reads
the file's settings and raises for any other.

Edge cases: a null text counts as empty and gives no ids; a word of any length is encoded whole; repeated rows give a row
each; an added column whose name is taken gets underscores; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lumenspark.llm import textops
from lumenspark.llm.shared import fresh


LONG = 2048
MEMO_BYTES = 64 << 20
MEMO_WORD = 256
ENCODER_WORDS = 150_000  # in an encoder's memo: workers hold it from task to task, through other stages too


class Memo:
    """Word -> value, bounded by words and by their characters. When it is full, the words of the batch at hand stay
    (frequent ones are among them). Words of more than ``MEMO_WORD`` characters are computed anew."""

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 500_000):
        self.compute, self.limit = compute, limit
        self.known: dict[str, object] = {}
        self.held = 0

    def look_up(self, words: list[str]) -> list:
        known = self.known
        out = list(map(known.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            fresh = list({words[i] for i in missing})
            found = dict(zip(fresh, self.compute(fresh), strict=True))
            for i in missing:
                out[i] = found[words[i]]
            short = {w: x for w, x in found.items() if len(w) <= MEMO_WORD}
            known.update(short)
            self.held += sum(map(len, short))
            if len(known) > self.limit or self.held > MEMO_BYTES:
                self.known = {w: x for w, x in zip(words, out, strict=True) if len(w) <= MEMO_WORD}
                self.held = sum(map(len, self.known))
        return out


def merge_words(symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rank_of_key: np.ndarray, product: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges all words at once. Returns the ids of all words in order, and each word's number of ids.

    ``symbols``: first symbols of all words (``lengths`` each); ``keys``: sorted left * base + right; ``rank_of_key`` and
    ``product``: rank of each key and the symbol that each rank makes.
    """
    n_words = len(lengths)
    none = np.int64(1 << 40)
    word = np.repeat(np.arange(n_words), lengths)
    live = symbols.astype(np.int64)
    done_word, done_symbol = [], []
    while len(live):
        rank = np.full(len(live), none)
        key = live[:-1] * base + live[1:]
        same = np.flatnonzero(word[:-1] == word[1:])
        key = key[same]
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        hit = keys[at] == key
        rank[same[hit]] = rank_of_key[at[hit]]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        lowest = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(live)))
        low = np.repeat(lowest, sizes)
        rest = low < none
        if not rest.all():
            done_word.append(word[~rest])
            done_symbol.append(live[~rest])
            live, word, rank, low = live[rest], word[rest], rank[rest], low[rest]
            if not len(live):
                break
        at = np.flatnonzero(rank == low)
        # Neighbours that both want to merge are occurrences of one pair (x, x): every second one does, from the left.
        breaks = np.concatenate(([True], np.diff(at) != 1))
        run = np.flatnonzero(breaks)
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        live[at] = product[rank[at]]
        stay = np.ones(len(live), bool)
        stay[at + 1] = False
        live, word = live[stay], word[stay]
    word = np.concatenate(done_word) if done_word else np.empty(0, np.int64)
    ids = np.concatenate(done_symbol) if done_symbol else np.empty(0, np.int64)
    order = np.argsort(word, kind="stable")
    return ids[order], np.bincount(word, minlength=n_words).astype(np.int64)


def merge_long(symbols: np.ndarray, keys: np.ndarray, rank_of_key: np.ndarray, product: np.ndarray, base: int) -> np.ndarray:
    """Ids of one word, as ``merge_words`` gives them: rounds by ascending rank over the places that have it."""
    n = len(symbols)
    none = np.int64(1 << 40)
    symbol = np.append(symbols.astype(np.int64), -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    alive = np.ones(n + 1, bool)
    alive[n] = False
    rank = np.full(n + 1, none)
    places: dict[int, list[np.ndarray]] = {}
    order: list[int] = []

    def look(at: np.ndarray) -> None:
        """Ranks of the pairs that begin at these places, and where to find the places by rank."""
        pair = symbol[at] * base + symbol[after[at]]
        found = np.searchsorted(keys, pair)
        found[found == len(keys)] = 0
        rank[at] = np.where((after[at] < n) & (keys[found] == pair), rank_of_key[found], none)
        at = at[rank[at] < none]
        at = at[np.argsort(rank[at], kind="stable")]
        if not len(at):
            return
        starts = np.flatnonzero(np.concatenate(([True], np.diff(rank[at]) != 0))).tolist()
        for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
            r = int(rank[at[a]])
            if r not in places:
                heapq.heappush(order, r)
            places.setdefault(r, []).append(at[a:b])

    look(np.arange(n))
    while order:
        r = heapq.heappop(order)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        run = np.flatnonzero(np.concatenate(([True], after[at[:-1]] != at[1:])))
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        gone = after[at]
        alive[gone], rank[gone] = False, none
        symbol[at] = product[r]
        after[at] = after[gone]
        inside = after[at] < n
        before[after[at[inside]]] = at[inside]
        beside = np.concatenate((at, before[at]))
        look(np.unique(beside[beside >= 0]))
    return symbol[:n][alive[:n]]


class Vocabulary:
    """A byte-level BPE vocabulary with its merges as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _require_supported(spec, path)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = _byte_alphabet()
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.of_byte[b] = vocab[c]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of_key = key[order], order.astype(np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.width = self.kind.itemsize

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word (little-endian, ``width`` bytes an id)."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            out = dict(zip([i for i in range(len(words)) if len(words[i]) <= LONG], self.encode_words([w for w in words if len(w) <= LONG]), strict=True))
            for i in long:
                first = self.of_byte[np.frombuffer(words[i].encode(), np.uint8)]
                out[i] = merge_long(first, self.keys, self.rank_of_key, self.product, self.size).astype(self.kind).tobytes()
            return [out[i] for i in range(len(words))]
        if not words:
            return []
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, counts = merge_words(self.of_byte[np.frombuffer(b"".join(raw), np.uint8)], lengths, self.keys, self.rank_of_key, self.product, self.size)
        packed, ends = ids.astype(self.kind).tobytes(), (np.cumsum(counts) * self.width).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that form no code point become U+FFFD. Special tokens stay."""
        table = self.token_bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


#: The splitting pattern of byte-level vocabularies, which ``fst`` compiles.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _require_supported(spec: dict, path: str) -> None:
    """Raises where the file asks for anything that these modules do not do."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    flags = [t["content"] for t in spec["added_tokens"] if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or odd or flags:
        raise ValueError(f"{path}: only byte-level BPE without normalizer, prefix space, affixes and token flags is supported")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others
    follow from U+0100 on in byte order (fixed by the published format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes whole texts. ``encoder_of`` keeps one for each worker process, so that tasks share its memo."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.memo = Memo(vocabulary.encode_words, ENCODER_WORDS)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        from lumenspark.llm.fst import split_special

        pieces, row_start, marks = split_special(texts, self.vocabulary.special)
        packed = self.memo.look_up(pieces)
        for i, special in marks.items():
            packed[i] = np.array([special], self.vocabulary.kind).tobytes()
        at = row_start.tolist()
        return [np.frombuffer(b"".join(packed[a:b]), self.vocabulary.kind) for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    return Encoder(load_vocabulary(path))


def encode_documents(docs: DataFrame, tokenizer_path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """Adds the token ids of every whole text as ``array<int>``; all other columns stay. One pass, no shuffle."""
    ids_column = fresh(docs, ids_column)

    def run(batches):
        encoder = encoder_of(tokenizer_path)
        for batch in textops.batches_by_bytes(batches, text_column):
            ids = encoder.encode(batch.column(batch.schema.get_field_index(text_column)))
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.concatenate([*ids, np.empty(0, np.uint16)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*batch.schema.names, ids_column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids_column, ArrayType(IntegerType()))]))


def decode_ids(df: DataFrame, tokenizer_path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """Adds the text of ``ids_column``. Null ids give an empty text."""
    text_column = fresh(df, text_column)

    def run(batches):
        vocabulary = load_vocabulary(tokenizer_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_column)).to_pylist()
            texts = [vocabulary.decode(np.array(x or [], np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_column])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(text_column, StringType())]))


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes and decodes every whole text and returns digests of both: id, n_tokens, ids_sha256, decoded_sha256.

    Ids are hashed as little-endian unsigned 32-bit integers, decoded texts as UTF-8.
    """

    def run(batches):
        vocabulary = load_vocabulary(tokenizer_path)
        encoder = encoder_of(tokenizer_path)
        for batch in textops.batches_by_bytes(batches, "text"):
            ids = encoder.encode(batch.column(1))
            columns = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(vocabulary.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
