"""Token counts by finite-state tokenizer compilation.

A byte-level BPE tokenizer is compiled into two deterministic transducers run one after the other.

* The *splitter* turns the pre-tokenizer's pattern into 13 states over 12 classes of code points. Each transition is
  annotated with what it emits: a boundary before the code point just read, one before the code point ahead of it, or
  both (the delay replaces the pattern's look-ahead). Texts are cut into chunks; for each chunk the map "state before ->
  state after" is run for all start states at once, the maps are composed by a parallel prefix scan, and with the start
  states known every chunk emits its boundaries, all chunks in lockstep. Chunks of one long text are as independent as
  chunks of many short ones.
* The *merge transducer* reads one piece between boundaries. Its states are piece prefixes, and the transition that
  closes a piece emits the number of tokens that the merges leave. Closing transitions are compiled on first use, in
  batches, by ``bpe.merge_words``, and kept in a bounded memo; a dropped one is compiled again when it is next met.

Edge cases: a null text counts as empty and gives 0 tokens; repeated rows give a row each; an empty table gives none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm import textops
from lumenspark.llm.bpe import Memo, Vocabulary, load_vocabulary

SPACE, BLANK, QUOTE, SHORT, R, V, L, E, LETTER, NUMBER, OTHER, END = range(12)
NONE, BEFORE, EARLIER, BOTH = 0, 1, 2, 3
CHUNK = 256


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """Class of every code point; the last entry (one past the largest) is the end of a text."""
    import regex

    table = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(every[m.start()]), ord(every[m.end() - 1])
            table[lo : hi + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    for letters, kind in (("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        for x in letters:
            table[ord(x)] = kind
    table[0x110000] = END
    return table


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray, int]:
    """Transitions and emissions, both flat by state * 12 + class, and the number of states."""
    names = ["start", "space", "blank", "spaces", "blanks", "letters", "numbers", "others", "quote", "quote_r", "quote_v", "quote_l", "closed"]
    at = {x: i for i, x in enumerate(names)}
    go, emit = np.zeros((len(names), 12), np.uint8), np.zeros((len(names), 12), np.uint8)
    letters = (SHORT, R, V, L, E, LETTER)

    def opening(kind: int) -> str:
        if kind == END:
            return "start"
        return {SPACE: "space", BLANK: "blank", NUMBER: "numbers", OTHER: "others", QUOTE: "quote"}.get(kind, "letters")

    for name in names:
        for kind in range(12):
            # By default a new piece opens before this code point.
            to, out = opening(kind), NONE if kind == END else BEFORE
            if name in ("space", "blank", "spaces", "blanks"):
                if kind in (SPACE, BLANK):
                    to, out = ("spaces" if kind == SPACE else "blanks"), NONE
                elif kind != END:
                    joins = name in ("space", "spaces")  # one space goes with what follows
                    out = (NONE if joins else BEFORE) | (EARLIER if name in ("spaces", "blanks") else NONE)
                    if joins and kind == QUOTE:
                        to = "others"
            elif name == "letters" and kind in letters or name == "numbers" and kind == NUMBER or name == "others" and kind in (OTHER, QUOTE):
                to, out = name, NONE
            elif name == "quote":
                if kind in (OTHER, QUOTE):
                    to, out = "others", NONE
                elif kind == SHORT:
                    to, out = "closed", NONE
                elif kind in (R, V, L):
                    to, out = {R: "quote_r", V: "quote_v", L: "quote_l"}[kind], NONE
            elif name in ("quote_r", "quote_v", "quote_l"):
                if kind == (L if name == "quote_l" else E):
                    to, out = "closed", NONE
                elif kind in letters:
                    to, out = "letters", EARLIER
                else:
                    out = EARLIER | (NONE if kind == END else BEFORE)
            go[at[name], kind], emit[at[name], kind] = at[to], out
    return go.ravel(), emit.ravel(), len(names)


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Where pieces open, as a mask over ``classes`` (texts, each followed by END)."""
    go, emit, states = splitter()
    n = len(classes)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)  # one row for each step
    wide = go.astype(np.intp) * 12
    maps = np.tile(np.arange(states, dtype=np.intp) * 12, (chunks, 1))
    for step in range(CHUNK):
        maps = wide[maps + grid[step][:, None]]
    maps //= 12
    # Hillis-Steele scan: after the round with distance d, maps[c] stands for the 2 d chunks that end with c.
    d = 1
    while d < chunks:
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].copy(), 1)
        d *= 2
    state = np.zeros(chunks, np.intp)
    state[1:] = maps[:-1, 0] * 12
    out = np.empty((CHUNK, chunks), np.uint8)
    for step in range(CHUNK):
        at = state + grid[step]
        out[step] = emit[at]
        state = wide[at]
    flat = out.T.ravel()[:n]
    opens = (flat & BEFORE) > 0
    opens[:-1] |= (flat[1:] & EARLIER) > 0
    return opens


def split(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Pieces of all rows in order, and where each row's pieces begin (one entry more than rows)."""
    data, offsets = textops.text_buffers(texts)
    whole = data.tobytes().decode("utf-8")
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    char_offsets = np.zeros(len(offsets), np.int64)
    char_offsets[1:] = textops.row_sums(lead, offsets).cumsum()
    classes = np.insert(code_point_classes()[points], char_offsets[1:], END)
    opens = np.flatnonzero(boundaries(classes))
    ends_at = char_offsets[1:] + np.arange(len(offsets) - 1)  # where each row's END stands
    row_start = np.zeros(len(offsets), np.int64)
    row_start[1:] = np.searchsorted(opens, ends_at, "right")
    start = opens - np.repeat(np.arange(len(offsets) - 1), np.diff(row_start))
    end = np.empty_like(start)
    end[:-1] = start[1:]
    last = row_start[1:][np.diff(row_start) > 0] - 1
    end[last] = char_offsets[1:][np.diff(row_start) > 0]
    return [whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], row_start


def split_special(texts: pa.Array, special: dict[str, int]) -> tuple[list[str], np.ndarray, dict[int, int]]:
    """As ``split``, but special strings are cut out first, as the library does by default.

    The third result maps a piece's index to the special id that it stands for.
    """
    data, _ = textops.text_buffers(texts)
    raw = data.tobytes()
    if not any(x.encode() in raw for x in special):
        return *split(texts), {}
    import re

    cutter = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")")
    parts, owner, kinds = [], [], []
    for i, text in enumerate(texts.to_pylist()):
        for j, part in enumerate(cutter.split(text or "")):
            parts.append("" if j % 2 else part)
            owner.append(i)
            kinds.append(special[part] if j % 2 else -1)
    pieces, part_start = split(pa.array(parts, pa.string()))
    out: list[str] = []
    marks: dict[int, int] = {}
    row_start = np.zeros(len(texts) + 1, np.int64)
    for k, (i, kind) in enumerate(zip(owner, kinds, strict=True)):
        if kind >= 0:
            marks[len(out)] = kind
            out.append("")
        else:
            out.extend(pieces[part_start[k] : part_start[k + 1]])
        row_start[i + 1] = len(out)
    return out, row_start, marks


class Counter:
    """The compiled pair of transducers. ``counter_of`` keeps one for each worker process."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.memo = Memo(lambda words: [len(x) // vocabulary.width for x in vocabulary.encode_words(words)])

    def count(self, texts: pa.Array) -> np.ndarray:
        pieces, row_start, marks = split_special(texts, self.vocabulary.special)
        counts = np.array(self.memo.look_up(pieces), np.int64)
        if marks:
            counts[list(marks)] = 1
        return textops.row_sums(counts, row_start)


@lru_cache(2)
def counter_of(path: str) -> Counter:
    return Counter(load_vocabulary(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, over_limit. One pass, no shuffle; other columns are ignored."""

    def run(batches):
        counter = counter_of(tokenizer_path)
        for batch in textops.batches_by_bytes(batches, "text"):
            texts = batch.column(1)
            _, offsets = textops.text_buffers(texts)
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)
