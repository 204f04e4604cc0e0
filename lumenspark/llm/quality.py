"""Quality rules, line first: bad lines go, then documents that lose too much of their text.

A line with a word fails if

* it has more than one symbol of ``#*$%&|<>`` to ten words (mark-up, tables, navigation bars),
* it has fewer than ``MENU_WORDS`` words and does not end in one of ``ENDS`` (menu entries), or
* it holds a boilerplate phrase (``PHRASES`` in English, German, French and Spanish, in any case of A-Z).

A document is kept if it passes the base rules (50 words or more; at most half of its words in repeated 3-word windows) and
at least half of its words lie in lines that stay. Lines are parted by ``\\n`` only.

Scale: one pass, no shuffle; a task holds a batch of about half a MB of text, or one longer text.

Edge cases: a null text has no words and fails the base; lines without a word never count; repeated rows are judged each on
its own; ids and other columns may have any name and type (``quality_report`` ignores other columns, ``clean`` keeps them);
an empty table gives no rows. Lines and windows are compared by 64-bit hashes of their words' bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm import textops

MENU_WORDS = 4
PHRASES = (
    "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "accept cookies", "use cookies", "click here", "sign up for", "subscribe to our", "log in to", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren", "verwendet cookies", "hier klicken",
    "tous droits réservés", "politique de confidentialité", "accepter les cookies", "utilise des cookies", "cliquez ici",
    "todos los derechos reservados", "política de privacidad", "aceptar las cookies", "aceptar cookies", "utiliza cookies", "haga clic aquí",
)
SYMBOLS = b"#*$%&|<>"
#: Marks that may end a line: ASCII, then closing quotes, stops and brackets of other scripts.
ENDS = ".!?:;,\"')]}" + "…”’“»›‹«。！？：；，、）」』】》؟۔।"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_END_POINTS = np.array(sorted(map(ord, ENDS)))


def _last_points(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The code point that ends before each place."""
    point, shift = np.zeros(len(end), np.int64), 0
    at, waiting = end - 1, np.ones(len(end), bool)
    for _ in range(4):
        byte = data[np.maximum(at, 0)].astype(np.int64)
        inner = (byte & 0xC0) == 0x80
        lead = np.where(byte < 0x80, byte, np.where(byte < 0xE0, byte & 0x1F, np.where(byte < 0xF0, byte & 0x0F, byte & 0x07)))
        point = np.where(waiting, point | (np.where(inner, byte & 0x3F, lead) << shift), point)
        waiting &= inner
        at, shift = at - 1, shift + 6
    return point


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the key occurs twice or more; the key occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, again


def judge(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts and verdicts of a batch of texts."""
    data, offsets = textops.text_buffers(texts)
    words = textops.tokenize(data, offsets)
    n_rows = len(offsets) - 1
    row_of_word = np.repeat(np.arange(n_rows), np.diff(words.row_start))
    word_at = words.start + offsets[row_of_word]
    n_words = np.diff(words.row_start)
    lead = (data & 0xC0) != 0x80
    symbol = _IS_SYMBOL[data]

    lines = textops.tokenize(data, offsets, textops.IS_NEWLINE)
    row_of_line = np.repeat(np.arange(n_rows), np.diff(lines.row_start))
    line_at = lines.start + offsets[row_of_line]
    line_end = line_at + lines.length
    words_in_line = np.searchsorted(word_at, line_end) - np.searchsorted(word_at, line_at)
    full = words_in_line > 0
    salt = lambda rows: textops.mix(rows.astype(np.uint64) + np.uint64(1))
    _, again = _repeats(np.where(full, lines.hashes ^ salt(row_of_line), np.arange(len(full), dtype=np.uint64)))
    again &= full

    window, first = textops.row_windows(words, 3)
    twice, _ = _repeats(window ^ salt(row_of_word[first]))
    covered = np.zeros(len(word_at) + 1, bool)
    for i in range(3):
        covered[first[twice] + i] = True

    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol, out=sums[1:])
    symbols_in_line = sums[line_end] - sums[line_at]
    # The last word's last byte ends the line's text.
    last_word = np.searchsorted(word_at, line_end) - 1
    word_end = word_at + words.length
    ends_well = np.zeros(len(full), bool)
    ends_well[full] = np.isin(_last_points(data, word_end[last_word[full]]), _END_POINTS)
    bad = (symbols_in_line * 10 > words_in_line) | ((words_in_line < MENU_WORDS) & ~ends_well)
    low = textops._LOWER[data].tobytes()
    for phrase in PHRASES:
        raw, at = phrase.encode(), -1
        while (at := low.find(raw, at + 1)) >= 0:
            i = int(np.searchsorted(line_at, at, "right")) - 1
            if i >= 0 and at + len(raw) <= line_end[i]:
                bad[i] = True
    lost = textops.row_sums(np.where(bad & full, words_in_line, 0), lines.row_start)
    n_repeat = textops.row_sums(covered[:-1], words.row_start)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words,
        "word_chars": textops.row_sums(lead & ~textops.IS_SPACE[data], offsets),
        "n_symbols": textops.row_sums(symbol, offsets),
        "n_dup_lines": textops.row_sums(again, lines.row_start),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "lost_words": lost,
        "kept": ~failed & (2 * lost <= n_words),
        "_line_at": line_at,
        "_line_end": line_end,
        "_line_bad": bad & full,
        "_line_row": row_of_line,
    }


REPORT = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "lost_words": "long", "kept": "boolean"}


def quality_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and verdict of every whole text. One pass, no shuffle."""

    def run(batches):
        for batch in textops.batches_by_bytes(batches, "text"):
            found = judge(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k]) for k in REPORT)], names=["id", *REPORT])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in REPORT.items())
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def clean(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Kept documents with their bad lines removed; all columns stay."""

    def run(batches):
        for batch in textops.batches_by_bytes(batches, text_column):
            at = batch.schema.get_field_index(text_column)
            texts = batch.column(at).fill_null("")
            found = judge(texts)
            data, offsets = textops.text_buffers(texts)
            out = []
            raw = data.tobytes()
            bad = np.flatnonzero(found["_line_bad"])
            cuts = np.searchsorted(found["_line_row"][bad], np.arange(batch.num_rows + 1))
            for i in np.flatnonzero(found["kept"]).tolist():
                begin, parts = int(offsets[i]), []
                for j in bad[cuts[i] : cuts[i + 1]].tolist():
                    parts.append(raw[begin : int(found["_line_at"][j])])
                    begin = min(int(found["_line_end"][j]) + 1, int(offsets[i + 1]))
                out.append((b"".join(parts) + raw[begin : int(offsets[i + 1])]).decode())
            rows = batch.filter(pa.array(found["kept"]))
            yield rows.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
c AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, ws FROM b),
w AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM b),
g AS (SELECT rid, i, x AS x1, lead(x) OVER p AS x2, lead(x, 2) OVER p AS x3 FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x1, x2, x3) AS n FROM g WHERE x3 IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY rid),
ln0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
ln1 AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS lw, len(regexp_extract_all(line, '[#*$%&|<>]')) AS ls FROM ln0),
ln2 AS (SELECT *, row_number() OVER (PARTITION BY rid, line ORDER BY i) AS nth,
        (ls * 10 > lw) OR (lw < 4 AND NOT regexp_matches(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), '[.!?:;,"'')\]}…”’“»›‹«。！？：；，、）」』】》؟۔।]$'))
        OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'PHRASES') AS bad
      FROM ln1 WHERE lw > 0),
l AS (SELECT rid, count_if(nth > 1)::BIGINT AS n_dup_lines, coalesce(sum(CASE WHEN bad THEN lw END), 0)::BIGINT AS lost_words FROM ln2 GROUP BY rid),
a AS (SELECT c.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(lost_words, 0) AS lost_words FROM c LEFT JOIN rep USING (rid) LEFT JOIN l USING (rid))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_words <= n_words AS kept FROM a
""".replace("PHRASES", "|".join(PHRASES))
