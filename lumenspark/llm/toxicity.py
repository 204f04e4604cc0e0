"""Toxicity by maximum-scoring segments.

*Model.* Words (lower-cased runs of letters, digits and longer code points) and their heads (first ``HEADS`` bytes, for stems
that inflection hides) are hashed into ``BUCKETS`` features; a word scores by the most telling of its features. From
labelled documents each feature gets the log-odds of the toxic against the other class, by the documents that hold it (a
word repeated within one text tells no more), smoothed by an informative Dirichlet prior (``PRIOR`` pseudo-counts spread
as in both classes together). Features that the labels say little about
(|log-odds| under ``CERTAIN`` standard errors) score nothing, and every word pays ``DRIFT``, so that chance runs end.

*Search.* One linear scan per text finds every maximal scoring segment (Ruzzo and Tompa's disjoint segments); runs of
words that do not raise the score count as one step.

*Calibration.* A segment of score s in a text of n words has the extreme-value tail ``1 - exp(-K n exp(-l s))``. ``l`` and
``K`` come from the scores of other-class texts; segments whose tail is under ``SIGNIFICANT`` are toxic passages. A text's
evidence is the sum of ``l s - log(K n)`` over them, or the best segment's where none is. A Gumbel curve, fitted on
documents whose features were learned without them (two folds), turns evidence into a score from 0 to 1.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled documents (those of the smallest hashes); everything sent to
the driver or broadcast is bounded by that and by ``BUCKETS``. Scoring is one pass over whole texts without a shuffle.

Edge cases: null and empty texts hold no segment and get the score of no evidence; null labels are not learned from;
repeated rows are scored each; an empty table gives no rows; without labels of both classes every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm import textops

SAMPLE_ROWS = 20_000
BUCKETS = 1 << 18
HEADS = (4, 5, 6)
PRIOR = 20_000.0
CERTAIN = 4.0
DRIFT = 0.05
SIGNIFICANT = 0.01


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every word (one row for the word itself, one for each head), and row offsets into them."""
    t = textops.tokenize_column(texts, textops.IS_PUNCT, lower=True, prefixes=HEADS)
    return (np.stack([t.hashes, *t.prefixes]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32), t.row_start


def word_scores(features: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The most telling feature's score of each word, less the drift."""
    best = table[features[0]]
    for row in features[1:]:
        other = table[row]
        best = np.where(np.abs(other) > np.abs(best), other, best)
    return best - DRIFT


def log_odds(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Score of each feature from its counts in both classes."""
    both = toxic + other
    if not toxic.sum() or not other.sum():
        return np.zeros(len(toxic))
    prior = PRIOR * both / both.sum() + 1e-9
    n1, n0 = toxic.sum() + PRIOR, other.sum() + PRIOR
    a, b = toxic + prior, other + prior
    delta = np.log(a) - np.log(np.maximum(n1 - a, 1e-9)) - np.log(b) + np.log(np.maximum(n0 - b, 1e-9))
    certain = np.abs(delta) > CERTAIN * np.sqrt(1 / a + 1 / b)
    return np.where(certain & (both > 2), delta, 0.0)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, end), in linear time."""
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(up.astype(np.int8))) + 1
    cuts = np.concatenate(([0], edge, [len(scores)]))
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    first = 0 if up[0] else 1
    #: Score before, score after, first word, end, and the nearest earlier segment with a lower score before.
    stack: list[tuple[float, float, int, int, int]] = []
    for i in range(first, len(cuts) - 1, 2):
        a, b = int(cuts[i]), int(cuts[i + 1])
        left, right = float(sums[a]), float(sums[b])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, a, b, j))
                break
            left, a = stack[j][0], stack[j][2]
            del stack[j:]
    return [(r - x, a, b) for x, r, a, b, _ in stack]


@dataclass(frozen=True)
class Model:
    scores: np.ndarray  # of each feature
    decay: float  # l
    scale: float  # K
    at: float  # the Gumbel curve's place and slope
    slope: float
    blind: bool = False

    def evidence(self, texts: pa.Array) -> list[tuple[float, int, int, int, int]]:
        """Of each text: evidence, number of words, significant segments, and the best segment's first word and end."""
        features, row_start = word_features(texts)
        scores = word_scores(features, self.scores)
        out = []
        for a, b in zip(row_start[:-1].tolist(), row_start[1:].tolist(), strict=True):
            n = max(b - a, 1)
            found = segments(scores[a:b])
            if not found:
                out.append((-np.log(self.scale * n) if n else 0.0, b - a, 0, -1, -1))
                continue
            bits = [self.decay * s - np.log(self.scale * n) for s, _, _ in found]
            tails = [x for x in bits if -np.expm1(-np.exp(-x)) < SIGNIFICANT]
            best = int(np.argmax(bits))
            out.append((float(sum(tails)) if tails else float(bits[best]), b - a, len(tails), found[best][1], found[best][2]))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.blind:
            return np.zeros(len(evidence))
        return np.exp(-np.exp(-np.clip(self.slope * (evidence - self.at), -30, 30)))


def _tail_parameters(best: np.ndarray, n_words: np.ndarray) -> tuple[float, float]:
    """Decay and scale of the best segment's score in other-class texts, by the Gumbel distribution's moments."""
    if len(best) < 10:
        return 1.0, 1e-3
    trimmed = best[best <= np.quantile(best, 0.99)]
    spread = max(float(trimmed.std()), 0.25)
    decay = np.pi / (spread * np.sqrt(6))
    middle = float(trimmed.mean()) - 0.5772156649015329 / decay
    return float(decay), float(np.exp(decay * middle) / max(np.median(n_words), 1))


def _gumbel_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Place and slope of the curve exp(-exp(-slope (x - at))) by greatest likelihood on a grid, then refined."""
    best = (np.inf, 0.0, 1.0)
    places = np.unique(np.quantile(x, np.linspace(0, 1, 41)))
    slopes = np.geomspace(0.02, 5, 15)
    for _ in range(3):
        for slope in slopes:
            for at in places:
                p = np.clip(np.exp(-np.exp(-np.clip(slope * (x - at), -30, 30))), 1e-6, 1 - 1e-6)
                loss = -(y * np.log(p) + (1 - y) * np.log1p(-p)).mean()
                if loss < best[0]:
                    best = (loss, float(at), float(slope))
        gap = max((places[-1] - places[0]) / 50, 1e-3) if len(places) > 1 else 1e-3
        places = np.linspace(best[1] - gap, best[1] + gap, 13)
        slopes = np.geomspace(best[2] / 1.4, best[2] * 1.4, 9)
    return best[1], best[2]


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the rows of ``labels`` that are not held out: three jobs over a bounded sample."""
    chosen = labels.where(F.col("toxic").isNotNull() & ~F.coalesce(held_out(), F.lit(True))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most ``sample_rows`` rows of three numbers: a proven bound for the broadcast.
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("fold"))
    sample = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic", "fold")

    def count(batches):
        total = np.zeros(4 * BUCKETS, np.int32)
        for batch in textops.batches_by_bytes(batches, "text"):
            features, row_start = word_features(batch.column(0))
            cell = batch.column(2).to_numpy() * 2 + batch.column(1).to_numpy()
            row = np.repeat(np.arange(len(cell), dtype=np.int64), np.diff(row_start)) * BUCKETS
            row, feature = np.divmod(np.unique(row + features), BUCKETS)
            np.add.at(total, cell[row].astype(np.int64) * BUCKETS + feature, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["cell", "n"])

    counted = sample.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(4 * BUCKETS)
    counts[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    counts = counts.reshape(2, 2, BUCKETS)
    if not counts[:, 0].sum() or not counts[:, 1].sum():
        return Model(np.zeros(BUCKETS), 1.0, 1.0, 0.0, 1.0, blind=True)
    other_fold = docs.sparkSession.sparkContext.broadcast([log_odds(counts[1 - f, 1], counts[1 - f, 0]).astype(np.float32) for f in range(2)])

    def best_segments(batches):
        for batch in textops.batches_by_bytes(batches, "text"):
            features, row_start = word_features(batch.column(0))
            folds, out = batch.column(2).to_numpy(), []
            for i, (a, b) in enumerate(zip(row_start[:-1].tolist(), row_start[1:].tolist(), strict=True)):
                found = sorted((s for s, _, _ in segments(word_scores(features[:, a:b], other_fold.value[int(folds[i])]).astype(float))), reverse=True)
                out.append((found, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x for x, _ in out], pa.list_(pa.float64())), pa.array([n for _, n in out], pa.int64())], names=["toxic", "found", "n"])

    rows = sample.mapInArrow(best_segments, "toxic int, found array<double>, n long").toArrow()
    other_fold.unpersist()
    y = rows["toxic"].to_numpy().astype(float)
    n = np.maximum(rows["n"].to_numpy().astype(float), 1)
    all_found = [x.values.to_numpy() for x in rows["found"]]
    best = np.array([x[0] if len(x) else 0.0 for x in all_found])
    decay, scale = _tail_parameters(best[y == 0], n[y == 0])

    def evidence(found, words):
        bits = decay * (found if len(found) else np.zeros(1)) - np.log(scale * words)
        tails = bits[-np.expm1(-np.exp(-bits)) < SIGNIFICANT]
        return tails.sum() if len(tails) else bits.max()

    x = np.array([evidence(f, w) for f, w in zip(all_found, n, strict=True)])
    at, slope = _gumbel_curve(x, y)
    return Model(log_odds(counts[:, 1].sum(0), counts[:, 0].sum(0)).astype(np.float32), decay, scale, at, slope)


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of every whole text: id, score, predicted, n_passages, best_first, best_end (words), n_words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats: a fixed size

    def run(batches):
        m = shared.value
        for batch in textops.batches_by_bytes(batches, "text"):
            e = np.array(m.evidence(batch.column(1)), float).reshape(-1, 5)
            score = m.score(e[:, 0])
            whole = [pa.array(e[:, i].astype(np.int64)) for i in (2, 3, 4, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *whole], names=["id", "score", "predicted", "n_passages", "best_first", "best_end", "n_words"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double, predicted int, n_passages long, best_first long, best_end long, n_words long").withColumnRenamed("id", id_column)


def drop_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The documents that the model does not call toxic, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in textops.batches_by_bytes(batches, text_column):
            e = np.array(m.evidence(batch.column(batch.schema.get_field_index(text_column))), float).reshape(-1, 5)
            yield batch.filter(pa.array(m.score(e[:, 0]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
