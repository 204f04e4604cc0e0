"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's target (in words) is its share of all words by weight, at most ``cap`` times the words it has; what the capped
sources leave over goes to the others by weight until none is above its cap. A document of a source with rate
``e = target / words`` is expected ``e`` times. Prefix sums of these expected copies run over a source's documents in
order of size, one random offset is added, and a document is emitted once for each integer that its step crosses. As
neighbours in this order have like sizes, the words taken come within a few documents' sizes of the target.

Scale: the order within a source is (size class, hash bucket, size, id). Documents are dealt by the triple (source, class,
bucket), so a hot source or a large group of copies spreads over many tasks; the prefix sums over triples and over classes
work on pre-aggregated counts in two short windows. Only scalar sums reach the driver.

Edge cases: a null text has size 0; a null source is a source of its own (the last); documents of size 0 take 0 words;
repeated rows are separate documents, and rows of one id and size are ordered by a hash of their texts, so reruns copy the
same ones; rows with a null id are dealt by that hash, too; ids may be of any type that has an order; an empty table gives no
rows; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.llm.shared import keep, numbered

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
CAP = 3
SEED = "mix"


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _whole(c):
    return c.cast("decimal(38,0)")


def source_targets(sized: DataFrame, cycle=CYCLE, cap: int = CAP) -> DataFrame:
    """One row per source of ``sized`` (_source, _size): _key, source_size, target, both in words."""
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    ranked = numbered(totals.withColumn("_last", F.col("_source").isNull()), [F.col("_last"), F.col("_source")])
    weight = F.element_at(F.array(*[F.lit(x) for x in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    sources = keep(ranked.select("_source", "source_size", weight.cast("long").alias("w")))
    whole = lambda c: _whole(F.col(c) if isinstance(c, str) else c)
    n, everything, rest_w = sources.agg(F.count("*"), F.sum("source_size"), F.sum("w")).first()
    if not n:
        return sources.select(_key("_source").alias("_key"), "source_size", F.lit(0.0).alias("target"))
    given, capped_before = 0, 0
    while True:
        above = whole("w") * _whole(F.lit(str(everything - given))) > whole("source_size") * _whole(F.lit(str(cap * rest_w)))
        given_now, w_now, capped = sources.agg(F.sum(F.when(above, F.col("source_size") * cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("w"))), F.count_if(above)).first()
        if capped == capped_before or not w_now:
            break
        given, rest_w, capped_before = int(given_now), int(w_now), capped
    target = F.when(above, (F.col("source_size") * cap).cast("double")).otherwise((F.col("w") * F.lit(everything - given)).cast("double") / F.lit(float(rest_w)))
    return sources.select(_key("_source").alias("_key"), "source_size", target.alias("target"))


def _key(source: str):
    """Never null, so that joins and windows find the null source too."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def plan_copies(docs: DataFrame, sized: DataFrame, id_column: str = "doc_id", cycle=CYCLE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and copies to ``docs``, which has _source, _size and _tie; ``sized`` has these and the id only."""
    place = lambda df: df.withColumns({"_key": _key("_source"), "_class": F.floor(F.sqrt(F.col("_size").cast("double"))), "_bucket": F.coalesce(F.substring(F.md5(F.col(id_column).cast("string").cast("binary")), 1, 2), F.concat(F.lit("n"), F.pmod("_tie", F.lit(256)).cast("string")))})
    triples = keep(place(sized).groupBy("_key", "_class", "_bucket").agg(F.count("*").alias("_n")))
    before = F.sum("_n").over(Window.partitionBy("_key", "_class").orderBy("_bucket")) - F.col("_n")
    classes = triples.groupBy("_key", "_class").agg(F.sum("_n").alias("_m"))
    class_before = (F.sum("_m").over(Window.partitionBy("_key").orderBy("_class")) - F.col("_m")).alias("_class_before")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    of_class = classes.select("_key", "_class", class_before).join(source_targets(sized, cycle, cap), "_key").withColumn("_offset", offset)
    places = triples.select("_key", "_class", "_bucket", before.alias("_before")).join(of_class, ["_key", "_class"]).select("_key", "_class", "_bucket", (F.col("_before") + F.col("_class_before")).alias("_start"), "source_size", "target", "_offset")
    inside = F.row_number().over(Window.partitionBy("_key", "_class", "_bucket").orderBy("_size", id_column, "_tie"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = (F.col("_start") + F.col("_inside")).cast("double")
    copies = F.floor(rank * F.col("_rate") + F.col("_offset")) - F.floor((rank - 1) * F.col("_rate") + F.col("_offset"))
    return (
        place(docs)
        .withColumn("_inside", inside)
        .join(places, ["_key", "_class", "_bucket"])
        .withColumn("_rate", rate)
        .withColumn("copies", F.least(copies, F.lit(cap).cast("long")))
        .drop("_key", "_class", "_bucket", "_inside", "_start", "_offset", "_rate")
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken (words), copies."""
    sized = keep(docs.select("doc_id", F.col("source").cast("string").alias("_source"), word_count().alias("_size"), F.xxhash64(F.col("text").cast("string")).alias("_tie")))
    out = plan_copies(sized, sized)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: each row once per copy, columns as in ``docs``."""
    # The row travels as one struct, so that no name of its columns can clash with ours.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    whole = docs.select(row, "doc_id", F.col("source").cast("string").alias("_source"), word_count().alias("_size"), F.xxhash64(F.col("text").cast("string")).alias("_tie"))
    sized = keep(whole.select("doc_id", "_source", "_size", "_tie"))
    out = plan_copies(whole, sized).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("_row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
r AS (SELECT source, ss, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
q AS (SELECT *, sum(ss) OVER () AS everything,
        coalesce(sum(3 * ss) OVER (ORDER BY 3.0 * ss / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
        sum(w) OVER (ORDER BY 3.0 * ss / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM r),
f AS (SELECT max(given) AS given, min(rest) AS rest FROM (SELECT given, rest FROM q WHERE w * (everything - given) <= 3 * ss * rest ORDER BY given, rest DESC LIMIT 1)),
t AS (SELECT q.source, q.ss, CASE WHEN q.w * (q.everything - f.given) > 3 * q.ss * f.rest THEN (3 * q.ss)::DOUBLE
        ELSE (q.w * (q.everything - f.given))::DOUBLE / f.rest::DOUBLE END AS target FROM q, f),
k AS (SELECT d.doc_id, d.size, t.ss AS source_size, t.target, CASE WHEN t.ss > 0 THEN t.target / t.ss::DOUBLE ELSE 0.0 END AS rate,
        ('0x' || substr(md5('mix:' || coalesce('s' || d.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off,
        row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(d.size::DOUBLE)), coalesce(substr(md5(d.doc_id::VARCHAR), 1, 2), ''), d.size, d.doc_id)::DOUBLE AS n
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(floor(n * rate + off) - floor((n - 1) * rate + off), 3)::BIGINT AS copies FROM k)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
