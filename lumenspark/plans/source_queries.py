"""Parsing and writing of text, over the document, page and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspark.plans.registry import DEM, dem, query, table
from lumenspark.sources import rasters, tables


@query("s3_quantise", f"WITH {DEM} SELECT r, c, round_even(least(greatest(z * 2, -32768.0), 32767.0), 0)::SMALLINT AS half_m FROM dem")
def _(spark, sf):
    return dem(spark, sf).select("r", "c", rasters.quantise(F.col("z")).alias("half_m"))


@query("s6_windowed_scan", f"WITH {DEM} SELECT r - 7 AS r, c - 5 AS c, round(31.5 - 5, 1) AS s0, round(249.5 - 7, 1) AS l0, z FROM dem WHERE r >= 7 AND r < 263 AND c >= 5 AND c < 37")
def _(spark, sf):
    """A window of a raster, its origin shifted along: the window is the operator."""
    from lumenspark.operators.raster import crop

    return crop(dem(spark, sf), 7, 5, 256, 32).select("r", "c", F.lit(31.5 - 5).alias("s0"), F.lit(249.5 - 7).alias("l0"), "z")


@query("s7_natural_origin", """WITH w AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'PARAMETER["latitude_of_origin",-' || (s_suppkey % 90) || '.5],PARAMETER["central_meridian",' || (s_suppkey % 360) || ']' ELSE 'PARAMETER["Latitude of natural origin", -' || (s_suppkey % 90) || '.5, x],PARAMETER["Longitude of natural origin", ' || (s_suppkey % 360) || ', x]' END AS t FROM supplier)
SELECT id, -((id % 90) + 0.5)::DOUBLE AS lat0, (id % 360)::DOUBLE AS lon0 FROM w""")
def _(spark, sf):
    k = F.col("s_suppkey")
    old = F.format_string('PARAMETER["latitude_of_origin",-%d.5],PARAMETER["central_meridian",%d]', k % 90, k % 360)
    new = F.format_string('PARAMETER["Latitude of natural origin", -%d.5, x],PARAMETER["Longitude of natural origin", %d, x]', k % 90, k % 360)
    lat, lon = tables.natural_origin(F.when(k % 2 == 0, old).otherwise(new))
    return table(spark, sf, "supplier").select(k.alias("id"), lat.alias("lat0"), lon.alias("lon0"))


@query("s11_time_list", "WITH l AS (SELECT CASE event_id % 4 WHEN 0 THEN '# note' WHEN 1 THEN '   ' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '  # frame' END AS v FROM events) SELECT DISTINCT epoch_us(strptime(trim(split_part(v, '#', 1)), '%Y-%m-%dT%H:%M:%S')) AS us FROM l WHERE trim(split_part(v, '#', 1)) <> ''")
def _(spark, sf):
    k = F.col("event_id") % 4
    line = F.when(k == 0, "# note").when(k == 1, "   ").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("  # frame")))
    return tables.time_list(table(spark, sf, "events").select(line.alias("value"))).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("s12_time_spellings", "SELECT event_id, epoch_us(date_trunc('second', ts)) AS us FROM events")
def _(spark, sf):
    """Four spellings of one time."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".000")))
    return table(spark, sf, "events").select("event_id", F.unix_micros(tables.parse_time(text).cast("timestamp")).alias("us"))


@query("s14_pairs", "SELECT a.doc_id FROM documents a JOIN labels b USING (doc_id)")
def _(spark, sf):
    """Ids that have a file of both kinds."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("s17_identify", "SELECT d.doc_id, sha256(text) AS sha256 FROM documents d WHERE strlen(text) IN (SELECT strlen(text) FROM documents WHERE lang = 'en')")
def _(spark, sf):
    """Hashes of the texts whose size is that of a known one: the size goes first."""
    d = table(spark, sf, "documents")
    sizes = d.where("lang = 'en'").select(F.octet_length("text").alias("length")).distinct()
    return d.withColumn("length", F.octet_length("text")).join(sizes, "length", "left_semi").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("s18_hash_cache", "SELECT o_orderkey, l.h FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS h FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey) l ON l_orderkey = o_orderkey")
def _(spark, sf):
    cached = table(spark, sf, "lineitem").where("l_linenumber > 2").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("h"))
    o = table(spark, sf, "orders")
    return o.join(cached, o["o_orderkey"] == cached["l_orderkey"], "left").select("o_orderkey", "h")


@query("s21_overview_no_data", f"WITH {DEM}, n AS (SELECT r, c, CASE WHEN (r + c) % 11 = 0 THEN 2e6 ELSE z END AS z FROM dem) SELECT r // 2 AS r, c // 2 AS c, CASE WHEN abs(z) > 1e6 THEN 'NaN'::DOUBLE ELSE round(z, 6) END AS z FROM n WHERE r % 2 = 0 AND c % 2 = 0")
def _(spark, sf):
    """Every second cell, no data as NaN: down-sampling is the operator."""
    from lumenspark.operators.raster import overview

    holes = dem(spark, sf).withColumn("z", F.when((F.col("r") + F.col("c")) % 11 == 0, 2e6).otherwise(F.col("z")))
    return overview(holes, 2).select("r", "c", F.round("z", 6).alias("z"))


@query("s24_sections", "WITH l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 1 THEN '[part' || c_custkey || ']' ELSE 'key' || c_custkey || ' = ' || c_mktsegment END AS v FROM customer), n AS (SELECT k, v, last_value(CASE WHEN v LIKE '[%' THEN trim(v, '[]') END IGNORE NULLS) OVER (ORDER BY k) AS section FROM l) SELECT section, trim(split_part(v, '=', 1)) AS key, trim(split_part(v, '=', 2)) AS value FROM n WHERE v NOT LIKE '[%'")
def _(spark, sf):
    k = F.col("c_custkey")
    line = F.when(k % 7 == 1, F.concat(F.lit("[part"), k, F.lit("]"))).otherwise(F.concat(F.lit("key"), k, F.lit(" = "), F.col("c_mktsegment")))
    return tables.sections(table(spark, sf, "customer").select("c_custkey", line.alias("value")), "c_custkey")


@query("s25_synthetic_terrain", "SELECT i // 64 AS r, i % 64 AS c, CASE WHEN i = 2020 THEN 1000.0 WHEN i // 64 BETWEEN 40 AND 44 THEN 50.0 ELSE 0.0 END AS z FROM range(4096) t(i)")
def _(spark, sf):
    """Flat ground with a band and a spike."""
    i = F.col("id")
    return spark.range(4096).select(F.expr("id div 64").alias("r"), (i % 64).alias("c"), F.when(i == 2020, 1000.0).when(F.expr("id div 64").between(40, 44), 50.0).otherwise(0.0).alias("z"))


@query("k2_azel_lines", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (epoch_us(ts) // 1000) % 1000 <> 0 THEN '.' || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') ELSE '' END || 'Z' AS time FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("time"))
    return tables.azel_lines(e, "time")


@query("k4_csv_cells", "SELECT page_id, CASE WHEN regexp_matches(html, '[\",\\r\\n]') THEN '\"' || replace(html, '\"', '\"\"') || '\"' ELSE html END AS cell FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tables.csv_cell(F.col("html")).alias("cell"))


@query("k5_description", """SELECT s_suppkey, '{"name":"' || s_name || '","nation":' || s_nationkey || ',"window":{"rows":' || (s_suppkey % 16) || ',"cols":' || (s_suppkey % 9) || '}}' AS json FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.struct((k % 16).alias("rows"), (k % 9).alias("cols")).alias("window"))).alias("json"))


@query("k4_manifest_unpivot", "SELECT n_nationkey AS id, unnest(['name', 'region']) AS key, unnest([n_name, n_regionkey::VARCHAR]) AS value FROM nation")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    return n.unpivot(["id"], ["name", "region"], "key", "value")


@query("safe_name", "SELECT page_id, regexp_replace(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tables.safe_name(F.col("url")).alias("name"))


@query("human_bytes", "SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN printf('%.1f MB', n_chars / 1048576.0) WHEN n_chars >= 1024 THEN printf('%.1f KB', n_chars / 1024.0) ELSE n_chars || ' B' END AS size FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tables.human_bytes(F.col("n_chars")).alias("size"))


@query("human_duration", "SELECT doc_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s // 3600 || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS took FROM (SELECT doc_id, round_even(n_chars / 2.0, 0)::BIGINT AS s FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tables.human_duration(F.col("n_chars") / 2).alias("took"))


@query("s22_constant_columns", "SELECT count(DISTINCT r_regionkey) > 1 AS r_regionkey, count(DISTINCT 'x') > 1 AS fixed FROM region")
def _(spark, sf):
    """Which columns of a plot vary."""
    r = table(spark, sf, "region").withColumn("fixed", F.lit("x"))
    return r.agg(*((F.countDistinct(c) > 1).alias(c) for c in ("r_regionkey", "fixed")))
