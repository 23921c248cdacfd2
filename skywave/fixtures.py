"""Views over the given tables in the shapes that the signal operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS, COLS = 64, 48
#: Orders of a capture, and patches of a frame (20 wide): captures and frames grow in number with the tables.
CAPTURE_ORDERS = 32768
FRAME_PATCHES = 400
_CAPTURE = f"concat(l_returnflag, '-', l_orderkey div {CAPTURE_ORDERS})"


def cells(spark: SparkSession, sf_dir: str, rows: int = ROWS, cols: int = COLS, by: str = _CAPTURE) -> DataFrame:
    """(capture_id, frame_id, f, t, power_db): a dense grid with a roll-off, one carrier and one wideband burst."""
    li = table(spark, sf_dir, "lineitem").select(F.expr(by).alias("capture_id"), F.expr(f"CAST(l_partkey % {rows} AS INT)").alias("f"), F.expr(f"CAST(datediff(l_shipdate, DATE '1995-01-01') % {cols} AS INT)").alias("t"), "l_extendedprice")
    power = li.groupBy("capture_id", "f", "t").agg(F.sum("l_extendedprice").alias("pw"))
    grid = li.select("capture_id").distinct().withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    extra = f"CASE WHEN f BETWEEN {rows * 20 // 64} AND {rows * 27 // 64} AND t BETWEEN {cols * 5 // 48} AND {cols * 40 // 48} THEN 15.0D WHEN f BETWEEN {rows // 8} AND {rows * 55 // 64} AND t BETWEEN {cols * 20 // 48} AND {cols * 23 // 48} THEN 15.0D ELSE 0.0D END"
    value = F.expr(f"10*log10(greatest(coalesce(CAST(pw AS DOUBLE), 0.0D), 1.0D)) - abs(f - {rows // 2})/4.0D + {extra}")
    return grid.join(power, ["capture_id", "f", "t"], "left").select("capture_id", F.lit(0).alias("frame_id"), "f", "t", value.alias("power_db"))


def axis(spark: SparkSession, sf_dir: str, rows: int = ROWS, by: str = _CAPTURE) -> DataFrame:
    """(capture_id, f, freq_hz) for each capture of cells()."""
    c = table(spark, sf_dir, "lineitem").select(F.expr(by).alias("capture_id")).distinct()
    return c.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("freq_hz", F.lit(100e6) + (F.col("f") - rows // 2) * 1e5)


def iq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("b", F.expr("event_id div 10000"))
    # samples are numbered inside ranges of ids, which start where the ranges before them end
    ahead = e.groupBy(F.col("event_type").alias("at"), F.col("b").alias("ab")).agg(F.count("*").alias("n")).selectExpr("at", "ab", "coalesce(sum(n) OVER (PARTITION BY at ORDER BY ab ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead")
    e = e.join(ahead, e.event_type.eqNullSafe(F.col("at")) & e.b.eqNullSafe(F.col("ab")))
    return e.selectExpr("event_type AS capture_id", "CAST(ahead + row_number() OVER (PARTITION BY event_type, b ORDER BY event_id) - 1 AS BIGINT) AS n", "value AS i", "CAST(get_json_object(props, '$.k') AS DOUBLE) - 50 AS q")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("r"), F.min("l_discount").alias("d"), F.min("l_tax").alias("x")).selectExpr(
        "CAST(s % 50 AS BIGINT) AS capture_id", "CAST(l_orderkey*8 + l_linenumber AS BIGINT) AS box_id", "CAST(p*7 % 512 AS BIGINT) AS freq_start", "CAST(p*7 % 512 + 2 + CAST(q AS INT) % 13 AS BIGINT) AS freq_stop",
        "CAST(l_orderkey*11 % 4096 AS BIGINT) AS time_start", "CAST(l_orderkey*11 % 4096 + 4 + l_linenumber*3 AS BIGINT) AS time_stop",
        "CASE r WHEN 'A' THEN 'persistent_carrier' WHEN 'R' THEN 'transient_wideband_burst' ELSE 'unsplit' END AS split_role", "CAST(q AS BIGINT) AS filled_area", "CAST(d AS DOUBLE) AS score_mean", "CAST(d AS DOUBLE) + CAST(x AS DOUBLE) AS score_peak",
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = F.col("vec_id") % FRAME_PATCHES
    return e.select(F.floor(F.col("vec_id") / FRAME_PATCHES).alias("capture_id"), F.col("vec_id").alias("node"), F.floor(at / 20).cast("int").alias("pr"), (at % 20).cast("int").alias("pc"), F.col("embedding").cast("array<double>").alias("x"), "label")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(
        "o_orderstatus AS capture_id", "o_orderkey AS ann_id", "CAST(o_orderkey*97 % 200000 AS BIGINT) AS sample_start", "CAST(50 + floor(o_totalprice) % 900 AS BIGINT) AS sample_count",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE -32.0D + o_custkey % 60 END AS freq_lower_edge", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE -31.0D + o_custkey % 60 + o_orderkey % 4 END AS freq_upper_edge", "o_orderpriority AS label",
    )


def tunes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.selectExpr("o_orderstatus AS capture_id", "CAST(o_custkey*1000 % 200000 AS BIGINT) AS sample_start").distinct().withColumn("frequency", F.expr("1e6D + (sample_start div 1000) % 5 * 100"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr("user_id % 5 AS channel", "datediff(ts, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS frame_id", "event_id % 16 AS patch", "least(value/200.0D, 1.0D) AS v").groupBy("channel", "frame_id", "patch").agg(F.avg("v").alias("p"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").selectExpr("doc_id AS item", "doc_id % 8 * 10 - 40 AS snr_db", "(length(lang) + doc_id) % 3 = 0 AS pred", "quality = 1 AS gt", "toxic = 1 AS texture")


#: The same views for the SQL twins.
SQL = {
    "fx_cells": """fx_cells AS (
  SELECT g.capture_id, 0 AS frame_id, g.f, g.t, 10*log10(greatest(coalesce(pw, 0.0), 1.0)) - abs(g.f - 32)/4.0
    + CASE WHEN g.f BETWEEN 20 AND 27 AND g.t BETWEEN 5 AND 40 THEN 15.0 WHEN g.f BETWEEN 8 AND 55 AND g.t BETWEEN 20 AND 23 THEN 15.0 ELSE 0.0 END AS power_db
  FROM (SELECT * FROM (SELECT DISTINCT l_returnflag || '-' || l_orderkey // 32768 AS capture_id FROM lineitem), (SELECT unnest(range(64)) AS f), (SELECT unnest(range(48)) AS t)) g
  LEFT JOIN (SELECT l_returnflag || '-' || l_orderkey // 32768 AS capture_id, l_partkey % 64 AS f, date_diff('day', TIMESTAMP '1995-01-01', CAST(l_shipdate AS TIMESTAMP)) % 48 AS t, CAST(sum(l_extendedprice) AS DOUBLE) AS pw
    FROM lineitem GROUP BY ALL) p ON g.capture_id = p.capture_id AND g.f = p.f AND g.t = p.t)""",
    "fx_axis": "fx_axis AS (SELECT c AS capture_id, f, 100e6 + (f - 32) * 1e5 AS freq_hz FROM (SELECT DISTINCT l_returnflag || '-' || l_orderkey // 32768 AS c FROM lineitem), (SELECT unnest(range(64)) AS f))",
    "fx_iq": "fx_iq AS (SELECT event_type AS capture_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, value AS i, CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50 AS q FROM events)",
    "fx_boxes": """fx_boxes AS (SELECT min(l_suppkey) % 50 AS capture_id, l_orderkey*8 + l_linenumber AS box_id,
  min(l_partkey)*7 % 512 AS freq_start, min(l_partkey)*7 % 512 + 2 + CAST(min(l_quantity) AS INT) % 13 AS freq_stop,
  l_orderkey*11 % 4096 AS time_start, l_orderkey*11 % 4096 + 4 + l_linenumber*3 AS time_stop,
  CASE min(l_returnflag) WHEN 'A' THEN 'persistent_carrier' WHEN 'R' THEN 'transient_wideband_burst' ELSE 'unsplit' END AS split_role,
  CAST(min(l_quantity) AS INT) AS filled_area, CAST(min(l_discount) AS DOUBLE) AS score_mean, CAST(min(l_discount) AS DOUBLE) + CAST(min(l_tax) AS DOUBLE) AS score_peak
  FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "fx_patches": "fx_patches AS (SELECT vec_id // 400 AS capture_id, vec_id AS node, vec_id % 400 // 20 AS pr, vec_id % 20 AS pc, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)",
    "fx_annotations": """fx_annotations AS (SELECT o_orderstatus AS capture_id, o_orderkey AS ann_id, o_orderkey*97 % 200000 AS sample_start,
  CAST(50 + floor(o_totalprice) % 900 AS BIGINT) AS sample_count, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE -32.0 + o_custkey % 60 END AS freq_lower_edge,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE -31.0 + o_custkey % 60 + o_orderkey % 4 END AS freq_upper_edge, o_orderpriority AS label FROM orders)""",
    "fx_tunes": "fx_tunes AS (SELECT *, 1e6 + (sample_start // 1000) % 5 * 100 AS frequency FROM (SELECT DISTINCT o_orderstatus AS capture_id, o_custkey*1000 % 200000 AS sample_start FROM orders))",
    "fx_frames": "fx_frames AS (SELECT user_id % 5 AS channel, date_diff('day', TIMESTAMP '2024-01-01', ts) AS frame_id, event_id % 16 AS patch, avg(least(value/200.0, 1.0)) AS p FROM events GROUP BY ALL)",
    "fx_pred": "fx_pred AS (SELECT doc_id AS item, doc_id % 8 * 10 - 40 AS snr_db, (length(lang) + doc_id) % 3 = 0 AS pred, quality = 1 AS gt, toxic = 1 AS texture FROM labels JOIN documents USING (doc_id))",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
