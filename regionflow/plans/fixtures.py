"""Detections, anchors and sizes derived from the driver's tables. The same text runs in Spark and in the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WIDTH, HEIGHT = 1280, 720

DET = """SELECT user_id % 4 AS clip_id, CAST(floor(event_id/40.0) AS INT) AS frame_idx, event_id AS det_id,
  CASE event_type WHEN 'click' THEN 'plate' WHEN 'error' THEN 'vehicle' WHEN 'purchase' THEN 'person' ELSE 'face' END AS cls,
  value AS score, CAST((event_id*37) % 1100 AS INT) AS x, CAST((event_id*53) % 600 AS INT) AS y,
  CAST(CASE event_type WHEN 'click' THEN 40 + event_id % 60 + CASE WHEN event_id % 13 = 0 THEN 200 ELSE 0 END
       WHEN 'error' THEN 260 + event_id % 120 WHEN 'purchase' THEN 40 + event_id % 30 ELSE 16 + event_id % 32 END AS INT) AS w,
  CAST(CASE event_type WHEN 'click' THEN 15 + event_id % 20
       WHEN 'error' THEN 160 + event_id % 80 WHEN 'purchase' THEN 120 + event_id % 60 ELSE 16 + event_id % 32 END AS INT) AS h
FROM {events}"""

ANC = """SELECT user_id AS track_id, user_id % 4 AS clip_id,
  CASE WHEN user_id % 3 = 0 THEN 'face' WHEN user_id % 3 = 1 THEN 'plate' ELSE 'vehicle' END AS cls,
  CAST(10 + 3*n + event_id % 3 AS INT) AS frame_idx, CAST(100 + 4*n + event_id % 7 AS INT) AS x, CAST(200 + event_id % 11 AS INT) AS y,
  CAST(40 + n % 9 AS INT) AS w, CAST(30 + n % 5 AS INT) AS h
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM {events}) e
WHERE n < 1 + user_id % 12"""

SIZES = """SELECT DISTINCT CAST(160 * (p_size % 25 + 1) AS INT) AS width, CAST(90 * (p_size % 24 + 1) AS INT) AS height FROM {part}"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DET, events=_read(spark, sf_dir, "events"))


def anc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ANC, events=_read(spark, sf_dir, "events"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SIZES, part=_read(spark, sf_dir, "part"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _read(spark, sf_dir, name)


def sql(body: str) -> str:
    """A checking query over the derived relations."""
    return f"WITH det AS ({DET.format(events='events')}), anc AS ({ANC.format(events='events')}), sizes AS ({SIZES.format(part='part')}) {body}"
