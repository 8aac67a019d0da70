"""The registered queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.geometry import Box
from ..operators import boxes as B
from ..operators import coverage as C
from ..operators import tracks as T
from ..params import ROAD, VEHICLE_CLASSES, Params
from ..sources import sidecar
from . import fixtures as X
from .fixtures import HEIGHT, WIDTH

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
ID = ("clip_id", "frame_idx", "det_id")


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL over det, anc, sizes and the tables."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = X.sql(sql)
        return f

    return register


def queries() -> dict[str, Query]:
    from . import pixel_queries

    return _QUERIES | pixel_queries.queries()


def oracle_sql() -> dict[str, str]:
    from . import pixel_queries

    return _SQL | {name: X.sql(body.replace("WITH ", ", ", 1) if body.startswith("WITH ") else body) for name, body in pixel_queries.oracle_sql(s_tiles, _COVER).items()}


# SQL of expressions that several queries share
def s_iou(a: str, b: str) -> str:
    both = f"(greatest(0, least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x))::BIGINT * greatest(0, least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y)))"
    union = f"({a}.w::BIGINT*{a}.h + {b}.w::BIGINT*{b}.h - {both})"
    return f"(CASE WHEN {union} > 0 THEN {both}::DOUBLE / {union}::DOUBLE ELSE 0 END)"


def s_even(e: str) -> str:
    return f"CAST(round_even(({e})::DOUBLE, 0) AS INTEGER)"


def s_inside(v: str, p: str) -> str:
    return f"{p}.x + {p}.w/2.0 BETWEEN {v}.x AND {v}.x + {v}.w AND {p}.y + {p}.h/2.0 BETWEEN {v}.y AND {v}.y + {v}.h"


def s_shift(x: str, y: str, w: str, h: str) -> str:
    return f"greatest(0, {x}) AS x, greatest(0, {y}) AS y, greatest(0, least({w}, {WIDTH} - greatest(0, {x}))) AS w, greatest(0, least({h}, {HEIGHT} - greatest(0, {y}))) AS h"


def s_dilate(px: int) -> str:
    return (
        f"greatest(0, x-{px}) AS x, greatest(0, y-{px}) AS y, least({WIDTH}, x+w+{px}) - greatest(0, x-{px}) AS w, least({HEIGHT}, y+h+{px}) - greatest(0, y-{px}) AS h"
    )


def s_greedy(source: str, group: str, order: str, most: float, fields: str) -> str:
    """Rows kept by the greedy fold."""
    item = "{" + ", ".join(f"'{f}': {f}" for f in fields.split(", ")) + "}"
    return f"""SELECT {group}, unnest(kept, recursive := true) FROM (SELECT {group}, list_reduce(l, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k: {s_iou('b', 'k')} > {most})) > 0
  THEN kept ELSE list_append(kept, b) END, l[1:0]) AS kept FROM (SELECT {group}, list({item} ORDER BY {order}) AS l FROM {source} GROUP BY {group}))"""


# scalar box algebra
@query(f"SELECT a.clip_id, a.frame_idx, a.det_id AS det_a, b.det_id AS det_b, {s_iou('a', 'b')} AS iou FROM det a JOIN det b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.cls = b.cls AND a.det_id < b.det_id WHERE {s_iou('a', 'b')} > 0")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.det(spark, sf_dir)
    a, b = d.alias("a"), d.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("clip_id", "frame_idx", "cls")]
    pairs = a.join(b, on[0] & on[1] & on[2] & (F.col("a.det_id") < F.col("b.det_id")))
    found = G.iou(Box.of("a."), Box.of("b."))
    return pairs.select("a.clip_id", "a.frame_idx", F.col("a.det_id").alias("det_a"), F.col("b.det_id").alias("det_b"), found.alias("iou")).where("iou > 0")


@query("SELECT a.det_id AS det_a, b.det_id AS det_b, sqrt((a.x+a.w/2.0-b.x-b.w/2.0)**2 + (a.y+a.h/2.0-b.y-b.h/2.0)**2) AS dist FROM det a JOIN det b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.det_id < b.det_id")
def center_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.det(spark, sf_dir)
    a, b = d.alias("a"), d.alias("b")
    pairs = a.join(b, (F.col("a.clip_id") == F.col("b.clip_id")) & (F.col("a.frame_idx") == F.col("b.frame_idx")) & (F.col("a.det_id") < F.col("b.det_id")))
    return pairs.select(F.col("a.det_id").alias("det_a"), F.col("b.det_id").alias("det_b"), G.distance(Box.of("a."), Box.of("b.")).alias("dist"))


def _boxes(rows: DataFrame, b: Box, keys: tuple[str, ...] = ID) -> DataFrame:
    return rows.select(*keys, *b.named())


@query(f"SELECT clip_id, frame_idx, det_id, {s_shift('x-50', 'y-50', 'w+100', 'h+100')} FROM det")
def clamp_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    return _boxes(X.det(spark, sf_dir), G.shift_clamp(Box(b.x - 50, b.y - 50, b.w + 100, b.h + 100), WIDTH, HEIGHT))


@query(f"SELECT clip_id, frame_idx, det_id, {s_dilate(8)} FROM det")
def dilate_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(X.det(spark, sf_dir), G.dilate(Box.of(), 8, WIDTH, HEIGHT))


_CORNER = {k: s_even(e) for k, e in (("x1", "least(x/2.0, (x+w)*0.75::DOUBLE) - 20"), ("y1", "least(y/2.0, (y+h)*0.75::DOUBLE) - 20"), ("x2", "greatest(x/2.0, (x+w)*0.75::DOUBLE) - 20"), ("y2", "greatest(y/2.0, (y+h)*0.75::DOUBLE) - 20"))}


@query(
    f"SELECT * FROM (SELECT clip_id, frame_idx, det_id, greatest(0, {_CORNER['x1']}) AS x, greatest(0, {_CORNER['y1']}) AS y, least({WIDTH}, {_CORNER['x2']}) - greatest(0, {_CORNER['x1']}) AS w, least({HEIGHT}, {_CORNER['y2']}) - greatest(0, {_CORNER['y1']}) AS h FROM det) WHERE w > 0 AND h > 0"
)
def xyxy_round_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    box = G.from_corners((b.x + b.w) * 0.75 - 20, (b.y + b.h) * 0.75 - 20, b.x / 2.0 - 20, b.y / 2.0 - 20, WIDTH, HEIGHT)
    return _boxes(X.det(spark, sf_dir), box).where("w > 0 AND h > 0")


@query(
    f"SELECT clip_id, frame_idx, det_id, greatest(0, x) AS x1, greatest(0, y) AS y1, least({WIDTH}, x+w) AS x2, least({HEIGHT}, y + greatest(1, {s_even('h*0.6::DOUBLE')})) AS y2 FROM det WHERE cls = 'vehicle'"
)
def cabin_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = G.cabin_corners(Box.of(), 0.6, WIDTH, HEIGHT)
    return X.det(spark, sf_dir).where("cls = 'vehicle'").select(*ID, *[c.cast("int").alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)])


@query(f"SELECT clip_id, frame_idx, det_id, x <= 3 OR y <= 3 OR x+w >= {WIDTH}-3 OR y+h >= {HEIGHT}-3 AS pinned FROM det")
def edge_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.det(spark, sf_dir).select(*ID, G.at_edge(Box.of(), 3, WIDTH, HEIGHT).alias("pinned"))


_SCALE = "640::DOUBLE / greatest(width, height)::DOUBLE"


@query(
    f"SELECT width, height, {_SCALE} AS scale, greatest(1, {s_even(f'width * ({_SCALE})')}) AS nw, greatest(1, {s_even(f'height * ({_SCALE})')}) AS nh, CAST(floor((640 - greatest(1, {s_even(f'width * ({_SCALE})')})) / 2.0) AS INTEGER) AS pad_x, CAST(floor((640 - greatest(1, {s_even(f'height * ({_SCALE})')})) / 2.0) AS INTEGER) AS pad_y FROM sizes"
)
def letterbox_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sizes(spark, sf_dir).select("width", "height", *[c.alias(n) for n, c in G.letterbox(F.col("width"), F.col("height"), 640).items()])


_SPEED = "(det_id % 50) / 2.0"
_FLOOR = f"CASE WHEN cls = 'plate' THEN 16 ELSE {s_even('0.35::DOUBLE * greatest(w, h)')} END"
_GAIN = f"(CASE WHEN cls = 'face' THEN 1.6 ELSE 1.0 END)::DOUBLE * {_SPEED}"
_PAD = f"greatest(least(CASE WHEN {_SPEED} > 0 THEN {s_even(_GAIN)} ELSE 0 END, 160), {_FLOOR})"
_PADDED = f"SELECT *, {_PAD} AS pad FROM det"
_GROWN = {"x": "greatest(0, x-pad)", "y": "greatest(0, y-pad)", "w": f"greatest(0, least(w+2*pad, {WIDTH} - greatest(0, x-pad)))", "h": f"greatest(0, least(h+2*pad, {HEIGHT} - greatest(0, y-pad)))"}


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.det(spark, sf_dir).withColumn("speed", (F.col("det_id") % 50) / 2.0)


@query("SELECT clip_id, frame_idx, det_id, " + ", ".join(f"CASE WHEN pad > 0 THEN {v} ELSE {k} END AS {k}" for k, v in _GROWN.items()) + f" FROM ({_PADDED})")
def motion_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, cls = Box.of(), F.col("cls")
    gain = F.when(cls == "face", F.lit(1.6)).otherwise(F.lit(1.0))
    return _boxes(_moving(spark, sf_dir), G.motion_pad(b, F.col("speed"), G.margin_floor(cls, b, 16, 0.35), gain, 160, WIDTH, HEIGHT))


_CAB = {"x": "greatest(0, x)", "y": "greatest(0, y)", "w": f"greatest(0, least(w, {WIDTH} - greatest(0, x)))", "h": f"greatest(0, least(greatest(1, {s_even('h*0.6::DOUBLE')}), {HEIGHT} - greatest(0, y)))"}


@query("SELECT clip_id, frame_idx, det_id, " + ", ".join(f"CASE WHEN cls = 'vehicle' THEN {_CAB[k]} WHEN pad > 0 THEN {v} ELSE {k} END AS {k}" for k, v in _GROWN.items()) + f" FROM ({_PADDED})")
def emit_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(_moving(spark, sf_dir), G.emitted(F.col("cls"), Box.of(), F.col("speed"), ROAD, WIDTH, HEIGHT))


@query(f"SELECT width, height, greatest(2, {s_even('12::DOUBLE * width / 1920.0::DOUBLE')}) AS radius FROM sizes")
def blur_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sizes(spark, sf_dir).select("width", "height", G.blur_radius(F.col("width")).alias("radius"))


@query(
    f"SELECT DISTINCT width, '[0:v]split=2[base][soft];[soft]boxblur=' || greatest(2, {s_even('12::DOUBLE * width / 1920.0::DOUBLE')}) || ':2[blurred];[1:v]format=gray[m];[blurred][m]alphamerge[patch];[base][patch]overlay[vout]' AS graph FROM sizes"
)
def filter_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sizes(spark, sf_dir).select("width").distinct().select("width", G.filter_graph(G.blur_radius(F.col("width"))).alias("graph"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS source_hash FROM documents")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_hash"))


@query("SELECT det_id, CASE WHEN (clip_id * 10.0) > 0 THEN frame_idx / (clip_id * 10.0) ELSE frame_idx::DOUBLE END::DOUBLE AS ts FROM det")
def frame_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.det(spark, sf_dir).select("det_id", G.timestamp(F.col("frame_idx"), F.col("clip_id").cast("double") * 10).alias("ts"))


# gates
@query("SELECT clip_id, frame_idx, det_id, score FROM det WHERE score::FLOAT >= 20.35::FLOAT")
def conf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.det(spark, sf_dir).where(B.confident(F.col("score"), 20.35)).select(*ID, "score")


@query("SELECT clip_id, frame_idx, det_id, cls FROM det WHERE (score/100.0)::FLOAT >= CASE cls WHEN 'face' THEN 0.15::FLOAT WHEN 'plate' THEN 0.4::FLOAT WHEN 'vehicle' THEN 0.6::FLOAT ELSE 0.35::FLOAT END")
def decoupled_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.det(spark, sf_dir).where(B.class_confident(F.col("cls"), F.col("score") / 100.0, ROAD)).select(*ID, "cls")


@query("SELECT vec_id, list_position(s, list_max(s)) - 1 AS cls_id FROM (SELECT vec_id, embedding[5:64] AS s FROM embeddings) WHERE list_position(s, list_max(s)) - 1 IN (2, 3, 5, 7)")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 5, 60).alias("s"))
    return rows.select("vec_id", (F.array_position("s", F.array_max("s")).cast("int") - 1).alias("cls_id")).where(F.col("cls_id").isin(*VEHICLE_CLASSES))


@query("SELECT clip_id, frame_idx, det_id FROM det WHERE cls = 'plate' AND h > 0 AND w >= 2.0*h AND w <= 6.0*h")
def aspect_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.det(spark, sf_dir).where((F.col("cls") == "plate") & B.aspect_band(F.col("w"), F.col("h"), 2.0, 6.0)).select(*ID)


@query(f"SELECT clip_id, frame_idx, det_id FROM det WHERE cls = 'plate' AND w*h <= {0.006 * HEIGHT * WIDTH!r}::DOUBLE")
def area_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.det(spark, sf_dir).where((F.col("cls") == "plate") & B.area_at_most(Box.of(), 0.006, WIDTH, HEIGHT)).select(*ID)


@query(f"SELECT clip_id, frame_idx, det_id FROM det WHERE cls = 'vehicle' AND h >= {0.25 * HEIGHT!r}::DOUBLE AND y <= {(1 - 0.3) * HEIGHT!r}::DOUBLE")
def filter_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.det(spark, sf_dir).where((F.col("cls") == "vehicle") & B.tall_and_high(Box.of(), HEIGHT, 0.25, 0.3)).select(*ID)


@query(f"SELECT clip_id, frame_idx, det_id FROM det WHERE cls = 'person' AND h >= {0.2 * HEIGHT!r}::DOUBLE AND y <= {HEIGHT}")
def filter_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.det(spark, sf_dir).where((F.col("cls") == "person") & B.tall_and_high(Box.of(), HEIGHT, 0.2)).select(*ID)


# cadence and regions
@query("SELECT clip_id, frame_idx, det_id FROM det WHERE frame_idx % 8 = 0")
def sample_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.samples(X.det(spark, sf_dir), 60.0, 8.0).select(*ID)


@query(
    "SELECT clip_id, frame_idx, count(*) FILTER (cls IN ('face', 'plate')) AS n_boxes, string_agg(det_id, ',' ORDER BY CASE cls WHEN 'face' THEN 0 ELSE 1 END, det_id) FILTER (cls IN ('face', 'plate')) AS boxes, count(*) FILTER (cls = 'face') AS n_faces, count(*) FILTER (cls = 'plate') AS n_plates FROM det WHERE frame_idx % 4 = 0 GROUP BY clip_id, frame_idx HAVING count(*) FILTER (cls IN ('face', 'plate')) > 0"
)
def frame_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = B.samples(X.det(spark, sf_dir), 60.0, 15.0).where("cls IN ('face', 'plate')")
    ordered = F.array_sort(F.collect_list(F.struct(F.when(F.col("cls") == "face", 0).otherwise(1).alias("rank"), "det_id")))
    lists = both.groupBy("clip_id", "frame_idx").agg(ordered.alias("all"), F.count_if(F.col("cls") == "face").alias("n_faces"), F.count_if(F.col("cls") == "plate").alias("n_plates"))
    joined = F.array_join(F.transform("all", lambda s: s["det_id"].cast("string")), ",")
    return lists.select("clip_id", "frame_idx", F.size("all").cast("long").alias("n_boxes"), joined.alias("boxes"), "n_faces", "n_plates")


@query("SELECT clip_id, count(*) FILTER (cls = 'face') AS n_face, count(*) FILTER (cls = 'plate') AS n_plate FROM det GROUP BY clip_id")
def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.det(spark, sf_dir).groupBy("clip_id").agg(F.count_if(F.col("cls") == "face").alias("n_face"), F.count_if(F.col("cls") == "plate").alias("n_plate"))


@query(
    "SELECT clip_id, frame_idx, CAST(coalesce(greatest(0, 6 - (frame_idx - seen)), 0) AS INTEGER) AS run FROM (SELECT clip_id, frame_idx, last_value(CASE WHEN hot THEN frame_idx END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS seen FROM (SELECT clip_id, frame_idx, bool_or(cls = 'plate' AND w >= 90) AS hot FROM det GROUP BY clip_id, frame_idx))"
)
def boost_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = X.det(spark, sf_dir).groupBy("clip_id", "frame_idx").agg(F.bool_or((F.col("cls") == "plate") & (F.col("w") >= 90)).alias("hot"))
    return B.boost_run(frames, F.col("hot"), 6).select("clip_id", "frame_idx", "run")


# greedy folds
@query(s_greedy("det", "clip_id, frame_idx, cls", "det_id", 0.15, "det_id, x, y, w, h"))
def greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.dedupe(X.det(spark, sf_dir), 0.15)


@query(s_greedy("(SELECT * FROM det WHERE score::FLOAT > 5.0::FLOAT)", "clip_id, frame_idx", "score DESC, det_id", 0.1, "det_id, x, y, w, h"))
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.nms(X.det(spark, sf_dir), 5.0, 0.1)


@query(s_greedy("(SELECT *, det_id % 7 AS detections, frame_idx - det_id % 5 AS last_detect, det_id AS track_ord FROM det)", "clip_id, frame_idx, cls", "detections DESC, last_detect DESC, track_ord", 0.1, "track_ord, x, y, w, h"))
def dedup_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = X.det(spark, sf_dir).withColumns({"detections": F.col("det_id") % 7, "last_detect": F.col("frame_idx") - F.col("det_id") % 5, "track_ord": F.col("det_id")})
    return B.strongest_tracks(tracks, 0.1)


@query(s_greedy("(SELECT *, det_id AS ord FROM det)", "clip_id, frame_idx", "w*h DESC, ord", 0.1, "ord, x, y, w, h"))
def posthoc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.largest_boxes(X.det(spark, sf_dir).withColumn("ord", F.col("det_id")), 0.1)


# tiles and decoding
def s_tiles(px: int) -> str:
    n = lambda side: f"greatest(1, {s_even(f'{side} / {px}.0::DOUBLE')})"
    return f"""SELECT width, height, CAST(j*nx + i AS INTEGER) AS tile_ord, nx*ny AS n_tiles,
  CASE WHEN nx*ny = 1 THEN 0 ELSE greatest(0, trunc(i*tw - tw*0.15::DOUBLE))::INTEGER END AS x0, CASE WHEN nx*ny = 1 THEN 0 ELSE greatest(0, trunc(j*th - th*0.15::DOUBLE))::INTEGER END AS y0,
  CASE WHEN nx*ny = 1 THEN width ELSE least(width, trunc((i+1)*tw + tw*0.15::DOUBLE))::INTEGER END AS x1, CASE WHEN nx*ny = 1 THEN height ELSE least(height, trunc((j+1)*th + th*0.15::DOUBLE))::INTEGER END AS y1
  FROM (SELECT *, unnest(range(0, nx)) AS i FROM (SELECT *, unnest(range(0, ny)) AS j FROM (SELECT width, height, nx, ny, width / nx::DOUBLE AS tw, height / ny::DOUBLE AS th FROM (SELECT width, height, {n('width')} AS nx, {n('height')} AS ny FROM sizes))))"""


@query(f"SELECT width, height, tile_ord, x0, y0, x1, y1 FROM ({s_tiles(1280)})")
def frame_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tiles(X.sizes(spark, sf_dir))


_OWN_TILES = s_tiles(400).replace("FROM sizes", f"FROM (SELECT {WIDTH} AS width, {HEIGHT} AS height)")


@query(
    f"SELECT clip_id, frame_idx, cls, det_id, x, y, w, h FROM (WITH t AS ({_OWN_TILES}), m AS (SELECT d.clip_id, d.frame_idx, d.cls, d.det_id, CASE WHEN clip_id = 3 THEN x ELSE x % 300 + x0 END AS x, CASE WHEN clip_id = 3 THEN y ELSE y % 200 + y0 END AS y, w, h FROM det d JOIN t ON t.tile_ord = d.det_id % 6) SELECT clip_id, frame_idx, cls, det_id, x, y, w, h FROM m WHERE clip_id = 3 UNION ALL SELECT clip_id, frame_idx, cls, det_id, x, y, w, h FROM ({s_greedy('(SELECT * FROM m WHERE clip_id <> 3)', 'clip_id, frame_idx, cls', 'det_id', 0.5, 'det_id, x, y, w, h')}))"
)
def tile_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in tiles of 400 pixels; clip 3 has one tile."""
    grid = B.tiles(spark.range(1).select(F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")), 400)
    whole = F.col("clip_id") == 3
    d = X.det(spark, sf_dir).join(F.broadcast(grid.select("tile_ord", "x0", "y0")), F.col("tile_ord") == F.col("det_id") % 6)  # six tiles
    d = d.withColumns({"x": F.when(whole, F.col("x")).otherwise(F.col("x") % 300), "y": F.when(whole, F.col("y")).otherwise(F.col("y") % 200), "x0": F.when(whole, 0).otherwise(F.col("x0")), "y0": F.when(whole, 0).otherwise(F.col("y0"))})
    return B.merge_tiles(d, F.when(whole, 1).otherwise(6)).select("clip_id", "frame_idx", "cls", "det_id", *"xywh")


def s_decode(scores: str, keep: str) -> str:
    """Anchors of 640 pixels in frames of 1280 by 720: scale 0.5, padding 0 and 140."""
    c = {k: s_even(e) for k, e in (("x1", "(cx - bw/2 - 0)/0.5::DOUBLE"), ("y1", "(cy - bh/2 - 140)/0.5::DOUBLE"), ("x2", "(cx + bw/2 - 0)/0.5::DOUBLE"), ("y2", "(cy + bh/2 - 140)/0.5::DOUBLE"))}
    return f"""SELECT * FROM (SELECT vec_id, greatest(0, {c['x1']}) AS x, greatest(0, {c['y1']}) AS y, least(1280, {c['x2']}) - greatest(0, {c['x1']}) AS w, least(720, {c['y2']}) - greatest(0, {c['y1']}) AS h, score, cls_id FROM (
  SELECT vec_id, v[1]::DOUBLE AS cx, v[2]::DOUBLE AS cy, v[3]::DOUBLE AS bw, v[4]::DOUBLE AS bh, list_max(s) AS score, CASE WHEN len(s) > 1 THEN CAST(list_position(s, list_max(s)) - 1 AS INTEGER) ELSE 0 END AS cls_id FROM (
  SELECT vec_id, [(320::DOUBLE + embedding[1]::DOUBLE*1000)::FLOAT, (320::DOUBLE + embedding[2]::DOUBLE*500)::FLOAT, (20::DOUBLE + abs(embedding[3]::DOUBLE)*200)::FLOAT, (20::DOUBLE + abs(embedding[4]::DOUBLE)*200)::FLOAT] AS v, {scores} AS s FROM embeddings)) WHERE score >= 0.05::FLOAT {keep}) WHERE w > 0 AND h > 0"""


def _anchors(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, F.Column]:
    e = lambda k: F.element_at("embedding", k).cast("double")
    box = [(320 + e(1) * 1000).cast("float"), (320 + e(2) * 500).cast("float"), (20 + F.abs(e(3)) * 200).cast("float"), (20 + F.abs(e(4)) * 200).cast("float")]
    return X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.concat(F.array(*box), F.slice("embedding", 5, n))


@query(s_decode("embedding[5:5]", ""))
def yolo_decode_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.decode(*_anchors(spark, sf_dir, 1), WIDTH, HEIGHT, 640, 0.05).drop("embedding")


@query(s_decode("embedding[5:64]", "AND cls_id IN (2, 3, 5, 7)"))
def yolo_decode_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.decode(*_anchors(spark, sf_dir, 60), WIDTH, HEIGHT, 640, 0.05, VEHICLE_CLASSES).drop("embedding")


# joins
@query(f"SELECT v.clip_id, v.frame_idx, v.det_id FROM det v WHERE v.cls = 'vehicle' AND EXISTS (SELECT 1 FROM det p WHERE p.cls = 'plate' AND p.clip_id = v.clip_id AND p.frame_idx = v.frame_idx AND {s_inside('v', 'p')})")
def plate_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.det(spark, sf_dir)
    return B.corroborated(d.where("cls = 'vehicle'"), d.where("cls = 'plate'")).select(*ID)


@query(
    f"SELECT clip_id, track_id, cls, frame_idx, x, y, w, h FROM anc WHERE cls <> 'vehicle' OR (clip_id, track_id) IN (SELECT (v.clip_id, v.track_id) FROM anc v JOIN anc p ON p.cls = 'plate' AND p.clip_id = v.clip_id AND p.frame_idx = v.frame_idx AND {s_inside('v', 'p')} WHERE v.cls = 'vehicle')"
)
def corroborated_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.anc(spark, sf_dir).select("clip_id", "track_id", "cls", "frame_idx", *"xywh")
    return T.with_plates(a, a.where("cls = 'plate'"))


_DIAG = "greatest(sqrt(d.w::DOUBLE*d.w + d.h::DOUBLE*d.h), sqrt(t.w::DOUBLE*t.w + t.h::DOUBLE*t.h))"


@query(
    f"SELECT clip_id, frame_idx, cls, det_id, track_ord, CASE WHEN iou >= 0.3 THEN 'iou' ELSE 'gate' END AS stage FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY CASE WHEN iou >= 0.3 THEN 0 ELSE 1 END, CASE WHEN iou >= 0.3 THEN -iou END NULLS FIRST, CASE WHEN iou >= 0.3 THEN -track_ord END NULLS FIRST, dist, track_ord) AS nth FROM (SELECT d.clip_id, d.frame_idx, d.cls, d.det_id, t.det_id AS track_ord, {s_iou('d', 't')} AS iou, sqrt((d.x+d.w/2.0-t.x-t.w/2.0)**2 + (d.y+d.h/2.0-t.y-t.h/2.0)**2) AS dist, greatest(1.2::DOUBLE*{_DIAG}, 72) + (t.det_id % 50)/2.0 AS gate FROM det d JOIN det t ON t.clip_id = d.clip_id AND t.frame_idx = d.frame_idx - 1 AND t.cls = d.cls) WHERE iou >= 0.3 OR dist <= gate) WHERE nth = 1"
)
def associate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a frame against those of the frame before, taken as tracks."""
    tracks = _moving(spark, sf_dir).select("clip_id", (F.col("frame_idx") + 1).alias("frame_idx"), "cls", F.col("det_id").alias("track_ord"), "speed", *"xywh")
    return B.associate(X.det(spark, sf_dir), tracks, ROAD)


@query(f"SELECT s.clip_id, s.frame_idx, s.det_id FROM det s WHERE s.det_id % 3 = 0 AND EXISTS (SELECT 1 FROM det f WHERE f.det_id % 3 <> 0 AND f.clip_id = s.clip_id AND f.frame_idx = s.frame_idx AND f.cls = s.cls AND {s_iou('s', 'f')} > 0.1)")
def retire_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.det(spark, sf_dir)
    return B.superseded(d.where("det_id % 3 = 0"), d.where("det_id % 3 <> 0"), 0.1).select(*ID)


_HORIZON = f"CASE WHEN cls = 'face' THEN CASE WHEN {_SPEED} >= 6 THEN 6 ELSE 20 END ELSE 9 END"


@query(f"SELECT clip_id, frame_idx, det_id, {_HORIZON} AS horizon FROM det")
def coast_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moving(spark, sf_dir).select(*ID, B.coast_horizon(F.col("cls"), F.col("speed"), ROAD).alias("horizon"))


@query(
    f"SELECT clip_id, frame_idx, det_id, (det_id % 4 > 0 OR cls = 'face') AND w > 0 AND h > 0 AND det_id % 23 <= {_HORIZON} AND NOT (cls = 'face' AND (x <= 3 OR y <= 3 OR x+w >= {WIDTH}-3 OR y+h >= {HEIGHT}-3) AND det_id % 23 > 2) AS alive FROM det"
)
def alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth track has no flow points."""
    state = B.alive(F.col("cls"), Box.of(), F.col("det_id") % 4 > 0, F.col("det_id") % 23, F.col("speed"), ROAD, WIDTH, HEIGHT, 2)
    return _moving(spark, sf_dir).select(*ID, state.alias("alive"))


# tracks
_LEAD = "SELECT *, lead(frame_idx) OVER o AS nf, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead(w) OVER o AS nw, lead(h) OVER o AS nh, row_number() OVER o AS nth FROM {} WINDOW o AS (PARTITION BY clip_id, track_id ORDER BY frame_idx)"
_BETWEEN = (
    "SELECT clip_id, track_id, cls, CAST(frame_idx + i AS INTEGER) AS frame_idx, "
    + ", ".join(f"{s_even(f'{c} + (i / (nf - frame_idx)::DOUBLE) * (n{c} - {c})')} AS {c}" for c in "xywh")
    + " FROM (SELECT *, unnest(range(1, nf - frame_idx)) AS i FROM ("
    + _LEAD
    + ") WHERE nf - frame_idx > 1)"
)
_ROLL = (
    "SELECT clip_id, track_id, cls, frame_idx, "
    + s_shift(*(s_even(f"r{c}") for c in "xywh"))
    + " FROM (SELECT clip_id, track_id, cls, CAST(f AS INTEGER) AS frame_idx, "
    + ", ".join(f"{c} + (n{c} - {c}) / (nf - frame_idx)::DOUBLE * (f - frame_idx) AS r{c}" for c in "xywh")
    + " FROM (SELECT *, unnest(range(greatest(0, frame_idx - {k}), frame_idx)) AS f FROM ("
    + _LEAD
    + ") WHERE nth = 1 AND nf IS NOT NULL AND frame_idx > 0)) WHERE rw > 0 AND rh > 0"
)


@query("SELECT clip_id, track_id, cls, frame_idx, x, y, w, h FROM anc WHERE cls <> 'face' OR track_id IN (SELECT track_id FROM anc GROUP BY track_id HAVING count(*) >= 2)")
def confirm_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.anc(spark, sf_dir).select("clip_id", "track_id", "cls", "frame_idx", *"xywh")
    return T.confirmed(a, a, 2)


@query(_BETWEEN.format("anc"))
def interpolate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.interpolated(X.anc(spark, sf_dir)).select("clip_id", "track_id", "cls", "frame_idx", *"xywh")


@query(_ROLL.replace("{k}", "40").format("anc"))
def pre_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pre_roll(X.anc(spark, sf_dir), 40, WIDTH, HEIGHT).select("clip_id", "track_id", "cls", "frame_idx", *"xywh")


_KEPT = "(SELECT * FROM anc WHERE cls <> 'face' OR track_id IN (SELECT track_id FROM anc GROUP BY track_id HAVING count(*) >= 2))"
_ALL = (
    f"(SELECT clip_id, frame_idx, track_id::INTEGER AS ord, x, y, w, h FROM {_KEPT} UNION ALL SELECT clip_id, frame_idx, track_id::INTEGER AS ord, x, y, w, h FROM ({_BETWEEN.format(_KEPT)}) UNION ALL SELECT clip_id, frame_idx, track_id::INTEGER AS ord, x, y, w, h FROM ({_ROLL.replace('{k}', '5').format(_KEPT)}))"
)


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.anc(spark, sf_dir)
    return T.frame_boxes(a, a, face_min_detections=2, interpolate=True, pre_roll_frames=5, width=WIDTH, height=HEIGHT, dedup_iou=0.55)


_CONFIRMED = s_greedy(_ALL, "clip_id, frame_idx", "w*h DESC, ord", 0.55, "ord, x, y, w, h")


@query(_CONFIRMED)
def confirmed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confirmed(spark, sf_dir)


@query(
    "SELECT clip_id, cls, coalesce(max(d), 0)::DOUBLE AS speed FROM (SELECT clip_id, cls, sqrt((x+w/2.0-px-pw/2.0)**2 + (y+h/2.0-py-ph/2.0)**2) AS d FROM (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM anc WINDOW o AS (PARTITION BY clip_id, track_id ORDER BY frame_idx))) GROUP BY clip_id, cls"
)
def max_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_speed(X.anc(spark, sf_dir))


# timeline, mask and coverage
_TIMELINE = f"(SELECT * FROM (SELECT clip_id, frame_idx, ord, {s_dilate(8)} FROM ({_CONFIRMED})) WHERE w > 0 AND h > 0)"


@query(f"SELECT * FROM {_TIMELINE}")
def timeline_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.timeline(_confirmed(spark, sf_dir), 8, WIDTH, HEIGHT)


@query(
    f"SELECT f.clip_id, f.frame_idx, count(t.ord)::INTEGER AS n, coalesce(string_agg(t.ord, ',' ORDER BY t.ord), '') AS ords FROM (SELECT clip_id, CAST(unnest(range(0, 60)) AS INTEGER) AS frame_idx FROM (SELECT DISTINCT clip_id FROM anc)) f LEFT JOIN {_TIMELINE} t USING (clip_id, frame_idx) GROUP BY f.clip_id, f.frame_idx"
)
def active_boxes_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = X.anc(spark, sf_dir).select("clip_id").distinct().withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(59))))
    found = T.active_at(frames, T.timeline(_confirmed(spark, sf_dir), 8, WIDTH, HEIGHT))
    return found.select("clip_id", "frame_idx", "n", F.coalesce(F.array_join(F.transform("boxes", lambda b: b["ord"].cast("string")), ","), F.lit("")).alias("ords"))


@query(f"SELECT clip_id, frame_idx, CAST(row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY ord) - 1 AS INTEGER) AS nth, x, y, w, h FROM {_TIMELINE}")
def sidecar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines as JSON and back."""
    return sidecar.from_json(sidecar.to_json(T.timeline(_confirmed(spark, sf_dir), 8, WIDTH, HEIGHT)))


_RECT = f"greatest(0, x) AS x1, greatest(0, y) AS y1, least({WIDTH}, x+w+1) AS x2, least({HEIGHT}, y+h+1) AS y2"


def s_painted(source: str, group: str) -> str:
    return f"SELECT {group}, sum(greatest(0, x2 - greatest(x1, coalesce(m, x1))))::BIGINT AS pixels FROM (SELECT *, max(x2) OVER (PARTITION BY {group}, yy ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT *, unnest(range(y1, y2)) AS yy FROM ({source}) WHERE x2 > x1 AND y2 > y1)) GROUP BY {group}"


@query(s_painted(f"SELECT clip_id, frame_idx, {_RECT} FROM det WHERE cls <> 'vehicle'", "clip_id, frame_idx"))
def mask_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.painted(C.rectangles(X.det(spark, sf_dir).where("cls <> 'vehicle'"), WIDTH, HEIGHT))


_CABINS = f"SELECT clip_id, frame_idx, det_id, greatest(0, x) AS cx1, greatest(0, y) AS cy1, least({WIDTH}, x+w) AS cx2, least({HEIGHT}, y + greatest(1, {s_even('h*0.6::DOUBLE')})) AS cy2 FROM det v WHERE cls = 'vehicle' AND EXISTS (SELECT 1 FROM det p WHERE p.cls = 'plate' AND p.clip_id = v.clip_id AND p.frame_idx = v.frame_idx AND {s_inside('v', 'p')})"
_UNDER = f"SELECT c.clip_id, c.frame_idx, c.det_id, greatest(x1, cx1) AS x1, greatest(y1, cy1) AS y1, least(x2, cx2) AS x2, least(y2, cy2) AS y2 FROM ({_CABINS}) c JOIN (SELECT clip_id, frame_idx, {_RECT} FROM (SELECT clip_id, frame_idx, {s_dilate(40)} FROM det WHERE cls <> 'vehicle')) b USING (clip_id, frame_idx)"
_COVER = f"SELECT clip_id, frame_idx, det_id, CASE WHEN area > 0 THEN coalesce(pixels, 0) / area::DOUBLE END AS coverage FROM (SELECT *, CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN (cx2-cx1)*(cy2-cy1) ELSE 0 END AS area FROM ({_CABINS})) LEFT JOIN ({s_painted(_UNDER, 'clip_id, frame_idx, det_id')}) USING (clip_id, frame_idx, det_id)"


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.det(spark, sf_dir)
    vehicles = B.corroborated(d.where("cls = 'vehicle'"), d.where("cls = 'plate'"))
    masked = T.timeline(d.where("cls <> 'vehicle'").withColumn("ord", F.col("det_id")), 40, WIDTH, HEIGHT)
    return C.sightings(vehicles, masked, 0.6, WIDTH, HEIGHT)


@query(_COVER)
def cabin_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sightings(spark, sf_dir)


@query(f"SELECT clip_id, count(*) AS vehicle_frames, count(*) FILTER (coverage < 0.25) AS leaks, count(*) FILTER (coverage < 0.25) = 0 AS ok FROM ({_COVER}) GROUP BY clip_id")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.report(_sightings(spark, sf_dir), 0.25)


@query(f"SELECT clip_id, frame_idx, det_id, coverage FROM ({_COVER}) WHERE coverage < 0.25 ORDER BY coverage, frame_idx, det_id LIMIT 5")
def worst_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.worst(_sightings(spark, sf_dir), 0.25)


_GATED = (
    "(SELECT * FROM det WHERE frame_idx % 2 = 0 AND (score/100.0)::FLOAT >= CASE cls WHEN 'face' THEN 0.15::FLOAT WHEN 'plate' THEN 0.1::FLOAT WHEN 'vehicle' THEN 0.1::FLOAT ELSE 0.35::FLOAT END "
    f"AND (cls <> 'plate' OR (h > 0 AND w >= 2.0*h AND w <= 6.0*h AND w*h <= {0.006 * HEIGHT * WIDTH!r}::DOUBLE)))"
)
_LISTED = f"({s_greedy(_GATED, 'clip_id, frame_idx, cls', 'det_id', 0.5, 'det_id, x, y, w, h')})"


@query(
    f"WITH g AS {_LISTED}, b AS (SELECT clip_id, frame_idx, det_id, x, y, w, h FROM g WHERE cls <> 'vehicle' UNION ALL SELECT clip_id, frame_idx, det_id, {_CAB['x']} AS x, {_CAB['y']} AS y, {_CAB['w']} AS w, {_CAB['h']} AS h FROM g v WHERE cls = 'vehicle' AND EXISTS (SELECT 1 FROM g p WHERE p.cls = 'plate' AND p.clip_id = v.clip_id AND p.frame_idx = v.frame_idx AND {s_inside('v', 'p')})) SELECT * FROM (SELECT clip_id, frame_idx, det_id AS ord, {s_dilate(8)} FROM b) WHERE w > 0 AND h > 0".replace("WITH g", ", g", 1)
)
def timeline_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cadence, thresholds, gates, greedy dedupe, corroboration, cabins and dilation: from detections to a timeline."""
    p = Params.of(ROAD, conf=0.1, vehicle_conf=0.1)
    cls, b = F.col("cls"), Box.of()
    plate = B.aspect_band(b.w, b.h, p.plate_min_aspect, p.plate_max_aspect) & B.area_at_most(b, p.plate_max_area_frac, WIDTH, HEIGHT)
    d = B.samples(X.det(spark, sf_dir), 16.0, p.sample_fps).where(B.class_confident(cls, F.col("score") / 100.0, p) & ((cls != "plate") | plate))
    d = B.dedupe(d)
    vehicles = B.corroborated(d.where("cls = 'vehicle'"), d.where("cls = 'plate'"))
    cabins = vehicles.select("clip_id", "frame_idx", "det_id", *G.shift_clamp(Box(b.x, b.y, b.w, F.greatest(F.lit(1), G.even(b.h * F.lit(p.track_cabin_frac)))), WIDTH, HEIGHT).named())
    boxes = d.where("cls <> 'vehicle'").select(*cabins.columns).unionByName(cabins).withColumnRenamed("det_id", "ord")
    return T.timeline(boxes, 8, WIDTH, HEIGHT)
