"""Every relational operator as a query over the derived views, with the SQL it is compared with.

Doubles that are computed are rounded to 6 or 9 places on both sides; every order ends in an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodemine.functions import geometry as G
from lodemine.functions import text as X
from lodemine.functions import vectors as V
from lodemine.operators import clusters as C
from lodemine.operators import neighbours as N
from lodemine.operators import ranking as R
from lodemine.operators import relational as L
from lodemine.operators import suppress as S
from lodemine.operators import svm as M
from lodemine.sources import images as I
from lodemine.sources.views import SQL as VIEW
from lodemine.sources.views import detections, images, patches
from lodemine.sources.workspaces import unpack

QUERIES: dict = {}
ORACLES: dict = {}

Session = SparkSession
_R = lambda c, n=6: F.round(c, n) + F.lit(0.0)


def query(sql: str | None = None, views: str = ""):
    """Registers the function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH " + ",\n".join(VIEW[v] for v in views.split()) if views else ""
            body = sql.strip()
            if head and body.startswith("WITH "):
                body = ", " + body[5:]
            ORACLES[f.__name__] = f"{head}\n{body}".strip()
        return f

    return add


# -- images, labels, orders

ORD = """WITH o AS (SELECT *, row_number() OVER (ORDER BY is_pos DESC, (imidx * 37) % 101, imidx) - 1 AS ord FROM images)"""


def _ordered(spark: Session, sf: str) -> DataFrame:
    return I.image_order(images(spark, sf), (F.col("imidx") * 37) % 101)


@query("SELECT imidx, is_pos, nrows, ncols FROM images", "patches images")
def image_table(spark, sf):
    return images(spark, sf)


@query("SELECT is_pos, count(*) AS n FROM images GROUP BY is_pos", "patches images")
def label_split_counts(spark, sf):
    return images(spark, sf).groupBy("is_pos").agg(F.count("*").alias("n"))


@query(ORD + " SELECT ord, imidx, is_pos FROM o", "patches images")
def stratified_order(spark, sf):
    return _ordered(spark, sf).select("ord", "imidx", "is_pos")


@query(
    """WITH f AS (SELECT imidx, is_pos, imidx % 7 AS bin FROM images),
s AS (SELECT is_pos, bin, count(*) AS n FROM f GROUP BY is_pos, bin),
l AS (SELECT max(bin) AS last, count(*) * 6 - sum(least(n, 6)) AS lack FROM s WHERE NOT is_pos),
r AS (SELECT *, row_number() OVER (PARTITION BY is_pos, bin ORDER BY (imidx * 37) % 101, imidx) AS k FROM f)
SELECT imidx, is_pos, bin FROM r, l WHERE k <= 6 + CASE WHEN NOT is_pos AND bin = last THEN lack ELSE 0 END""",
    "patches images",
)
def per_folder_sample(spark, sf):
    rows = images(spark, sf).select("imidx", "is_pos", (F.col("imidx") % 7).alias("bin")).withColumn("label", F.when(F.col("is_pos"), "positive").otherwise("negative"))
    return I.sample_per_folder(rows, 6, "bin", "label", [(F.col("imidx") * 37) % 101, "imidx"]).select("imidx", "is_pos", "bin")


@query(ORD + " SELECT ord, imidx FROM o WHERE ord % 10 = 0", "patches images")
def seed_every_nth(spark, sf):
    return I.seeds(_ordered(spark, sf), 10).select("ord", "imidx")


@query(
    ORD
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY is_pos ORDER BY ord) - 1 AS pos FROM o)
SELECT ord, imidx, is_pos, CASE WHEN is_pos AND pos % 3 = 1 THEN 'train' WHEN is_pos AND pos % 3 = 2 THEN 'validate'
  WHEN NOT is_pos AND pos >= 1 AND (pos - 1) % 7 = 0 THEN 'train' WHEN NOT is_pos AND pos >= 2 AND (pos - 2) % 7 = 0 THEN 'validate' END AS part FROM p""",
    "patches images",
)
def train_val_rotation(spark, sf):
    return I.rotation(_ordered(spark, sf), 1).select("ord", "imidx", "is_pos", "part")


@query(
    """WITH s AS (SELECT imidx FROM images WHERE imidx % 10 < 3)
SELECT imidx, is_pos, imidx IN (SELECT imidx FROM s) AS is_init FROM images""",
    "patches images",
)
def init_marks(spark, sf):
    im = images(spark, sf)
    return L.marks(im.select("imidx", "is_pos"), im.filter("imidx % 10 < 3"), "imidx", "is_init")


# -- vectors


@query(
    """WITH v AS (SELECT patch_id, [CAST(x AS DOUBLE) for x in feat] AS f FROM patches),
c AS (SELECT patch_id, [x - list_sum(f) / len(f) for x in f] AS c FROM v),
d AS (SELECT patch_id, c, sqrt(list_sum([x * x for x in c]) / len(c)) * len(c) + 1e-15 AS d FROM c),
u AS (SELECT patch_id, unnest(range(1, len(c) + 1)) AS pos, c, d FROM d)
SELECT patch_id, CAST(pos AS INT) AS pos, round(c[pos] / d, 9) + 0.0 AS center FROM u""",
    "patches",
)
def row_standardize(spark, sf):
    return patches(spark, sf).select("patch_id", F.posexplode(V.standardise(V.doubles(F.col("feat")))).alias("pos", "x")).select("patch_id", (F.col("pos") + 1).alias("pos"), _R(F.col("x"), 9).alias("center"))


@query(
    """WITH v AS (SELECT patch_id, imidx, [CAST(x AS DOUBLE) for x in feat] AS f FROM patches)
SELECT a.patch_id AS a, b.patch_id AS b, round(list_sum([(a.f[i] - b.f[i]) * (a.f[i] - b.f[i]) for i in range(1, len(a.f) + 1)]), 6) + 0.0 AS d
FROM v a JOIN v b ON a.imidx = b.imidx AND a.patch_id < b.patch_id""",
    "patches",
)
def l2_pairs(spark, sf):
    return N.pair_distances(patches(spark, sf), ["imidx"], "patch_id", "feat").select("a", "b", _R(F.col("d")).alias("d"))


NN = """WITH v AS (SELECT patch_id, imidx, is_pos, [CAST(x AS DOUBLE) for x in feat] AS f FROM patches),
c AS (SELECT patch_id, imidx, is_pos, [x - list_sum(f) / len(f) for x in f] AS c FROM v),
e AS (SELECT patch_id, imidx, is_pos, [x / (sqrt(list_sum([y * y for y in c]) / len(c)) * len(c) + 1e-15) for x in c] AS f FROM c),
p AS (SELECT a.patch_id, a.imidx AS own, b.imidx, b.patch_id AS target_id, list_sum([(a.f[i] - b.f[i]) * (a.f[i] - b.f[i]) for i in range(1, len(a.f) + 1)]) AS dist
      FROM e a, e b WHERE a.is_pos),
nn AS (SELECT patch_id, own, imidx, dist, target_id FROM (SELECT *, row_number() OVER (PARTITION BY patch_id, imidx ORDER BY dist, target_id) AS k FROM p) WHERE k = 1)"""


def _nearest(spark: Session, sf: str, k: int | None = None) -> DataFrame:
    p = patches(spark, sf)
    return N.nearest_per_image(p.filter("is_pos").select("patch_id", "feat"), p.select(F.col("patch_id").alias("target_id"), "imidx", "feat"), k=k)


def _without_own(spark: Session, sf: str, k: int) -> DataFrame:
    """At least the k nearest images besides the patch's own."""
    own = patches(spark, sf).select("patch_id", F.col("imidx").alias("own"))
    return _nearest(spark, sf, k + 1).join(own, "patch_id").filter("imidx <> own")


@query(NN + " SELECT patch_id, imidx, round(dist, 9) AS dist, target_id FROM nn", "patches")
def nn_per_image(spark, sf):
    return _nearest(spark, sf).select("patch_id", "imidx", _R(F.col("dist"), 9).alias("dist"), "target_id")


TOPN = NN + """, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY patch_id ORDER BY dist, imidx) AS INT) AS nn_rank FROM nn WHERE imidx <> own),
topn AS (SELECT t.*, im.is_pos FROM t JOIN (SELECT DISTINCT imidx, is_pos FROM patches) im USING (imidx) WHERE nn_rank <= 20)"""


@query(TOPN + " SELECT patch_id, nn_rank, imidx, is_pos, round(dist, 9) AS dist FROM topn", "patches")
def topk_neighbors(spark, sf):
    top = N.with_labels(N.top_images(_without_own(spark, sf, 20), 20), images(spark, sf))
    return top.select("patch_id", "nn_rank", "imidx", "is_pos", _R(F.col("dist"), 9).alias("dist"))


@query(
    TOPN + """, q AS (SELECT patch_id, CAST(sum(CAST(is_pos AS INT)) AS BIGINT) AS purity FROM topn GROUP BY patch_id)
SELECT patch_id, purity, CAST(row_number() OVER (ORDER BY purity DESC, patch_id) AS INT) AS rank FROM q""",
    "patches",
)
def cluster_purity_rank(spark, sf):
    return N.purity_rank(N.with_labels(N.top_images(_without_own(spark, sf, 20), 20), images(spark, sf)), 20)


@query(
    """WITH v AS (SELECT patch_id, list_sum([CAST(feat[i] AS DOUBLE) * ((i * 7) % 11 - 5) / 10 for i in range(1, len(feat) + 1)]) - 0.1 AS d FROM patches)
SELECT patch_id, round(d, 6) + 0.0 AS decision, CASE WHEN d > 0 THEN 1 ELSE -1 END AS predicted FROM v""",
    "patches",
)
def linear_decision(spark, sf):
    w = F.transform(F.sequence(F.lit(1), F.size("feat")), lambda i: ((i * 7) % 11 - 5) / 10.0)
    d = patches(spark, sf).select("patch_id", V.decision(V.doubles(F.col("feat")), w, F.lit(0.1)).alias("d"))
    return d.select("patch_id", _R(F.col("d")).alias("decision"), V.predicted(F.col("d")).alias("predicted"))


@query(
    """WITH v AS (SELECT patch_id, is_pos, k, list_sum([CAST(feat[i] AS DOUBLE) * ((i * (k + 3)) % 13 - 6) / 12 for i in range(1, len(feat) + 1)]) AS d FROM patches, range(20) r(k))
SELECT k AS detector, count(*) AS n, round(100 * avg(CASE WHEN (d > 0) = is_pos THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(sum(d), 6) + 0.0 AS total FROM v GROUP BY k""",
    "patches",
)
def composite_decision(spark, sf):
    detectors = spark.range(20).select(F.col("id").alias("detector"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: ((i * (F.col("id") + 3)) % 13 - 6) / 12.0).alias("w"))
    scored = patches(spark, sf).join(F.broadcast(detectors)).select("detector", "is_pos", V.dot(V.doubles(F.col("feat")), F.col("w")).alias("d"))  # 20 rows
    right = F.when((F.col("d") > 0) == F.col("is_pos"), 1.0).otherwise(0.0)
    return scored.groupBy("detector").agg(F.count("*").alias("n"), F.round(100 * F.avg(right), 6).alias("accuracy"), _R(F.sum("d")).alias("total"))


@query(
    """WITH v AS (SELECT patch_id, [CASE WHEN i % 3 = patch_id % 3 THEN CAST(feat[i] AS DOUBLE) ELSE 0 END for i in range(1, len(feat) + 1)] AS f FROM patches)
SELECT patch_id, round(list_sum([x * x for x in f]), 6) + 0.0 AS norm, CAST(len(f) AS INT) AS width FROM v""",
    "patches",
)
def sparse_unpack(spark, sf):
    kept = F.filter(F.sequence(F.lit(1), F.size("feat")), lambda i: i % 3 == F.col("patch_id") % 3)
    sparse = F.map_from_arrays(kept, F.transform(kept, lambda i: F.get("feat", i - 1).cast("double")))
    return patches(spark, sf).select("patch_id", V.dense(sparse, 64).alias("f")).select("patch_id", _R(V.dot(F.col("f"), F.col("f"))).alias("norm"), F.size("f").alias("width"))


# -- filters


@query("SELECT det_id, detector, decision FROM detections WHERE decision >= 50", "detections")
def decision_threshold(spark, sf):
    return detections(spark, sf).filter("decision >= 50").select("det_id", "detector", "decision")


@query("SELECT patch_id, patch_id % 18 AS gradsum FROM patches WHERE patch_id % 18 >= 9", "patches")
def texture_filter(spark, sf):
    return patches(spark, sf).select("patch_id", (F.col("patch_id") % 18).alias("gradsum")).filter("gradsum >= 9")


@query("SELECT det_id, x2 < 160 AND y2 < 160 AS inside, (x2 - x1) = (y2 - y1) AS square FROM detections", "detections")
def in_bounds(spark, sf):
    return detections(spark, sf).select("det_id", ((F.col("x2") < 160) & (F.col("y2") < 160)).alias("inside"), G.is_square(G.box()).alias("square"))


# -- geometry

IOU = """WITH g AS (SELECT a.det_id AS a, b.det_id AS b,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1) AS i,
  (a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) AS sa, (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) AS sb
  FROM detections a JOIN detections b ON a.detector = b.detector AND a.imidx = b.imidx AND a.det_id {op} b.det_id)"""


@query(IOU.format(op="<") + " SELECT a, b, round(i / CAST(sa + sb - i AS DOUBLE), 6) + 0.0 AS iou FROM g", "detections")
def pairwise_iou(spark, sf):
    of = lambda a, b: _R(G.iou(a, b)).alias("iou")
    return S.pairs_of_groups(detections(spark, sf), ["detector", "imidx"], of, ordered=False)


@query(IOU.format(op="<>") + " SELECT a, b, round(i / CAST(sa AS DOUBLE), 6) + 0.0 AS share FROM g", "detections")
def pairwise_overlap_own(spark, sf):
    share = lambda a, b: _R(G.overlap_of_first(a, b)).alias("share")
    return S.pairs_of_groups(detections(spark, sf), ["detector", "imidx"], share)


@query(IOU.format(op="<") + " SELECT CAST(greatest(ceil(i / CAST(sa + sb - i AS DOUBLE) * 10), 1) AS INT) AS bin, count(*) AS n FROM g GROUP BY 1", "detections")
def iou_histogram(spark, sf):
    return S.iou_bins(detections(spark, sf), ["detector", "imidx"])


@query(
    """WITH c AS (SELECT det_id, CAST(det_id % 19 AS INT) AS level, x1 // 8 AS cx, y1 // 8 AS cy, 8.0 * pow(2.0, (det_id % 19) / 8.0) / (400.0 / 160.0) AS u FROM detections)
SELECT det_id, CAST(floor(cx * u) AS INT) AS x1, CAST(floor(cy * u) AS INT) AS y1,
  CAST(floor(cx * u) AS INT) + CAST(round_even(10.0 * u, 0) AS INT) - 1 AS x2, CAST(floor(cy * u) AS INT) + CAST(round_even(10.0 * u, 0) AS INT) - 1 AS y2 FROM c""",
    "detections",
)
def cell_to_box(spark, sf):
    level = (F.col("det_id") % 19).cast("int")
    cell = lambda c: F.floor(F.col(c) / 8)
    canonical = G.canonical_scale(F.lit(160), F.lit(240), 400)
    return detections(spark, sf).select("det_id", G.cell_box(level, cell("y1"), cell("x1"), G.level_scale(level), canonical).alias("b")).select("det_id", "b.*")


@query(
    """SELECT det_id, greatest(least(x1, 239), 0) AS x1, greatest(least(y1, 159), 0) AS y1, greatest(least(x2, 239), 0) AS x2, greatest(least(y2, 159), 0) AS y2,
  greatest(least(y2, 160), 0) AS y2_inclusive FROM detections""",
    "detections",
)
def clip_box(spark, sf):
    b = G.box()
    return detections(spark, sf).select("det_id", G.clip(b, F.lit(240), F.lit(160)).alias("b"), G.clip(b, F.lit(240), F.lit(160), True).alias("c")).select("det_id", "b.*", F.col("c.y2").alias("y2_inclusive"))


@query("SELECT det_id, (x1 * 160 + y1) % 160 AS row, CAST(floor((x1 * 160 + y1) / 160) AS BIGINT) AS col, x1 * 160 + y1 AS idx FROM detections", "detections")
def subscripts(spark, sf):
    d = detections(spark, sf).select("det_id", G.linear_index(F.col("y1"), F.col("x1"), 160).alias("idx"))
    return d.select("det_id", "idx", G.subscripts(F.col("idx"), 160).alias("s")).select("det_id", "s.*", "idx")


@query(
    """SELECT imidx, CAST(least(floor(8 * log2(400 / 80.0)), floor(8 * log2(ceil(ncols * (400.0 / nrows)) / 80.0))) + 1 AS INT) AS levels,
  CAST(ceil(ncols * (400.0 / nrows)) AS BIGINT) AS width FROM images""",
    "patches images",
)
def pyramid_levels(spark, sf):
    width = G.derived_size(F.col("ncols"), G.canonical_scale(F.col("nrows"), F.col("ncols"), 400, smaller_side=False))
    return images(spark, sf).select("imidx", G.pyramid_levels(F.lit(400), width).alias("levels"), width.alias("width"))


@query(
    """WITH n AS (SELECT imidx, CAST(least(floor(8 * log2(400 / 80.0)), floor(8 * log2(ceil(ncols * (400.0 / nrows)) / 80.0))) + 1 AS INT) AS levels FROM images)
SELECT imidx, CAST(k AS INT) AS level, round(pow(2.0, k / 8.0), 6) AS scale FROM (SELECT imidx, unnest(range(levels)) AS k FROM n)""",
    "patches images",
)
def level_scales(spark, sf):
    width = G.derived_size(F.col("ncols"), G.canonical_scale(F.col("nrows"), F.col("ncols"), 400, smaller_side=False))
    levels = images(spark, sf).select("imidx", F.explode(F.sequence(F.lit(0), G.pyramid_levels(F.lit(400), width) - 1)).alias("level"))
    return levels.select("imidx", "level", F.round(G.level_scale(F.col("level")), 6).alias("scale"))


# -- greedy suppression

FOLD = """WITH l AS (SELECT detector, imidx, list({{'i': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'a': (x2 - x1 + 1) * (y2 - y1 + 1)}} ORDER BY decision DESC, det_id) AS b FROM detections GROUP BY detector, imidx),
f AS (SELECT detector, imidx, list_reduce([[x] for x in b], lambda k, x: CASE WHEN len([1 for o in k if {covers}]) > 0 THEN k ELSE list_concat(k, x) END) AS kept FROM l)
SELECT detector, imidx, unnest([x.i for x in kept]) AS det_id FROM f"""
INTER = "greatest(0, least(o.x2, x[1].x2) - greatest(o.x1, x[1].x1) + 1) * greatest(0, least(o.y2, x[1].y2) - greatest(o.y1, x[1].y1) + 1)"


@query(FOLD.format(covers=f"{INTER} / CAST(x[1].a AS DOUBLE) > 0.4"), "detections")
def nms_own_area(spark, sf):
    return S.suppress_own_area(detections(spark, sf), 0.4).select("detector", "imidx", "det_id")


@query(FOLD.format(covers=f"{INTER} / CAST(x[1].a + o.a - {INTER} AS DOUBLE) > 0.1"), "detections")
def clean_overlap_iou(spark, sf):
    return S.suppress_iou(detections(spark, sf), 0.1).select("detector", "imidx", "det_id")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY detector, imidx ORDER BY decision DESC, det_id) AS k FROM detections),
g AS (SELECT detector, imidx, 0 AS k, CAST([] AS STRUCT(i BIGINT, x1 INT, y1 INT, x2 INT, y2 INT)[]) AS kept FROM (SELECT DISTINCT detector, imidx FROM r)
  UNION ALL
  SELECT detector, imidx, k, CASE WHEN 10 * coalesce(list_sum([(xs[i + 1] - xs[i]) * coalesce(list_sum([CASE WHEN len([1 for c in cut if c.x1 <= xs[i] AND c.x2 > xs[i] AND c.y1 <= ys[j] AND c.y2 > ys[j]]) > 0 THEN ys[j + 1] - ys[j] ELSE 0 END for j in range(1, len(ys))]), 0) for i in range(1, len(xs))]), 0)
    > 6 * (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) THEN kept ELSE list_append(kept, b) END
  FROM (SELECT *, list_sort(list_distinct(flatten([[c.x1, c.x2] for c in cut]))) AS xs, list_sort(list_distinct(flatten([[c.y1, c.y2] for c in cut]))) AS ys
    FROM (SELECT g.detector, g.imidx, r.k, g.kept, {'i': r.det_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2} AS b,
        [{'x1': greatest(q.x1, r.x1), 'y1': greatest(q.y1, r.y1), 'x2': least(q.x2, r.x2) + 1, 'y2': least(q.y2, r.y2) + 1} for q in g.kept if q.x1 <= r.x2 AND q.x2 >= r.x1 AND q.y1 <= r.y2 AND q.y2 >= r.y1] AS cut
      FROM g JOIN r ON g.detector = r.detector AND g.imidx = r.imidx AND r.k = g.k + 1)))
SELECT detector, imidx, b.i AS det_id FROM (SELECT detector, imidx, unnest(kept) AS b FROM g JOIN (SELECT detector, imidx, max(k) AS k FROM r GROUP BY ALL) USING (detector, imidx, k))""",
    "detections",
)
def clean_by_coverage(spark, sf):
    return S.clean_coverage(detections(spark, sf), 0.6).select("detector", "imidx", "det_id")


# -- ranking

BEST = """WITH w AS (SELECT *, row_number() OVER (PARTITION BY detector, imidx ORDER BY decision DESC, det_id) AS k FROM detections),
best AS (SELECT * EXCLUDE k FROM w WHERE k = 1)"""
TOP = BEST + """, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY detector ORDER BY decision DESC, det_id) AS INT) AS rank FROM best)"""


@query(BEST + " SELECT detector, imidx, det_id, decision FROM best", "detections")
def best_per_image_detector(spark, sf):
    return R.best_per_image(detections(spark, sf)).select("detector", "imidx", "det_id", "decision")


@query(TOP + " SELECT detector, rank, imidx, det_id, decision FROM r WHERE rank <= 20", "detections")
def topn_per_detector(spark, sf):
    return R.top_n(detections(spark, sf), 20).select("detector", "rank", "imidx", "det_id", "decision")


@query(
    """WITH pt AS (SELECT *, CASE WHEN imidx < 50 AND imidx % 3 = 0 THEN 'train' WHEN imidx % 3 = 1 THEN 'validate' END AS part FROM detections),
s AS (SELECT 'train' AS part_set, 20 AS n, * FROM pt WHERE part = 'train' UNION ALL SELECT 'validate', 20, * FROM pt WHERE part = 'validate' AND imidx < 50 UNION ALL SELECT 'all', 100, * FROM pt WHERE part = 'validate'),
w AS (SELECT *, row_number() OVER (PARTITION BY part_set, detector, imidx ORDER BY decision DESC, det_id) AS k FROM s),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY part_set, detector ORDER BY decision DESC, det_id) AS INT) AS rank FROM w WHERE k = 1)
SELECT part_set, detector, rank, det_id FROM r WHERE rank <= n""",
    "detections",
)
def topn_train_val_all(spark, sf):
    d = detections(spark, sf)
    ids = spark.range(100).select(F.col("id").cast("int").alias("imidx"))
    train, validate = ids.filter("imidx < 50 AND imidx % 3 = 0"), ids.filter("imidx % 3 = 1")
    sets = {"train": (L.semi(d, train, "imidx"), 20), "validate": (L.semi(d, validate.filter("imidx < 50"), "imidx"), 20), "all": (L.semi(d, validate, "imidx"), 100)}
    out = [R.top_n(rows, n).select(F.lit(name).alias("part_set"), "detector", "rank", "det_id") for name, (rows, n) in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT detector, imidx, count(*) AS votes FROM detections GROUP BY detector, imidx HAVING count(*) > 2", "detections")
def vote_filter(spark, sf):
    return R.at_least(detections(spark, sf), ["detector", "imidx"], 2)


@query("SELECT det_id, CASE WHEN row_number() OVER (PARTITION BY detector ORDER BY decision DESC, det_id) <= 5 THEN detector ELSE -1 END AS cluster_id FROM detections", "detections")
def assign_train_top(spark, sf):
    return R.assign_top(detections(spark, sf), 5).select("det_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


@query(TOP + " SELECT detector, rank, det_id FROM r WHERE rank <= 10 OR (rank BETWEEN 15 AND 100 AND (rank - 15) % 7 = 0)", "detections")
def rank_sampling(spark, sf):
    return R.sampled_ranks(R.top_n(detections(spark, sf), 100)).select("detector", "rank", "det_id")


@query("SELECT detector, det_id, CAST(row_number() OVER (PARTITION BY detector ORDER BY decision DESC, det_id) AS INT) AS \"order\" FROM detections", "detections")
def argsort_desc(spark, sf):
    return R.argsort_desc(detections(spark, sf), ["detector"], "decision", "det_id").select("detector", "det_id", "order")


@query("SELECT detector, det_id FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY decision DESC, det_id) AS k FROM detections) WHERE k <= 5", "detections")
def best_five(spark, sf):
    return R.top(detections(spark, sf), ["detector"], R.by_score(), 5).select("detector", "det_id")


# -- detections as rows


@query("SELECT imidx, detector, det_id, decision, x1, y1, x2, y2 FROM detections", "detections")
def detections_flat(spark, sf):
    d = detections(spark, sf)
    nested = d.groupBy("imidx", "detector").agg(F.collect_list(F.struct("det_id", "decision", G.box().alias("pos"))).alias("dets"))
    return nested.select("imidx", "detector", F.inline("dets")).select("imidx", "detector", "det_id", "decision", "pos.*")


@query("SELECT detector, count(*) AS n, CAST(sum(x1 + y1 + x2 + y2 + 4) AS BIGINT) AS checksum FROM detections GROUP BY detector", "detections")
def detection_totals(spark, sf):
    return detections(spark, sf).groupBy("detector").agg(F.count("*").alias("n"), F.sum(F.expr("x1 + y1 + x2 + y2 + 4")).alias("checksum"))


@query(
    """WITH w AS (SELECT d, i FROM range(20) a(d), range(110) b(i))
SELECT CAST(w.d AS INT) AS detector, CAST(w.i AS INT) AS imidx, CAST(count(det_id) AS INT) AS n, max(decision) AS best FROM w LEFT JOIN detections ON detector = w.d AND imidx = w.i GROUP BY w.d, w.i""",
    "detections",
)
def lookup_or_empty(spark, sf):
    wanted = spark.range(20 * 110).select((F.col("id") % 20).cast("int").alias("detector"), F.floor(F.col("id") / 20).cast("int").alias("imidx"))
    got = L.lookup(wanted, detections(spark, sf), ["detector", "imidx"], ["decision"], ["det_id"])
    return got.select("detector", "imidx", F.size("found").alias("n"), F.array_max(F.col("found.decision")).alias("best"))


# -- counts


@query(
    """SELECT im.imidx, im.is_pos, count(d.det_id) AS n, count(DISTINCT d.detector) AS detectors FROM images im LEFT JOIN detections d ON d.imidx = im.imidx AND d.decision > 60
GROUP BY im.imidx, im.is_pos""",
    "patches images detections",
)
def counts_over_thresh(spark, sf):
    hits = detections(spark, sf).filter("decision > 60").select("imidx", "det_id", "detector")
    return images(spark, sf).join(hits, "imidx", "left").groupBy("imidx", "is_pos").agg(F.count("det_id").alias("n"), F.countDistinct("detector").alias("detectors"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY decision DESC, det_id) AS k FROM detections)
SELECT detector, CAST(sum(CASE WHEN imidx < 50 THEN 1 ELSE 0 END) AS BIGINT) AS pos, CAST(sum(CASE WHEN imidx < 50 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM r WHERE k <= 30 GROUP BY detector""",
    "detections",
)
def overall_counts(spark, sf):
    pos = F.sum(F.when(F.col("imidx") < 50, 1).otherwise(0))
    return R.top(detections(spark, sf), ["detector"], R.by_score(), 30).groupBy("detector").agg(pos.alias("pos"), (F.count("*") - pos).alias("neg"))


@query(
    """WITH c AS (SELECT detector, CAST(sum(CASE WHEN decision > 60 AND imidx < 50 THEN 1 ELSE 0 END) AS BIGINT) AS pos, CAST(sum(CASE WHEN decision > 60 AND imidx >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM detections GROUP BY detector),
p AS (SELECT *, (pos + 1) / CAST(pos + neg + 2 AS DOUBLE) AS posterior FROM c)
SELECT detector, pos, neg, round(posterior, 6) AS posterior, CAST(row_number() OVER (ORDER BY posterior DESC, detector) AS INT) AS rank FROM p""",
    "detections",
)
def posterior_rank(spark, sf):
    over = F.col("decision") > 60
    c = detections(spark, sf).groupBy("detector").agg(F.sum(F.when(over & (F.col("imidx") < 50), 1).otherwise(0)).alias("pos"), F.sum(F.when(over & (F.col("imidx") >= 50), 1).otherwise(0)).alias("neg"))
    c = c.withColumn("posterior", L.laplace(F.col("pos"), F.col("neg")))  # a row per detector from here on
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.col("posterior").desc(), "detector"))).withColumn("posterior", F.round("posterior", 6))


@query("SELECT d.detector, coalesce(min(k.decision), -1) AS least FROM (SELECT DISTINCT detector FROM detections) d LEFT JOIN detections k ON k.detector = d.detector AND k.decision > 99 GROUP BY d.detector", "detections")
def least_kept_score(spark, sf):
    d = detections(spark, sf)
    return d.select("detector").distinct().join(d.filter("decision > 99").groupBy("detector").agg(F.min("decision").alias("least")), "detector", "left").select("detector", F.coalesce("least", F.lit(-1.0)).alias("least"))


@query("SELECT DISTINCT imidx FROM detections WHERE decision > 90", "detections")
def distinct_images(spark, sf):
    return detections(spark, sf).filter("decision > 90").select("imidx").distinct()


# -- duplicates and overlap between detectors

OVER = TOP + """, t AS (SELECT * FROM r WHERE rank <= 50),
p AS (SELECT a.detector AS a, b.detector AS b, b.det_id AS d,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1) AS i,
  (a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) AS s FROM t a JOIN t b ON a.imidx = b.imidx AND a.detector < b.detector),
o AS (SELECT a, b, d, i / CAST(s - i AS DOUBLE) AS iou FROM p)"""
DUP = OVER + """, m AS (SELECT a, b, d, max(iou) AS iou FROM o GROUP BY a, b, d),
h AS (SELECT a, b, CAST(sum(CASE WHEN greatest(ceil(iou * 10), 1) >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM m GROUP BY a, b),
z AS (SELECT detector AS b, count(*) AS boxes FROM t GROUP BY detector),
dup AS (SELECT a, b, hits, boxes, hits > 0.1 * boxes AS duplicate FROM h JOIN z USING (b))"""


def _top50(spark: Session, sf: str) -> DataFrame:
    return R.top_n(detections(spark, sf), 50).drop("rank")


@query(DUP + " SELECT * FROM dup", "detections")
def duplicate_cluster_pairs(spark, sf):
    return C.duplicate_pairs(_top50(spark, sf)).select("a", "b", "hits", "boxes", "duplicate")


@query(OVER + " SELECT a, b, count(DISTINCT d) AS n FROM o WHERE iou > 0.3 GROUP BY a, b", "detections")
def detector_overlap_matrix(spark, sf):
    return C.overlap_counts(_top50(spark, sf))


def _greedy_sql(pairs: str) -> str:
    """A recursive walk over the detectors in order, with the list of those accepted so far."""
    return f"""{pairs}, n AS (SELECT DISTINCT detector AS id FROM detections),
g AS (SELECT 0 AS k, CAST([] AS INT[]) AS ok UNION ALL
  SELECT k + 1, CASE WHEN EXISTS (SELECT 1 FROM n WHERE id = k) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.b = k AND list_contains(g.ok, bad.a)) THEN list_append(g.ok, k) ELSE g.ok END FROM g WHERE k < 20)
SELECT unnest(ok) AS detector FROM g WHERE k = 20"""


def _accepted(spark: Session, sf: str, conflicts: DataFrame) -> DataFrame:
    ranks = detections(spark, sf).select("detector").distinct().withColumn("rank", F.col("detector"))
    return C.accept_in_order(ranks, conflicts).select("detector")


@query(_greedy_sql(DUP + ", bad AS (SELECT a, b FROM dup WHERE duplicate)"), "detections")
def accept_clusters(spark, sf):
    return _accepted(spark, sf, C.duplicate_pairs(_top50(spark, sf)).filter("duplicate"))


@query(_greedy_sql(OVER + ", bad AS (SELECT a, b FROM o WHERE iou > 0.3 GROUP BY a, b HAVING count(DISTINCT d) > 5)"), "detections")
def non_overlapping_detectors(spark, sf):
    return _accepted(spark, sf, C.overlap_counts(_top50(spark, sf)).filter("n > 5"))


for _name in ("accept_clusters", "non_overlapping_detectors", "clean_by_coverage"):
    ORACLES[_name] = ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1)


# -- set operations

HIGH, LOW = "SELECT DISTINCT imidx FROM detections WHERE decision > 95", "SELECT DISTINCT imidx FROM detections WHERE decision < 5"


def _sides(spark: Session, sf: str) -> tuple[DataFrame, DataFrame]:
    d = detections(spark, sf)
    return d.filter("decision > 95").select("imidx").distinct(), d.filter("decision < 5").select("imidx").distinct()


@query(f"{HIGH} INTERSECT {LOW}", "detections")
def intersect_ids(spark, sf):
    a, b = _sides(spark, sf)
    return a.intersect(b)


@query(f"{HIGH} EXCEPT {LOW}", "detections")
def except_ids(spark, sf):
    a, b = _sides(spark, sf)
    return a.subtract(b)


@query(f"{HIGH} UNION ALL {LOW}", "detections")
def union_rows(spark, sf):
    a, b = _sides(spark, sf)
    return a.unionByName(b)


@query(f"SELECT det_id, imidx FROM detections WHERE imidx IN ({HIGH})", "detections")
def semi_clusters(spark, sf):
    return L.semi(detections(spark, sf), _sides(spark, sf)[0], "imidx").select("det_id", "imidx")


@query(f"SELECT det_id, imidx FROM detections WHERE imidx NOT IN ({HIGH})", "detections")
def anti_clusters(spark, sf):
    return L.anti(detections(spark, sf), _sides(spark, sf)[0], "imidx").select("det_id", "imidx")


@query("SELECT DISTINCT d.detector, CAST((d.detector * 7) % 20 AS INT) AS position FROM detections d WHERE d.decision > 50 AND d.detector % 2 = 0", "detections")
def member_positions(spark, sf):
    d = detections(spark, sf)
    b = d.filter("detector % 2 = 0").select("detector", ((F.col("detector") * 7) % 20).cast("int").alias("position")).distinct()
    return L.member_positions(d.filter("decision > 50"), b, "detector", "position")


@query("SELECT detector, CAST(det_id % 3 AS INT) AS round, count(*) AS n, min(det_id) AS first FROM detections GROUP BY detector, det_id % 3", "detections")
def collate_rounds(spark, sf):
    d = detections(spark, sf)
    parts = [d.filter(f"det_id % 3 = {r}").groupBy("detector").agg(F.lit(r).alias("round"), F.count("*").alias("n"), F.min("det_id").alias("first")) for r in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- sampling

CDF = """WITH p AS (SELECT detector, imidx, count(*) AS w FROM detections GROUP BY detector, imidx),
c AS (SELECT *, sum(w) OVER (PARTITION BY detector ORDER BY imidx) / CAST(sum(w) OVER (PARTITION BY detector) AS DOUBLE) AS share FROM p)"""


def _shares(spark: Session, sf: str) -> DataFrame:
    w = detections(spark, sf).groupBy("detector", "imidx").agg(F.count("*").alias("w"))
    return L.running_share(w, ["detector"], ["imidx"], "w")


@query(CDF + " SELECT detector, imidx, round(share, 6) AS share FROM c", "detections")
def cumulative_pdf(spark, sf):
    return _shares(spark, sf).select("detector", "imidx", F.round("share", 6).alias("share"))


@query(CDF + ", u AS (SELECT i AS draw, (i * 37 % 101) / 101.0 AS u FROM range(50) r(i)) SELECT detector, draw, min(imidx) AS imidx FROM c, u WHERE share >= u GROUP BY detector, draw", "detections")
def inverse_cdf_lookup(spark, sf):
    ids = detections(spark, sf).select("detector").distinct()
    draws = ids.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(49)))).select("detector", F.col("draw").cast("long").alias("draw"), ((F.col("draw") * 37 % 101) / 101.0).alias("u"))
    return L.invert_share(draws, _shares(spark, sf), ["detector"], "u", "share", "imidx").select("detector", "draw", "imidx")


# -- mining


@query(
    """WITH m AS (SELECT detector, least(count(*) FILTER (decision >= 60), 3 * count(*) FILTER (decision >= 90)) AS most FROM detections GROUP BY detector),
r AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY decision DESC, det_id) AS k FROM detections WHERE decision >= 60)
SELECT detector, CAST(k AS INT) AS rank, det_id FROM r JOIN m USING (detector) WHERE k <= most""",
    "detections",
)
def cull_negatives(spark, sf):
    return M.cull_negatives(detections(spark, sf), at=60, near=90).select("detector", "rank", "det_id")


@query(
    """WITH b AS (SELECT i, CAST(floor(15 * pow(2.0, 0.71 * i)) AS BIGINT) AS images FROM range(40) r(i)),
s AS (SELECT i, CAST(sum(images) OVER (ORDER BY i) AS BIGINT) - images AS start FROM b),
n AS (SELECT imidx, row_number() OVER (ORDER BY imidx) - 1 AS place FROM images WHERE NOT is_pos)
SELECT imidx, CAST(max(i) AS INT) AS step FROM n JOIN s ON start <= place GROUP BY imidx""",
    "patches images",
)
def mining_schedule(spark, sf):
    return R.growing_batches(images(spark, sf).filter("NOT is_pos"), [F.col("imidx").asc()], 15, 0.71).select("imidx", "step")


def _models(spark: Session, sf: str) -> DataFrame:
    p = patches(spark, sf)
    return M.fit_clusters(p.filter("is_pos").select(F.col("imidx").cast("long").alias("cluster_id"), "feat"), p.filter("NOT is_pos").select("feat"))


@query()
def svm_fit(spark, sf):
    return _models(spark, sf).select("cluster_id", _R(F.col("rho")).alias("rho"), F.size("w").alias("width"), "n_pos", "n_neg")


@query()
def hard_negative_round(spark, sf):
    from lodemine.sources.rounds import settle

    p = patches(spark, sf)
    models = settle(_models(spark, sf))
    hard = M.score(p.filter("NOT is_pos"), models, -1.02).join(p.select(F.col("patch_id").alias("det_id"), "feat"), "det_id")
    mined = M.cull_negatives(hard).select(F.col("detector").alias("cluster_id"), "feat")
    again = M.fit_clusters(p.filter("is_pos").select(F.col("imidx").cast("long").alias("cluster_id"), "feat"), p.filter("NOT is_pos").select("feat"), mined)
    return again.select("cluster_id", _R(F.col("rho")).alias("rho"), "n_pos", "n_neg")


# -- report and strings


@query(
    TOP + """, c AS (SELECT detector, CAST(sum(CASE WHEN imidx < 50 THEN 1 ELSE 0 END) AS BIGINT) AS pos, CAST(sum(CASE WHEN imidx < 50 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM r WHERE rank <= 20 GROUP BY detector),
h AS (SELECT detector, string_agg('<td><img src="' || det_id || '.jpg" title="' || CAST(floor(decision * 1000) AS BIGINT) || '"/></td>', '' ORDER BY rank) AS cells FROM r WHERE rank <= 20 GROUP BY detector)
SELECT detector, '<tr><td>' || detector || '<br/>positive: ' || pos || ' other: ' || neg || '</td>' || cells || '</tr>' AS html FROM h JOIN c USING (detector)""",
    "detections",
)
def report_rows_html(spark, sf):
    from lodemine.plans.report import rows_html

    return rows_html(R.top_n(detections(spark, sf), 20), F.col("imidx") < 50)


@query(r"""SELECT event_id, CAST(regexp_extract_all(props, '(\d+)', 1)[1] AS BIGINT) AS first, CAST(len(regexp_extract_all(props, '\d+')) AS INT) AS n FROM events""")
def digits_parse(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", X.digits(F.col("props")).alias("d")).select("event_id", F.get("d", F.lit(0)).alias("first"), F.size("d").alias("n"))


@query(
    r"""WITH t AS (SELECT user_id, 'perm ' || user_id || ' inds ' || string_agg(CAST(event_id % 50 AS VARCHAR), ' ' ORDER BY event_id) AS line FROM events GROUP BY user_id)
SELECT user_id, CAST(split_part(split_part(line, ' inds ', 1), ' ', 2) AS BIGINT) AS key, CAST(len(string_split(split_part(line, ' inds ', 2), ' ')) AS INT) AS n,
  CAST(list_sum([CAST(x AS BIGINT) for x in string_split(split_part(line, ' inds ', 2), ' ')]) AS BIGINT) AS total FROM t"""
)
def permutation_parse(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    lines = e.groupBy("user_id").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("event_id")), lambda x: (x % 50).cast("string"))).alias("p"))
    lines = lines.select("user_id", F.concat(F.lit("perm "), "user_id", F.lit(" inds "), "p").alias("line"))
    parts = lines.select("user_id", X.permutation(F.col("line")).alias("p"))
    return parts.select("user_id", "p.key", F.size("p.values").alias("n"), X.checksum(F.col("p.values")).alias("total"))


@query("""WITH n AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '.jpg' WHEN 1 THEN event_type || '.JPG' ELSE event_type END AS f FROM events)
SELECT event_id, CASE WHEN lower(f) LIKE '%.jpg' THEN f ELSE f || '.jpg' END AS name FROM n""")
def path_suffix(spark, sf):
    k = F.col("event_id") % 3
    name = F.when(k == 0, F.concat("event_type", F.lit(".jpg"))).when(k == 1, F.concat("event_type", F.lit(".JPG"))).otherwise(F.col("event_type"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", X.with_suffix(name).alias("name"))


@query("SELECT event_id, replace('ds.' || event_type || '.' || user_id, '.', '/') AS path FROM events")
def dotted_path(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", X.dotted_path(F.concat(F.lit("ds."), "event_type", F.lit("."), "user_id")).alias("path"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def struct_unpack(spark, sf):
    return unpack(spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.from_json("props", "k long").alias("s")), "s")


# -- image kernels, on rasters drawn from the patches' vectors


def _pictures(spark: Session, sf: str) -> DataFrame:
    """A picture for each image, its brightness being the vector of the image's first patch."""
    from lodemine.operators.rasters import synthetic_images

    fields = patches(spark, sf).groupBy("imidx").agg(F.min_by("feat", "patch_id").alias("field"))
    return synthetic_images(spark, images(spark, sf).select("imidx", "is_pos").join(fields, "imidx"))


@query()
def feature_pyramid(spark, sf):
    from lodemine.operators.rasters import pyramid_stats

    return pyramid_stats(_pictures(spark, sf)).withColumn("gradient", F.round("gradient", 4))


@query()
def weighted_patches(spark, sf):
    from lodemine.operators.rasters import sample_patches

    got = sample_patches(_pictures(spark, sf))
    return got.select("imidx", "level", "cy", "cx", "x1", "y1", "x2", "y2", F.round("probability", 9).alias("probability"), F.size("feat").alias("width"))


@query()
def detect_in_images(spark, sf):
    from lodemine.config import DetectionParams
    from lodemine.operators.rasters import detect, sample_patches

    im = _pictures(spark, sf)
    seeds = sample_patches(im)
    models = M.fit_clusters(seeds.select(F.col("imidx").cast("long").alias("cluster_id"), "feat"), sample_patches(im.filter("NOT is_pos")).select("feat"))
    found = detect(im, models, detection=DetectionParams(threshold=-0.9))
    return found.select("detector", "imidx", "level", "x1", "y1", "x2", "y2", F.round("decision", 6).alias("decision"))


# -- further operators on the views


@query(
    """WITH p AS (SELECT event_id, (event_id * 7) % 256 / 255.0 AS r, (event_id * 31) % 256 / 255.0 AS g, (event_id * 101) % 256 / 255.0 AS b FROM events),
t AS (SELECT event_id, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS x, 0.212671 * r + 0.715160 * g + 0.072169 * b AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS z FROM p),
f AS (SELECT event_id, y, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16 / 116.0 END AS fx, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16 / 116.0 END AS fy, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16 / 116.0 END AS fz FROM t)
SELECT event_id, round(CASE WHEN y > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * y END, 5) + 0.0 AS l, round(500 * (fx - fy), 5) + 0.0 AS a, round(200 * (fy - fz), 5) + 0.0 AS b FROM f"""
)
def lab_pixels(spark, sf):
    from lodemine.functions.color import lab

    part = lambda k: (F.col("event_id") * k) % 256 / 255.0
    got = spark.read.parquet(f"{sf}/events.parquet").select("event_id", lab(part(7), part(31), part(101)).alias("c"))
    return got.select("event_id", _R(F.col("c.L"), 5).alias("l"), _R(F.col("c.a"), 5).alias("a"), _R(F.col("c.b"), 5).alias("b"))


@query("SELECT DISTINCT d.detector, CAST(r.k - 1 AS INT) AS position FROM detections d JOIN (SELECT detector, row_number() OVER (ORDER BY detector) AS k FROM (SELECT DISTINCT detector FROM detections)) r USING (detector)", "detections")
def detector_id_map(spark, sf):
    ids = detections(spark, sf).select("detector").distinct()  # a row per detector
    return ids.withColumn("position", (F.row_number().over(Window.orderBy("detector")) - 1).cast("int"))


@query("SELECT imidx, CAST(count(*) AS INT) AS n, max(decision) AS best, min(det_id) AS first FROM detections GROUP BY imidx", "detections")
def regroup_by_image(spark, sf):
    d = detections(spark, sf)
    got = L.lookup(d.select("imidx").distinct(), d, ["imidx"], ["detector", "decision"], ["det_id"])
    return got.select("imidx", F.size("found").alias("n"), F.array_max("found.decision").alias("best"), F.get("found", F.lit(0)).getField("det_id").alias("first"))


@query(
    """WITH a AS (SELECT detector, CAST(detector % 4 AS INT) AS age, count(*) FILTER (decision > 90) AS votes FROM detections GROUP BY detector)
SELECT detector, CASE WHEN votes <= 2 THEN 'dropped' WHEN age >= 2 THEN 'finished' ELSE 'active' END AS state, CASE WHEN votes > 2 AND age < 2 THEN age + 1 END IS NOT NULL AS goes_on FROM a""",
    "detections",
)
def retire_clusters(spark, sf):
    d = detections(spark, sf)
    ages = d.select("detector", (F.col("detector") % 4).alias("age")).distinct()
    voted = R.at_least(d.filter("decision > 90"), ["detector"], 2)
    kept, gone = L.semi(ages, voted, "detector"), L.anti(ages, voted, "detector")
    state = F.when(F.col("age") >= 2, "finished").otherwise("active")
    return kept.select("detector", state.alias("state"), (F.col("age") < 2).alias("goes_on")).unionByName(gone.select("detector", F.lit("dropped").alias("state"), F.lit(False).alias("goes_on")))


@query("SELECT imidx FROM images WHERE NOT is_pos AND imidx IN (SELECT imidx FROM detections WHERE decision > 50)", "patches images detections")
def train_negative_mask(spark, sf):
    return L.semi(images(spark, sf).filter("NOT is_pos"), detections(spark, sf).filter("decision > 50"), "imidx").select("imidx")


@query(TOP + " SELECT detector, det_id FROM r WHERE rank <= 5 AND imidx >= 0", "detections")
def first_valid(spark, sf):
    return R.top_n(detections(spark, sf).filter("imidx IS NOT NULL"), 5).select("detector", "det_id")


@query(_greedy_sql(OVER + ", bad AS (SELECT a, b FROM o WHERE iou > 0.3 GROUP BY a, b HAVING count(DISTINCT d) > 5)").replace("SELECT unnest(ok) AS detector FROM g WHERE k = 20", "SELECT unnest(ok[1:5]) AS detector FROM g WHERE k = 20"), "detections")
def report_cap(spark, sf):
    ranks = detections(spark, sf).select("detector").distinct().withColumn("rank", F.col("detector"))
    return C.accept_in_order(ranks, C.overlap_counts(_top50(spark, sf)).filter("n > 5"), most=5).select("detector")


ORACLES["report_cap"] = ORACLES["report_cap"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("SELECT is_pos, count(*) AS n, round(avg(CASE WHEN list_sum([CAST(x AS DOUBLE) for x in feat]) > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy FROM patches GROUP BY is_pos", "patches")
def accuracy_by_label(spark, sf):
    hit = F.when(V.total(V.doubles(F.col("feat"))) > 0, 1.0).otherwise(0.0)
    return patches(spark, sf).groupBy("is_pos").agg(F.count("*").alias("n"), F.round(F.avg(hit) * 100, 6).alias("accuracy"))


@query(
    """SELECT imidx, CAST(ceil(nrows * (400.0 / least(nrows, ncols))) AS BIGINT) AS rows_exact, CAST(ceil(ncols * (400.0 / least(nrows, ncols))) AS BIGINT) AS cols_exact,
  round(400.0 / nrows, 6) AS scale_fast FROM images""",
    "patches images",
)
def canonical_sizes(spark, sf):
    rows, cols = F.col("nrows"), F.col("ncols")
    exact = G.canonical_scale(rows, cols, 400)
    return images(spark, sf).select("imidx", G.derived_size(rows, exact).alias("rows_exact"), G.derived_size(cols, exact).alias("cols_exact"), F.round(G.canonical_scale(rows, cols, 400, False), 6).alias("scale_fast"))


@query()
def nearest_windows(spark, sf):
    from lodemine.operators.rasters import nearest_in_images, sample_patches

    im = _pictures(spark, sf)
    centers = sample_patches(im.filter("is_pos")).select("patch_id", "feat")
    return nearest_in_images(im, centers).select("patch_id", "imidx", F.round("dist", 9).alias("dist"), "level", "cy", "cx")


@query()
def patch_crops(spark, sf):
    from lodemine.operators.rasters import crop_patches, sample_patches

    im = _pictures(spark, sf)
    boxes = sample_patches(im).select("patch_id", "imidx", "x1", "y1", "x2", "y2")
    return crop_patches(boxes, im).select("patch_id", "imidx", F.length("png").alias("bytes"), F.sha2("png", 256).alias("sha256"))
