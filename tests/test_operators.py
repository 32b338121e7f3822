import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemine.functions import geometry as G
from lodemine.operators import clusters as C
from lodemine.operators import suppress as S
from lodemine.operators import neighbours as N
from lodemine.operators.neighbours import nearest_per_image, standardise_rows


def boxes(spark, rows):
    return spark.createDataFrame(rows, "det_id long, detector int, imidx int, decision double, x1 int, y1 int, x2 int, y2 int")


def random_boxes(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.integers(0, 60), rng.integers(0, 60), rng.integers(5, 40), rng.integers(5, 40)
        out.append((i, int(rng.integers(0, 3)), int(rng.integers(0, 4)), float(rng.integers(0, 20)), int(x), int(y), int(x + w), int(y + h)))
    return out


def inter(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]) + 1, min(a[7], b[7]) - max(a[5], b[5]) + 1
    return w * h if w > 0 and h > 0 else 0


def size(a):
    return (a[6] - a[4] + 1) * (a[7] - a[5] + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_suppression_matches_pick_and_delete(spark, seed):
    rows = random_boxes(120, seed)
    for op, covers in ((lambda d: S.suppress_own_area(d, 0.4), lambda k, b: inter(k, b) / size(b) > 0.4), (lambda d: S.suppress_iou(d, 0.2), lambda k, b: inter(k, b) / (size(k) + size(b) - inter(k, b)) > 0.2)):
        left, kept = sorted(rows, key=lambda r: (-r[3], r[0])), set()
        while left:
            best = left.pop(0)
            kept.add(best[0])
            left = [b for b in left if (b[1], b[2]) != (best[1], best[2]) or not covers(best, b)]
        got = op(boxes(spark, rows))
        assert {r.det_id for r in got.collect()} == kept
    assert op(boxes(spark, [])).count() == 0


def test_overlap_edge_cases(spark):
    rows = [((0, 0, 9, 9), (0, 0, 9, 9), 1.0), ((0, 0, 9, 9), (9, 9, 18, 18), 1 / 199), ((0, 0, 9, 9), (10, 0, 19, 9), 0.0), ((0, 0, 9, 9), (2, 2, 3, 3), 0.04)]
    for a, b, want in rows:
        lit = lambda t: F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), t)])
        assert spark.range(1).select(G.iou(lit(a), lit(b))).first()[0] == pytest.approx(want)


def test_nearest_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 6)), rng.normal(size=(70, 6))
    image = [int(i % 7) for i in range(70)]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "patch_id long, feat array<double>")
    t = spark.createDataFrame([(i, image[i], v.tolist()) for i, v in enumerate(y)], "target_id long, imidx int, feat array<double>")
    got = {(r.patch_id, r.imidx): r.target_id for r in nearest_per_image(c, t, 8, 16).collect()}
    d = ((standardise_rows(x)[:, None] - standardise_rows(y)[None]) ** 2).sum(2)
    for i in range(30):
        for k in range(7):
            own = [j for j in range(70) if image[j] == k]
            assert got[i, k] == min(own, key=lambda j: (d[i, j], j))
    assert nearest_per_image(c, t.limit(0)).count() == 0


def _clustered(spark, n, images, rng, dims=12, groups=6):
    at = rng.normal(size=(groups, dims)) * 40
    home = rng.integers(0, groups, images)  # an image has targets of two groups
    image = rng.integers(0, images, n)
    of = np.where(rng.random(n) < 0.5, home[image], (home[image] + 1) % groups)
    y = at[of] + rng.normal(size=(n, dims))
    return at, y, image, spark.createDataFrame([(i, int(k), v.tolist(), "x") for i, (k, v) in enumerate(zip(image, y))], "target_id long, imidx int, feat array<double>, dist string")


@pytest.mark.parametrize("k", [None, 3])
def test_pivots_rule_out_blocks_and_lose_nothing(spark, k):
    rng = np.random.default_rng(8)
    at, y, image, t = _clustered(spark, 4000, 20, rng)
    x = at[rng.integers(0, len(at), 150)] + rng.normal(size=(150, at.shape[1]))
    c = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "patch_id long, feat array<double>, imidx int")
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    rows = nearest_per_image(c, t, 16, 500, standardise=False, k=k, counts=counts).collect()
    d = ((x[:, None] - y[None]) ** 2).sum(2)
    want = []
    for i in range(len(x)):
        own = sorted((min((d[i, j], j) for j in np.flatnonzero(image == m)), m) for m in range(20))
        want += [(i, m, j) for (_, j), m in sorted(own, key=lambda o: (o[0][0], o[1]))[:k]]
    assert sorted((r.patch_id, r.imidx, r.target_id) for r in rows) == sorted(want)
    assert all(r.dist == pytest.approx(d[r.patch_id, r.target_id], abs=1e-9) for r in rows)
    looked, multiplied = counts[0].value, counts[1].value
    assert looked == 150 * 4000 and multiplied < (0.3 if k else 0.6) * looked, (looked, multiplied)


def test_whole_blocks_are_skipped():
    rng = np.random.default_rng(4)
    pivots = np.array([[0.0, 0.0], [100.0, 0.0]])
    near, far = rng.normal(size=(600, 2)), rng.normal(size=(600, 2)) + pivots[1]
    c = N.Centres.of(np.arange(300), rng.normal(size=(300, 2)), pivots)
    best, at = np.full(300, np.inf), np.full(300, -1, np.int64)
    pairs = N.nearest_of_image(c, np.arange(1200), np.concatenate([near, far]), pivots, best, at)
    assert pairs[0] == 300 * 1200 and pairs[1] <= 300 * 600 and (at < 600).all()
    # nothing of an image beyond the bound is touched
    assert N.nearest_of_image(c, np.arange(600), far, pivots, np.full(300, np.inf), at.copy(), best)[1] == 0


def test_nearest_in_groups_of_centres_and_with_a_hot_image(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=(900, 5)).round(1)
    image = np.where(rng.random(900) < 0.5, 0, rng.integers(1, 9, 900))
    x = np.concatenate([y[:20], rng.normal(size=(40, 5)).round(1)])
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 5), (77, None)], "patch_id long, feat array<double>")
    rows = [(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(image, y))]
    t = spark.createDataFrame(rows + [(1000, 3, None), (1001, None, [0.0] * 5), (None, 3, [0.0] * 5)] + rows[:5], "target_id long, imidx int, feat array<double>")
    d = ((x[:, None] - y[None]) ** 2).sum(2)
    want = {(i, m): min((round(d[i, j], 9), j) for j in np.flatnonzero(image == m)) for i in range(60) for m in range(9)}
    for group_bytes in (1 << 25, 800):
        got = nearest_per_image(c, t, 16, 64, standardise=False, group_bytes=group_bytes).collect()
        assert {(r.patch_id, r.imidx): round(r.dist, 9) for r in got} == {k: v[0] for k, v in want.items()} and len(got) == 540
    assert nearest_per_image(c.limit(0), t).count() == nearest_per_image(c, t.limit(0), k=3).count() == 0


def test_greedy_acceptance(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({tuple(sorted(map(int, rng.integers(0, 30, 2)))) for _ in range(60)})
    pairs = [(a, b) for a, b in pairs if a < b]
    ok = []
    for k in range(30):
        if not any(b == k and a in ok for a, b in pairs):
            ok.append(k)
    ranks = spark.createDataFrame([(k, k) for k in range(30)], "detector int, rank int")
    edges = spark.createDataFrame(pairs, "a int, b int")
    got = [r.detector for r in C.accept_in_order(ranks, edges).orderBy("rank").collect()]
    assert got == ok
    assert [r.detector for r in C.accept_in_order(ranks, edges, most=5).collect()] == ok[:5]


def test_whole_job(spark, tmp_path):
    from lodemine.config import MiningParams
    from lodemine.plans.mining import MiningJob

    rng = np.random.default_rng(6)
    centre = rng.normal(size=(4, 12))
    rows = []
    for im in range(36):
        pos = im < 18
        for k in range(4):
            f = (centre[k % 3] if pos and k < 3 else rng.normal(size=12) * 1.2) + 0.1 * rng.normal(size=12)
            rows.append((im * 4 + k, im, pos, f.tolist(), 50 * k, 0, 50 * k + 39, 39))
    patches = spark.createDataFrame(rows, "patch_id long, imidx int, is_pos boolean, feat array<double>, x1 int, y1 int, x2 int, y2 int")
    images = patches.select("imidx", "is_pos").distinct()
    params = MiningParams(neighbours=12, purity_depth=6, max_clusters=6, active_clusters=6, iterations=1)
    job = MiningJob(spark, patches, images, str(tmp_path / "job"), params)
    assert job.purity().orderBy("rank").first().purity == 6
    assert 1 <= job.accepted().count() <= 6
    ranks = job.ranked().orderBy("rank").collect()
    assert ranks and ranks[0].posterior > 0.8
    html = job.report().first()[0]
    assert html.startswith("<html>") and html.count("<tr>") == len(ranks)
    again = MiningJob(spark, patches.limit(0), images, str(tmp_path / "job"), params)
    assert again.ranked().count() == len(ranks)  # resumed from the stage tables


def test_stream(spark, tmp_path):
    from lodemine.streaming.scorer import counts_per_window, score_stream

    spark.createDataFrame([(i, i % 3, [float(i), 1.0], f"2024-01-01 00:0{i % 4}:00") for i in range(12)], "patch_id long, imidx int, feat array<double>, ts string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("patch_id long, imidx int, feat array<double>, ts string").parquet(str(tmp_path / "in"))
    models = spark.createDataFrame([(1, [1.0, 0.0], 5.0), (2, [-1.0, 0.0], 0.0)], "cluster_id long, w array<double>, rho double")
    q = score_stream(stream, models, 0.0).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.det_id, r.detector) for r in spark.table("scored").collect()}
    assert got == {(i, 1) for i in range(5, 12)} | {(0, 2)}
    seen = spark.createDataFrame([(1, 0.5, "2024-01-01 00:00:10"), (1, 0.7, "2024-01-01 00:00:50"), (2, 0.1, "2024-01-01 00:01:10")], "detector long, decision double, s string").withColumn("ts", F.to_timestamp("s"))
    assert {(r.detector, r.n) for r in counts_per_window(seen, "ts").collect()} == {(1, 2), (2, 1)}


def test_folder_scan(spark, tmp_path):
    from lodemine.sources.images import scan_folders

    for b in ("a", "b", "c"):
        (tmp_path / b).mkdir()
        for i in range(2):
            (tmp_path / b / f"{i}.jpg").write_bytes(b"x" * (i + 1))
    got = scan_folders(spark, str(tmp_path), ["a"], ["b"]).orderBy("imidx").collect()
    assert [(r.id, r.bytes, r.bin, r.label) for r in got] == [("0.jpg", 1, "a", "positive"), ("1.jpg", 2, "a", "positive"), ("0.jpg", 1, "b", "negative"), ("1.jpg", 2, "b", "negative")]


def test_stage_tables(spark, tmp_path):
    from lodemine.sources import stages

    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert stages.stage(spark, str(tmp_path), "a.b", make).count() == 3
    assert stages.stage(spark, str(tmp_path), "a.b", make).count() == 3
    assert len(made) == 1 and stages.stage_path(str(tmp_path), "a.b").endswith("/a/b")


def small_images(spark, n=4):
    from lodemine.operators.rasters import synthetic_images

    return synthetic_images(spark, spark.createDataFrame([(i, i < n // 2) for i in range(n)], "imidx int, is_pos boolean"))


def small_params():
    from lodemine.config import PyramidParams

    return PyramidParams(canonical_size=96, patch_size=40)


def test_nearest_window_of_an_image_is_the_patch_itself(spark):
    from lodemine.operators import rasters

    im = small_images(spark)
    seeds = rasters.sample_patches(im, small_params(), most=2).cache()
    near = rasters.nearest_in_images(im, seeds.select("patch_id", "feat"), small_params(), 0.0, chunk=3)
    own = near.join(seeds.select("patch_id", "imidx", "level", "cy", "cx"), ["patch_id", "imidx", "level", "cy", "cx"])
    assert own.count() == seeds.count() and own.agg(F.max("dist")).first()[0] < 1e-12
    assert near.count() == seeds.count() * 4
    again = rasters.features_at(seeds.select("patch_id", "imidx", "level", "cy", "cx", F.col("feat").alias("was")), im, small_params()).collect()
    assert all(np.allclose(r.was, r.feat) for r in again) and len(again) == seeds.count()


def test_crops_are_pictures_that_spark_reads(spark, tmp_path):
    from lodemine.operators import rasters
    from lodemine.sources.images import decode

    im = small_images(spark)
    boxes = spark.createDataFrame([(0, 1, 10, 10, 49, 29), (1, 3, 0, 0, 95, 95)], "id int, imidx int, x1 int, y1 int, x2 int, y2 int")
    for r in rasters.crop_patches(boxes, im, None).collect():
        (tmp_path / f"{r.id}.png").write_bytes(bytes(r.png))
    got = {r.name: r for r in decode(spark.read.format("image").load(str(tmp_path)).withColumn("name", F.element_at(F.split("image.origin", "/"), -1))).collect()}
    raster = np.frombuffer(im.filter("imidx = 1").first().raster, np.float32).reshape(96, 128, 3)
    crop = np.frombuffer(got["0.png"].raster, np.float32).reshape(got["0.png"].nrows, got["0.png"].ncols, 3)
    assert crop.shape == (20, 40, 3) and np.abs(crop - raster[10:30, 10:50]).max() < 0.01
    feat = rasters.featurise_crops(im.select("imidx", "raster", "nrows", "ncols"), small_params()).first().feat
    assert len(feat) == small_params().feature_width


def test_tables_from_folders(spark, tmp_path):
    from lodemine.config import MiningParams
    from lodemine.kernels.png import encode
    from lodemine.plans.mining import tables_from_folders

    rng = np.random.default_rng(0)
    for b in ("p", "n"):
        (tmp_path / b).mkdir()
        for i in range(2):
            (tmp_path / b / f"{i}.png").write_bytes(encode(rng.integers(0, 256, (96, 100, 3), dtype=np.uint8)))
    patches, images, rasters = tables_from_folders(spark, str(tmp_path), ["p"], ["n"], MiningParams(pyramid=small_params()), "*.png")
    assert rasters.count() == 4
    assert {(r.fullname, r.is_pos, r.nrows, r.ncols) for r in images.collect()} == {(f"{b}/{i}.png", b == "p", 96, 100) for b in "pn" for i in range(2)}
    assert patches.groupBy("imidx").count().count() == 4


def test_shared_negatives_beyond_the_bound_give_the_same_fit(spark):
    from lodemine.operators import svm

    rng = np.random.default_rng(1)
    pos = spark.createDataFrame([(k % 3, (rng.normal(size=40) + 2 * (np.arange(40) % 3 == k % 3)).tolist()) for k in range(30)], "cluster_id long, feat array<double>")
    neg = spark.createDataFrame([(rng.normal(size=40).tolist(),) for _ in range(9000)], "feat array<double>")
    own = spark.createDataFrame([(1, (rng.normal(size=40) + 0.5).tolist()) for _ in range(20)], "cluster_id long, feat array<double>")
    whole = {r.cluster_id: r for r in svm.fit_clusters(pos, neg, own).collect()}
    parts = {r.cluster_id: r for r in svm.fit_clusters(pos, neg, own, shared_mb=1).collect()}
    for k, r in whole.items():
        assert np.allclose(r.w, parts[k].w, atol=1e-5) and abs(r.rho - parts[k].rho) < 1e-5
        assert (r.n_pos, r.n_neg) == (parts[k].n_pos, parts[k].n_neg)


def test_from_a_folder_of_pictures_to_the_report(spark, tmp_path):
    from lodemine.config import DetectionParams, MiningParams
    from lodemine.kernels.png import encode
    from lodemine.plans.mining import MiningJob, tables_from_folders

    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:40, 0:40]
    sign = np.where((np.hypot(y - 20, x - 20) < 14) & (np.hypot(y - 20, x - 20) > 8), 255, 30)
    for b in ("p", "n"):
        (tmp_path / b).mkdir()
        for i in range(7):
            picture = np.repeat(rng.integers(90, 130, (96, 100, 1)), 3, 2)
            if b == "p":
                a, c = rng.integers(4, 50, 2)
                picture[a : a + 40, c : c + 40] = sign[..., None]
            (tmp_path / b / f"{i}.png").write_bytes(encode(picture.astype(np.uint8)))
    params = MiningParams(neighbours=6, purity_depth=4, max_clusters=4, active_clusters=4, iterations=1, top_vote=3, min_votes=1, first_batch=2, detection=DetectionParams(min_gradient=0.0), pyramid=small_params())
    patches, images, rasters = tables_from_folders(spark, str(tmp_path), ["p"], ["n"], params, "*.png")
    job = MiningJob(spark, settle_(patches), images, str(tmp_path / "out"), params, rasters=rasters)
    assert {"level", "cy", "cx", "x1"} <= set(job.neighbours().columns)
    assert job.seeds().count() and job.detections().count()
    best = job.ranked().orderBy("rank").first()
    assert best.pos > best.neg
    tops = spark.read.parquet(str(tmp_path / "out" / "rounds" / "r0" / "tops"))
    assert {r.kind for r in tops.select("kind").distinct().collect()} <= {"train", "validate", "all"} and tops.count()
    job.write_report(str(tmp_path / "out"))
    for by in ("posterior", "overallcounts"):
        names = {f.name for f in (tmp_path / "out" / f"report_{by}").glob("*.png")}
        html = job.report(by=by).first()[0]
        assert names and all(f'src="{n}"' in html for n in names)


def settle_(df):
    from lodemine.sources.rounds import settle

    return settle(df)


def test_patch_records(spark):
    from lodemine.operators import rasters

    im = small_images(spark, 2)
    r = rasters.with_metadata(rasters.sample_patches(im, small_params(), most=2), im, 3).first()
    assert (r.flip, r.trunc, r.setidx, tuple(r.size)) == (False, False, 3, (96, 128)) and r.pyramid == [r.level, r.cy, r.cx]


def test_permutation_lines(spark):
    from lodemine.functions import text as X

    df = spark.createDataFrame([("perm 7 inds 3 1 2",), ("perm 8 inds ",), ("nothing",), (None,)], "line string")
    got = [(r.p.key, r.p["values"], r.c) for r in df.select(X.permutation(F.col("line")).alias("p")).select("p", X.checksum(F.col("p.values")).alias("c")).collect()]
    assert got == [(7, [3, 1, 2], 6), (8, [], 0), (None, [], 0), (None, [], 0)]


def test_has_field(spark):
    from lodemine.operators.relational import has_field

    df = spark.range(1).select(F.struct(F.lit(1).alias("x")).alias("s"))
    assert has_field(df, "s.x") and not has_field(df, "s.y") and not has_field(df, "t") and not has_field(df, "s.x.z")


def test_pairs_of_groups_match_all_pairs(spark):
    found = [(i // 30, i % 7, 40 * (i % 3), 10 * (i % 4)) for i in range(90)]
    rows = [(g, i, x, y, x + 39, y + 39) for i, (g, _, x, y) in enumerate(found)] + [(0, 0, 0, 0, 39, 39), (None, 91, 0, 0, 39, 39), (None, 92, 0, 0, 39, 39)]
    df = spark.createDataFrame(rows, "g int, det_id long, x1 int, y1 int, x2 int, y2 int")
    share = lambda a, b: F.round(G.overlap_of_first(a, b), 6).alias("share")
    side = lambda s: df.select("g", F.col("det_id").alias(s), G.box().alias(f"box_{s}"))
    want = sorted(map(tuple, side("a").join(side("b"), "g").filter("a <> b").select("a", "b", share(F.col("box_a"), F.col("box_b"))).collect()))
    for block, blocks in ((2, 3), (5, 1), (1024, 8)):
        got = S.pairs_of_groups(df, ["g"], share, block=block, blocks=blocks, ids=20)
        assert got.columns == ["a", "b", "share"] and sorted(map(tuple, got.collect())) == want
    assert S.pairs_of_groups(df.limit(0), ["g"], share).count() == 0


def test_pairs_of_groups_by_short_runs(spark, tmp_path):
    rows = [(i % 2, i if i % 11 else 22, 20 * (i % 2), 0, 39, 39) for i in range(60)] + [(0, None, 0, 0, 39, 39), (1, None, 7, 0, 39, 39)]
    df = spark.createDataFrame(rows, "g int, det_id long, x1 int, y1 int, x2 int, y2 int")
    share = lambda a, b: F.round(G.overlap_of_first(a, b), 6).alias("share")
    side = lambda s: df.select("g", F.col("det_id").alias(s), G.box().alias(f"box_{s}"))
    want = sorted(map(tuple, side("a").join(side("b"), "g").filter("a <> b").select("a", "b", share(F.col("box_a"), F.col("box_b"))).collect()))
    for block, run in ((1024, 7), (9, 4), (9, 1)):
        assert sorted(map(tuple, S.pairs_of_groups(df, ["g"], share, block=block, run=run).collect())) == want
    # runs of a block's length take five times the room, and hold block x block rows of a task at once
    n = 3000
    equal = spark.range(n).select(F.lit(0).alias("g"), (F.col("id") * 100).alias("det_id"), *[F.lit(v).alias(c) for c, v in (("x1", 0), ("y1", 0), ("x2", 39), ("y2", 39))])
    S.pairs_of_groups(equal, ["g"], share).write.parquet(str(tmp_path / "out"))
    taken = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == n * (n - 1) and taken < 0.3 * n * (n - 1)

def test_pairs_of_groups_once(spark):
    rows = [(i % 2, i if i % 11 else 22, 20 * (i % 3), 0, 39 + 20 * (i % 3), 39) for i in range(60)] + [(0, None, 0, 0, 39, 39), (None, 7, 0, 0, 39, 39)] + [(1, 5, 0, 0, 39, 39)] * 5
    df = spark.createDataFrame(rows, "g int, det_id long, x1 int, y1 int, x2 int, y2 int")
    iou = lambda a, b: F.round(G.iou(a, b), 6).alias("iou")
    side = lambda s: df.select("g", F.col("det_id").alias(s), G.box().alias(f"box_{s}"))
    want = sorted(map(tuple, side("a").join(side("b"), "g").filter("a < b").select("a", "b", iou(F.col("box_a"), F.col("box_b"))).collect()))
    for block, blocks, run in ((1024, 8, 128), (9, 1, 4), (4, 2, 1), (1024, 8, 2)):
        got = S.pairs_of_groups(df, ["g"], iou, block=block, blocks=blocks, run=run, ids=20, ordered=False)
        assert got.columns == ["a", "b", "iou"] and sorted(map(tuple, got.collect())) == want

    compared = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a, b):
        compared.add(1)
        return 0.5

    equal = spark.range(40).select(F.lit(0).alias("g"), F.col("id").alias("det_id"), *[F.lit(v).alias(c) for c, v in (("x1", 0), ("y1", 0), ("x2", 39), ("y2", 39))])
    assert len(S.pairs_of_groups(equal, ["g"], counted, run=4, ordered=False).collect()) == 40 * 39 // 2
    assert 0 < compared.value <= 10 * 11 // 2


def test_pairs_of_groups_are_dealt_by_their_number(spark):
    equal = lambda n, g: spark.range(n).select(F.lit(g).alias("g"), (F.col("id") * 2 + g).alias("det_id"), (F.col("id") % 5).cast("int").alias("x1"), *[F.lit(v).alias(c) for c, v in (("y1", 0), ("x2", 39), ("y2", 39))])
    share = lambda a, b: F.round(G.overlap_of_first(a, b), 6).alias("share")
    # 12,000 rows are few ids, but 144,000,000 pairs
    assert S.pairs_of_groups(equal(12_000, 0), ["g"], share).rdd.getNumPartitions() >= 144_000_000 / (1 << 25) > 4
    df = equal(600, 0).unionByName(equal(30, 1))
    side = lambda s: df.select("g", F.col("det_id").alias(s), G.box().alias(f"box_{s}"))
    want = sorted(map(tuple, side("a").join(side("b"), "g").filter("a <> b").select("a", "b", share(F.col("box_a"), F.col("box_b"))).collect()))
    got = S.pairs_of_groups(df, ["g"], share, block=32, blocks=32, run=16, pairs=20_000)
    tasks = got.rdd.mapPartitions(lambda rows: [[tuple(r) for r in rows]]).collect()
    assert sorted(r for t in tasks for r in t) == want
    # ids alone leave the 359,400 pairs of the first group in one task
    assert len(tasks) >= 18 and max(map(len, tasks)) < 120_000


def test_pairs_once_are_dealt_by_their_number(spark):
    df = spark.range(600).select(F.lit(0).alias("g"), F.col("id").alias("det_id"), (F.col("id") % 5).cast("int").alias("x1"), *[F.lit(v).alias(c) for c, v in (("y1", 0), ("x2", 39), ("y2", 39))])
    iou = lambda a, b: F.round(G.iou(a, b), 6).alias("iou")
    got = S.pairs_of_groups(df, ["g"], iou, block=32, blocks=32, run=16, pairs=20_000, ordered=False)
    tasks = got.rdd.mapPartitions(lambda rows: [[(r.a, r.b) for r in rows]]).collect()
    assert sorted(r for t in tasks for r in t) == [(a, b) for a in range(600) for b in range(a + 1, 600)]
    # ids alone leave all 179,700 in one task
    assert max(map(len, tasks)) < 60_000


def test_pairwise_overlap_own_takes_little_room(spark, tmp_path):
    from lodemine.plans import catalogue

    n = 2000
    events = spark.range(n).select((F.col("id") * 100).alias("event_id"), F.lit(0).cast("long").alias("user_id"), F.lit(0.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    catalogue.QUERIES["pairwise_overlap_own"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == n * (n - 1)
    taken = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert taken < 0.25 * n * (n - 1)


def test_pair_distances_are_those_of_the_join(spark, monkeypatch):
    from lodemine.functions import vectors as V
    from lodemine.operators import neighbours as N
    from lodemine.plans import catalogue

    rng = np.random.default_rng(8)
    rows = [(i, i % 3, rng.normal(size=5).tolist()) for i in range(80)] + [(7, 1, [1.0] * 5), (90, 1, None), (91, 1, [1.0, None, 0.0, 2.0, 3.0]), (92, 1, [1.0, 2.0]), (93, 1, []), (94, 1, [float("inf")] * 5), (95, 1, [float("inf")] * 5), (96, None, [1.0] * 5), (None, 1, [1.0] * 5), (97, 4, [2.0] * 5), (98, 5, None), (99, 5, [])]
    df = spark.createDataFrame(rows, "patch_id long, imidx int, feat array<float>")
    side = lambda s: df.select("imidx", F.col("patch_id").alias(s), V.doubles(F.col("feat")).alias(f"f{s}"))
    want = side("a").join(side("b"), "imidx").filter("a < b").select("a", "b", V.squared_distance(F.col("fa"), F.col("fb")).alias("d"))
    exact = lambda got: sorted((r.a, r.b, repr(r.d)) for r in got.collect())
    for block in (1024, 9, 1):
        assert exact(N.pair_distances(df, ["imidx"], "patch_id", "feat", block)) == exact(want)
    assert N.pair_distances(df.limit(0), ["imidx"], "patch_id", "feat").count() == 0
    # the query doesn't fold vectors pair by pair
    monkeypatch.setattr(V, "squared_distance", None)
    catalogue.QUERIES["l2_pairs"](spark, "/root/testdata/sf0.001")


def test_values_are_carried_over_parts_of_a_key(spark):
    from lodemine.operators.relational import invert_share

    rng = np.random.default_rng(4)
    n = 3000
    weight = np.where(rng.random(n) < 0.3, 0, rng.random(n))
    share = np.cumsum(weight) / weight.sum()
    draws = np.concatenate([rng.random(500), share[rng.integers(0, n, 50)], [0.0, 1.0]])
    shares = spark.createDataFrame([(0, None, i, float(s)) for i, s in enumerate(share)] + [(1, "a", 7, 0.5), (1, "a", 8, None)], "k int, j string, position long, share double").repartition(5)
    rows = [(0, None, i, float(u)) for i, u in enumerate(draws)] + [(1, "a", 900, 0.4), (1, "a", 901, 0.6), (1, "a", 902, None), (2, "b", 903, 0.1)]
    asked = spark.createDataFrame(rows, "k int, j string, id long, u double").repartition(3)
    got = {(r.k, r.id): r.position for r in invert_share(asked, shares, ["k", "j"], "u", "share", "position").collect()}
    want = {(0, i): int(np.flatnonzero(share >= u)[0]) for i, u in enumerate(draws)} | {(1, 900): 7}
    assert got == want
    assert invert_share(asked.limit(0), shares, ["k"], "u", "share", "position").count() == 0


def test_growing_batches(spark):
    from lodemine.operators.ranking import growing_batches

    got = growing_batches(spark.range(50), [F.col("id").asc()], 3, 0.71).groupBy("step").count().orderBy("step").collect()
    assert [r["count"] for r in got] == [3, 4, 8, 13, 21, 1]


def test_clusters_of_any_size_are_fitted_as_the_local_fit(spark, sf):
    from lodemine.operators import svm
    from lodemine.sources.views import patches

    p = patches(spark, sf)
    rows = p.filter("is_pos").select((F.col("imidx") % 2).cast("long").alias("cluster_id"), "feat", F.lit(1).alias("y"))
    neg, own = p.filter("NOT is_pos").select("feat"), p.filter("NOT is_pos AND patch_id % 3 = 0").select(F.lit(1).cast("long").alias("cluster_id"), "feat")
    large = {r.cluster_id: r for r in svm.fit_large(rows.unionByName(own.withColumn("y", F.lit(-1))), neg).collect()}
    local = {r.cluster_id: r for r in svm.fit_clusters(rows.drop("y"), neg, own).collect()}
    x = np.array([r.feat for r in neg.collect()])
    for k, r in local.items():
        assert (r.n_pos, r.n_neg) == (large[k].n_pos, large[k].n_neg)
        mine = np.array([q.feat for q in rows.collect() if q.cluster_id == k])
        extra = [np.array([q.feat for q in own.collect()])] if k == 1 else []
        a = np.concatenate([mine, x, *extra])
        y = np.concatenate([np.ones(len(mine)), -np.ones(len(a) - len(mine))])

        def objective(m):
            return 0.5 * (np.dot(m.w, m.w) + m.rho**2) + 0.1 * (np.maximum(0, 1 - y * (a @ np.array(m.w) - m.rho)) ** 2).sum()

        assert abs(objective(r) - objective(large[k])) < 1e-6 and np.allclose(r.w, large[k].w, atol=1e-5)


def test_large_clusters_and_kinds_of_model(spark, monkeypatch):
    from lodemine.operators import svm

    rng = np.random.default_rng(3)
    wide = 70_000  # so that few rows are more than a megabyte
    x = rng.normal(size=(9, wide)) / 100
    pos = spark.createDataFrame([(i % 2 if i < 6 else 1, x[i].tolist()) for i in range(7)], "cluster_id long, feat array<double>")
    neg = spark.createDataFrame([(x[i].tolist(),) for i in (7, 8)], "feat array<double>")
    called = []
    large = svm.fit_large
    monkeypatch.setattr(svm, "fit_large", lambda rows, *a: called.append(rows.select("cluster_id").distinct().collect()) or large(rows, *a))
    got = {r.cluster_id: r for r in svm.fit_clusters(pos, neg, task_mb=2).collect()}
    want = {r.cluster_id: r for r in svm.fit_clusters(pos, neg).collect()}
    assert [[r[0] for r in c] for c in called] == [[1]] and set(got) == set(want) == {0, 1}
    assert all(np.allclose(got[k].w, want[k].w, atol=1e-6) and got[k].n_neg == want[k].n_neg == 2 for k in want)
    with pytest.raises(ValueError):
        svm.fit_clusters(pos, neg, task_mb=2, modeltype="hinge")
    small = pos.select("cluster_id", F.slice("feat", 1, 20).alias("feat"))
    less = neg.select(F.slice("feat", 1, 20).alias("feat"))
    for kind in svm.FITS:
        assert {r.cluster_id for r in svm.fit_clusters(small, less, modeltype=kind).collect()} == {0, 1}
