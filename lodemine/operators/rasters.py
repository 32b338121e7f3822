"""Image kernels over DataFrames: one image in, few rows out.

A window's feature vector never leaves the task that makes it unless it is sampled or scored: the
pyramid, the texture filter, the scores and the threshold all stand in one pass over the image.
Rasters are float32 RGB from 0 to 1 with nrows and ncols beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.config import DetectionParams, PyramidParams
from lodemine.kernels import pyramid as P
from lodemine.kernels.sampling import sample_patches as _sample

BOX = "x1 int, y1 int, x2 int, y2 int"


def _image(raster: bytes, rows: int, cols: int) -> np.ndarray:
    return np.frombuffer(raster, np.float32).reshape(rows, cols, 3).astype(np.float64)


def _box(cy, cx, unit: float | np.ndarray, cells: int, rows: int, cols: int) -> tuple:
    side = np.rint((cells + 2) * np.asarray(unit)).astype(int) - 1
    x1, y1 = np.floor(cx * unit).astype(int), np.floor(cy * unit).astype(int)
    return x1, y1, np.minimum(x1 + side, cols - 1), np.minimum(y1 + side, rows - 1)


def pyramid_stats(images: DataFrame, params: PyramidParams = PyramidParams()) -> DataFrame:
    """imidx, level, scale, rows, cols, windows, gradient: what each level of the pyramid holds."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, r, h, w in zip(pdf["imidx"], pdf["raster"], pdf["nrows"], pdf["ncols"]):
                p = P.build(_image(r, h, w), params)
                for k, level in enumerate(p.levels):
                    a, b = level.cells.shape[:2]
                    n = params.patch_cells
                    out.append((i, k, level.scale, a, b, max(0, a - n + 1) * max(0, b - n + 1), float(level.gradient.mean())))
            yield pd.DataFrame(out, columns=["imidx", "level", "scale", "rows", "cols", "windows", "gradient"])

    return images.select("imidx", "raster", "nrows", "ncols").mapInPandas(rows, "imidx int, level int, scale double, rows int, cols int, windows int, gradient double")


def sample_patches(images: DataFrame, params: PyramidParams = PyramidParams(), seed: int = 20, most: int = 25) -> DataFrame:
    """Gradient-weighted patches of each image, seeded by image and seed."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, r, h, w in zip(pdf["imidx"], pdf["raster"], pdf["nrows"], pdf["ncols"]):
                for s in _sample(_image(r, h, w), params, [seed, int(i)], most):
                    out.append((i, s["level"], s["cy"], s["cx"], *s["box"], s["probability"], s["gradsum"], s["feat"]))
            yield pd.DataFrame(out, columns=["imidx", "level", "cy", "cx", "x1", "y1", "x2", "y2", "probability", "gradsum", "feat"])

    got = images.select("imidx", "raster", "nrows", "ncols").mapInPandas(rows, f"imidx int, level int, cy int, cx int, {BOX}, probability double, gradsum double, feat array<double>")
    return got.withColumn("patch_id", F.xxhash64("imidx", "level", "cy", "cx"))


def with_metadata(patches: DataFrame, images: DataFrame, set_index: int = 0) -> DataFrame:
    """patches (imidx, level, cy, cx, box) with the record of a patch: flip and trunc (always false, as
    windows are neither mirrored nor cut), size of the image, pyramid place, setidx."""
    size = images.select("imidx", F.struct("nrows", "ncols").alias("size"))
    return patches.join(size, "imidx").select("*", F.lit(False).alias("flip"), F.lit(False).alias("trunc"), F.array("level", "cy", "cx").alias("pyramid"), F.lit(set_index).alias("setidx"))


def detect(images: DataFrame, detectors: DataFrame, params: PyramidParams = PyramidParams(), detection: DetectionParams = DetectionParams(), most_detectors: int = 4096) -> DataFrame:
    """Detections of every window of every image: pyramid, texture filter, scores, threshold in one
    pass, without making a window's features; suppression follows. Detectors are few (their number is checked)."""
    from lodemine.operators.suppress import suppress_own_area

    got = detectors.select("cluster_id", "w", "rho").orderBy("cluster_id").limit(most_detectors + 1).toPandas()
    if len(got) > most_detectors:
        raise ValueError(f"more than {most_detectors} detectors; score them in parts")
    model = images.sparkSession.sparkContext.broadcast((got["cluster_id"].to_numpy(), np.stack([np.asarray(w, float) for w in got["w"]]), got["rho"].to_numpy(float)))
    n = params.patch_cells

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, w, rho = model.value
        for pdf in batches:
            for i, r, h, c in zip(pdf["imidx"], pdf["raster"], pdf["nrows"], pdf["ncols"]):
                p = P.build(_image(r, h, c), params)
                for k, level in enumerate(p.levels):
                    for first, d, cy, cx in P.scores(level, n, w, detection.min_gradient):
                        d = d - rho[first : first + d.shape[1]]
                        at, which = np.nonzero(d >= detection.threshold)
                        x1, y1, x2, y2 = _box(cy[at], cx[at], params.cell * level.scale / p.canonical_scale, n, h, c)
                        yield pd.DataFrame({"detector": ids[first + which], "imidx": np.full(len(at), i), "decision": d[at, which], "level": np.full(len(at), k), "cy": cy[at], "cx": cx[at], "x1": x1, "y1": y1, "x2": x2, "y2": y2})

    found = images.select("imidx", "raster", "nrows", "ncols").mapInPandas(rows, f"detector long, imidx int, decision double, level int, cy int, cx int, {BOX}")
    found = found.withColumn("det_id", F.xxhash64("detector", "imidx", "level", "cy", "cx"))
    # a detector's windows of one image, which one task has just made
    return suppress_own_area(found, detection.overlap, most=None)


def synthetic_images(spark: SparkSession, images: DataFrame, nrows: int = 96, ncols: int = 128) -> DataFrame:
    """Rasters for tests and for the catalogue, as the tables hold no pictures: a grating of a direction
    and period by the image's number over a gradient. Where images have a vector ``field``, its values
    are the brightness of fields, eight a row."""
    field = F.col("field").cast("array<double>") if "field" in images.columns else F.lit(None).cast("array<double>")

    @F.pandas_udf("binary")
    def raster(ids: pd.Series, fields: pd.Series) -> pd.Series:
        y, x = np.mgrid[0:nrows, 0:ncols]
        out = []
        for i, v in zip(ids, fields):
            a, period = i % 9 * np.pi / 9, 6 + i % 7
            wave = 0.5 + 0.5 * np.sin(2 * np.pi * (x * np.cos(a) + y * np.sin(a)) / period)
            bright = np.ones(x.shape)
            if v is not None and len(v) >= 8:
                v = np.asarray(v, float)[: len(v) // 8 * 8].reshape(-1, 8)
                v = (v - v.min()) / (v.max() - v.min() + 1e-9)
                bright = v[y * len(v) // nrows, x * 8 // ncols]
            out.append(np.stack([wave * bright, x / ncols * bright, y / nrows * wave], -1).astype(np.float32).tobytes())
        return pd.Series(out)

    spread = images.repartition(2 * spark.sparkContext.defaultParallelism, "imidx")  # few rows, much work for each
    return spread.select("imidx", "is_pos", F.lit(nrows).alias("nrows"), F.lit(ncols).alias("ncols"), raster("imidx", field).alias("raster"))


def nearest_in_images(images: DataFrame, centers: DataFrame, params: PyramidParams = PyramidParams(), min_gradient: float = 9.0, chunk: int = 4096, block: int = 2048) -> DataFrame:
    """patch_id, imidx, dist, level, cy, cx and box: of each image the window nearest to each centre.

    The windows of an image are scored where they are made. Centres (patch_id, feat) go out in
    chunks of bounded size, one pass over the images for each; their number bounds the passes, not
    the memory. Ties go to the first window in order of level, column, row."""
    count = centers.count()
    chunks = max(1, -(-count // chunk))
    n, out = params.patch_cells, None
    for part in range(chunks):
        got = centers.filter(F.pmod(F.xxhash64("patch_id"), F.lit(chunks)) == part).orderBy("patch_id").toPandas()
        if not len(got):
            continue
        from lodemine.operators.neighbours import standardise_rows

        model = images.sparkSession.sparkContext.broadcast((got["patch_id"].to_numpy(), standardise_rows(np.stack([np.asarray(f, float) for f in got["feat"]]))))

        def rows(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            ids, c = model.value
            norm = (c * c).sum(1)
            for pdf in batches:
                for i, r, h, w in zip(pdf["imidx"], pdf["raster"], pdf["nrows"], pdf["ncols"]):
                    best, where = np.full(len(ids), np.inf), np.zeros((len(ids), 3), int)
                    p = P.build(_image(r, h, w), params)
                    for k, level in enumerate(p.levels):
                        f, _, cy, cx = P.windows(level, n, min_gradient)
                        for a in range(0, len(f), block):
                            t = standardise_rows(f[a : a + block])
                            d = np.maximum((t * t).sum(1)[:, None] - 2 * (t @ c.T) + norm, 0)
                            j = d.argmin(0)
                            near = d[j, np.arange(len(ids))]
                            better = near < best
                            best[better] = near[better]
                            where[better] = np.stack([np.full(len(j), k), cy[a + j], cx[a + j]], 1)[better]
                    ok = np.isfinite(best)
                    at = where[ok]
                    unit = np.array([params.cell * level.scale / p.canonical_scale for level in p.levels] or [1.0])[at[:, 0]]
                    x1, y1, x2, y2 = _box(at[:, 1], at[:, 2], unit, n, h, w)
                    yield pd.DataFrame({"patch_id": ids[ok], "imidx": np.full(ok.sum(), i), "dist": best[ok], "level": at[:, 0], "cy": at[:, 1], "cx": at[:, 2], "x1": x1, "y1": y1, "x2": x2, "y2": y2})

        near = images.select("imidx", "raster", "nrows", "ncols").mapInPandas(rows, f"patch_id long, imidx int, dist double, level int, cy int, cx int, {BOX}")
        out = near if out is None else out.unionByName(near)
    return out if out is not None else images.sparkSession.createDataFrame([], f"patch_id long, imidx int, dist double, level int, cy int, cx int, {BOX}")


def features_at(cells: DataFrame, images: DataFrame, params: PyramidParams = PyramidParams()) -> DataFrame:
    """cells (imidx, level, cy, cx and more) with ``feat`` and the window's box: each image's pyramid
    is built once, for the cells that name it."""
    n = params.patch_cells
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema) + f", feat array<double>, {BOX}"

    def fetch(wanted: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        if not len(image) or not len(wanted):
            return pd.DataFrame(columns=[*wanted.columns, "feat", "x1", "y1", "x2", "y2"])
        r = image.iloc[0]
        p = P.build(_image(r["raster"], r["nrows"], r["ncols"]), params)
        feats, boxes = [], []
        for level, cy, cx in zip(wanted["level"], wanted["cy"], wanted["cx"]):
            lv = p.levels[level]
            feats.append(lv.cells[cy : cy + n, cx : cx + n].ravel(order="F"))
            boxes.append(_box(np.asarray(cy), np.asarray(cx), params.cell * lv.scale / p.canonical_scale, n, r["nrows"], r["ncols"]))
        out = wanted.assign(feat=feats)
        out[["x1", "y1", "x2", "y2"]] = np.array(boxes, int)
        return out

    return cells.groupBy("imidx").cogroup(images.select("imidx", "raster", "nrows", "ncols").groupBy("imidx")).applyInPandas(fetch, schema)


def crop_patches(boxes: DataFrame, images: DataFrame, longer_side: int | None = 80) -> DataFrame:
    """boxes (imidx, x1, y1, x2, y2 and more) with ``png``: the pixels of each box. Rows of an image
    meet in one task and are cut from it one after another."""
    from lodemine.kernels.png import encode
    from lodemine.kernels.resize import to_bytes

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema) + ", png binary"

    def cut(wanted: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        if not len(image) or not len(wanted):
            return pd.DataFrame(columns=[*wanted.columns, "png"])
        r = image.iloc[0]
        x = _image(r["raster"], r["nrows"], r["ncols"])
        return wanted.assign(png=[encode(to_bytes(P.crop(x, *b, longer_side))) for b in wanted[["x1", "y1", "x2", "y2"]].itertuples(index=False)])

    return boxes.groupBy("imidx").cogroup(images.select("imidx", "raster", "nrows", "ncols").groupBy("imidx")).applyInPandas(cut, schema)


def _crop_feature(x: np.ndarray, params: PyramidParams) -> np.ndarray | None:
    """The one window of pixels scaled to a patch; None if they are too narrow for one."""
    small = replace(params, canonical_size=params.patch_size)
    level = P.build(x, small, [0]).levels
    f = P.windows(level[0], small.patch_cells)[0] if level else np.zeros((0, 0))
    return f[0] if len(f) else None


def featurise_crops(crops: DataFrame, params: PyramidParams = PyramidParams()) -> DataFrame:
    """crops (id, raster, nrows, ncols) as one window each: the crop is scaled to a patch."""

    @F.pandas_udf("array<double>")
    def feat(raster: pd.Series, nrows: pd.Series, ncols: pd.Series) -> pd.Series:
        return pd.Series([_crop_feature(_image(r, h, w), params) for r, h, w in zip(raster, nrows, ncols)])

    return crops.withColumn("feat", feat("raster", "nrows", "ncols"))


def features_of_boxes(boxes: DataFrame, images: DataFrame, params: PyramidParams = PyramidParams()) -> DataFrame:
    """boxes (imidx, x1, y1, x2, y2 and more) with ``feat``: each box is cut from its image and made a
    patch of its own, whose gradients and cells are those of the cut pixels alone."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema) + ", feat array<double>"

    def cut(wanted: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        if not len(image) or not len(wanted):
            return pd.DataFrame(columns=[*wanted.columns, "feat"])
        r = image.iloc[0]
        x = _image(r["raster"], r["nrows"], r["ncols"])
        return wanted.assign(feat=[_crop_feature(P.crop(x, *b, None), params) for b in wanted[["x1", "y1", "x2", "y2"]].itertuples(index=False)])

    return boxes.groupBy("imidx").cogroup(images.select("imidx", "raster", "nrows", "ncols").groupBy("imidx")).applyInPandas(cut, schema)
