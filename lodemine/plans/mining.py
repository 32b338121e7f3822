"""The whole mining job over feature tables.

Stages are written below ``base`` and a run resumes from those that are there. The driver holds
ids and counts of clusters only (at most ``active_clusters`` a round); features, neighbours and
detections stay in tables.
"""

from __future__ import annotations

import logging
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.config import MiningParams
from lodemine.functions.vectors import decision, doubles
from lodemine.operators import clusters as C
from lodemine.operators import neighbours as N
from lodemine.operators import ranking as R
from lodemine.operators import rasters as P
from lodemine.operators import svm as M
from lodemine.operators.relational import anti, semi
from lodemine.operators.suppress import suppress_iou, suppress_own_area
from lodemine.plans import report
from lodemine.sources import images as I
from lodemine.sources.journal import Journal
from lodemine.sources.rounds import clear, settle
from lodemine.sources.stages import save, stage

log = logging.getLogger("lodemine")
DETECTOR = f"{M.MODEL}, round int"


class MiningJob:
    """patches: patch_id, imidx, is_pos, feat, x1, y1, x2, y2; images: imidx, is_pos; rasters: imidx,
    raster, nrows, ncols. With rasters, neighbours are searched among, and negatives and detections
    come from, every window of every image, and patches are the candidates only; all of them are the
    first negatives. Without, the given patches stand for the windows, and the candidates among them,
    which are the first negatives, are those of every ``seed_every``-th image; the others are mined."""

    def __init__(self, spark: SparkSession, patches: DataFrame, images: DataFrame, base: str, params: MiningParams = MiningParams(), resume: bool = True, rasters: DataFrame | None = None):
        self.spark, self.patches, self.images, self.base, self.params, self.resume, self.rasters = spark, patches, images, base, params, resume, rasters

    def _stage(self, name: str, make) -> DataFrame:
        log.info("stage %s", name)
        return stage(self.spark, self.base, name, make, self.resume)

    # -- candidates

    def purity(self) -> DataFrame:
        """patch_id, purity, rank of the positive patches."""
        return self._stage("clusters.purity", lambda: N.purity_rank(self.neighbours(), self.params.purity_depth))

    def neighbours(self) -> DataFrame:
        """The nearest window in each of the nearest images of each positive patch, its own image
        left out, with the window's box."""

        def make() -> DataFrame:
            p, centers = self.patches, self.patches.filter("is_pos").select("patch_id", "feat")
            own = p.select("patch_id", F.col("imidx").alias("own"))
            if self.rasters is not None:
                near = P.nearest_in_images(self.rasters, centers, self.params.pyramid, self.params.detection.min_gradient)
                near = near.withColumn("target_id", F.xxhash64("imidx", "level", "cy", "cx"))
            else:
                near = N.nearest_per_image(centers, p.select(F.col("patch_id").alias("target_id"), "imidx", "feat"), k=self.params.neighbours + 1)
            top = N.top_images(near.join(own, "patch_id").filter("imidx <> own").drop("own"), self.params.neighbours)
            if self.rasters is None:
                top = top.join(p.select(F.col("patch_id").alias("target_id"), "x1", "y1", "x2", "y2"), "target_id")
            return N.with_labels(top, self.images)

        return self._stage("clusters.neighbours", make)

    def _features(self, rows: DataFrame, key: str) -> DataFrame:
        """cluster_id, key, feat of windows: from the pictures, or from the patches named by key."""
        if self.rasters is not None:
            return P.features_at(rows.select("cluster_id", key, "imidx", "level", "cy", "cx"), self.rasters, self.params.pyramid).select("cluster_id", key, "feat")
        return rows.select("cluster_id", key).join(self.patches.select(F.col("patch_id").alias(key), "feat"), key).select("cluster_id", key, "feat")

    def accepted(self) -> DataFrame:
        """cluster_id, rank: clusters in order of purity that repeat none accepted before."""

        def make() -> DataFrame:
            n = self.params
            ranks = self.purity().select(F.col("patch_id").alias("cluster_id"), "rank")
            seen = self.neighbours().filter(F.col("nn_rank") <= n.neighbours // 2)
            seen = seen.select(F.col("patch_id").alias("cluster_id"), F.col("target_id").alias("det_id"), "imidx", "x1", "y1", "x2", "y2").join(ranks, "cluster_id")
            pairs = C.duplicate_pairs(seen, n.duplicate_iou, n.duplicate_share, "cluster_id", "rank").filter("duplicate")
            return C.accept_in_order(ranks, pairs, "cluster_id", "rank", n.max_clusters)

        return self._stage("clusters.accepted", make)

    def seeds(self) -> DataFrame:
        """cluster_id, feat: the five nearest patches of each accepted cluster; with pictures, made
        anew from the pixels of their boxes."""

        def make() -> DataFrame:
            best = self.neighbours().filter(F.col("nn_rank") <= self.params.top_train).withColumnRenamed("patch_id", "cluster_id")
            best = semi(best, self.accepted(), "cluster_id")
            if self.rasters is not None and self.params.crop_seeds:
                cut = P.features_of_boxes(best.select("cluster_id", "imidx", "x1", "y1", "x2", "y2"), self.rasters, self.params.pyramid)
                return cut.select("cluster_id", "feat").dropna()
            return self._features(best, "target_id").select("cluster_id", "feat")

        return self._stage("clusters.seeds", make)

    def image_order(self) -> DataFrame:
        return self._stage("images.order", lambda: I.image_order(self.images, F.xxhash64("imidx", F.lit(self.params.seed))))

    # -- rounds

    def _detect(self, detectors: DataFrame, of: DataFrame, threshold: float, final: bool = False) -> DataFrame:
        """Detections on the images of ``of``, with their boxes, greedily cleaned."""
        d = self.params.detection
        if self.rasters is not None:
            rule = replace(d, threshold=threshold, overlap=d.final_overlap if final else d.overlap)
            found = P.detect(semi(self.rasters, of.select("imidx"), "imidx"), detectors, self.params.pyramid, rule).drop("kept_rank")
            return found if final else suppress_iou(found, d.collect_overlap).drop("kept_rank")
        found = M.score(semi(self.patches, of.select("imidx"), "imidx"), detectors, threshold)
        boxes = self.patches.select(F.col("patch_id").alias("det_id"), "x1", "y1", "x2", "y2")
        return suppress_own_area(found.join(boxes, "det_id"), d.final_overlap if final else d.collect_overlap).drop("kept_rank")

    def _mine(self, models: DataFrame, batch: DataFrame) -> DataFrame:
        """cluster_id, det_id, feat of the windows of negative images that the models score too high."""
        n = self.params
        if self.rasters is not None:
            rows = P.detect(semi(self.rasters, batch.select("imidx"), "imidx"), models, n.pyramid, n.detection)
        else:
            rows = M.score(semi(self.patches, batch.select("imidx"), "imidx"), models, n.cull_at)
        return self._features(rows.withColumnRenamed("detector", "cluster_id"), "det_id")

    def _refit(self, models: DataFrame, held: DataFrame | None, seeds: DataFrame, negatives: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Mines what the models score too high on a batch of negative images, culls, and fits again:
        the models, and the negatives held."""
        n = self.params
        mined = self._mine(models, batch)
        mined = settle((mined if held is None else held.unionByName(mined)).dropDuplicates(["cluster_id", "det_id"]))
        w = models.select("cluster_id", "w", "rho")
        scored = mined.join(w, "cluster_id").select("cluster_id", "det_id", "feat", decision(doubles(F.col("feat")), F.col("w"), F.col("rho")).alias("decision"))
        held = settle(M.cull_negatives(scored, "cluster_id", n.cull_at, n.cull_near, n.cull_factor).select("cluster_id", "det_id", "feat"))
        clear(mined)
        return M.fit_clusters(seeds, negatives, held.select("cluster_id", "feat"), n.svm_c, modeltype=n.modeltype), held

    def detectors(self) -> DataFrame:
        """Runs the rounds: train on one third of the positives, vote on the next, re-seed. A cluster
        that is voted in for ``iterations`` rounds is finished; one that isn't is dropped.

        Each fit, each batch of mined negatives and each vote is a step of the journal: a job that is
        started again goes on after the last one that was committed."""

        def make() -> DataFrame:
            journal = Journal(self.spark, self.base, "rounds.journal", self.resume)
            if journal.state is None:
                waiting = [r[0] for r in self.accepted().orderBy("rank").select("cluster_id").collect()]  # at most max_clusters ids
                # candidates of positive images are, all in all, of no pattern either
                initial = self.patches
                if self.rasters is None:
                    initial = semi(initial, self.image_order().filter(F.col("ord") % self.params.seed_every == 0).select("imidx"), "imidx")
                journal.commit({"round": 0, "step": "fit", "waiting": waiting, "active": [], "ages": {}}, own=self.seeds(), negatives=initial.select("feat"))
            steps = {"fit": self._fit_step, "mine": self._mine_step, "vote": self._vote_step}
            while journal.state["step"] != "done":
                steps[journal.state["step"]](journal, dict(journal.state))
            return journal.table("done") if "done" in journal else self.spark.createDataFrame([], DETECTOR)

        return self._stage("detectors", make)

    def _active(self, state: dict) -> DataFrame:
        return self.spark.createDataFrame([(c,) for c in state["active"]], "cluster_id long")

    def _fit_step(self, journal: Journal, state: dict) -> None:
        """Admits waiting clusters and fits the first models of a round."""
        room = self.params.active_clusters - len(state["active"])
        new, state["waiting"] = state["waiting"][:room], state["waiting"][room:]
        state["active"] += new
        # json has no whole numbers as keys
        state["ages"] = state["ages"] | {str(c): 0 for c in new}
        if not state["active"]:
            journal.commit({"step": "done"})
            return
        models = M.fit_clusters(semi(journal.table("own"), self._active(state), "cluster_id"), journal.table("negatives"), c=self.params.svm_c, modeltype=self.params.modeltype)
        journal.commit(state | {"step": "mine", "at": 0, "batch": 0}, models=models, held=None)

    def _mine_step(self, journal: Journal, state: dict) -> None:
        """One batch of negative images; batches grow."""
        n = self.params
        pool = I.rotation(self.image_order(), state["round"]).filter("NOT is_pos AND part = 'train'")
        at, size = state["at"], int(n.first_batch * 2 ** (n.batch_growth * state["batch"]))
        if at >= pool.count():
            journal.commit(state | {"step": "vote"})
            return
        batch = R.global_rank(pool, [F.col("ord").asc()], "_at").filter(F.col("_at").between(at, at + size - 1))
        seeds = semi(journal.table("own"), self._active(state), "cluster_id")
        models, held = self._refit(journal.table("models"), journal.table("held") if "held" in journal else None, seeds, journal.table("negatives"), batch)
        journal.commit(state | {"at": at + size, "batch": state["batch"] + 1}, models=models, held=held)
        clear(held)

    def _vote_step(self, journal: Journal, state: dict) -> None:
        """Detects on the validation images, votes, retires and re-seeds clusters."""
        n, j, active, ages = self.params, state["round"], state["active"], state["ages"]
        models, own, ids = journal.table("models"), journal.table("own"), self._active(state)
        parts = I.rotation(self.image_order(), j)
        looked = parts.filter("part = 'validate' OR part = 'train' AND is_pos")
        seen = settle(self._detect(models, looked, n.detection.threshold).join(parts.select("imidx", "part", "is_pos"), "imidx"))
        top = R.top_n(seen.filter("is_pos AND part = 'validate'"), n.top_validate)
        sets = {"train": R.top_n(seen.filter("part = 'train'"), n.top_validate), "validate": top, "all": R.top_n(seen.filter("part = 'validate'"), n.top_all)}
        kinds = [x.select(F.lit(name).alias("kind"), "detector", "rank", "det_id", "imidx", "is_pos", "decision", "x1", "y1", "x2", "y2") for name, x in sets.items()]
        save(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), self.base, f"rounds.r{j}.tops")
        voted = R.at_least(top.filter(F.col("rank") <= n.top_vote), ["detector"], n.min_votes)
        kept = {r[0] for r in voted.select("detector").collect()}  # at most active_clusters ids
        finished = [c for c in active if c in kept and ages[str(c)] + 1 >= n.iterations]
        done = {}
        if finished:
            part = models.filter(F.col("cluster_id").isin(finished)).withColumn("round", F.lit(j))
            done["done"] = journal.table("done").unionByName(part) if "done" in journal else part
        best = R.assign_top(top, n.top_train).filter("cluster_id IS NOT NULL")
        fresh = self._features(best, "det_id").select("cluster_id", "feat")
        after = semi(fresh, ids, "cluster_id").unionByName(anti(own, ids, "cluster_id"))
        log.info("round %d: %d active, %d voted in, %d finished, %d waiting", j, len(active), len(kept), len(finished), len(state["waiting"]))
        active = [c for c in active if c in kept and c not in finished]
        ages = {str(c): ages[str(c)] + 1 for c in active}
        journal.commit({"round": j + 1, "step": "fit", "waiting": state["waiting"], "active": active, "ages": ages}, own=after, models=None, held=None, **done)
        clear(seen)

    # -- result

    def detections(self) -> DataFrame:
        return self._stage("final.detections", lambda: self._detect(self.detectors(), self.images, self.params.detection.final_threshold, True))

    def ranked(self, by: str = "posterior") -> DataFrame:
        """The detectors that overlap none ranked before. by posterior: detector, pos, neg, posterior,
        rank; by overallcounts: detector, pos, neg, rank."""

        def make() -> DataFrame:
            n, found = self.params, self.detections()
            ranks = report.detector_ranks(found, self.images, n.count_threshold) if by == "posterior" else report.overall_ranks(found, self.images)
            ranks = settle(ranks)
            top = R.top(found, ["detector"], R.by_score(), 50 if by == "posterior" else 250, "_k").drop("_k").join(ranks.select("detector", F.col("rank").alias("place")), "detector")
            bad = C.overlap_counts(top, n.overlap_iou, "detector", "place").filter(F.col("n") > n.overlap_count)
            kept = C.accept_in_order(ranks.select("detector", "rank"), bad, most=n.report_detectors)
            return semi(ranks, kept, "detector")

        return self._stage("final.ranks" if by == "posterior" else f"final.ranks_{by}", make)

    def shown(self, by: str = "posterior") -> DataFrame:
        """The patches that the report shows, each with its rank."""
        return semi(R.top_n(self.detections(), self.params.report_patches), self.ranked(by), "detector").join(self.images, "imidx")

    def report(self, title: str = "patterns", by: str = "posterior") -> DataFrame:
        def make() -> DataFrame:
            rows = report.rows_html(self.shown(by), F.col("is_pos"), suffix=".png" if self.rasters is not None else ".jpg")
            return report.page(rows, self.ranked(by), title)

        return self._stage("final.report" if by == "posterior" else f"final.report_{by}", make)

    def pictures(self, by: str = "posterior") -> DataFrame:
        """name, png of the patches that the report shows; needs rasters."""
        boxes = self.shown(by).select("det_id", "imidx", "x1", "y1", "x2", "y2")
        cut = P.crop_patches(boxes, self.rasters, self.params.pyramid.patch_size)
        return cut.select(F.concat(F.col("det_id").cast("string"), F.lit(".png")).alias("name"), "png")

    def write_report(self, out: str, title: str = "patterns") -> None:
        """Both orders, each as a page with its pictures beside it."""
        for by in ("posterior", "overallcounts"):
            report.write_page(self.report(title, by), f"{out}/report_{by}")
            if self.rasters is not None:
                report.write_pictures(self.pictures(by), f"{out}/report_{by}")


def tables_from_folders(spark: SparkSession, base: str, positives: list[str], negatives: list[str], params: MiningParams, pattern: str = "*.jpg") -> tuple[DataFrame, DataFrame, DataFrame]:
    """patches, images and rasters of a job from folders of pictures: scan, decode, and draw patches
    by gradient weight from every image."""
    from lodemine.operators.rasters import sample_patches

    files = I.scan_folders(spark, base, positives, negatives, pattern)
    folders = [f"{base.rstrip('/')}/{b}" for b in [*positives, *negatives]]
    pictures = spark.read.format("image").option("pathGlobFilter", pattern).load(folders)
    name = F.concat_ws("/", F.slice(F.split("image.origin", "/"), -2, 2))
    rows = I.decode(pictures.withColumn("fullname", name), params.pyramid.pixel_scale).join(files.drop("path"), "fullname")
    images = settle(rows.select(F.col("imidx").cast("int").alias("imidx"), (F.col("label") == "positive").alias("is_pos"), "nrows", "ncols", "fullname", "raster"))
    patches = sample_patches(images, params.pyramid, params.seed).join(images.select("imidx", "is_pos"), "imidx")
    return patches.select("patch_id", "imidx", "is_pos", "feat", "x1", "y1", "x2", "y2"), images.drop("raster"), images.select("imidx", "raster", "nrows", "ncols")


def main(argv: list[str] | None = None) -> None:
    """Job script: patches and images as Parquet, or folders of pictures, in; stage tables and the
    report out."""
    import argparse

    a = argparse.ArgumentParser(description=main.__doc__)
    a.add_argument("--patches")
    a.add_argument("--images")
    a.add_argument("--basepath", help="a folder with one folder per bin")
    a.add_argument("--positives", nargs="*", default=[])
    a.add_argument("--negatives", nargs="*", default=[])
    a.add_argument("--pattern", default="*.jpg")
    a.add_argument("--outdir", required=True)
    a.add_argument("--fresh", action="store_true", help="make every stage anew")
    got = a.parse_args(argv)
    spark = SparkSession.builder.appName("lodemine").getOrCreate()
    if got.basepath:
        params = MiningParams()
        made = lru_cache(lambda: tables_from_folders(spark, got.basepath, got.positives, got.negatives, params, got.pattern))
        patches = stage(spark, got.outdir, "input.patches", lambda: made()[0], not got.fresh)
        images = stage(spark, got.outdir, "input.images", lambda: made()[1], not got.fresh)
        rasters = stage(spark, got.outdir, "input.rasters", lambda: made()[2], not got.fresh)
    else:
        patches, images, rasters = spark.read.parquet(got.patches), spark.read.parquet(got.images), None
    job = MiningJob(spark, patches, images, got.outdir, resume=not got.fresh, rasters=rasters)
    job.write_report(got.outdir)


if __name__ == "__main__":
    main()
