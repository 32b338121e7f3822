"""The journal, and a mining job that is stopped after every step."""

import numpy as np
import pytest

from lodemine.config import MiningParams
from lodemine.plans.mining import MiningJob
from lodemine.sources.journal import Journal


def test_entries_are_whole_and_tables_are_kept(spark, tmp_path):
    base = str(tmp_path)
    j = Journal(spark, base, "a.b")
    assert j.state is None and j.number == 0 and "x" not in j
    j.commit({"k": 1}, x=spark.range(3), y=spark.range(2))
    j.commit({"k": 2}, x=spark.range(5))
    again = Journal(spark, base, "a.b")
    assert (again.number, again.state) == (2, {"k": 2}) and again.table("x").count() == 5 and again.table("y").count() == 2
    # written but not committed: not seen, and swept with the next step
    spark.range(9).write.parquet(f"{base}/a/b/tables/00000003-x-lost")
    (tmp_path / "a/b/log/.00000003-half").write_text("{")
    again = Journal(spark, base, "a.b")
    assert again.number == 2 and again.table("x").count() == 5
    again.commit({"k": 3}, y=None)
    assert "y" not in again and "y" not in Journal(spark, base, "a.b")
    again.commit({"k": 4})
    left = sorted(p.name for p in (tmp_path / "a/b/tables").iterdir())
    assert len(left) == 1 and left[0].startswith("00000002-x")
    with pytest.raises(RuntimeError, match="another driver"):
        late = Journal(spark, base, "a.b")
        late.number = 3
        late.commit({"k": 9})
    assert Journal(spark, base, "a.b", resume=False).state is None


class Lost(Exception):
    pass


def test_a_job_that_is_lost_after_any_step_gives_the_same_detectors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(4, 8))
    rows = []
    for im in range(24):
        pos = im < 12
        for k in range(3):
            f = (centre[k % 2] if pos and k < 2 else rng.normal(size=8) * 1.2) + 0.1 * rng.normal(size=8)
            rows.append((im * 3 + k, im, pos, f.tolist(), 50 * k, 0, 50 * k + 39, 39))
    spark.createDataFrame(rows, "patch_id long, imidx int, is_pos boolean, feat array<double>, x1 int, y1 int, x2 int, y2 int").write.parquet(str(tmp_path / "p"))
    patches = spark.read.parquet(str(tmp_path / "p"))
    images = patches.select("imidx", "is_pos").distinct()
    params = MiningParams(neighbours=8, purity_depth=4, max_clusters=2, active_clusters=1, iterations=1, first_batch=2)
    new = lambda name: MiningJob(spark, patches, images, str(tmp_path / name), params)
    whole = {(r.cluster_id, r["round"]): (np.array(r.w), r.rho) for r in new("whole").detectors().collect()}
    steps = Journal(spark, str(tmp_path / "whole"), "rounds.journal").number

    commit, lives, seen = Journal.commit, 0, []
    for half in range(2 * steps + 5):
        lives += 1

        def once(self, state, **tables):
            if half % 2:  # lost while the step's tables are written
                for df in tables.values():
                    if df is not None:
                        df.write.parquet(f"{self.folder}/tables/{self.number + 1:08d}-lost-{lives}")
                        break
                raise Lost
            commit(self, state, **tables)
            seen.append(state["step"])
            raise Lost

        monkeypatch.setattr(Journal, "commit", once)
        try:
            got = new("parts").detectors().collect()
            break
        except Lost:
            pass
    assert len(seen) == steps and {"fit", "mine", "vote", "done"} == set(seen)
    assert len(got) == len(whole) > 0
    for r in got:
        w, rho = whole[r.cluster_id, r["round"]]
        assert np.allclose(r.w, w, atol=1e-6) and abs(r.rho - rho) < 1e-6
