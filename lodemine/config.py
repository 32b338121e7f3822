"""Parameters of the mining job, with the defaults of its published setting."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PyramidParams:
    canonical_size: int = 400
    patch_size: int = 80
    intervals: int = 8
    cell: int = 8
    use_color: bool = True
    color_weight: float = 0.0025
    pixel_scale: float = 255.0

    @property
    def patch_cells(self) -> int:
        return self.patch_size // self.cell - 2

    @property
    def channels(self) -> int:
        return 33 if self.use_color else 31

    @property
    def feature_width(self) -> int:
        return self.patch_cells**2 * self.channels


@dataclass(frozen=True)
class DetectionParams:
    overlap: float = 0.4
    collect_overlap: float = 0.1
    final_overlap: float = 0.5
    threshold: float = -1.002
    final_threshold: float = -0.85
    min_gradient: float = 9.0


@dataclass(frozen=True)
class MiningParams:
    neighbours: int = 100
    purity_depth: int = 20
    max_clusters: int = 1200
    active_clusters: int = 600
    iterations: int = 3
    first_batch: int = 15
    batch_growth: float = 0.71
    top_vote: int = 10
    top_train: int = 5
    top_validate: int = 20
    top_all: int = 100
    min_votes: int = 2
    svm_c: float = 0.1
    modeltype: str = "squared_hinge"
    crop_seeds: bool = True
    cull_at: float = -1.02
    cull_near: float = -1.0
    cull_factor: int = 3
    duplicate_iou: float = 0.2
    duplicate_share: float = 0.1
    overlap_iou: float = 0.3
    overlap_count: int = 5
    report_detectors: int = 500
    report_patches: int = 20
    count_threshold: float = -0.2
    seed_every: int = 4
    seed: int = 20
    detection: DetectionParams = field(default_factory=DetectionParams)
    pyramid: PyramidParams = field(default_factory=PyramidParams)
