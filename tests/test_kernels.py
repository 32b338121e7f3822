import numpy as np
import pytest

from lodemine.config import PyramidParams
from lodemine.kernels.color import rgb_to_lab
from lodemine.kernels.gradients import energy, histogram
from lodemine.kernels.pyramid import Level, build, crop, level_count, scores, windows
from lodemine.kernels.resize import resize, to_bytes, weights
from lodemine.kernels.sampling import blur, clean_coverage, distribution, draw, gaussian, sample_patches
from lodemine.operators.svm import fit_hinge, fit_sgd, fit_squared_hinge


def test_lab_of_plain_colours():
    black, white, grey = rgb_to_lab(np.array([[[0, 0, 0], [1, 1, 1], [0.5, 0.5, 0.5]]], float))[0]
    assert np.allclose(black, 0, atol=1e-9)
    assert np.allclose(white, [100, 0, 0], atol=0.05)
    assert np.allclose(grey[1:], 0, atol=0.05) and 70 < grey[0] < 80
    red = rgb_to_lab(np.array([[[1.0, 0, 0]]]))[0, 0]
    assert red[1] > 60 and red[2] > 40
    bytes_ = rgb_to_lab(np.full((2, 2, 3), 255.0))
    assert np.allclose(bytes_[..., 0], 100, atol=0.05)


@pytest.mark.parametrize("method", ["bicubic", "bilinear"])
def test_resize_keeps_constants_and_sizes(method):
    x = np.full((5, 7, 3), 0.25)
    for scale, shape in ((2, (10, 14)), (0.5, (3, 4)), (1, (5, 7))):
        y = resize(x, scale, method=method)
        assert y.shape[:2] == shape and np.allclose(y, 0.25)
    assert np.allclose(weights(7, 4, 4 / 7, method).sum(1), 1)


def test_resize_by_one_is_the_identity():
    x = np.arange(35, dtype=float).reshape(5, 7)
    assert np.allclose(resize(x, 1.0), x)
    assert np.allclose(resize(x, 2.0, method="bilinear")[0, :4], [0, 0.25, 0.75, 1.25])


def test_bytes():
    assert to_bytes(np.array([-1.0, 0.5, 2.0])).tolist() == [0, 128, 255]
    assert resize(np.full((4, 4), 200, np.uint8), 0.5).dtype == np.uint8


def slow_votes(image, cell):
    rows, cols = (int(round(n / cell)) for n in image.shape[:2])
    out = np.zeros((rows, cols, 18))
    for y in range(1, rows * cell - 1):
        for x in range(1, cols * cell - 1):
            grads = [(image[y, x + 1, c] - image[y, x - 1, c], image[y + 1, x, c] - image[y - 1, x, c]) for c in range(3)]
            dx, dy = max(grads, key=lambda g: g[0] ** 2 + g[1] ** 2)
            best, o = 0.0, 0
            for k in range(9):
                d = dx * np.cos(k * np.pi / 9) + dy * np.sin(k * np.pi / 9)
                if d > best + 1e-12:
                    best, o = d, k
                elif -d > best + 1e-12:
                    best, o = -d, k + 9
            yp, xp = (y + 0.5) / cell - 0.5, (x + 0.5) / cell - 0.5
            for iy in (int(np.floor(yp)), int(np.floor(yp)) + 1):
                for ix in (int(np.floor(xp)), int(np.floor(xp)) + 1):
                    if 0 <= iy < rows and 0 <= ix < cols:
                        out[iy, ix, o] += (1 - abs(yp - iy)) * (1 - abs(xp - ix)) * np.hypot(dx, dy)
    return out


def test_votes_match_a_slow_loop():
    from lodemine.kernels.gradients import _votes

    image = np.random.default_rng(0).random((24, 32, 3))
    assert np.allclose(_votes(image, 3, 4, 8), slow_votes(image, 8))


def test_histogram_of_simple_images():
    assert np.allclose(histogram(np.full((40, 40, 3), 0.3), 8), 0)
    ramp = np.repeat(np.linspace(0, 1, 40)[None, :, None], 40, 0).repeat(3, 2)
    f = histogram(ramp, 8)
    assert f.shape == (3, 3, 31)
    assert f[1, 1, :18].argmax() == 0 and f[1, 1, 18:27].argmax() == 0
    assert histogram(ramp.transpose(1, 0, 2), 8)[1, 1, 18:27].argmax() in (4, 5)
    assert np.allclose(energy(ramp)[20, 20], (255 / 39) ** 2)
    assert histogram(np.zeros((8, 8, 3)), 8).shape[:2] == (0, 0)


def test_pyramid_levels():
    assert level_count(400, 400, 8, 80) == 19
    params = PyramidParams(canonical_size=96, patch_size=40)
    p = build(np.random.default_rng(1).random((96, 128, 3)), params)
    assert len(p.levels) == level_count(96, 128, 8, 40)
    level = p.levels[0]
    f, g, y, x = windows(level, 3)
    assert f.shape == (len(g), 3 * 3 * 33) and len(g) == (level.cells.shape[0] - 2) * (level.cells.shape[1] - 2)
    assert (y[0], x[0], y[1], x[1]) == (0, 0, 1, 0)
    k = 5
    window = level.cells[y[k] : y[k] + 3, x[k] : x[k] + 3]
    assert np.allclose(f[k], window.ravel(order="F"))
    assert np.allclose(g[k], level.gradient[y[k] : y[k] + 3, x[k] : x[k] + 3].mean())
    kept = windows(level, 3, np.median(g))[1]
    assert len(kept) == (g >= np.median(g)).sum()
    assert crop(np.zeros((50, 60, 3)), 10, 5, 29, 44, 80).shape[:2] == (80, 40)
    assert crop(np.zeros((50, 60, 3)), 10, 5, 29, 44, None).shape[:2] == (40, 20)


def test_sampler_prefers_texture():
    rng = np.random.default_rng(2)
    image = np.full((160, 160, 3), 0.5)
    image[80:, 80:] = rng.random((80, 80, 3))
    got = sample_patches(image, PyramidParams(canonical_size=160, patch_size=40), 3)
    assert 0 < len(got) <= 25
    centres = np.array([[(p["box"][0] + p["box"][2]) / 2, (p["box"][1] + p["box"][3]) / 2] for p in got])
    assert (centres > 70).all(1).mean() > 0.8
    again = sample_patches(image, PyramidParams(canonical_size=160, patch_size=40), 3)
    assert [p["box"] for p in got] == [p["box"] for p in again]


def test_distribution_and_draws():
    assert np.isclose(gaussian(9, 2).sum(), 1)
    p = distribution(np.zeros((10, 12)), 5)
    assert np.isclose(p.sum(), 1) and np.allclose(p, p[0, 0])
    w = np.zeros((4, 5))
    w[2, 3] = 1
    assert set(draw(w, 50, np.random.default_rng(0)).tolist()) == {3 * 4 + 2}


def test_coverage_cleaning():
    boxes = np.array([[0, 0, 9, 9], [0, 0, 9, 9], [20, 20, 29, 29], [0, 0, 4, 9], [5, 0, 14, 9]])
    assert clean_coverage(boxes, np.array([5.0, 4, 3, 2, 1])).tolist() == [0, 2, 4]
    assert clean_coverage(np.zeros((0, 4), int), np.zeros(0)).tolist() == []


def test_squared_hinge_is_optimal():
    rng = np.random.default_rng(4)
    for n, d in ((40, 5), (8, 30)):
        x = rng.normal(size=(n, d))
        y = np.where(x[:, 0] + 0.3 * rng.normal(size=n) > 0, 1.0, -1.0)
        w, b = fit_squared_hinge(x, y, 0.1)
        a, v = np.column_stack([x, np.ones(n)]), np.append(w, b)
        slack = np.maximum(0, 1 - y * (a @ v))
        assert np.abs(v - 0.2 * a.T @ (y * slack)).max() < 1e-6
    w, b = fit_squared_hinge(np.ones((3, 2)), np.ones(3))
    assert not w.any() and b == 1


def test_cells_round_half_up_and_repeat_the_border():
    from lodemine.kernels.gradients import histogram

    image = np.random.default_rng(0).random((100, 97, 3))
    got = histogram(image, 8)
    assert got.shape == (11, 10, 31)
    # rows 99 to 102 of a thirteenth cell take the gradient of row 98
    y, x = np.minimum(np.arange(104), 98), np.arange(97)
    wide = np.zeros((13, 12, 18))
    for yy in range(1, 103):
        for xx in range(1, 95):
            a, b = int(y[yy]), int(min(x[xx], 95))
            dy, dx = image[a + 1, b] - image[a - 1, b], image[a, b + 1] - image[a, b - 1]
            k = int((dx * dx + dy * dy).argmax())
            along = dx[k] * np.cos(np.arange(9) * np.pi / 9) + dy[k] * np.sin(np.arange(9) * np.pi / 9)
            o = int(np.concatenate([along, -along]).argmax())
            cy, cx = (yy + 0.5) / 8 - 0.5, (xx + 0.5) / 8 - 0.5
            iy, ix = int(np.floor(cy)), int(np.floor(cx))
            for oy in (0, 1):
                for ox in (0, 1):
                    if 0 <= iy + oy < 13 and 0 <= ix + ox < 12:
                        wide[iy + oy, ix + ox, o] += abs(1 - oy - (cy - iy)) * abs(1 - ox - (cx - ix)) * np.hypot(dx[k], dy[k])
    from lodemine.kernels.gradients import _votes

    assert np.allclose(_votes(image, 13, 12, 8), wide)


def test_quick_distribution():
    from lodemine.kernels.sampling import quick_distribution

    w = np.zeros((30, 40))
    assert np.allclose(quick_distribution(w, 9), 1 / 1200)
    w[15, 20] = 2.0
    p = quick_distribution(w, 9)
    assert np.count_nonzero(p) == 1 and 0.9 < p[15, 20] < 1.1


@pytest.mark.parametrize("size", [1, 4, 5, 30])
def test_blur_is_the_direct_sum_with_nothing_beyond_the_border(size):
    rng = np.random.default_rng(size)
    x, k = rng.random((9, 13)), gaussian(size, size / 3)
    want = np.zeros(x.shape)
    for i in range(9):
        for j in range(13):
            for a in range(size):
                for b in range(size):
                    r, c = i + a - (size - 1) // 2, j + b - (size - 1) // 2
                    if 0 <= r < 9 and 0 <= c < 13:
                        want[i, j] += k[a, b] * x[r, c]
    assert np.allclose(blur(x, size, size / 3), want)
    assert np.allclose(distribution(x, size), want / want.sum())


@pytest.mark.parametrize("block", [3, 128])
def test_scores_by_shared_cells_are_those_of_the_windows(block):
    import tracemalloc

    rng = np.random.default_rng(3)
    level = Level(1.0, rng.random((40, 31, 33)), 20 * rng.random((40, 31)))
    w = rng.normal(size=(7, 8 * 8 * 33))
    for least in (None, 9.9):
        f, _, cy, cx = windows(level, 8, least)
        got = list(scores(level, 8, w, least, block))
        assert [g[0] for g in got] == list(range(0, 7, block))
        for at, d, y, x in got:
            assert np.allclose(d, f @ w[at : at + block].T, rtol=0, atol=1e-9) and (y == cy).all() and (x == cx).all()
    assert list(scores(Level(1.0, np.zeros((5, 9, 33)), np.zeros((5, 9))), 8, w)) == []

    def peak(work):
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    big = Level(1.0, rng.random((120, 160, 33)), 20 * rng.random((120, 160)))
    assert 20 * peak(lambda: [None for _ in scores(big, 8, w, None, block)]) < peak(lambda: windows(big, 8)[0] @ w.T)


def test_hinge_meets_the_conditions_of_an_optimum():
    rng = np.random.default_rng(4)
    for n, d in ((60, 5), (12, 30)):
        x = rng.normal(size=(n, d))
        y = np.where(x[:, 0] + 0.5 * rng.normal(size=n) > 0, 1.0, -1.0)
        w, b = fit_hinge(x, y, 0.1)
        of = lambda w, b: 0.5 * w @ w + 0.1 * np.maximum(0, 1 - y * (x @ w + b)).sum()
        best = of(w, b)
        for _ in range(300):
            assert of(w + 0.02 * rng.normal(size=d), b + 0.02 * rng.normal()) >= best - 1e-6
    assert fit_hinge(np.ones((3, 2)), -np.ones(3))[1] == -1


def test_averaged_steps_come_near_the_optimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    y = np.where(x[:, 0] - x[:, 1] + 0.3 > 0, 1.0, -1.0)
    w, b = fit_sgd(x, y)
    assert (np.sign(x @ w + b) == y).mean() > 0.97 and (fit_sgd(x, y)[0] == w).all()


def test_a_histogram_takes_little_memory():
    import tracemalloc

    from lodemine.kernels.gradients import histogram

    image = np.random.default_rng(2).random((400, 600, 3))
    tracemalloc.start()
    histogram(image, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * image.nbytes


def test_a_fit_in_parts_is_the_fit_of_all_and_copies_no_block():
    import tracemalloc

    rng = np.random.default_rng(7)
    x = rng.normal(size=(60_000, 32)).astype(np.float32)
    y = np.where(rng.random(len(x)) < 0.1, 1.0, -1.0)
    w, b = fit_squared_hinge(x[:900].astype(float), y[:900])
    for blocks, mb in (([x[:500], x[500:900]], 8), ([x[:0], x[:7], x[7:900].astype(float)], 0)):
        got = fit_squared_hinge(blocks, y[:900], part_mb=mb)
        assert np.allclose(got[0], w, atol=1e-9) and abs(got[1] - b) < 1e-9
    tracemalloc.start()
    fit_squared_hinge(x, y, part_mb=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * x.nbytes
