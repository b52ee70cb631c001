import itertools
import math

import numpy as np
import pytest

from fragmatch.functions import kernels as K

rng = np.random.default_rng(3)


def test_windows_order_and_edges():
    image = rng.random((5, 6, 3))
    p, xy = K.windows(image, 3)
    assert p.shape == (12, 3, 3, 3) and xy[0].tolist() == [0, 0] and xy[-1].tolist() == [3, 2]
    assert (p[5] == image[1:4, 1:4]).all()
    assert K.windows(image, 6)[0].shape == (0, 6, 6, 3)
    assert len(K.windows(image, 3, 2)[0]) == 4


def test_entropy_bounds():
    flat = np.full((1, 3, 3, 3), 0.4)
    assert K.entropy(flat)[0] == pytest.approx(0, abs=1e-6)
    assert K.entropy(rng.random((50, 6, 6, 3))).max() <= 3.0
    assert np.isfinite(K.entropy(np.full((1, 3, 3, 3), 2.0))).all()


@pytest.mark.parametrize("size", [3, 4, 5, 6])
def test_descriptors_are_unit_and_finite(size):
    p = rng.random((20, size, size, 3)) * 0.5 + 0.25
    for f in (*K.STRATEGIES.values(), K.zernike, K.persistence_descriptor, K.photometric, K.bayesian):
        v = f(p)
        assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5)
        assert np.array_equal(v, f(p))
    assert K.project(K.composite(p), 128).shape == (20, 128)


def test_raw_dimensions():
    dims = {s: (K.composite(rng.random((1, s, s, 3))).shape[1], K.composite(rng.random((1, s, s, 3)), False).shape[1]) for s in (3, 4, 5, 6, 8)}
    assert dims == {3: (106, 106), 4: (424, 256), 5: (954, 350), 6: (1696, 472), 8: (3816, 800)}
    assert [K.bayesian(rng.random((1, s, s, 3))).shape[1] for s in (3, 4, 5, 6)] == [100, 124, 155, 197]


def test_invariances():
    g = np.repeat(rng.random((10, 4, 4, 1)) * 0.5 + 0.25, 3, axis=3)
    assert np.allclose(K.binary_pattern(g), K.binary_pattern(g**0.5), atol=1e-5)
    assert np.allclose(K.persistence_descriptor(g), K.persistence_descriptor(g**0.5), atol=1e-6)
    p = rng.random((10, 3, 3, 3)) * 0.3 + 0.2
    assert ((K.chromaticity(p) * K.chromaticity(p * 1.5)).sum(1) > 0.9).all()
    assert np.allclose(K.photometric(p), K.photometric(p * 1.3 + 0.1), atol=1e-9)
    assert np.allclose(K.zernike(p), K.zernike(np.rot90(p, axes=(1, 2))), atol=1e-9)


def test_affine_fit():
    s = rng.random((6, 9, 3))
    m, b, rss, ok = K.affine_fit(s, s)
    assert ok.all() and (rss < 1e-3).all()
    true = np.eye(3) + 0.1 * rng.random((3, 3))
    t = s @ true.T + 0.05
    m, b, rss, ok = K.affine_fit(s, t, loss="l2", ridge=1e-9)
    assert np.allclose(m, true, atol=1e-4) and np.allclose(b, 0.05, atol=1e-4)
    out = t.copy()
    out[:, 4] += 0.8
    huber = np.abs(K.affine_fit(s, out)[0] - true).sum()
    assert huber <= np.abs(K.affine_fit(s, out, loss="l2")[0] - true).sum()
    m, b, rss, ok = K.affine_fit(np.full((1, 9, 3), 0.5), np.full((1, 9, 3), 0.5), ridge=0.0)
    assert not ok[0] and rss[0] == math.inf and (m[0] == np.eye(3)).all()


def test_affine_rows_do_not_depend_on_the_batch():
    s, t = rng.random((30, 16, 3)), rng.random((30, 16, 3))
    every = K.affine_fit(s, t)[2]
    one = np.array([K.affine_fit(s[k : k + 1], t[k : k + 1])[2][0] for k in range(30)])
    assert np.allclose(every, one, atol=1e-12)


def test_chi2():
    assert K.chi2_survival(np.array([24.996, 50.998]), np.array([15, 36])) == pytest.approx([0.05, 0.05], abs=1e-4)
    assert K.chi2_survival(np.array([0.0, -1.0, np.inf, 1e5]), np.array([15, 15, 15, 36])).tolist() == [1, 0, 0, 0]
    assert K.chi2_survival(np.array([1.0]), np.array([0]))[0] == 0


def test_persistence_by_hand():
    d = K.sublevel_diagram(np.array([[0.1, 0.5, 0.2]]))
    assert np.allclose(sorted(d.tolist()), [[0.1, 0.500001], [0.2, 0.5], [0.5, 0.5]])  # a pair without persistence is kept


def test_labels_against_flood_fill():
    for diagonal in (False, True):
        mask = rng.random((12, 15)) < 0.5
        label, n = K.label_cells(mask, diagonal)
        seen, count = np.zeros_like(mask), 0
        for y, x in itertools.product(range(12), range(15)):
            if mask[y, x] and not seen[y, x]:
                count += 1
                todo, members = [(y, x)], []
                seen[y, x] = True
                while todo:
                    a, b = todo.pop()
                    members.append((a, b))
                    for da, db in itertools.product((-1, 0, 1), repeat=2):
                        c = (a + da, b + db)
                        if (diagonal or not (da and db)) and 0 <= c[0] < 12 and 0 <= c[1] < 15 and mask[c] and not seen[c]:
                            seen[c] = True
                            todo.append(c)
                assert len({label[m] for m in members}) == 1 and label[members[0]] == count
        assert n == count and (label[~mask] == 0).all()


def test_blur_keeps_mass_and_resize_sizes():
    image = rng.random((20, 30))
    assert K.gaussian_blur(image, 2.0).sum() == pytest.approx(image.sum(), rel=1e-6)
    eight = (rng.random((40, 50, 3)) * 255).astype(np.uint8)
    assert K.resize(eight, 20, 25).shape == (20, 25, 3)
    assert (K.resize(np.full((16, 16, 3), 77, np.uint8), 9, 7) == 77).all()


def test_native_fraction():
    r = np.random.RandomState(0)
    image = (r.rand(64, 64, 3) * 255).astype(np.uint8)
    assert K.native_fraction(image) >= 0.85
    half = K.resize(K.resize(image, 32, 32), 64, 64, "cubic")
    assert K.native_fraction(half) <= 0.65


@pytest.mark.parametrize("side", [6, 10, 16])
def test_native_fraction_of_small_windows(side):
    flat = np.full((side, side, 3), 90, np.uint8)
    assert K.native_fraction(flat) == pytest.approx(0.3)  # nothing is lost at any size
    noise = (np.random.RandomState(side).rand(side, side, 3) * 255).astype(np.uint8)
    shares, lost = np.linspace(1.0, 0.3, 15), []
    for f in shares:
        back = K.resize(K.resize(noise, max(8, round(side * f)), max(8, round(side * f)), "lanczos"), side, side, "cubic")
        lost.append(((back.astype(float) - noise) ** 2).mean())
    knee = np.mean(lost[:2]) + 0.08 * (max(lost) - np.mean(lost[:2])) + 1.0
    assert K.native_fraction(noise) == pytest.approx(min(f for f, e in zip(shares, lost) if e <= knee))
