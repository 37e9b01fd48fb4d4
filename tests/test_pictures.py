import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.functions import kernels, pixels
from cardloom.sources import images


def _picture(seed: int, size: int) -> np.ndarray:
    """Lines of blocks on a page."""
    r = np.random.default_rng(seed)
    x = np.full((120, 200, 3), 235, np.uint8)
    for line in range(20, 105, 16):
        at = 20
        while at < 170:
            w = int(r.integers(4, 8 + size % 20))
            x[line : line + 7, at : min(at + w, 180)] = r.integers(10, 60)
            at += w + int(r.integers(3, 8))
    return x


def bmp(width, height):
    row = b"\x0a\x00\xff" * width + b"\x00" * (-3 * width % 4)
    data = row * height
    return b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(data), 2835, 2835, 0, 0) + data


def test_sources(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(bmp(4, 3))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    (tmp_path / "c.txt").write_text("no")
    files = images.image_files(spark, str(tmp_path)).select("source", "length").orderBy("source").collect()
    assert [r.source for r in files] == ["a.bmp", "b.png"] and files[0].length == len(bmp(4, 3))
    got = {r.path.rpartition("/")[2]: r for r in images.decoded_images(spark, str(tmp_path / "*.bmp"), str(tmp_path / "*.png")).collect()}
    assert got["a.bmp"].error is None and bytes(got["a.bmp"].image.data[:3]) == b"\x0a\x00\xff" and got["b.png"].error


def test_json_sink(spark, tmp_path):
    images.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}'


@pytest.mark.parametrize("angle", [-15, -7, -3, -1, 1, 2, 5, 11, 15])
def test_skew_is_found(angle):
    assert abs(kernels.skew(kernels.rotate(_picture(3, 5), angle)) + angle) < 0.6


def test_straight_and_blank_have_no_skew():
    assert kernels.skew(_picture(4, 9)) == 0.0 and kernels.skew(np.full((480, 640, 3), 200, np.uint8)) == 0.0
    for shape in ((1, 1, 3), (10, 2000, 3)):
        assert kernels.skew(np.zeros(shape, np.uint8)) == 0.0


def test_turns_and_crops():
    x = np.random.default_rng(0).integers(0, 255, (5, 7, 3)).astype(np.uint8)
    y = x
    for _ in range(4):
        y = kernels.quarter_turns(y, 90)
    assert (x == y).all() and kernels.quarter_turns(x, 90).shape == (7, 5, 3) and (kernels.quarter_turns(x, 90)[0, -1] == x[0, 0]).all()
    with pytest.raises(ValueError):
        kernels.quarter_turns(x, 45)
    assert kernels.crop(x, 2.9, 1, 100, 3).shape == (2, 5, 3) and kernels.crop(x, 5, 1, 2, 3) is None and kernels.crop(x, 90, 90, 99, 99) is None
    assert kernels.pad(x, 2).shape == (9, 11, 3)


def test_colours_and_quality():
    g = np.full((20, 30), 0.5)
    assert kernels.to_bgr(g).shape == (20, 30, 3) and kernels.to_bgr(g)[0, 0, 0] == 127 and kernels.to_bgr(np.zeros((4, 4, 4), np.uint8)).shape == (4, 4, 3)
    blur, contrast, noise, bright = kernels.quality(np.full((40, 50, 3), 200, np.uint8))
    assert (blur, contrast, noise, bright) == (0.0, 0.0, 0.0, 200.0) and kernels.noise(np.zeros((2, 9), np.uint8)) == 0.0
    r = np.random.default_rng(7).normal(0, 6, (80, 90))
    assert kernels.noise(np.clip(128 + r, 0, 255)) > 6


def test_resize_and_warp():
    x = _picture(2, 3)
    assert np.abs(kernels.resize(x, 200, 120).astype(int) - x).max() <= 1
    corners = np.array([[230, 120], [1120, 60], [1180, 760], [180, 690]], dtype=float)
    assert (kernels.order_corners(corners[[2, 0, 3, 1]]) == corners).all()
    flat = kernels.warp(x, np.array([[0, 0], [199, 0], [199, 119], [0, 119]]), 200, 120)
    assert np.abs(flat.astype(int) - x).max() <= 1 and kernels.sharpen_digits(x).shape == (360, 600, 3)


def test_enhancement():
    dull = _picture(5, 4)[10:42] // 5 + 100
    out = kernels.enhance_text(dull)
    assert out.shape == (64, 400, 3) and kernels.grey(out).std() > 1.5 * kernels.grey(dull).std()
    flat = np.full((90, 70), 128, np.uint8)
    assert (kernels.bilateral(flat) == 128).all() and (kernels.unsharp(flat) == 128).all() and kernels.equalise(flat).std() == 0
    noisy = np.clip(128 + np.random.default_rng(7).normal(0, 12, (60, 80)), 0, 255).astype(np.uint8)
    assert kernels.noise(kernels.bilateral(noisy)) < 0.7 * kernels.noise(noisy)
    assert kernels.enhance_text(np.zeros((300, 2000, 3), np.uint8)).shape == (300, 2000, 3)


def test_skew_of_many_pages():
    turns = [float(k % 21 - 10) for k in range(1, 60) if abs(k % 21 - 10) >= 1]
    found = [kernels.skew(kernels.rotate(_picture(k, 13 * k), t)) for k, t in enumerate(turns)]
    assert np.mean([abs(f + t) < 0.6 for f, t in zip(found, turns, strict=True)]) > 0.9


def scene(corners, size=(900, 1300), noise=0):
    """A card with lines of text, laid on a table by its corners."""
    card = np.full((630, 1000, 3), 225, np.uint8)
    for y in range(120, 560, 60):
        card[y : y + 18, 380:900] = 60
    card[150:480, 60:300] = 120
    src, dst = np.array([[0, 0], [999, 0], [999, 629], [0, 629]], float), np.array(corners, float)
    rows = []
    for (x, y), (u, v) in zip(dst, src, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    m = np.append(np.linalg.solve(np.array(rows), src.ravel()), 1).reshape(3, 3)
    y, x = np.mgrid[0 : size[0], 0 : size[1]]
    p = np.stack([x, y, np.ones_like(x)], axis=-1) @ m.T
    u, v = p[..., 0] / p[..., 2], p[..., 1] / p[..., 2]
    out = np.full((*size, 3), 70, np.uint8)
    inside = (u >= 0) & (u <= 999) & (v >= 0) & (v <= 629)
    out[inside] = card[np.rint(v[inside]).astype(int), np.rint(u[inside]).astype(int)]
    return np.clip(out + np.random.default_rng(7).normal(0, noise, out.shape), 0, 255).astype(np.uint8) if noise else out


@pytest.mark.parametrize("corners, noise", [([(230, 120), (1120, 60), (1180, 760), (180, 690)], 0), ([(230, 120), (1120, 60), (1180, 760), (180, 690)], 6), ([(300, 150), (1000, 150), (1000, 590), (300, 590)], 0), ([(420, 60), (900, 90), (880, 850), (400, 830)], 3)])
def test_a_cards_outline_is_found(corners, noise):
    found = kernels.find_card(scene(corners, noise=noise))
    assert found is not None and np.hypot(*(found - np.array(corners)).T).max() < 6
    flat, done = kernels.correct_perspective(scene(corners, noise=noise))
    assert done and flat.shape == (630, 1000, 3) and abs(int(flat[40, 500, 0]) - 225) < 40


def test_no_outline_where_there_is_no_card():
    for x in (np.full((480, 640, 3), 200, np.uint8), np.zeros((1, 1, 3), np.uint8), np.random.default_rng(0).integers(0, 255, (300, 400, 3)).astype(np.uint8), scene([(100, 100), (200, 100), (200, 160), (100, 160)])):
        same, done = kernels.correct_perspective(x)
        assert not done and same is x
    assert not kernels.card_like(np.array([[0, 0], [100, 0], [100, 100], [0, 100]], float)) and kernels.card_like(np.array([[0, 0], [54, 0], [54, 86], [0, 86]], float))


def test_levelled_text_stays_level():
    for angle in (-6.0, 3.0):
        flat, turned = kernels.deskew(kernels.rotate(_picture(3, 5), angle))
        assert abs(turned + angle) < 0.6 and abs(kernels.skew(flat)) < 0.6
    x = _picture(3, 5)
    assert kernels.deskew(x)[1] == 0.0 and (kernels.rotate(x, 0.0) == x).all()


def test_area_means():
    x = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert (kernels.shrink(x, 4, 3) == np.rint(x.reshape(3, 2, 4, 2).mean((1, 3)))).all() and (kernels.shrink(x, 8, 6) == x).all()
    assert abs(kernels.shrink(x, 3, 5).mean() - x.mean()) < 0.6


def test_parts_of_a_mask():
    r = np.random.default_rng(1)
    p = r.integers(0, 50, (200, 2))
    mask = np.zeros((20, 30), bool)
    mask[2, 3:9] = mask[3, 9] = mask[10:15, 4] = mask[19, 29] = True
    assert sorted(map(len, kernels.parts(mask))) == [1, 5, 7] and kernels.parts(np.zeros((4, 4), bool)) == []


def test_measures_of_columns_are_those_of_the_kernels(spark):
    rng = np.random.default_rng(9)
    shapes = [(1, 1), (1, 5), (5, 1), (2, 2), (3, 3), (8, 8), (7, 13), (31, 4)]
    made = [(k, rng.integers(0, 256, h * w).tolist(), w) for k, (h, w) in enumerate(shapes)]
    df = spark.createDataFrame([*made, (99, [], 4), (100, None, 4)], "id int, p array<int>, w int")
    got = {r.id: r for r in df.select("id", *(c.alias(n) for n, c in pixels.quality(F.col("p"), F.col("w")).items())).collect()}
    for k, p, w in made:
        g = np.asarray(p, np.uint8).reshape(-1, w)
        if min(g.shape) == 1:  # the kernels repeat the edge of such pictures in both directions
            assert abs(got[k].contrast - g.std()) < 1e-9 and abs(got[k].brightness - g.mean()) < 1e-9 and got[k].noise == 0
            continue
        want = kernels.quality(np.repeat(g[..., None], 3, 2))
        assert np.allclose([got[k].blur, got[k].contrast, got[k].noise, got[k].brightness], want), shapes[k]
    assert got[99].blur is None and got[100].brightness is None


def test_outlines_amid_clutter_and_with_dents():
    corners = [(300, 150), (1000, 170), (990, 610), (290, 590)]
    x = scene(corners)
    for k in range(12):  # other things on the table
        x[20 + k * 70 : 60 + k * 70, 20 : 60 + 5 * k] = 40 + 15 * k
        x[700 + k * 15 : 708 + k * 15, 300:1100] = 90 + 10 * (k % 3)
    found = kernels.find_card(x)
    assert found is not None and np.hypot(*(found - np.array(corners)).T).max() < 6
    x = scene(corners)
    x[150:178, 600:640] = x[5, 5]  # a finger over the upper edge
    x[400:430, 970:1000] = x[5, 5]
    found = kernels.find_card(x)
    assert found is not None and np.hypot(*(found - np.array(corners)).T).max() < 6


def test_borders():
    shape = np.zeros((9, 12), bool)
    shape[1:8, 1:11] = True
    shape[3:6, 3:9] = False  # a hole is no border of the outside
    shape[4, 5] = True  # and what is in it another part
    found = sorted((kernels.border(p) for p in kernels.parts(shape)), key=len)
    assert found[0].tolist() == [[5, 4]] and sorted(map(tuple, found[1])) == [(1, 1), (1, 7), (10, 1), (10, 7)]
    assert kernels.polygon_area(found[1]) == 54 and kernels.inside(found[0][0], found[1]) and not kernels.inside(np.array([0.0, 0.0]), found[1])
    line = np.array([[k, 2] for k in range(5)])
    assert {tuple(p) for p in kernels.border(line)} == {(0, 2), (4, 2)}
    assert kernels.is_convex(np.array([[0, 0], [4, 0], [4, 4], [0, 4]])) and not kernels.is_convex(np.array([[0, 0], [4, 0], [1, 1], [0, 4]]))
