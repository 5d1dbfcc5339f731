"""Work on pixels against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.operators import elements as E
from sheetloom.operators import images as I

RNG = np.random.default_rng(11)
IMAGE = RNG.integers(0, 256, (17, 23)).astype(np.uint8)


def mirrored(image, y, x):
    fold = lambda k, n: -k if k < 0 else 2 * (n - 1) - k if k >= n else k
    return int(image[fold(y, image.shape[0]), fold(x, image.shape[1])])


def test_filters():
    lap, grad = np.zeros(IMAGE.shape), np.zeros(IMAGE.shape)
    for y in range(17):
        for x in range(23):
            a = lambda dy, dx: mirrored(IMAGE, y + dy, x + dx)  # noqa: B023, E731
            lap[y, x] = a(-1, 0) + a(1, 0) + a(0, -1) + a(0, 1) - 4 * a(0, 0)
            gx = sum(w * (a(d, 1) - a(d, -1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(w * (a(1, d) - a(-1, d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            grad[y, x] = (gx * gx + gy * gy) ** 0.5
    assert np.allclose(I.laplacian(IMAGE), lap) and np.allclose(I.gradient(IMAGE), grad)
    assert I.entropy(np.zeros((4, 4), np.uint8)) == pytest.approx(0, abs=1e-6) and I.entropy(np.arange(256, dtype=np.uint8)) == pytest.approx(8, abs=1e-6)
    assert (I.scaled(np.array([[0, 100, 250]], np.uint8)) == [[10, 130, 255]]).all()
    assert (I.gray(np.dstack([IMAGE] * 3)) == IMAGE).all()


def test_thresholds_and_contrast():
    two = np.where(IMAGE > 128, 200, 40).astype(np.uint8)
    level, binary = I.otsu(two)
    assert 40 <= level < 200 and set(np.unique(binary)) == {0, 255} and ((binary == 255) == (two == 200)).all()
    m = I.median(IMAGE, 3)
    assert m[5, 5] == np.median(IMAGE[4:7, 4:7]) and m.shape == IMAGE.shape
    dull = (IMAGE // 8 + 100).astype(np.uint8)
    assert I.equalised(dull).std() > dull.std() and I.equalised(dull).shape == dull.shape
    assert I.sharpened(dull).astype(int).std() > dull.astype(int).std()
    assert min(I.prepared(IMAGE).shape) >= 300 and I.enhanced(np.dstack([IMAGE] * 3)).shape == IMAGE.shape
    assert I.enhanced(np.full((1, 1), 7, np.uint8)).shape == (1, 1)


@pytest.mark.parametrize("size", [1, 2, 5, 8])
def test_opening_keeps_what_is_long_enough(size):
    row = (RNG.random((6, 40)) < 0.7).astype(np.uint8) * 255
    expected = np.zeros_like(row)
    for y in range(6):
        for x in range(40 - size + 1):
            if row[y, x : x + size].all():
                expected[y, x : x + size] = 255
    assert (I.opened(row, size, 1)[:, size:-size] == expected[:, size:-size]).all()
    assert (I.opened(row.T, size, 0) == I.opened(row, size, 1).T).all()


def test_boxes_and_density():
    mask = np.zeros((10, 12), np.uint8)
    mask[1:4, 1:4] = mask[4, 4] = mask[8, 2:9] = mask[0, 11] = 9
    mask[6, 1] = mask[6, 3] = mask[7, 2] = 1
    assert sorted(I.boxes(mask)) == [(1, 1, 4, 4, 10), (1, 6, 8, 3, 10), (11, 0, 1, 1, 1)]
    assert I.line_density(mask, 1, 1, 3, 3) == 1.0 and I.line_density(mask, 0, 0, 0, 3) == 0.0
    page = np.full((60, 60), 255, np.uint8)
    page[20:30, 15:40] = 0
    assert I.refined(page, 5, 5, 50, 50) == (15, 20, 25, 10) and I.refined(page, 0, 0, 10, 10) == (0, 0, 10, 10)


def test_tables_on_pages(spark):
    page = np.zeros((200, 300), np.uint8)
    page[50, 40:200] = page[150, 40:200] = page[50:151, 40] = page[50:151, 199] = 255
    pages = spark.createDataFrame([(1, 1, 200, 300, 1, bytearray(page.tobytes())), (1, 2, 200, 300, 1, bytearray(bytes(60_000)))], "doc_id long, page_number int, height int, width int, channels int, pixels binary")
    found = E.regions(I.line_tables(pages), "line_table").collect()
    assert [(r["page_number"], r["area"]) for r in found] == [(1, 159.0 * 100)]
    assert 0.02 < found[0]["line_density"] < 0.05
    got = {r["page_number"]: r for r in I.measures(pages).collect()}
    assert got[2]["flat"] and got[2]["soft"] and not got[2]["noisy"]
    assert I.enhance(pages).where(F.length("pixels") == 60_000).count() == 2
