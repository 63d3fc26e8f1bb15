import numpy as np
import pytest

from veilspark.functions import raster as R
from veilspark.operators import connected, tiles


def _image(rng, width, height, patches):
    """Dark noise with skin-coloured patches, thin bridges and corners among them."""
    image = np.full((height, width, 4), 20, np.uint8)
    for _ in range(patches):
        w, h = (rng.integers(4, 60), rng.integers(4, 60)) if rng.random() < 0.6 else (rng.integers(30, 200), 5) if rng.random() < 0.5 else (5, rng.integers(30, 200))
        x, y = rng.integers(0, width), rng.integers(0, height)
        image[y:y + h, x:x + w, :3] = (232, 181, 140)
    image[..., 3] = 255
    return image


def _whole(image):
    return {(((y0 << 32) | 0) >> 32, x0, x1, y1, n) for x0, y0, x1, y1, n in R.components(R.dilate(R.cell_mask(image)))}


@pytest.mark.parametrize("width,height,side", [(1280, 800, 320), (203, 151, 48), (64, 64, 64), (7, 5, 4), (90, 30, 4)])
def test_tiles_give_what_one_task_gives(spark, width, height, side):
    rng = np.random.default_rng(width)
    images = {i: _image(rng, width, height, n) for i, n in enumerate((0, 3, 40))}
    df = spark.createDataFrame([(i, width, height, a.tobytes()) for i, a in images.items()], "image_id bigint, width int, height int, data binary")
    cut = tiles.cut(df, side)
    got = {}
    for r in tiles.regions(cut).collect():
        got.setdefault(r.image_id, set()).add((r.y0, r.x0, r.x1, r.y1, r.area))
        assert r.cells == R.cell_mask(images[r.image_id]).size
    assert got == {i: _whole(a) for i, a in images.items() if _whole(a)}
    boxes = sorted((r.image_id, r.first, *r.box, round(r.confidence, 9)) for r in tiles.face_candidates(cut).collect())
    want = [(i, *map(float, b[:4]), round(b[4], 9)) for i, a in images.items() for b in R.face_boxes(a)]
    assert [(b[0], *b[2:]) for b in boxes] == want


def test_small_images_are_stitched_and_large_ones_joined_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [(90, 30), (64, 64), (90, 30), (7, 5), (203, 151)]
    rows = [(i, w, h, _image(rng, w, h, 12).tobytes()) for i, (w, h) in enumerate(sizes)]
    cut = tiles.cut(spark.createDataFrame(rows, "image_id bigint, width int, height int, data binary"), 24)
    joined = sorted(map(tuple, tiles.regions(cut, stitch=0).collect()))
    both = sorted(map(tuple, tiles.regions(cut, stitch=200).collect()))

    def never(edges):
        raise AssertionError("small images need no table of edges")

    monkeypatch.setattr(tiles, "roots", never)
    assert joined and joined == both == sorted(map(tuple, tiles.regions(cut).collect()))


def test_no_tiles(spark):
    assert tiles.face_candidates(spark.createDataFrame([], tiles.TILE)).count() == 0


def test_tile_sides_off_the_grid_are_refused(spark):
    with pytest.raises(ValueError):
        tiles.cut(spark.createDataFrame([], "image_id bigint, width int, height int, data binary"), 10)


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 130), (130, 115), (7, 7), (115, 100)]
    got = {r.node: r.root for r in connected.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {130: 100, 115: 100}
