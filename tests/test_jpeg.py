"""JPEG files in strips against Spark's own decoder."""

import os

import numpy as np
import pytest

from weftline.functions import jpeg
from weftline.plans.batch import run_batch
from weftline.sources import sinks
from weftline.sources.images import pixels_of, read_images

GEN = np.random.default_rng(5)


def frame(spark, *rasters, holes=()):
    rows = [(i, x, y, int(c)) for i, r in enumerate(rasters) for (y, x), c in np.ndenumerate(r) if (i, x, y) not in holes]
    return spark.createDataFrame(rows, "image_id long, x int, y int, c long")


def packed(rgb):
    rgb = np.asarray(rgb, np.int64)
    return rgb[..., 0] << 24 | rgb[..., 1] << 16 | rgb[..., 2] << 8 | 255


def smooth(h, w):
    y, x = np.mgrid[:h, :w]
    return packed(np.stack([128 + 100 * np.sin(x / 17), 128 + 90 * np.cos(y / 23), (x + y) % 200 + 20 * np.sin(y / 9) + 20], -1))


def noise(h, w):
    return packed(GEN.integers(0, 256, (h, w, 3)))


def decoded(spark, folder, encoded):
    folder.mkdir()
    for r in encoded:
        (folder / f"{r.image_id}.jpg").write_bytes(r.data)
    images = read_images(spark, str(folder))
    assert images.filter("not ok").count() == 0
    names = {r.image_id: int(os.path.basename(r.path)[:-4]) for r in images.select("image_id", "path").collect()}
    out = {}
    for image_id, pdf in pixels_of(images).toPandas().groupby("image_id"):
        out[names[image_id]] = sinks.raster_of(pdf)
    return out


def furthest(a, b):
    return max(int(np.abs((a >> s & 255) - (b >> s & 255)).max()) for s in (24, 16, 8))


def test_strips_decode_within_the_steps(spark, tmp_path):
    """At quality 100 every step is 1, so what is left is rounding; sides that aren't multiples of 8 or 64 are there."""
    rasters = [noise(200, 30), noise(64, 8), smooth(65, 130), noise(1, 1), np.full((129, 9), packed([255, 0, 0])), noise(8, 70)]
    encoded = sinks.encode_images(frame(spark, *rasters), "jpg", 100).collect()
    assert {(r.image_id, r.width, r.height) for r in encoded} == {(i, r.shape[1], r.shape[0]) for i, r in enumerate(rasters)}
    got = decoded(spark, tmp_path / "best", encoded)
    for i, want in enumerate(rasters):
        assert got[i].shape == want.shape and furthest(got[i], want) <= 4, i
    # coarser files are smaller, and smooth images stay close
    sizes = {q: len(sinks.encode_images(frame(spark, smooth(65, 130)), "jpeg", q).first().data) for q in (100, 75, 10)}
    assert sizes[10] < sizes[75] < sizes[100]
    got = decoded(spark, tmp_path / "usual", sinks.encode_images(frame(spark, smooth(65, 130)), "jpeg").collect())
    assert np.abs((got[0] >> 16 & 255) - (rasters[2] >> 16 & 255)).mean() < 4


def test_holes_are_black(spark, tmp_path):
    """A strip that is narrower than its image, short or missing is filled before it is transformed."""
    raster = smooth(200, 19)
    holes = {(0, x, y) for x in range(19) for y in range(64, 128)} | {(0, x, y) for x in range(11, 19) for y in range(128, 200)} | {(0, x, y) for x in range(19) for y in range(50, 64)}
    want = raster.copy()
    for _, x, y in holes:
        want[y, x] = 255
    got = decoded(spark, tmp_path / "f", sinks.encode_images(frame(spark, raster, holes=holes), "jpg", 100).collect())
    assert got[0].shape == want.shape and furthest(got[0], want) <= 4


def test_kinds_side_by_side(spark):
    rasters = [noise(70, 9), noise(70, 9), noise(70, 9), noise(70, 9)]
    df = frame(spark, *rasters).selectExpr("*", "element_at(array('png', 'jpg', 'bmp', 'jpeg'), cast(image_id as int) + 1) AS own")
    begin = {r.image_id: bytes(r.data[:2]) for r in sinks.encode_images(df, df.own).collect()}
    assert begin == {0: b"\x89P", 1: b"\xff\xd8", 2: b"BM", 3: b"\xff\xd8"}


def test_strips_together_are_strips_alone():
    """Pieces of a strip and many strips in a piece give the same bytes, restart markers by line included."""
    strips = [np.stack([r >> s & 255 for s in (24, 16, 8)], -1) for r in (noise(64, 30), smooth(64, 130), noise(1, 1), np.full((64, 9), packed([255, 0, 0])), noise(44, 70))]
    for quality in (10, 100):
        alone = []
        for own in strips:
            lines = [jpeg._bits(jpeg._coefficients(own[i : i + 8], quality), np.array([-(-own.shape[1] // 8)]))[0] + bytes([0xFF, 0xD0 + i // 8 % 8]) for i in range(0, len(own), 8)]
            alone.append(b"".join(lines))
        for piece in (1, 1000, 1 << 16):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(jpeg, "PIECE", piece)
                assert jpeg.strips(strips, quality) == alone


def test_codes_and_steps():
    for kind in (0, 1):
        code, bits = jpeg.codes(kind)
        for of in (0, 1):
            own = [format(c, f"0{n}b") for c, n in zip(code[of], bits[of], strict=True) if n]
            assert len(own) == len(set(own)) == (162 if kind else 12) and max(map(len, own)) <= 16
            assert not any(a != b and b.startswith(a) for a in own for b in own) and not any("0" not in c for c in own)
    assert sorted(jpeg.ZIGZAG) == list(range(64)) and list(jpeg.ZIGZAG[:10]) == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert (jpeg.steps(100) == 1).all() and jpeg.steps(50)[0, 0] == 16 and jpeg.steps(1).max() == 255
    for quality in (0, 101):
        with pytest.raises(ValueError):
            jpeg.steps(quality)


def test_long_runs_of_zeros(spark, tmp_path):
    """Coefficients far from each other need codes for sixteen zeros, once and more often, for both kinds of components."""
    blocks = []
    for ks in ([63], [16, 33], [1, 62], [17, 49, 63], [5]):
        for part in range(3):
            values = np.zeros(64)
            values[jpeg.ZIGZAG[ks]] = 60
            planes = np.full((3, 8, 8), 0.0)
            planes[part] = jpeg.COSINES.T @ values.reshape(8, 8) @ jpeg.COSINES
            rgb = np.einsum("ij,jyx->yxi", np.linalg.inv(jpeg.FROM_RGB), planes) + 128
            blocks.append(np.rint(np.clip(rgb, 0, 255)))
    raster = packed(np.concatenate(blocks, 1))
    whole = jpeg._coefficients(np.stack([raster >> s & 255 for s in (24, 16, 8)], -1), 75)
    runs = np.diff(np.flatnonzero(whole[0, 0]), prepend=0)
    assert runs.max() > 16
    got = decoded(spark, tmp_path / "f", sinks.encode_images(frame(spark, raster), "jpg", 75).collect())
    back = jpeg._coefficients(np.stack([got[0] >> s & 255 for s in (24, 16, 8)], -1), 75)
    assert (np.abs(back - whole) <= 1).all() and (back == whole).mean() > 0.99


def test_too_large_for_the_format(spark, tmp_path):
    df = spark.createDataFrame([(1, 70000, 0, 255), (2, 0, 0, 255)], "image_id long, x int, y int, c long")
    encoded = sinks.encode_images(df, "jpg")
    assert {r.image_id: r.data is None for r in encoded.collect()} == {1: True, 2: False}
    done = sinks.write_files(encoded.selectExpr("image_id || '.jpg' AS name", "data"), str(tmp_path)).collect()
    assert {r.name: r.ok for r in done} == {"1.jpg": False, "2.jpg": True} and os.listdir(tmp_path) == ["2.jpg"]


def test_batch_writes_jpeg(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(sinks.encode_images(frame(spark, noise(20, 20)), "jpg").first().data)
    rows = run_batch(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert [(r.output, r.ok) for r in rows] == [("a_normalized.jpg", True)]
    assert read_images(spark, str(tmp_path / "out")).first().ok
