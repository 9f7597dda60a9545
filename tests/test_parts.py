"""Adaptive palettes, and JPEG files decoded by their restart segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from imagelake.operators import palette
from imagelake.sources import jpeg, jpegparts
from imagelake.sources.base import Image

RNG = np.random.default_rng(12)


def table(spark, images):
    rows = [(name, y, x, *map(int, v[y, x])) for name, v in images.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, r int, g int, b int").repartition(3)


def test_adaptive_palettes(spark):
    ramp = np.stack(np.meshgrid(np.arange(0, 256, 12), np.arange(0, 256, 12), indexing="ij") + (np.full((22, 22), 40),), 2)
    few = np.array([[[0, 0, 0], [255, 9, 3]], [[255, 9, 3], [7, 7, 200]]])
    dark = RNG.integers(0, 40, (20, 20, 3))
    images = {"ramp": ramp, "few": few, "dark": dark, "one": np.full((3, 3, 3), 77), "noise": RNG.integers(0, 256, (24, 24, 3))}
    px = table(spark, images)
    found = set()
    for parts in (1, 5):
        made, places = palette.adaptive(px.repartition(parts), ["image"], ["r", "g", "b"], 16)
        pals = {r.image: [tuple(c) for c in r.palette] for r in made.collect()}
        out = {(r.image, r.y, r.x): r.idx for r in palette.indexed(px, places, ["image"], ["r", "g", "b"]).collect()}
        found.add((str(sorted(pals.items())), str(sorted(out.items()))))
    assert len(found) == 1  # whatever the layout
    assert len(out) == sum(v.shape[0] * v.shape[1] for v in images.values()) and all(len(p) <= 16 for p in pals.values())
    assert pals["one"] == [(77.0, 77.0, 77.0)] and sorted(pals["few"]) == [(0.0, 0.0, 0.0), (7.0, 7.0, 200.0), (255.0, 9.0, 3.0)]
    for name, v in images.items():
        error = np.mean([sum((a - b) ** 2 for a, b in zip(pals[name][out[name, y, x]], v[y, x], strict=True)) for y in range(v.shape[0]) for x in range(v.shape[1])])
        level = np.minimum(v // 128, 1) * 128 + 64  # 8 colours by halves of each channel
        # Of noise, twice as many colours can take no more than about 0.63 of the error.
        assert error < np.mean(((level - v) ** 2).sum(2)) * (0.7 if name == "noise" else 0.5)
    assert palette.adaptive(px.limit(0), ["image"], ["r", "g", "b"], 4)[0].collect() == []


@pytest.mark.parametrize("channels, subsampling, restart", [("Y", "444", 3), ("RGB", "444", 5), ("RGB", "420", 2), ("RGB", "422", 7), ("RGB", "420", 4), ("RGB", "420", 0)])
def test_restart_segments_equal_the_decoder(spark, channels, subsampling, restart):
    smooth = np.add.outer(np.arange(45) * 3, np.arange(61) * 2)[:, :, None] % 256 + RNG.integers(0, 30, (45, 61, len(channels)))
    data = jpeg.encode(Image("jpeg", list(channels), "unorm8", np.clip(smooth, 0, 255).astype(np.uint8)), 80, subsampling, restart=restart)
    want = jpeg.decode(data, interpolate=False)
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data))], "path string, content binary")
    index = jpegparts.restart_index(files).collect()
    units = -(-45 // (16 if subsampling == "420" else 8)) * -(-61 // (8 if subsampling == "444" else 16))
    assert len(index) == 2 * (-(-units // restart) if restart else 1)
    out = jpegparts.decode_restarts(files, tasks=4).filter("path = 'b'").collect()
    assert all(r.error is None for r in out)
    assert {(r.y, r.x, r.channel): r.value for r in out} == {(y, x, c): want.samples[y, x, k] for y in range(45) for x in range(61) for k, c in enumerate(want.channels)} and len(out) == want.samples.size


def test_restart_segments_of_other_files(spark):
    v = RNG.integers(0, 256, (40, 40, 1)).astype(np.uint8)
    good = jpeg.encode(Image("jpeg", ["Y"], "unorm8", v), restart=5)
    progressive = jpeg.encode(Image("jpeg", ["Y"], "unorm8", v), progressive=True)
    at = good.rindex(b"\xff\xd3") + 2
    hurt = good[:at] + b"\xff\0" * ((len(good) - at - 2) // 2) + good[-2:]
    rows = [("progressive", progressive), ("cut", good[: len(good) // 2]), ("none", None), ("hurt", hurt)]
    files = spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in rows], "path string, content binary")
    out = jpegparts.decode_restarts(files, tasks=3)
    count = {r.path: (r.good, r.bad) for r in out.groupBy("path").agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad")).collect()}
    assert count["progressive"] == (1600, 0) and count["cut"] == (0, 1) and count["none"] == (0, 1)
    assert count["hurt"][0] >= 4 * 5 * 64 and count["hurt"][1] <= 1
