"""Planner, lowering, catalogue, data source and stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from imagelake.plans.frame import ImageFrame
from imagelake.plans.planner import Capabilities, Description, PlanError, plan
from imagelake.sources import catalog, dds, png
from imagelake.sources.base import Image


def names(p):
    return [s.name for s in p.steps]


CAPS = {k: Capabilities.of(c) for k, c in catalog.REGISTRY.codecs.items()}


def test_identity_plan_is_empty():
    p = plan(Description(8, 8, ("R", "G", "B")), CAPS["png"], "strict", crop=(0, 0, 8, 8), resize=(8, 8))
    assert p.steps == [] and p.losses == []


def test_order_and_losses():
    d = Description(8, 6, ("R", "G", "B", "A"), "float32", orientation="flip_y", parts=2, metadata=("x", "x", "y"), subsampled=("B",))
    p = plan(d, CAPS["jpeg"], "preview", crop=(1, 1, 4, 4), resize=(2, 2))
    assert names(p) == ["select_part", "change_grid", "select_channels", "convert_sample", "crop", "resample", "orient", "drop_metadata", "drop_metadata"]
    assert {x.category for x in p.losses} == {"topology", "sampling", "channel", "dynamic_range", "orientation", "metadata"}
    with pytest.raises(PlanError):
        plan(d, CAPS["jpeg"], "preserve")
    assert p.fingerprint() == plan(d, CAPS["jpeg"], "preview", crop=(1, 1, 4, 4), resize=(2, 2)).fingerprint()


def test_rules():
    assert names(plan(Description(4, 4, ("R", "G", "B", "A"), encoding="bc7"), Capabilities(("unorm8",), (4,), ("bc7",)))) == ["transcode"]
    assert plan(Description(4, 4, ("Y",)), Capabilities(("unorm8",), (3, 4))).target.channels == ("R", "G", "B")
    assert plan(Description(4, 4, ("R", "G", "B")), CAPS["dds"]).target.channels == ("R", "G", "B", "A")
    assert plan(Description(4, 4, ("R", "G", "B"), "float32"), CAPS["hdr"], "preview").target.encoding == "rgbe"
    assert plan(Description(4, 4, ("Y",)), CAPS["hdr"], "preview").target.channels == ("R", "G", "B")
    assert plan(Description(4, 4, ("R",), "float16"), CAPS["png"], "preview").target.sample == "unorm16"
    for bad in (dict(resize=(0, 1)), dict(crop=(0, 0, 9, 1)), dict(encoding="bc7"), dict(policy="none")):
        with pytest.raises(PlanError):
            plan(Description(4, 4, ("R", "G", "B", "A")), CAPS["dds"], **bad)


def wide(spark, v, channels):
    rows = [("a", y, x, *map(int, v[y, x])) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, " + ", ".join(f"{c} int" for c in channels))


def test_frame_crops_and_orients(spark):
    v = np.arange(48).reshape(4, 4, 3) * 5
    frame = ImageFrame(wide(spark, v, "RGB"), Description(4, 4, ("R", "G", "B"), orientation="flip_x")).crop(1, 1, 2, 3)
    out = frame.pixels(catalog.REGISTRY.codecs["png"], "preview")
    got = {(r.y, r.x): (r.R, r.G, r.B) for r in out.collect()}
    want = v[1:4, 1:3][:, ::-1]
    assert got == {(y, x): tuple(want[y, x]) for y in range(3) for x in range(2)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_frame_resizes_flat_images(spark):
    v = np.full((6, 6, 1), 77)
    out = ImageFrame(wide(spark, v, "L"), Description(6, 6, ("Y",))).resize(3, 2).pixels(catalog.REGISTRY.codecs["png"], "preview").collect()
    assert len(out) == 6 and {r.L for r in out} == {77}


def test_palette_expansion(spark):
    v = np.array([[[0], [1]], [[2], [1]]])
    palette = spark.createDataFrame([(i, i * 10, i * 20, i * 30) for i in range(3)], "I int, R int, G int, B int")
    frame = ImageFrame(wide(spark, v, "I").withColumn("I", F.col("I")), Description(2, 2, ("I",), "uint8", indexed=True), palette=palette)
    p = frame.plan(catalog.REGISTRY.codecs["png"], "preview")
    assert names(p)[0] == "expand_indexed" and p.target.channels == ("R", "G", "B")


def test_decode_encode_frames(spark):
    v = np.arange(60).reshape(4, 5, 3).astype(np.uint8)
    data = png.encode(Image("png", list("RGB"), "unorm8", v))
    files = spark.createDataFrame([("a", bytearray(data), 1), ("b", bytearray(data[:50]), 2), ("c", None, 3)], "path string, content binary, width int")
    images = catalog.decode_images(files).cache()
    rows = {r.path: r for r in images.collect()}
    assert rows["a"].samples == v.ravel().tolist() and rows["b"].error.code == "TruncatedChunk" and rows["c"].error is not None
    px = {(r.y, r.x, r.channel): r.value for r in catalog.to_pixels(images).collect()}
    assert px[2, 3, "G"] == v[2, 3, 1] and len(px) == 60
    back = {r.path: r for r in catalog.encode_images(images, "png").collect()}
    assert (png.decode(bytes(back["a"].content)).samples == v).all() and back["b"].error
    assert [r.type for r in catalog.png_chunks(files).orderBy("path", "ordinal").collect()] == ["IHDR", "IDAT", "IEND", "IHDR"]
    assert [r[0] for r in files.select(catalog.probe(F.col("content"))).collect()] == ["png", "png", None]


def test_texture_source_prunes(spark, tmp_path):
    base = np.arange(256).reshape(8, 8, 4).astype(np.uint8)
    im = Image("dds", list("RGBA"), "unorm8", base, others={(0, 0, 0, 1): base[::2, ::2].copy(), (0, 0, 0, 2): base[::4, ::4].copy()})
    (tmp_path / "t.dds").write_bytes(dds.encode_dds(im))
    (tmp_path / "t.ktx2").write_bytes(dds.encode_ktx2(im, compress=True))
    catalog.register(spark)
    for name in ("t.dds", "t.ktx2"):
        t = spark.read.format("texture").load(f"{tmp_path}/{name}")
        assert t.count() == 4 * (64 + 16 + 4) and t.rdd.getNumPartitions() == 3
        small = t.filter("level = 2")
        assert small.rdd.getNumPartitions() == 1
        assert {(r.y, r.x, r.channel): r.value for r in small.collect()}[1, 1, "B"] == base[4, 4, 2]


def test_texture_source_takes_folders_and_lists(spark, tmp_path):
    for k, name in enumerate(("a.dds", "sub/b.ktx2", "c.dds", "readme.txt")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        im = Image("dds", list("RGBA"), "unorm8", np.full((4, 4, 4), k, np.uint8), metadata=[])
        (tmp_path / name).write_bytes(dds.encode_ktx2(im) if "ktx2" in name else dds.encode_dds(im) if "dds" in name else b"text")
    catalog.register(spark)
    whole = spark.read.format("texture").load(str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.value) for r in whole.collect()} == {("a.dds", 0), ("b.ktx2", 1), ("c.dds", 2)} and whole.rdd.getNumPartitions() == 3
    two = spark.read.format("texture").load(f"{tmp_path}/a.dds, file://{tmp_path}/c.dds")
    assert two.count() == 128 and two.select("path").distinct().count() == 2


def test_unknown_steps_are_refused(spark):
    frame = ImageFrame(wide(spark, np.zeros((2, 2, 3), int), "RGB"), Description(2, 2, ("R", "G", "B")))
    p = frame.plan(catalog.REGISTRY.codecs["png"])
    for step in ("sharpen", "translate_metadata", "apply_supercompression"):
        with pytest.raises(PlanError):
            frame.run(p.then(step))
    assert frame.run(p.then("preserve_metadata", "exif")).count() == 4


def test_subsampled_frames(spark):
    stored = wide(spark, np.array([[[10], [20]], [[30], [40]]]), "L").withColumns({"x": F.col("x") * 2, "y": F.col("y") * 2})
    frame = ImageFrame(stored, Description(5, 3, ("Y",), subsampled=(2, 2)))
    assert names(frame.plan(catalog.REGISTRY.codecs["png"])) == ["change_grid"]
    out = {(r.y, r.x): r.L for r in frame.pixels(catalog.REGISTRY.codecs["png"]).filter("x < 4").collect()}
    assert out == {(y, x): 10 + x // 2 * 10 + y // 2 * 20 for y in range(3) for x in range(4)}
    v = np.arange(16).reshape(4, 4)
    px = wide(spark, np.stack([v, v, v], 2), "RGB").withColumn("B", F.when((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0), F.col("B")))
    frame = ImageFrame(px, Description(4, 4, ("R", "G", "B"), subsampled=("B",)))
    out = {(r.y, r.x): (r.R, r.B) for r in frame.pixels(catalog.REGISTRY.codecs["png"]).collect()}
    assert out == {(y, x): (v[y, x], v[y - y % 2, x - x % 2]) for y in range(4) for x in range(4)}


@pytest.mark.parametrize("encoding", ["bc1", "bc2", "bc3", "bc4", "bc5"])
def test_frames_encode_and_decode_blocks(spark, encoding):
    """As the image codec does, with edges that are no whole blocks."""
    from imagelake.sources import texture

    channels = {"bc4": ("R",), "bc5": ("R", "G")}.get(encoding, ("R", "G", "B", "A"))
    v = np.random.default_rng(3).integers(0, 256, (6, 7, len(channels))).astype(np.uint8)
    frame = ImageFrame(wide(spark, v, channels), Description(7, 6, channels))
    coded = frame.pixels(catalog.REGISTRY.codecs["dds"], "preview", encoding)
    raw = b"".join(bytes(r.element) for r in coded.orderBy("brow", "bcol").collect())
    assert raw == texture.encode_image(encoding, v)
    back = ImageFrame(coded, Description(7, 6, channels, encoding=encoding)).pixels(catalog.REGISTRY.codecs["webp" if len(channels) == 4 else "png"], "preview")
    want = texture.decode_image(encoding, raw, 7, 6)
    if encoding == "bc5":  # as grey: no such channels
        want = want[:, :, :2]
    got = {(r.y, r.x): tuple(r[c] for c in channels) for r in back.collect()} if set(channels) <= set(back.columns) else None
    assert got is None or got == {(y, x): tuple(want[y, x]) for y in range(6) for x in range(7)}
    same = ImageFrame(coded, Description(7, 6, channels, encoding=encoding)).pixels(catalog.REGISTRY.codecs["dds"], "strict")
    assert same.columns == ["image", "brow", "bcol", "element"] and same.exceptAll(coded).count() == 0


@pytest.mark.parametrize("encoding", ["b5g6r5", "b5g5r5a1", "r10g10b10a2", "r11g11b10f", "rgb9e5", "rgbe"])
def test_frames_pack_and_unpack(spark, encoding):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 256, (3, 4, 4))
    codec = catalog.REGISTRY.codecs["hdr" if encoding == "rgbe" else "dds"]
    frame = ImageFrame(wide(spark, v, "RGBA"), Description(4, 3, ("R", "G", "B", "A")))
    coded = frame.pixels(codec, "preview", encoding)
    assert coded.columns == ["image", "y", "x", "element"] and coded.count() == 12
    channels = ("R", "G", "B", "A") if encoding in ("b5g5r5a1", "r10g10b10a2") else ("R", "G", "B")
    back = ImageFrame(coded, Description(4, 3, channels, "float32", encoding=encoding)).pixels(catalog.REGISTRY.codecs["exr"], "preview")
    step = {"b5g6r5": 31, "b5g5r5a1": 31, "r10g10b10a2": 1023, "r11g11b10f": 32, "rgb9e5": 256, "rgbe": 128}[encoding]
    assert all(abs(r[c] - v[r.y, r.x, "RGBA".index(c)] / 255) <= 1.01 / step for r in back.collect() for c in "RGB")


def test_neighbours_across_bands(spark, monkeypatch):
    """One shuffle, and the same neighbours however images are cut into bands."""
    from imagelake.functions import predict

    v = np.random.default_rng(4).integers(0, 256, (23, 5))
    px = wide(spark, v[:, :, None], "v")
    at = lambda y, x: int(v[y, x]) if y >= 0 and x >= 0 else None
    want = {(y, x): (at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)) for y in range(23) for x in range(5)}
    for band in (1, 2, 7, 64):
        monkeypatch.setattr(predict, "BAND", band)
        near = predict.with_neighbours(px, "image")
        assert near._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert {(r.y, r.x): (r.left, r.up, r.corner) for r in near.collect()} == want


def test_convert_files(spark):
    from imagelake.plans.convert import Request, convert_files
    from imagelake.sources import webp
    from imagelake.sources.options import OptionError

    v = np.random.default_rng(2).integers(0, 256, (9, 12, 4)).astype(np.uint8)
    noisy = png.encode(Image("png", list("RGBA"), "unorm8", v))
    grey = png.encode(Image("png", ["Y"], "unorm16", (v[:, :, :1].astype(np.uint16) << 8)))
    indexed = png.encode(Image("png", ["I"], "unorm8", v[:, :, :1] % 7, palette=np.arange(21).reshape(7, 3) * 10))
    files = spark.createDataFrame([("a/n.png", bytearray(noisy)), ("a/g.png", bytearray(grey)), ("a/i.png", bytearray(indexed)), ("a/bad", bytearray(noisy[:60])), ("a/none", None)], "path string, content binary")
    out = {r.path: r for r in convert_files(files, Request("webp", crop=(2, 1, 8, 6))).collect()}
    assert (webp.decode(bytes(out["a/n.png"].content)).samples == v[1:7, 2:10]).all() and out["a/n.png"].steps == "crop(2, 1, 8, 6)"
    assert (webp.decode(bytes(out["a/g.png"].content)).samples[:, :, 1] == np.rint(v[1:7, 2:10, 0].astype(int) * 256 / 65535 * 255)).all() and "numeric" in out["a/g.png"].losses
    assert (webp.decode(bytes(out["a/i.png"].content)).samples[:, :, :3] == (np.arange(21).reshape(7, 3) * 10)[v[1:7, 2:10, 0] % 7]).all()
    assert out["a/bad"].content is None and "png" in out["a/bad"].error and out["a/none"].error
    assert {r.error is None for r in convert_files(files, Request("webp", policy="strict")).filter("path = 'a/n.png'").collect()} == {True}
    assert "strict" in convert_files(files, Request("jpeg", policy="strict")).filter("path = 'a/n.png'").head().error
    small = {r.path: r for r in convert_files(files.limit(2), Request("jpeg", target_bytes=900)).collect()}
    assert all(len(r.content) <= 900 and r.reached and 1 <= r.quality <= 100 for r in small.values())
    tiny = convert_files(files.limit(1), Request("jpeg", target_bytes=10)).head()
    assert not tiny.reached and tiny.quality == 1
    for bad in (Request("png", target_bytes=9), Request("jpeg", target_bytes=0), Request("gif"), Request("jpeg", options=(("x", "y"),)), Request("jpeg", options=(("quality", "3"),), target_bytes=9)):
        with pytest.raises(OptionError):
            convert_files(files, bad)


def test_whole_file_steps_equal_frames(spark):
    """Crop, resize, orientation and sample types: the same by rows of pixels and by whole images."""
    from imagelake.plans import convert

    v = np.random.default_rng(9).integers(0, 256, (7, 9, 3)).astype(np.uint8)
    for orientation in ("identity", "rotate90", "flip_y", "transverse"):
        d = Description(9, 7, ("R", "G", "B"), orientation=orientation)
        p = plan(d, CAPS["png"], "preview", resize=(4, 5), crop=(1, 1, 7, 6))
        whole = convert.carried_out(Image("png", list("RGB"), "unorm8", v, orientation=orientation), p).samples
        rows = ImageFrame(wide(spark, v, "RGB"), d).run(p).collect()
        assert len(rows) == whole.shape[0] * whole.shape[1] and all(abs(int(whole[r.y, r.x, k]) - r[c]) <= 1 for r in rows for k, c in enumerate("RGB"))


def test_command_line(spark, tmp_path, capsys):
    from imagelake.__main__ import main

    v = np.random.default_rng(3).integers(0, 256, (16, 16, 3)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png.encode(Image("png", list("RGB"), "unorm8", v)))
    (tmp_path / "in" / "b.png").write_bytes(b"no image")
    assert main(["--formats"]) == 0 and "quality: 1 to 100" in capsys.readouterr().out
    assert main([f"{tmp_path}/in", f"{tmp_path}/out", "--to", "jpeg", "--resize", "8x4", "--target-size", "1K"]) == 1
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.jpg"] and "b.png" in capsys.readouterr().out
    data = (tmp_path / "out" / "a.jpg").read_bytes()
    assert len(data) <= 1024 and catalog.REGISTRY.codecs["jpeg"].decode(data).samples.shape == (4, 8, 3)
    assert main([f"{tmp_path}/in/a.png", f"{tmp_path}/out", "--to", "png", "--option", "filter=sub", "--crop", "1,2,3,4"]) == 0
    assert (png.decode((tmp_path / "out" / "a.png").read_bytes()).samples == v[2:6, 1:4]).all()
    for bad in (["--crop", "1,2"], ["--resize", "8"], ["--option", "quality"], ["--option", "quality=0"], ["--target-size", "many"]):
        assert main([f"{tmp_path}/in", f"{tmp_path}/out", "--to", "jpeg", *bad]) == 2
    assert main([]) == 2


def test_stream(spark, tmp_path):
    from imagelake.streaming.ingest import image_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png.encode(Image("png", ["Y"], "unorm8", np.zeros((3, 2, 1), np.uint8))))
    q = image_stream(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("images").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.format, r.width, r.height) for r in spark.table("images").collect()] == [("png", 2, 3)]


def test_target_size_takes_the_best_of_all_qualities():
    """Sizes that fall where quality rises don't mislead the search, and bounds of sizes hold."""
    from imagelake.plans.convert import Request, converted
    from imagelake.sources import jpeg

    rng, dips = np.random.default_rng(3), 0
    for k in range(24):
        image = Image("png", list("RGB"), "unorm8", rng.integers(0, 256, (8, 8, 3) if k % 2 else (9, 7, 3)).astype(np.uint8))
        sizes = [len(jpeg.encode(image, quality=q)) for q in range(1, 101)]
        least = list(jpeg.least_sizes(image, range(1, 101)))
        assert all(a <= b for a, b in zip(least, sizes, strict=True)) and sum(sizes) - sum(least) < 400
        dips += sum(a > b for a, b in zip(sizes, sizes[1:]))
        for target in (sizes[0] - 1, sizes[30], sizes[60], sizes[80]):
            fits = [q for q, size in enumerate(sizes, 1) if size <= target]
            made = converted(png.encode(image), Request("jpeg", target_bytes=target))
            assert (made.quality, made.reached) == ((fits[-1], True) if fits else (1, False))
            assert len(made.content) == sizes[made.quality - 1]
    assert dips
