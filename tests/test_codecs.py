"""Codecs: round trips, formats read back by independent means, and inputs that must be rejected."""

import struct
import zlib

import numpy as np
import pytest

from imagelake.sources import dds, exr, hdr, jpeg, png, webp
from imagelake.sources.base import FormatError, Image, Limits
from imagelake.sources.catalog import REGISTRY

rng = np.random.default_rng(7)


def ramp(w, h, n, top=255, kind=np.uint8):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([(x * (3 + c) + y * (5 - c)) % (top + 1) for c in range(n)], 2).astype(kind)


@pytest.mark.parametrize("channels,depth", [("Y", 1), ("Y", 2), ("Y", 4), ("Y", 8), ("Y", 16), ("YA", 8), ("RGB", 8), ("RGB", 16), ("RGBA", 8), ("RGBA", 16)])
@pytest.mark.parametrize("row_filter", [None, 0, 1, 2, 3, 4])
def test_png_round_trip(channels, depth, row_filter):
    im = Image("png", list(channels), f"unorm{depth}", ramp(17, 13, len(channels), (1 << depth) - 1, np.uint16))
    out = png.decode(png.encode(im, row_filter=row_filter))
    assert (out.samples == im.samples).all() and out.channels == im.channels and out.sample == im.sample


def test_png_palette_and_interlace():
    im = Image("png", ["I"], "unorm4", ramp(15, 9, 1, 15), palette=rng.integers(0, 256, (16, 3)).astype(np.uint8))
    out = png.decode(png.encode(im))
    assert (out.samples == im.samples).all() and (out.palette == im.palette).all()
    v = ramp(11, 10, 3)
    raw = b"".join(b"\0" + v[y, x0::dx].tobytes() for x0, y0, dx, dy in png.ADAM7 for y in range(y0, 10, dy) if x0 < 11)
    chunk = lambda k, p: struct.pack(">I", len(p)) + k + p + struct.pack(">I", zlib.crc32(k + p))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 11, 10, 8, 2, 0, 0, 1)) + chunk(b"tEXt", b"Title\0A caf\xe9") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    out = png.decode(data)
    assert (out.samples == v).all() and out.metadata == [("png.text", "Title", "A café")]


@pytest.mark.parametrize("kind", ["float16", "float32", "uint32"])
@pytest.mark.parametrize("compression", ["none", "rle", "zips", "zip", "piz"])
def test_exr_round_trip(kind, compression):
    v = ramp(13, 37, 4, 900, np.dtype(kind))
    v[:, :5] = v[0, 0]
    im = Image("exr", ["R", "G", "B", "A"], kind, v, window=(-10, -5))
    out = exr.decode(exr.encode(im, compression))
    assert out.channels == ["A", "B", "G", "R"] and out.window == (-10, -5)
    assert (out.samples == v[:, :, [3, 2, 1, 0]]).all()


@pytest.mark.parametrize("compression", ["none", "zip", "piz"])
@pytest.mark.parametrize("tile", [None, (8, 16)])
def test_exr_parts_and_tiles(compression, tile):
    a = Image("exr", ["diffuse.R", "diffuse.G"], "float16", ramp(21, 37, 2, 900, np.float16))
    b = Image("exr", ["Z"], "float32", ramp(9, 5, 1, 70, np.float32), window=(3, -2))
    one = exr.decode(exr.encode(a, compression, tile))
    assert one.channels == ["diffuse.G", "diffuse.R"] and (one.samples == a.samples[:, :, ::-1]).all()
    out = exr.decode(exr.encode_parts([("beauty", a), ("depth", b)], compression, tile))
    assert (out.samples == one.samples).all() and (out.others[1, 0, 0, 0] == b.samples).all()
    assert [m[1:] for m in out.metadata] == [("beauty", ("diffuse.G", "diffuse.R")), ("depth", ("Z",))]


@pytest.mark.parametrize("largest", [1, 300, 65_535])
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (2, 2), (7, 5), (32, 33), (16, 64)])
def test_wavelet_and_huffman_invert(largest, shape):
    from imagelake.sources import piz

    v = rng.integers(0, largest + 1, shape).astype(np.int64)
    w = v.copy()
    piz.wavelet(w, largest, True)
    flat = w.ravel().copy()
    assert (piz.huffman_decode(piz.huffman_encode(flat), len(flat)) == flat).all()
    piz.wavelet(w, largest, False)
    assert (w == v).all()


@pytest.mark.parametrize("size", [(31, 12), (5, 7), (300, 3)])
@pytest.mark.parametrize("orientation", ["identity", "flip_x", "flip_y", "rotate180"])
def test_hdr_round_trip(size, orientation):
    v = (ramp(*size, 3) / 16.0).astype(np.float32)
    v[0, :4] = v[0, 0]
    out = hdr.decode(hdr.encode(Image("hdr", ["R", "G", "B"], "float32", v, orientation=orientation)))
    top = v.max(2, keepdims=True)
    assert out.orientation == orientation and (np.abs(out.samples - v) <= top / 128 + 1e-6).all()
    assert (hdr.decode(hdr.encode(out)).samples == out.samples).all()


def test_rgbe_edges():
    v = np.array([[0, 0, 0], [-1, 2, 0], [1e-33, 0, 0], [np.inf, 1, 1], [np.nan, 0.5, 0.25], [1, 1, 1]])
    e = hdr.encode_rgbe(v)
    assert e[0].tolist() == e[2].tolist() == e[3].tolist() == [0, 0, 0, 0]
    assert e[1].tolist() == [0, 128, 0, 130] and e[5].tolist() == [128, 128, 128, 129]


@pytest.mark.parametrize("module", ["dds", "ktx2", "ktx2z"])
@pytest.mark.parametrize("name", ["r8", "rg8", "rgba8", "r16", "rgba16", "rgba16f", "r32f", "rgba32f"])
def test_texture_round_trip(module, name):
    _, _, channels, sample, *_ = dds.FORMATS[name]
    kind = np.dtype(dds._KIND[sample])
    base = ramp(16, 8, len(channels), 200).astype(kind)
    others = {(0, e, 0, lv): np.ascontiguousarray(base[:: 1 << lv, :: 1 << lv])[: max(1, 8 >> lv)] + kind.type(e) for e in range(2) for lv in range(3) if (e, lv) != (0, 0)}
    im = Image("dds", list(channels), sample, base, others=others)
    data = dds.encode_dds(im) if module == "dds" else dds.encode_ktx2(im, compress=module == "ktx2z")
    out = dds.decode_dds(data) if module == "dds" else dds.decode_ktx2(data)
    assert (out.samples == base).all() and out.others.keys() == others.keys()
    assert all((out.others[k] == v).all() for k, v in others.items())


@pytest.mark.parametrize("name,bound", [("bc1", 40), ("bc2", 40), ("bc3", 40), ("bc4", 40), ("bc5", 40), ("r10g10b10a2", 0.002), ("b5g6r5", 0.02), ("rgb9e5", 0.003), ("r11g11b10f", 0.02)])
def test_encoded_elements(name, bound):
    channels, packed = dds.FORMATS[name][2], dds.FORMATS[name][3] == "packed"
    v = np.stack([np.add.outer(np.arange(13), np.arange(18)) * (c + 1) % 120 + 60 for c in range(len(channels))], 2)
    v = v / 255.0 if packed else v.astype(np.uint8)
    im = Image("x", list(channels), "float32" if packed else "unorm8", v)
    out = dds.decode_dds(dds.encode_dds(im, name))
    assert out.encoding == name and np.abs(out.samples.astype(float) - v)[..., :3].max() <= bound


def test_bc1_modes():
    from imagelake.sources import texture

    block = struct.pack("<HHI", 0xF800, 0x001F, 0b11100100)
    four = texture.decode_image("bc1", block, 4, 4)[0]
    assert four.tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]
    three = texture.decode_image("bc1", struct.pack("<HHI", 0x001F, 0xF800, 0b11100100), 4, 4)[0]
    assert three[2].tolist() == [127, 0, 127, 255] and three[3].tolist() == [0, 0, 0, 0]


def test_bc7_tables_agree():
    from imagelake.sources import bc7

    for p in range(64):
        assert bc7.subset_of(2, p, 0) == 0 and bc7.subset_of(2, p, bc7.ANCHOR_TWO[p]) == 1
        assert [bc7.subset_of(3, p, t) for t in (0, bc7.ANCHOR_SECOND[p], bc7.ANCHOR_THIRD[p])] == [0, 1, 2]
        assert {bc7.subset_of(3, p, t) for t in range(16)} == {0, 1, 2}
    for subsets, pb, rb, sb, cb, ab, ends, shared, ib, ib2 in bc7.MODES:  # every mode fills its 128 bits
        used = bc7.MODES.index((subsets, pb, rb, sb, cb, ab, ends, shared, ib, ib2)) + 1
        used += pb + rb + sb + 2 * subsets * (3 * cb + ab + ends) + subsets * shared + 16 * ib - subsets + (16 * ib2 - 1 if ib2 else 0)
        assert used == 128


def test_bc7_solid_mode_6():
    from imagelake.sources import bc7

    word, at = 1 << 6, 7
    for v in (10, 10, 60, 60, 100, 100, 127, 127):
        word |= v << at
        at += 7
    word |= 0b01 << at  # low bits of the ends: 1 and 0
    block = word.to_bytes(16, "little")
    assert bc7.decode_block(block) == [(21, 121, 201, 255)] * 16
    assert bc7.decode_block(bytes(16)) == [(0, 0, 0, 255)] * 16


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("subsampling", ["444", "422", "420"])
def test_jpeg_round_trip(subsampling, progressive):
    y, x = np.mgrid[0:40, 0:51]
    v = np.stack((x * 4, y * 5, (x + y) * 2), 2).astype(np.uint8)
    out = jpeg.decode(jpeg.encode(Image("jpeg", ["R", "G", "B"], "unorm8", v), 92, subsampling, progressive))
    assert out.samples.shape == v.shape and np.abs(out.samples.astype(int) - v).mean() < 6
    grey = jpeg.decode(jpeg.encode(Image("jpeg", ["Y"], "unorm8", v[:, :, :1]), 95, progressive=progressive))
    assert np.abs(grey.samples.astype(int) - v[:, :, :1]).mean() < 3


@pytest.mark.parametrize("n", [3, 4])
@pytest.mark.parametrize("kind", ["flat", "ramp", "noise", "two", "wide"])
def test_webp_round_trip(n, kind):
    v = {
        "flat": np.full((9, 14, n), 7), "ramp": ramp(19, 11, n), "noise": rng.integers(0, 256, (12, 17, n)), "two": np.where(ramp(20, 5, n) > 128, 255, 0),
        "wide": np.repeat(rng.integers(0, 256, (4, 40, n)), 25, axis=1),
    }[kind].astype(np.uint8)
    out = webp.decode(webp.encode(Image("webp", list("RGBA")[:n], "unorm8", v)))
    assert (out.samples[:, :, :n] == v).all() and (n == 4 or (out.samples[:, :, 3] == 255).all())


def test_webp_transforms():
    """Predictor, cross-colour and palette transforms against their definitions, by hand-made streams."""
    w = webp._Writer()

    def plain(argb):  # an entropy image of few pixels: no cache, five simple codes, at most two symbols each
        w.put(0, 1)
        channels = [[p >> k & 255 for p in argb] for k in (8, 16, 0, 24)]
        codes = []
        for c in channels:
            used = sorted(set(c))
            w.put(1, 1), w.put(len(used) - 1, 1), w.put(1, 1)
            for s in used:
                w.put(s, 8)
            codes.append({s: (k, len(used) - 1) for k, s in enumerate(used)})
        w.put(1, 1), w.put(0, 1), w.put(0, 1), w.put(0, 1)
        for i in range(len(argb)):
            for c, code in zip(channels, codes, strict=True):
                w.put(*code[c[i]])

    w.put(0x2F, 8), w.put(3, 14), w.put(1, 14), w.put(1, 1), w.put(0, 3)
    w.put(1, 1), w.put(3, 2), w.put(1, 8)  # palette of two colours, stored as differences
    plain([0xFF102030, 0x00010101])
    w.put(0, 1)
    w.put(0, 1), w.put(0, 1)  # no cache, one group; eight indices fit one packed pixel of each row
    used = [0b0101, 0b1110]
    w.put(1, 1), w.put(1, 1), w.put(1, 1), w.put(used[0], 8), w.put(used[1], 8)
    for _ in range(4):
        w.put(1, 1), w.put(0, 1), w.put(0, 1), w.put(0, 1)
    w.put(0, 1), w.put(1, 1)
    body = w.done()
    body = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    out = webp.decode(b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body)
    a, b = [16, 32, 48, 255], [17, 33, 49, 255]
    assert out.samples[0].tolist() == [b, a, b, a] and out.samples[1].tolist() == [a, b, b, b]


def test_webp_predictors():
    left, top, right, corner = (np.array(v) for v in ([9, 200, 10, 0], [9, 100, 30, 4], [9, 50, 7, 8], [9, 90, 200, 2]))
    assert webp._predicted(0, left, top, right, corner).tolist() == [255, 0, 0, 0]
    assert [webp._predicted(k, left, top, right, corner).tolist() for k in (1, 2, 3, 4)] == [v.tolist() for v in (left, top, right, corner)]
    assert webp._predicted(7, left, top, right, corner).tolist() == [9, 150, 20, 2]
    assert webp._predicted(12, left, top, right, corner).tolist() == [9, 210, 0, 2]
    assert webp._predicted(13, left, top, right, corner).tolist() == [9, 180, 0, 2]


def test_jpeg_progressive_equals_baseline():
    v = ramp(37, 29, 3)
    im = Image("jpeg", list("RGB"), "unorm8", v)
    assert (jpeg.decode(jpeg.encode(im, 80)).samples == jpeg.decode(jpeg.encode(im, 80, progressive=True)).samples).all()


def test_registry():
    im = Image("png", ["Y"], "unorm8", ramp(8, 8, 1))
    assert REGISTRY.resolve(png.encode(im)[:16]).format == "png"
    assert REGISTRY.resolve(b"nothing", ".HDR").format == "hdr"
    with pytest.raises(FormatError):
        REGISTRY.resolve(b"nothing")
    with pytest.raises(ValueError):
        REGISTRY.register(REGISTRY.codecs["png"])


PNG = png.encode(Image("png", ["R", "G", "B"], "unorm8", ramp(9, 7, 3)))
EXR = exr.encode(Image("exr", ["R"], "float16", ramp(8, 20, 1, 100, np.float16)))
HDR = hdr.encode(Image("hdr", ["R", "G", "B"], "float32", ramp(20, 5, 3).astype(np.float32)))
KTX = dds.encode_ktx2(Image("ktx2", list("RGBA"), "unorm8", ramp(8, 8, 4)))
DDS = dds.encode_dds(Image("dds", list("RGBA"), "unorm8", ramp(8, 8, 4)))
WEBP = webp.encode(Image("webp", list("RGB"), "unorm8", ramp(16, 16, 3)))
JPG = jpeg.encode(Image("jpeg", ["Y"], "unorm8", ramp(16, 16, 1)))


@pytest.mark.parametrize(
    "decode,data",
    [
        (png.decode, PNG[:-5]), (png.decode, PNG[:40] + b"x" + PNG[41:]), (png.decode, PNG[:-12]), (png.decode, b"x" + PNG[1:]),
        (exr.decode, EXR.replace(b"lineOrder\0lineOrder", b"lineOther\0lineOrder")), (exr.decode, EXR[:-9]), (exr.decode, EXR[:60]), (exr.decode, b"y" + EXR[1:]),
        (hdr.decode, HDR[:-3]), (hdr.decode, HDR.replace(b"32-bit_rle_rgbe", b"32-bit_rle_xyze")), (hdr.decode, HDR.replace(b"+X", b"*X")),
        (dds.decode_ktx2, KTX[:-1]), (dds.decode_ktx2, KTX[:12] + struct.pack("<I", 9999) + KTX[16:]), (dds.decode_ktx2, KTX[:44] + struct.pack("<I", 1) + KTX[48:]),
        (dds.decode_dds, DDS[:-1]), (dds.decode_dds, DDS[:100]), (dds.decode_dds, DDS[:4] + b"\0" + DDS[5:]),
        (jpeg.decode, JPG[:-2]), (jpeg.decode, JPG[:30]), (jpeg.decode, JPG.replace(b"\xff\xc0", b"\xff\xc9")), (jpeg.decode, b""), (webp.decode, WEBP[:-3]), (webp.decode, WEBP.replace(b"VP8L", b"VP8 ")), (webp.decode, WEBP[:20] + b"x" + WEBP[21:]),
    ],
)
def test_must_reject(decode, data):
    with pytest.raises(FormatError):
        decode(data)


def test_limits():
    with pytest.raises(FormatError) as e:
        png.decode(PNG, Limits(dimension=8))
    assert e.value.code == "LimitExceeded"


# ---------------------------------------------------------------- encoders' choices


def test_webp_effort_never_grows_files():
    from imagelake.sources import webp

    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:37, 0:45]
    images = [
        np.stack((x * 5, y * 6, x + y, np.full_like(x, 255)), 2), rng.integers(0, 256, (20, 33, 4)), np.array([[1, 2, 3, 4], [250, 0, 0, 255]])[rng.integers(0, 2, (19, 23))],
        np.repeat(rng.integers(0, 256, (5, 9, 3)), 4, 0), np.zeros((1, 1, 4)), rng.integers(0, 200, (40, 3))[rng.integers(0, 40, (17, 18))], np.stack((x * y % 256, x * y % 251, x * x % 256), 2),
    ]
    for v in images:
        v = v.astype(np.uint8)
        files = [webp.encode(Image("webp", list("RGBA")[: v.shape[2]], "unorm8", v), e) for e in ("fast", "balanced", "best")]
        assert len(files[0]) >= len(files[1]) >= len(files[2])
        for f in files:
            assert (webp.decode(f).samples[:, :, : v.shape[2]] == v).all()


def mixed(side: int = 96) -> np.ndarray:
    """A pattern, grey noise, a noisy ramp and a few scattered colours, a quarter each."""
    y, x = np.mgrid[:side, :side]
    rng, half = np.random.default_rng(5), side // 2
    v = np.stack([x, y, x + y], -1) + rng.integers(0, 4, (side, side, 3))
    v[:half, :half] = ((x // 9 + y // 7) % 5 * 50)[:half, :half, None]
    v[:half, half:] = rng.integers(0, 256, (half, half, 1))
    v[half:, :half] = rng.integers(0, 256, (40, 3))[rng.integers(0, 40, (half, half))]
    return v.astype(np.uint8)


def test_webp_groups_of_codes():
    from imagelake.sources import vp8lgroups

    px = np.full((96, 96, 4), 255, np.int64)
    px[:, :, 1:] = mixed()
    for green, prediction in ((False, None), (True, None), (True, "tiles")):
        plain, rich = (webp._planned(px, False, green, prediction, False, webp._NEAREST, grouped) for grouped in (False, True))
        assert (webp.decode_lossless(rich, Limits()) == px).all()
        assert len(rich) < 0.9 * len(plain)
    t = vp8lgroups.tokens(webp._packed(px).ravel(), {1: 2, 96: 1})
    assert t.cache and len(np.unique(vp8lgroups.grouped(t, 96, 96, vp8lgroups.tile_shift(96, 96)))) > 1
    flat = vp8lgroups.tokens(np.zeros(5000, np.int64), {1: 2})  # a pixel, and copies of at most 4096
    assert flat.start.tolist() == [0, 1, 4097] and not flat.cache


def test_webp_copies_from_anywhere():
    from imagelake.sources import vp8lgroups

    rng = np.random.default_rng(6)
    block = rng.integers(0, 1 << 24, 700)
    start, length, code = vp8lgroups.walked(np.concatenate((block, rng.integers(0, 1 << 24, 50), block)), {1: 2})
    assert length.max() == 700 and code[length.argmax()] == 750 + 120 and length.sum() == 1450
    for v in (1, 2, 4, 5, 8, 9, 120, 121, 4096, 1 << 19):
        assert [int(a[0]) for a in vp8lgroups.prefixes(np.array([v]))] == list(webp._prefix_of(v))


@pytest.mark.parametrize("h, w", [(1, 1), (1, 300), (300, 1), (2, 2), (33, 17), (5, 700)])
def test_webp_grouped_shapes(h, w):
    rng = np.random.default_rng(h * 1000 + w)
    for v in (np.zeros((h, w, 4)), rng.integers(0, 256, (h, w, 4)), rng.integers(0, 2, (h, w, 4)) * 255, np.broadcast_to(np.arange(w)[None, :, None] // 3 % 256, (h, w, 4))):
        v = v.astype(np.int64)
        for plan in (p for p in webp.PLANS["best"] if p[-1]):
            body = webp._planned(v, True, *plan)
            assert body is None or (webp.decode_lossless(body, Limits()) == v).all()


def test_webp_alpha_planes():
    from imagelake.sources import webp

    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (6, 9)).astype(np.uint8)

    def filtered(kind):
        out = a.astype(int).copy()
        for y in range(6):
            for x in range(9):
                if kind and (x or y):
                    left, top, corner = (int(a[y, x - 1]) if x else 0), (int(a[y - 1, x]) if y else 0), (int(a[y - 1, x - 1]) if x and y else 0)
                    p = top if x == 0 else left if y == 0 else {1: left, 2: top, 3: min(255, max(0, left + top - corner))}[kind]
                    out[y, x] -= p
        return (out & 255).astype(np.uint8)

    for kind in range(4):
        assert (webp.alpha_plane(bytes([kind << 2]) + filtered(kind).tobytes(), 9, 6) == a).all()
        px = np.zeros((6, 9, 3), np.uint8)
        px[:, :, 1] = filtered(kind)
        lossless = webp.chunks(webp.encode(Image("webp", list("RGB"), "unorm8", px)))[0][1]
        # the stream without its 5 bytes of header
        assert (webp.alpha_plane(bytes([kind << 2 | 1]) + lossless[5:], 9, 6) == a).all()
    for bad in (b"", b"\x02" + bytes(54), b"\x20" + bytes(54), b"\x00" + bytes(53)):
        with pytest.raises(FormatError):
            webp.alpha_plane(bad, 9, 6)


def test_png_efforts_and_filters():
    from imagelake.sources import png

    y, x = np.mgrid[0:300, 0:300]
    smooth = np.stack((x, y, x + y), 2).astype(np.uint8)
    noise = np.random.default_rng(1).integers(0, 256, (300, 300, 3)).astype(np.uint8)
    size = {}
    for name, v in (("smooth", smooth), ("noise", noise)):
        for effort in png.LEVELS:
            data = png.encode(Image("png", list("RGB"), "unorm8", v), effort=effort)
            assert (png.decode(data).samples == v).all()
            size[name, effort] = len(data)
    assert size["smooth", "smallest"] <= size["smooth", "optimal"] <= size["smooth", "fast"] < size["smooth", "none"]
    assert size["noise", "fast"] == size["noise", "none"]  # stored, as no filter helps
    assert png.high_entropy(noise.reshape(300, -1), 3) and not png.high_entropy(smooth.reshape(300, -1), 3) and not png.high_entropy(noise[:200].reshape(200, -1), 3)
    assert png.sampled_choice(smooth.reshape(300, -1), 3)[1] == "smallest" and png.sampled_choice(noise.reshape(300, -1), 3)[1] == "fast"
    for kind in range(5):
        assert (png.decode(png.encode(Image("png", list("RGB"), "unorm8", smooth), row_filter=kind)).samples == smooth).all()


def test_jpeg_restart_markers():
    from imagelake.sources import jpeg

    assert [jpeg.restart_interval(*a) for a in ((4, 10**6, 8), (400, 100, 8), (400, 10**6, 8), (20, 10**6, 16), (401, 3 * 8192, 8))] == [0, 0, 50, 4, 134]
    v = np.random.default_rng(6).integers(0, 256, (70, 90, 3)).astype(np.uint8)
    plain = jpeg.decode(jpeg.encode(Image("jpeg", list("RGB"), "unorm8", v), 80)).samples
    for restart in (1, 3, 7, None):
        data = jpeg.encode(Image("jpeg", list("RGB"), "unorm8", v), 80, restart=restart)
        assert (jpeg.decode(data).samples == plain).all() and (restart is None or data.count(b"\xff\xdd") == 1)


def test_jpeg_refinement_stays_in_its_band():
    from imagelake.sources import jpeg

    class One:
        def __init__(self, symbols):
            self.symbols = symbols

        def symbol(self, table):
            return self.symbols.pop(0)

        def take(self, n):
            return 1

    block = np.zeros(64, np.int64)
    with pytest.raises(FormatError):
        jpeg._refine(One([0xF0, 0x51]), block, 60, 63, 0, None, 0)


def test_options():
    from imagelake.sources import catalog
    from imagelake.sources.options import OPTIONS, OptionError, parse

    assert set(OPTIONS) == set(catalog.REGISTRY.codecs)
    assert parse("jpeg", [("Quality", "75"), ("chroma-subsampling", "444")]) == {"quality": 75, "subsampling": "444"}
    assert parse("png", [("filter", "Paeth"), ("compression", "FAST")]) == {"row_filter": 4, "effort": "fast"} and parse("dds", []) == {}
    for fmt, pairs in (
        ("jpeg", [("quality", "0")]), ("jpeg", [("quality", "x")]), ("jpeg", [("quality", "1"), ("QUALITY", "2")]), ("jpeg", [("effort", "best")]), ("dds", [("x", "y")]),
        ("jpeg", [("progressive", "yes")]), ("jpeg", [("progressive", "true"), ("restart-interval", "4")]), ("webp", [("effort", "most")]),
    ):
        with pytest.raises(OptionError):
            parse(fmt, pairs)


def test_working_memory_is_bounded():
    from imagelake.sources import webp
    from imagelake.sources.base import Budget, Limits

    b = Budget("webp", 100)
    b.reserve(60)
    b.reserve(40)
    b.release(50)
    assert (b.used, b.peak) == (50, 100)
    for size in (51, -1):
        with pytest.raises(FormatError):
            b.reserve(size)
    data = webp.encode(Image("webp", list("RGB"), "unorm8", np.zeros((50, 50, 3), np.uint8)))
    with pytest.raises(FormatError):
        webp.decode(data, Limits(working_bytes=10_000))


# ---------------------------------------------------------------- BC6H


def test_bc6h_layouts_are_whole():
    """Every endpoint bit stands in a layout once, and blocks are full."""
    from collections import Counter

    from imagelake.sources import bc6h

    for mode, (first, others, delta, _) in bc6h.MODES.items():
        bits = Counter(bc6h.LAYOUTS[mode])
        two = ("d", 0) in bits
        want = Counter((c + "w", k) for c in "rgb" for k in range(first))
        want += Counter((c + e, k) for c, n in zip("rgb", others) for e in ("xyz" if two else "x") for k in range(n))
        want += Counter(("d", k) for k in range(5 if two else 0))
        assert bits == want, mode
        assert (2 if mode < 2 else 5) + len(bc6h.LAYOUTS[mode]) + (46 if two else 63) == 128, mode
        assert delta == (mode not in (3, 30))


def put_bc6h(mode, values, indices):
    """A block from its fields."""
    from imagelake.sources import bc6h

    word, at = mode, 2 if mode < 2 else 5
    for name, bit in bc6h.LAYOUTS[mode]:
        word |= (values[name] >> bit & 1) << at
        at += 1
    return (word | indices << at).to_bytes(16, "little")


@pytest.mark.parametrize("mode", [0, 1, 2, 6, 10, 14, 18, 22, 26, 30, 3, 7, 11, 15])
@pytest.mark.parametrize("signed", [False, True])
def test_bc6h_decoding(mode, signed):
    """Against the rules worked out per texel: endpoints, deltas, subsets, weights."""
    from imagelake.sources import bc6h, bc7

    first, others, delta, _ = bc6h.MODES[mode]
    two = ("d", 0) in bc6h.LAYOUTS[mode]
    r = np.random.default_rng(mode)
    extend = lambda v, n: v - (1 << n) if v >= 1 << (n - 1) else v
    for _ in range(20):
        values = {c + "w": int(r.integers(0, 1 << first)) for c in "rgb"} | {c + e: int(r.integers(0, 1 << n)) for c, n in zip("rgb", others) for e in "xyz"} | {"d": int(r.integers(0, 32))}
        bits = 46 if two else 63
        indices = int(r.integers(0, 1 << 62)) & (1 << bits) - 1
        got = bc6h.decode_block(put_bc6h(mode, values, indices), signed)
        stream = indices
        for t in range(16):
            subset = int(bc7.TWO[values["d"]][t]) if two else 0
            anchor = t == 0 or two and t == bc7.ANCHOR_TWO[values["d"]]
            n = (3 if two else 4) - anchor
            w = bc7.WEIGHTS[3 if two else 4][stream & (1 << n) - 1]
            stream >>= n
            for k, c in enumerate("rgb"):
                pair = []
                for e in ("wx", "yz")[subset]:
                    v = values[c + e]
                    if delta and e != "w":
                        v = (values[c + "w"] + extend(v, others[k])) % (1 << first)
                    if signed:
                        v = extend(v, first)
                        m = abs(v)
                        u = m if first >= 16 or m == 0 else 0x7FFF if m >= 2 ** (first - 1) - 1 else (m * 2**15 + 2**14) // 2 ** (first - 1)
                        pair.append(-u if v < 0 else u)
                    else:
                        pair.append(v if first >= 15 or v == 0 else 0xFFFF if v == 2**first - 1 else (v * 2**15 + 2**14) // 2 ** (first - 1))
                m = (pair[0] * (64 - w) + pair[1] * w + 32) >> 6
                assert got[t][k] == ((0x8000 | (-m * 31 >> 5) if m < 0 and -m * 31 >> 5 else abs(m) * 31 >> 5) if signed else m * 31 >> 6)


def test_bc6h_reserved_modes_and_containers():
    from imagelake.sources import bc6h, texture

    for mode in (19, 23, 27, 31):
        assert bc6h.decode_block(bytes([mode]) + bytes(range(15)), False) == [(0, 0, 0)] * 16
    blocks = b"".join(put_bc6h(3, {c + e: 300 + 40 * k for k, (c, e) in enumerate((c, e) for c in "rgb" for e in "wx")}, 0x123456789ABCDEF) for _ in range(4))
    im = Image("dds", list("RGB"), "float16", np.zeros((8, 8, 3), np.float16))
    with pytest.raises(FormatError):
        dds.encode_dds(im, "bc6h")
    head = dds.encode_dds(Image("dds", list("RGBA"), "unorm8", np.zeros((8, 8, 4), np.uint8)), "bc3")
    data = head.replace(struct.pack("<I", 77), struct.pack("<I", 95), 1)[: len(head) - 64] + blocks
    out = dds.decode_dds(data)
    assert out.encoding == "bc6h" and out.sample == "float16" and (out.samples == texture.decode_image("bc6h", blocks, 8, 8)).all() and out.samples.max() > 0


# ---------------------------------------------------------------- EXR levels


def with_levels(w, h, mode):
    from imagelake.sources import exr

    r = np.random.default_rng(w * h + mode)
    made = {(i, j): r.normal(size=(lh, lw, 2)).astype(np.float16) for i, j, lw, lh in exr.levels_of(w, h, mode)}
    others = {(0, 0, 0, i if mode & 15 == 1 else (i, j)): v for (i, j), v in made.items() if (i, j) != (0, 0)}
    return Image("exr", ["A", "B"], "float16", made[0, 0], others=others)


@pytest.mark.parametrize("mode", [1, 2, 17, 18])
@pytest.mark.parametrize("size", [(13, 9), (8, 8), (1, 5), (16, 3)])
@pytest.mark.parametrize("compression", ["none", "zip", "piz"])
def test_exr_levels(mode, size, compression):
    from imagelake.sources import exr

    im = with_levels(*size, mode)
    out = exr.decode(exr.encode(im, compression, (4, 3), mode))
    assert (out.samples == im.samples).all() and set(out.others) == set(im.others)
    assert all((out.others[k] == v).all() for k, v in im.others.items())


def test_exr_level_counts():
    from imagelake.sources import exr

    assert [v[2:] for v in exr.levels_of(13, 5, 1)] == [(13, 5), (6, 2), (3, 1), (1, 1)]
    assert [v[2:] for v in exr.levels_of(13, 5, 17)] == [(13, 5), (7, 3), (4, 2), (2, 1), (1, 1)]
    assert exr.levels_of(4, 2, 2) == [(0, 0, 4, 2), (1, 0, 2, 2), (2, 0, 1, 2), (0, 1, 4, 1), (1, 1, 2, 1), (2, 1, 1, 1)]
    data = bytearray(exr.encode(with_levels(8, 8, 1), "none", (4, 4), 1))
    with pytest.raises(FormatError):
        exr.decode(bytes(data), Limits(levels=2))
    im = with_levels(8, 8, 1)
    del im.others[0, 0, 0, 2]
    for bad in (lambda: exr.encode(im, "zip", (4, 4), 1), lambda: exr.encode(with_levels(8, 8, 1), "zip", None, 1)):
        with pytest.raises(FormatError):
            bad()


# ---------------------------------------------------------------- lossy frames


def rfc_like(t):
    """The tables as they stand in the text, with comments and page feet."""
    def braces(v):
        return "{" + ", ".join(braces(x) if isinstance(x, tuple) else str(x) for x in v) + "}"

    foot = "\nBankoski, et al.              Informational                    [Page 73]\n\x0c\nRFC 6386                   VP8 Data Format and Decoding Guide      November 2011\n"
    return (
        "   text\n const Prob default_coeff_probs [BLOCK_TYPES] [8] [3][11] =\n /* block 1 */ " + braces(t.coefficients).replace("}, {", "},\n /* 3 */ {") + ";\n more\n"
        "const Prob coeff_update_probs [4] [8] [3] [11] = " + braces(t.updates).replace("}}, {{", "}}, // 12\n" + foot + "{{", 1) + ";\n const Prob kf_bmode_probs [num_intra_bmodes] [num_intra_bmodes]\n [num_intra_bmodes-1] = " + braces(t.modes) + ";"
    )


def random_tables(seed):
    from imagelake.sources import vp8

    r = np.random.default_rng(seed)
    made = lambda *shape: vp8.tuple_of(r.integers(1, 256, shape))
    return vp8.Tables(made(4, 8, 3, 11), made(4, 8, 3, 11), made(10, 10, 9))


def test_vp8_tables_from_text():
    from imagelake.sources import vp8

    t = random_tables(1)
    assert vp8.tables_of(rfc_like(t)) == t
    for bad in ("", rfc_like(t).replace("kf_bmode_probs", "x"), rfc_like(t).replace("[num_intra_bmodes-1] = {{{", "[num_intra_bmodes-1] = {{{7, ")):
        with pytest.raises(FormatError):
            vp8.tables_of(bad)


def test_vp8_arithmetic_coder():
    from imagelake.sources import vp8

    r = np.random.default_rng(2)
    for n in (1, 50, 5000):
        probabilities = r.integers(1, 256, n).tolist()
        bits = [int(r.random() >= p / 256) if r.random() < 0.9 else int(r.integers(0, 2)) for p in probabilities]
        w = vp8.Writer()
        for b, p in zip(bits, probabilities):
            w.bit(b, p)
        reader = vp8.Reader(w.done())
        assert [reader.bit(p) for p in probabilities] == bits
    w = vp8.Writer()
    for mode in range(10):
        w.tree(vp8.B_TREE, [77] * 9, mode)
    reader = vp8.Reader(w.done())
    assert [reader.tree(vp8.B_TREE, [77] * 9) for _ in range(10)] == list(range(10))


def test_vp8_transforms():
    from imagelake.sources import vp8

    r = np.random.default_rng(3)
    for _ in range(50):
        x = r.integers(-255, 256, (4, 4))
        assert np.abs(vp8.inverse(vp8.forward(x)) - x).max() <= 1 and np.abs(vp8.inverse_wht(vp8.forward_wht(x * 8)) - x * 8).max() <= 1
        i = r.integers(-2000, 2001, (4, 4)).tolist()
        t = [[0] * 4 for _ in range(4)]
        for c in range(4):  # columns, then rows, one number at a time
            a, b = i[0][c] + i[2][c], i[0][c] - i[2][c]
            low = (i[1][c] * 35468 >> 16) - (i[3][c] + (i[3][c] * 20091 >> 16))
            high = (i[1][c] + (i[1][c] * 20091 >> 16)) + (i[3][c] * 35468 >> 16)
            t[0][c], t[3][c], t[1][c], t[2][c] = a + high, a - high, b + low, b - low
        out = [[0] * 4 for _ in range(4)]
        for k in range(4):
            a, b = t[k][0] + t[k][2], t[k][0] - t[k][2]
            low = (t[k][1] * 35468 >> 16) - (t[k][3] + (t[k][3] * 20091 >> 16))
            high = (t[k][1] + (t[k][1] * 20091 >> 16)) + (t[k][3] * 35468 >> 16)
            out[k] = [(a + high + 4) >> 3, (b + low + 4) >> 3, (b - low + 4) >> 3, (a - high + 4) >> 3]
        assert vp8.inverse(np.array(i)).tolist() == out


def test_vp8_small_prediction():
    """The directional modes as the format lists them, texel by texel."""
    from imagelake.sources import vp8

    r = np.random.default_rng(4)
    for _ in range(20):
        a, left, p = r.integers(0, 256, 8).tolist(), r.integers(0, 256, 4).tolist(), int(r.integers(0, 256))
        e = [left[3], left[2], left[1], left[0], p, *a]
        two, three = (lambda x, y: (x + y + 1) >> 1), (lambda x, y, z: (x + 2 * y + z + 2) >> 2)
        e2, e3 = (lambda i: two(e[i], e[i + 1])), (lambda i: three(e[i - 1], e[i], e[i + 1]))
        a2, a3 = (lambda i: two(a[i], a[i + 1])), (lambda i: three(a[i - 1], a[i], a[i + 1]))
        want = {
            vp8.B_VR: [[e2(4), e2(5), e2(6), e2(7)], [e3(4), e3(5), e3(6), e3(7)], [e3(3), e2(4), e2(5), e2(6)], [e3(2), e3(4), e3(5), e3(6)]],
            vp8.B_VL: [[a2(0), a2(1), a2(2), a2(3)], [a3(1), a3(2), a3(3), a3(4)], [a2(1), a2(2), a2(3), a3(5)], [a3(2), a3(3), a3(4), a3(6)]],
            vp8.B_HD: [[e2(3), e3(4), e3(5), e3(6)], [e2(2), e3(3), e2(3), e3(4)], [e2(1), e3(2), e2(2), e3(3)], [e2(0), e3(1), e2(1), e3(2)]],
            vp8.B_HU: [[two(left[0], left[1]), three(*left[:3]), two(left[1], left[2]), three(*left[1:])], [two(left[1], left[2]), three(*left[1:]), two(left[2], left[3]), three(left[2], left[3], left[3])],
                       [two(left[2], left[3]), three(left[2], left[3], left[3]), left[3], left[3]], [left[3]] * 4],
            vp8.B_LD: [[three(a[r + c], a[r + c + 1], a[min(7, r + c + 2)]) for c in range(4)] for r in range(4)],
            vp8.B_RD: [[e3(4 - r + c) for c in range(4)] for r in range(4)],
            vp8.B_VE: [[three(p, a[0], a[1]), a3(1), a3(2), a3(3)]] * 4,
            vp8.B_HE: [[v] * 4 for v in (three(p, left[0], left[1]), three(*left[:3]), three(*left[1:]), three(left[2], left[3], left[3]))],
            vp8.B_DC: [[(sum(a[:4]) + sum(left) + 4) >> 3] * 4] * 4,
            vp8.B_TM: [[min(255, max(0, left[r] + a[c] - p)) for c in range(4)] for r in range(4)],
        }
        for mode, block in want.items():
            assert vp8.small(mode, a, left, p).tolist() == block, mode


def test_vp8_loop_filter():
    """Lines across an edge, one by one."""
    from imagelake.sources import vp8

    c = lambda v: max(-128, min(127, v))

    def line(v, simple, big, edge, inner, steep):
        p3, p2, p1, p0, q0, q1, q2, q3 = v
        if abs(p0 - q0) * 2 + abs(p1 - q1) // 2 > edge:
            return v
        if not simple and max(abs(p3 - p2), abs(p2 - p1), abs(p1 - p0), abs(q1 - q0), abs(q2 - q1), abs(q3 - q2)) > inner:
            return v
        high = abs(p1 - p0) > steep or abs(q1 - q0) > steep
        p2, p1, p0, q0, q1, q2 = (x - 128 for x in (p2, p1, p0, q0, q1, q2))

        def common(outer):
            a = c((c(p1 - q1) if outer else 0) + 3 * (q0 - p0))
            return c(p0 + (c(a + 3) >> 3)), c(q0 - (c(a + 4) >> 3)), c(a + 4) >> 3

        if simple or (big and high):
            p0, q0, _ = common(True)
        elif big:
            w = c(c(p1 - q1) + 3 * (q0 - p0))
            a, b, d = (c((n * w + 63) >> 7) for n in (27, 18, 9))
            p0, q0, p1, q1, p2, q2 = c(p0 + a), c(q0 - a), c(p1 + b), c(q1 - b), c(p2 + d), c(q2 - d)
        else:
            p0, q0, a = common(high)
            if not high:
                a = (a + 1) >> 1
                p1, q1 = c(p1 + a), c(q1 - a)
        return [v[0], p2 + 128, p1 + 128, p0 + 128, q0 + 128, q1 + 128, q2 + 128, v[7]]

    r = np.random.default_rng(5)
    for simple in (True, False):
        for big in (True, False):
            lines = np.clip(r.integers(0, 256, (400, 1)) + r.integers(-12, 13, (400, 8)), 0, 255)
            edge, inner, steep = 30, 9, 3
            want = [line(v, simple, big, edge, inner, steep) for v in lines.tolist()]
            vp8.smooth(lines, simple, big, edge, inner, steep)
            assert lines.tolist() == want


@pytest.mark.parametrize("seed", [None, 7])
def test_vp8_round_trip(seed):
    from imagelake.sources import vp8

    tables = vp8.even_tables() if seed is None else random_tables(seed)
    y, x = np.mgrid[0:45, 0:70]
    smooth_ = np.stack((x * 3 % 256, y * 5 % 256, (x + y) * 2 % 256), 2).astype(np.uint8)
    noise = np.random.default_rng(3).integers(0, 256, (33, 17, 1)).repeat(3, 2).astype(np.uint8)
    for v in (smooth_, noise, np.zeros((1, 1, 3), np.uint8), np.full((16, 16, 3), 255, np.uint8)):
        error = []
        for quality in (0, 50, 100):
            out = vp8.decode(vp8.encode(v, quality, tables), Limits(), tables)
            assert out.shape == v.shape
            error.append(float(((out.astype(int) - v) ** 2).mean()))
        assert error[2] <= error[0] and error[2] < 8
    for modes in (1, 2, 4):
        assert ((vp8.decode(vp8.encode(smooth_, 90, tables, modes), Limits(), tables).astype(int) - smooth_) ** 2).mean() < 40


def test_vp8_frames_with_small_blocks_segments_and_filters():
    """A frame of 4 x 4 modes without coefficients, in two segments and two partitions: its pixels follow from prediction
    alone, and its modes from their neighbours' contexts."""
    from imagelake.sources import vp8

    tables, r = random_tables(8), np.random.default_rng(9)
    rows, columns = 3, 2
    modes = r.integers(0, 10, (rows * 4, columns * 4))
    w = vp8.Writer()
    w.number(0, 2)
    for value, bits in ((1, 1), (1, 1), (1, 1), (1, 1)):  # segments, a map, values, absolute ones
        w.number(value, bits)
    for value in (20, 60, 0, 0):
        w.bit(int(value > 0))
        if value:
            w.number(value, 7)
            w.bit(0)
    for value in (0, 63, 0, 0):
        w.bit(int(value > 0))
        if value:
            w.number(value, 6)
            w.bit(0)
    for _ in range(3):
        w.bit(1)
        w.number(128, 8)
    w.number(0, 1)
    w.number(1, 6)  # a level, which segments replace
    w.number(0, 3)
    w.bit(0)
    w.number(1, 2)
    w.number(50, 7)
    w.number(0, 5)
    w.bit(0)
    for kind in tables.updates:
        for band in kind:
            for context in band:
                for p in context:
                    w.bit(0, p)
    w.bit(1)
    w.number(200, 8)
    for my in range(rows):
        for mx in range(columns):
            w.tree(vp8.SEGMENT_TREE, [128] * 3, (my + mx) % 2)
            w.bit(1, 200)
            w.tree(vp8.Y_TREE, vp8.Y_PROBS, vp8.B)
            for k in range(16):
                y, x = my * 4 + k // 4, mx * 4 + k % 4
                above, left = int(modes[y - 1, x]) if y else vp8.B_DC, int(modes[y, x - 1]) if x else vp8.B_DC
                w.tree(vp8.B_TREE, tables.modes[above][left], int(modes[y, x]))
            w.tree(vp8.UV_TREE, vp8.UV_PROBS, vp8.TM)
    first = w.done()
    data = (len(first) << 5 | 16).to_bytes(3, "little") + b"\x9d\x01\x2a" + (32).to_bytes(2, "little") + (48).to_bytes(2, "little") + first + (4).to_bytes(3, "little") + bytes(8)
    plain = {}
    for level in (False, True):
        frame = bytearray(data)
        h, _, _ = vp8.read_header(bytes(frame), Limits(), tables)
        assert (h.width, h.height, h.partitions, h.quantisers, h.levels, h.level, h.skipping) == (32, 48, 2, [20, 60, 0, 0], [0, 63, 0, 0], 1, 200)
        soften = vp8.soften
        if not level:
            vp8.soften = lambda *a: None
        try:
            plain[level] = vp8.decode_frame(bytes(frame), Limits(), tables)[0]
        finally:
            vp8.soften = soften
    at = lambda y, x: 127 if y < 0 else 129 if x < 0 else int(got[y, x])
    got = np.zeros((48, 32), int)
    for my in range(rows):
        for mx in range(columns):
            for k in range(16):
                y, x = my * 16 + k // 4 * 4, mx * 16 + k % 4 * 4
                over = my * 16 - 1 if k % 4 == 3 else y - 1
                right = [at(over, c) if c < 32 else at(over, 31) for c in range(x + 4, x + 8)]
                above = [at(y - 1, c) for c in range(x, x + 4)] + right
                got[y : y + 4, x : x + 4] = vp8.small(int(modes[y // 4, x // 4]), above, [at(c, x - 1) for c in range(y, y + 4)], at(y - 1, x - 1))
    assert (plain[False] == got).all() and (plain[True] != got).any()


def test_webp_lossy_files():
    from imagelake.sources import vp8, webp

    tables = vp8.even_tables()
    v = np.random.default_rng(6).integers(0, 256, (20, 30, 4)).astype(np.uint8)
    v[:, :, :3] = 90
    data = webp.encode(Image("webp", list("RGBA"), "unorm8", v), lossless=False, quality=90, tables=tables)
    assert [k for k, _ in webp.chunks(data)] == ["VP8X", "ALPH", "VP8 "]
    out = webp.decode(data, Limits(), tables).samples
    assert (out[:, :, 3] == v[:, :, 3]).all() and np.abs(out[:, :, :3].astype(int) - 90).max() <= 3
    assert [k for k, _ in webp.chunks(webp.encode(Image("webp", list("RGB"), "unorm8", v[:, :, :3]), lossless=False, tables=tables))] == ["VP8 "]
    for bad in (lambda: webp.decode(data), lambda: webp.encode(Image("webp", list("RGBA"), "unorm8", v), lossless=False), lambda: webp.decode(data[:60], Limits(), tables)):
        with pytest.raises(FormatError):
            bad()
    frame = dict(webp.chunks(data))["VP8 "]
    for cut in (5, 9, 12):
        with pytest.raises(FormatError):
            vp8.decode(frame[:cut], Limits(), tables)
