"""Plans as DataFrame transformations over wide pixels: (image, y, x, one column of doubles per channel).

The grey channel Y stands in column L, as Spark's column names don't tell Y from y. Samples are normalised to 0..1
(or kept, for floats) on entry and brought to the target's type on exit, so the steps between are expressions that
Catalyst fuses; only resampling, filling of subsampled channels and blocks shuffle.

Encoded images: packed pixels have a column `element` (an unsigned word) in place of channels, block formats have
rows (image, brow, bcol, element) with the block's bytes. A step without a lowering raises PlanError.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.functions import grid, packed, samples
from imagelake.operators import blocks, geometry
from imagelake.plans.planner import REFUSED, Plan, PlanError, Step

BLOCKS = ("bc1", "bc2", "bc3", "bc4", "bc5", "bc6h", "bc6h_signed", "bc7")


def normalised(pixels: DataFrame, channels: list[str], sample: str) -> DataFrame:
    if not sample.startswith("unorm"):
        return pixels
    bits = int(sample.removeprefix("unorm"))
    return pixels.withColumns({c: samples.unorm_to_float(F.col(c), bits).cast("double") for c in channels})


def stored(pixels: DataFrame, channels: list[str], sample: str) -> DataFrame:
    if sample == "float16":
        return pixels.withColumns({c: samples.half_to_float(samples.float_to_half(F.col(c))) for c in channels})
    if not sample.startswith("unorm"):
        return pixels
    bits = int(sample.removeprefix("unorm"))
    return pixels.withColumns({c: samples.float_to_unorm(F.col(c), bits) for c in channels})


def column(channel: str) -> str:
    return "L" if channel == "Y" else channel


@dataclass
class State:
    """Rows between two steps. encoded: their element's format, if they are elements."""

    rows: DataFrame
    names: list[str]
    image: str
    palette: DataFrame | None = None
    encoded: str | None = None

    def with_rows(self, rows: DataFrame, names: list[str] | None = None) -> State:
        return replace(self, rows=rows, names=self.names if names is None else names)


def select_part(s: State, part: int) -> State:
    return s.with_rows(s.rows.filter(F.col("part") == part) if "part" in s.rows.columns else s.rows)


def expand_indexed(s: State, bits: int) -> State:
    on = [s.image, "I"] if s.image in s.palette.columns else "I"
    names = [c for c in "RGBA" if c in s.palette.columns]
    return s.with_rows(normalised(s.rows.join(s.palette, on), names, f"unorm{bits}"), names)


def change_grid(s: State, step_x: int, step_y: int, width: int, height: int, *channels: str) -> State:
    coarse = [column(c) for c in channels]
    if set(s.names) <= set(coarse):
        return s.with_rows(grid.replicate(s.rows, step_x, step_y, width, height))
    return s.with_rows(grid.fill(s.rows, s.image, coarse, step_x, step_y))


def map_channels(s: State, source: str, made: str) -> State:
    return s.with_rows(s.rows.withColumns({c: F.col(column(source)) for c in made}), [*made, *(c for c in s.names if c == "A")])


def synthesize(s: State, channel: str, value: float) -> State:
    return s.with_rows(s.rows.withColumn(channel, F.lit(float(value))), [*s.names, channel])


def select_channels(s: State, *channels: str) -> State:
    return s.with_rows(s.rows, [column(c) for c in channels])


def _colours(s: State, f) -> State:
    return s.with_rows(s.rows.withColumns({c: f(F.col(c)) for c in s.names if c != "A"}))


def premultiply(s: State) -> State:
    return _colours(s, lambda c: samples.premultiply(c, F.col("A")))


def unpremultiply(s: State) -> State:
    return _colours(s, lambda c: samples.unpremultiply(c, F.col("A")))


def color_transform(s: State, source: str, target: str) -> State:
    curves = {("linear", "srgb"): samples.linear_to_srgb, ("srgb", "linear"): samples.srgb_to_linear}
    if (source, target) not in curves:
        raise PlanError(f"no transform from {source} to {target}")
    return _colours(s, curves[source, target])


def decode_elements(s: State, encoding: str, width: int, height: int) -> State:
    word = F.col("element")
    if encoding in BLOCKS:
        names = {"bc4": ["R"], "bc5": ["R", "G"], "bc6h": list("RGB"), "bc6h_signed": list("RGB")}.get(encoding, list("RGBA"))
        texels = blocks.decode_blocks(s.rows, s.image, encoding, names, width, height)
        return replace(s.with_rows(texels if encoding.startswith("bc6h") else normalised(texels, names, "unorm8"), names), encoded=None)
    if encoding == "rgbe":
        byte = lambda k: F.shiftright(word, 8 * k).bitwiseAND(255)
        made = {c: packed.rgbe_decode(byte(k), byte(3)) for k, c in enumerate("rgb")}
    elif encoding in ("rgb9e5", "r11g11b10f"):
        made = {"rgb9e5": packed.rgb9e5_decode, "r11g11b10f": packed.r11g11b10f_decode}[encoding](word)
    elif encoding in packed.FIELDS:
        made = packed.unpack_unorm(word, encoding)
    else:
        raise PlanError(f"no decoder for {encoding}")
    names = [c.upper() for c in "rgba" if c in made]
    return replace(s.with_rows(s.rows.withColumns({c.upper(): v for c, v in made.items()}).drop("element"), names), encoded=None)


def encode_elements(s: State, encoding: str) -> State:
    if encoding in ("bc1", "bc2", "bc3", "bc4", "bc5"):
        rows = blocks.encode_blocks(stored(s.rows, s.names, "unorm8"), s.image, encoding, s.names)
        return replace(s.with_rows(rows, []), encoded=encoding)
    c = {n.lower(): F.col(n) for n in s.names}
    if encoding == "rgbe":
        made = packed.rgbe_encode(c["r"], c["g"], c["b"])
        word = sum((F.shiftleft(made[k].cast("long"), 8 * i) for i, k in enumerate("gbe", 1)), made["r"].cast("long"))
    elif encoding in ("rgb9e5", "r11g11b10f"):
        word = {"rgb9e5": packed.rgb9e5_encode, "r11g11b10f": packed.r11g11b10f_encode}[encoding](c["r"], c["g"], c["b"])
    elif encoding in packed.FIELDS:
        word = packed.pack_unorm(c, encoding)
    else:
        raise PlanError(f"no encoder for {encoding}")
    return replace(s.with_rows(s.rows.withColumn("element", word), []), encoded=encoding)


LOWERINGS = {
    "select_part": select_part, "expand_indexed": expand_indexed, "change_grid": change_grid, "map_channels": map_channels, "synthesize": synthesize,
    "select_channels": select_channels, "premultiply": premultiply, "unpremultiply": unpremultiply, "color_transform": color_transform,
    "decode_elements": decode_elements, "encode_elements": encode_elements,
    "transcode": lambda s, encoding: replace(s, encoded=encoding),  # the elements stay as they are
    "crop": lambda s, *box: s.with_rows(geometry.crop(s.rows, *box)),
    "resample": lambda s, *sizes: s.with_rows(geometry.resample(s.rows, s.image, sizes[:2], sizes[2:], s.names)),
    "orient": lambda s, name, width, height: s.with_rows(geometry.orient(s.rows, width, height, name)),
    "map_window": lambda s, dx, dy: s.with_rows(geometry.map_window(s.rows, dx, dy)),
    "convert_sample": lambda s, source, target: s,  # values between entry and exit are normalised
    "drop_metadata": lambda s, namespace: s, "preserve_metadata": lambda s, *namespaces: s,  # pixels carry none
}


def apply(s: State, step: Step) -> State:
    if step.name in REFUSED:
        raise PlanError(f"{step.name} is named in plans and not carried out")
    if step.name not in LOWERINGS:
        raise PlanError(f"no lowering for the step {step}")
    return LOWERINGS[step.name](s, *step.args)


def lower(pixels: DataFrame, plan: Plan, channels: tuple[str, ...], sample: str, palette: DataFrame | None = None, image: str = "image") -> DataFrame:
    """pixels (or elements, if the plan begins by decoding or passing them on) in, rows of the plan's target out."""
    later = any(step.name in ("decode_elements", "transcode", "expand_indexed") for step in plan.steps)
    names = [] if later else [column(c) for c in channels]
    s = State(normalised(pixels, names, sample), names, image, palette)
    for step in plan.steps:
        s = apply(s, step)
    if s.encoded in BLOCKS:
        return s.rows.select(image, "brow", "bcol", "element")
    if s.encoded:
        return s.rows.select(image, "y", "x", "element")
    return stored(s.rows.select(image, "y", "x", *s.names), s.names, plan.target.sample)
