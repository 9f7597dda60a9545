"""The conversion planner: from a description of an image to steps, with every loss reported before any job runs.

A plan is a list of small records; lowering.py turns them into DataFrame transformations. Steps come in a fixed
order, steps that would change nothing are left out, and an encoded image that stays as it is passes through.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

POLICIES = ("strict", "preserve", "preview", "explicit")


#: Kinds of loss. What keeps the meaning of an image is no semantic loss: replication, turning, a crop that was asked for.
CATEGORIES = ("numeric", "channel", "colorimetric", "dynamic_range", "spatial", "orientation", "sampling", "topology", "metadata", "compression", "transcode")


class PlanError(ValueError):
    """No plan exists, or the policy forbids it; category: of the reason."""

    def __init__(self, message: str, category: str = "transcode"):
        super().__init__(message)
        self.category = category


@dataclass(frozen=True)
class Loss:
    category: str  # one of CATEGORIES
    message: str
    semantic: bool = True


def gate(policy: str, losses: list[Loss]) -> list[Loss]:
    """The losses, if the policy lets them pass: strict none, preserve none that is semantic, the others all."""
    bad = losses if policy == "strict" else [x for x in losses if x.semantic] if policy == "preserve" else []
    if bad:
        raise PlanError(f"{policy}: " + "; ".join(x.message for x in bad), bad[0].category)
    return losses


@dataclass(frozen=True)
class Description:
    """One part: extent, channel names, sample type, and what else a codec reports."""

    width: int
    height: int
    channels: tuple[str, ...]
    sample: str = "unorm8"
    encoding: str | None = None
    orientation: str = "identity"
    indexed: bool = False
    palette_bits: int = 8
    premultiplied: bool = False
    subsampled: tuple = ()  # names of channels on a coarser grid, or that grid's steps where all channels stand on it
    grid: tuple[int, int] = (2, 2)  # steps of the named ones
    parts: int = 1
    metadata: tuple[str, ...] = ()  # namespaces


@dataclass(frozen=True)
class Capabilities:
    samples: tuple[str, ...]
    channel_counts: tuple[int, ...] | None = None
    encodings: tuple[str, ...] = ()
    arbitrary_names: bool = False
    multipart: bool = False
    orientation: bool = False
    metadata: tuple[str, ...] = ()

    @staticmethod
    def of(codec) -> Capabilities:
        return Capabilities(codec.samples, codec.channel_counts, codec.encodings, codec.arbitrary_names, codec.multipart, codec.orientation, codec.metadata)


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple = ()

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass
class Plan:
    steps: list[Step]
    target: Description
    losses: list[Loss] = field(default_factory=list)
    policy: str = "preserve"

    def text(self) -> str:
        return "|".join(["1", self.policy, *map(str, self.steps)])

    def fingerprint(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def then(self, name: str, *args) -> Plan:
        """The plan with a step that the planner itself never chooses: map_window, premultiply, color_transform, ..."""
        return replace(self, steps=[*self.steps, Step(name, args)])


#: Steps that frames of pixels refuse: codecs do the one kind themselves, and pixels carry no metadata.
REFUSED = ("remove_supercompression", "apply_supercompression", "translate_metadata")
#: Namespaces whose entries other formats can say.
TRANSLATABLE = ("png", "png.text", "exr", "ktx2", "hdr", "jpeg")

# Channels of encoded targets, and the samples that their colours are brought to first.
ENCODED = {
    "bc1": (("R", "G", "B", "A"), "unorm8"), "bc2": (("R", "G", "B", "A"), "unorm8"), "bc3": (("R", "G", "B", "A"), "unorm8"),
    "bc4": (("R",), "unorm8"), "bc5": (("R", "G"), "unorm8"), "rgbe": (("R", "G", "B"), "float32"), "b5g6r5": (("R", "G", "B"), "unorm8"),
    "b5g5r5a1": (("R", "G", "B", "A"), "unorm8"), "r10g10b10a2": (("R", "G", "B", "A"), "unorm16"), "r11g11b10f": (("R", "G", "B"), "float16"), "rgb9e5": (("R", "G", "B"), "float16"),
}
NO_ENCODER = ("bc6h", "bc6h_signed", "bc7")


def canonical(channels: tuple[str, ...], most: int | None) -> tuple[list[str], list[str]]:
    """Known channels in the order R, G, B, A, Y (Y, A for grey images), at most `most`; and what is dropped."""
    order = ("Y", "A") if set(channels) <= {"Y", "A"} else ("R", "G", "B", "A", "Y")
    kept = [c for c in order if c in channels][:most]
    return kept, [c for c in channels if c not in kept]


def replacement(sample: str, supported: tuple[str, ...]) -> tuple[str, Loss | None]:
    if sample in supported:
        return sample, None
    floating = sample.startswith("float")
    if floating and "unorm16" in supported:
        to = "unorm16"
    elif "unorm8" in supported:
        to = "unorm8"
    elif "float32" in supported:
        to = "float32"
    else:
        to = supported[0]
    return to, converted(sample, to)


def converted(sample: str, to: str) -> Loss:
    return Loss("dynamic_range" if sample.startswith("float") and not to.startswith("float") else "numeric", f"{sample} to {to}")


def plan(source: Description, target: Capabilities, policy: str = "preserve", encoding: str | None = None, resize: tuple[int, int] | None = None, crop: tuple[int, int, int, int] | None = None, metadata: str = "drop") -> Plan:
    if policy not in POLICIES:
        raise PlanError(f"unknown policy {policy}")
    if metadata not in ("drop", "keep"):
        raise PlanError(f"metadata can be dropped or kept, not {metadata}", "metadata")
    if resize and min(resize) <= 0 or crop and (min(crop[2:]) <= 0 or min(crop[:2]) < 0):
        raise PlanError("extents must be positive", "topology")
    if crop and (crop[0] + crop[2] > source.width or crop[1] + crop[3] > source.height):
        raise PlanError("the crop lies outside", "topology")
    if encoding in NO_ENCODER:
        raise PlanError(f"no encoder for {encoding}")
    if encoding and encoding not in target.encodings:
        raise PlanError(f"the target has no {encoding}")
    if encoding is None and "rgbe" in target.encodings:
        encoding = "rgbe"
    steps, losses, now = [], [], source
    if source.parts > 1 and not target.multipart:
        steps.append(Step("select_part", (0,)))
        losses.append(Loss("topology", f"{source.parts - 1} parts dropped"))
        now = replace(now, parts=1)
    fixed = source.orientation == "identity" or target.orientation
    if source.encoding and source.encoding == (encoding or source.encoding) and source.encoding in target.encodings and not resize and not crop and fixed:
        steps.append(Step("transcode", (source.encoding,)))
        dropped: list[Loss] = []
        steps += _metadata(source, dropped, target, metadata)
        return _finish(Plan(steps, replace(now, metadata=()), losses + gate(policy, dropped), policy))
    if source.encoding:
        steps.append(Step("decode_elements", (source.encoding, source.width, source.height)))
        now = replace(now, encoding=None)
    if source.indexed:
        if source.palette_bits not in (8, 16):
            raise PlanError("palette samples must have 8 or 16 bits")
        steps.append(Step("expand_indexed", (source.palette_bits,)))
        now = replace(now, indexed=False, sample=f"unorm{source.palette_bits}", channels=("R", "G", "B", "A") if "A" in source.channels else ("R", "G", "B"))
    if source.subsampled:
        named = [c for c in source.subsampled if isinstance(c, str)]
        step = source.grid if named else source.subsampled
        steps.append(Step("change_grid", (*step, source.width, source.height, *(named or now.channels))))
        losses += gate(policy, [Loss("sampling", "subsampled channels are replicated", semantic=False)])
    dropped = []
    now = _channels(now, target, encoding, steps, dropped)
    losses += gate(policy, dropped)
    to, loss = replacement(now.sample, target.samples)
    if encoding:
        to = ENCODED[encoding][1]
        loss = converted(now.sample, to) if to != now.sample else None
    if to != now.sample:
        if now.sample == "uint32":
            raise PlanError("uint32 channels can't be converted")
        steps.append(Step("convert_sample", (now.sample, to)))
        losses += gate(policy, [loss])
        now = replace(now, sample=to)
    if source.premultiplied:
        steps.append(Step("unpremultiply"))
        now = replace(now, premultiplied=False)
    if crop and crop != (0, 0, now.width, now.height):
        steps.append(Step("crop", crop))
        losses.append(Loss("topology", f"cropped to {crop[2]} x {crop[3]}", semantic=False))
        now = replace(now, width=crop[2], height=crop[3])
    if resize and resize != (now.width, now.height):
        steps.append(Step("resample", (now.width, now.height, *resize)))
        losses.append(Loss("topology", f"resized to {resize[0]} x {resize[1]}", semantic=False))
        now = replace(now, width=resize[0], height=resize[1])
    if not fixed:
        steps.append(Step("orient", (source.orientation, now.width, now.height)))
        losses += gate(policy, [Loss("orientation", "pixels are turned, as the target has no orientation", semantic=False)])
        swap = source.orientation in ("transpose", "rotate90", "rotate270", "transverse")
        now = replace(now, orientation="identity", width=now.height if swap else now.width, height=now.width if swap else now.height)
    steps += _metadata(source, losses, target, metadata)
    if encoding:
        steps.append(Step("encode_elements", (encoding,)))
        losses += gate(policy, [Loss("compression", f"encoded as {encoding}")])
        now = replace(now, encoding=encoding)
    return _finish(Plan(steps, replace(now, metadata=()), losses, policy))


def _channels(now: Description, target: Capabilities, encoding: str | None, steps: list[Step], losses: list[Loss]) -> Description:
    if target.arbitrary_names and not encoding:
        return now
    counts = target.channel_counts
    grey = set(now.channels) <= {"Y", "A"}
    wants_colour = encoding and "G" in ENCODED[encoding][0]
    if grey and (wants_colour or (counts and len(now.channels) not in counts and {3, 4} & set(counts))):
        names = ("R", "G", "B", "A") if "A" in now.channels else ("R", "G", "B")
        steps.append(Step("map_channels", ("Y", "RGB")))
        now = replace(now, channels=names)
    if encoding:
        wanted = ENCODED[encoding][0]
        source = ("Y",) if grey and wanted == ("R",) else ()
        have = [c for c in wanted if c in now.channels]
        missing = [c for c in wanted if c not in now.channels and c != "A"]
        if missing and not source:
            raise PlanError(f"{encoding} needs {missing}", "channel")
        if source:
            steps.append(Step("map_channels", ("Y", "R")))
            have = ["R"]
        dropped = [c for c in now.channels if c not in have and c not in source]
        if "A" in wanted and "A" not in have:
            steps.append(Step("synthesize", ("A", 1.0)))
            have.append("A")
        now_names = tuple(c for c in wanted if c in have)
    else:
        kept, dropped = canonical(now.channels, max(counts) if counts else None)
        if not kept:
            raise PlanError("no channel is known to the target", "channel")
        if counts and len(kept) not in counts:
            if len(kept) + 1 in counts and "A" not in kept:
                steps.append(Step("synthesize", ("A", 1.0)))
                kept = kept + ["A"]
            else:
                raise PlanError(f"{len(kept)} channels are not supported", "channel")
        now_names = tuple(kept)
    if dropped:
        losses.append(Loss("channel", f"dropped {', '.join(dropped)}"))
    if now_names != now.channels:
        steps.append(Step("select_channels", now_names))
    return replace(now, channels=now_names)


def _metadata(source: Description, losses: list[Loss], target: Capabilities, metadata: str) -> list[Step]:
    """A step for each namespace. What kept ones lose depends on their entries, and is reported where these are at hand."""
    steps, family = [], lambda n: n.partition(".")[0]
    for n in sorted(set(source.metadata)):
        if metadata == "keep" and family(n) in map(family, target.metadata) and n != "exr.part":
            steps.append(Step("preserve_metadata", (n,)))
        elif metadata == "keep" and target.metadata and n in TRANSLATABLE:
            steps.append(Step("translate_metadata", (n, target.metadata[-1])))
        else:
            steps.append(Step("drop_metadata", (n,)))
            losses.append(Loss("metadata", f"namespace {n} dropped"))
    return steps


def _finish(p: Plan) -> Plan:
    """Losses that no step is refused for count at the end, and there in strict plans only."""
    if p.policy == "strict":
        gate(p.policy, p.losses)
    return p
