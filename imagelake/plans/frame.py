"""A fluent surface over planner and lowering: ImageFrame(...).crop(...).resize(...).plan() / .pixels()."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from imagelake.plans.lowering import lower
from imagelake.plans.planner import Capabilities, Description, Plan, plan
from imagelake.sources.base import Codec


@dataclass(frozen=True)
class ImageFrame:
    """Pixels (image, y, x, channels) of images that share one description. Immutable: each call returns a new one."""

    data: DataFrame
    description: Description
    box: tuple[int, int, int, int] | None = None
    size: tuple[int, int] | None = None
    palette: DataFrame | None = None

    def crop(self, x: int, y: int, width: int, height: int) -> ImageFrame:
        return replace(self, box=(x, y, width, height))

    def resize(self, width: int, height: int) -> ImageFrame:
        return replace(self, size=(width, height))

    def plan(self, codec: Codec, policy: str = "preserve", encoding: str | None = None) -> Plan:
        return plan(self.description, Capabilities.of(codec), policy, encoding, self.size, self.box)

    def pixels(self, codec: Codec, policy: str = "preserve", encoding: str | None = None) -> DataFrame:
        """Pixels as the codec takes them, or elements where they are encoded."""
        return self.run(self.plan(codec, policy, encoding))

    def run(self, plan: Plan) -> DataFrame:
        d = self.description
        return lower(self.data, plan, d.channels, d.sample, self.palette)
