"""Options of a run, checked once."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from pathlib import PurePath


def check_radii(radii) -> list[float]:
    """One or more radii as a sorted list: finite, positive, none twice."""
    if radii is None:
        raise ValueError("the radius method needs r_check")
    out = [float(radii)] if isinstance(radii, (int, float)) else [float(r) for r in radii]
    if not out or any(not math.isfinite(r) or r <= 0 for r in out):
        raise ValueError("radii must be finite positive numbers")
    if len(set(out)) < len(out):
        raise ValueError("a radius is given twice")
    return sorted(out)


def radius_token(radius: float) -> str:
    """A radius as part of a file name: 0.25 -> 0p25, 2.0 -> 2, 1e-05 -> 1em05."""
    text = repr(float(radius)).removesuffix(".0")
    return text.translate(str.maketrans({"+": "p", "-": "m", ".": "p"}))


def with_radius(path: str, radius: float) -> str:
    """A result's path with the radius before its extension."""
    p = PurePath(path)
    return str(p.with_name(f"{p.stem}_r_{radius_token(radius)}{p.suffix}"))


@dataclass(frozen=True)
class RunConfig:
    """One analysis. Names and defaults follow the command line; ``mode`` and ``intermediate_*`` are accepted and have no effect."""

    detection_method: str = "radius"
    background: str = "all"
    r_check: float | tuple[float, ...] | None = None
    grid_check: int | None = None
    z_mode: str = "discrete"
    column_name: str = "x,y,z,geneID,cell"
    min_gene_number: int = 5
    min_neighbor_number: int = 1
    expression_level: float = 100.0
    filter_threshold: float = 1e-5
    pair_keep: str = "last"
    distribution_analysis: bool = False
    r_dist: float | None = None
    around_count_threshold: int = 100
    shape_max_distance_count: int | None = 10_000
    shape_qvalue_threshold: float = 0.05
    unsegmented: bool = False
    rect_length: float = 20.0
    mode: str = "fast"
    exclude_cells: tuple[str, ...] = ()
    bucket_width: float | None = None

    def __post_init__(self):
        for value, allowed, name in (
            (self.detection_method, ("radius", "nine_grid"), "detection_method"),
            (self.background, ("all", "cooccurrence"), "background"),
            (self.z_mode, ("discrete", "continuous"), "z_mode"),
            (self.pair_keep, ("first", "last"), "pair_keep"),
            (self.mode, ("robust", "fast"), "mode"),
        ):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.detection_method == "radius":
            check_radii(self.r_check)
        elif self.grid_check is None:
            raise ValueError("the nine_grid method needs grid_check")
        elif isinstance(self.r_check, (tuple, list)) and len(self.r_check) > 1:
            raise ValueError("several radii need the radius method")
        if self.unsegmented and (self.background == "cooccurrence" or self.distribution_analysis or self.mode == "robust"):
            raise ValueError("unsegmented data has neither co-occurrence background nor distribution analysis nor robust mode")
        if self.distribution_analysis:
            if self.mode == "robust":
                raise ValueError("distribution analysis needs fast mode")
            if self.r_dist is None:
                raise ValueError("distribution analysis needs r_dist")
            if self.detection_method != "radius":
                raise ValueError("distribution analysis needs the radius method")
            if self.z_mode == "continuous":
                raise ValueError("distribution analysis takes z as discrete")
        if self.shape_max_distance_count is not None and self.shape_max_distance_count < self.around_count_threshold:
            raise ValueError("shape_max_distance_count is below around_count_threshold")
        if not 0 < self.shape_qvalue_threshold <= 1:
            raise ValueError("shape_qvalue_threshold must be above 0 and at most 1")
        if self.bucket_width is not None and not self.bucket_width > 0:
            raise ValueError("bucket_width must be positive")
        if self.rect_length <= 0:
            raise ValueError("rect_length must be positive")

    @property
    def reach(self) -> float:
        """The radius, or the grid distance."""
        return float(self.grid_check) if self.detection_method == "nine_grid" else check_radii(self.r_check)[0]

    def by_radius(self) -> list[RunConfig]:
        """A config for each radius."""
        if self.detection_method != "radius":
            return [self]
        return [replace(self, r_check=r) for r in check_radii(self.r_check)]
