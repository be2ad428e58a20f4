"""What a search asks for, checked on the driver before any job runs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from enum import Enum
from numbers import Real


class Mode(str, Enum):
    KNN_CLIM = "knn_clim"
    KNN_GEOG = "knn_geog"
    COUNT = "count"
    SUM = "sum"
    MEAN = "mean"
    ALL = "all"

    @property
    def nearest(self) -> bool:
        return self in (Mode.KNN_CLIM, Mode.KNN_GEOG)

    @property
    def weighted(self) -> bool:
        return self in (Mode.SUM, Mode.MEAN)

    @property
    def pairs(self) -> bool:
        return self.nearest or self is Mode.ALL


class Weight(str, Enum):
    UNIFORM = "uniform"
    INVERSE_CLIM = "inverse_clim"
    INVERSE_GEOG = "inverse_geog"


class Coords(str, Enum):
    AUTO = "auto"
    LONLAT = "lonlat"
    PROJECTED = "projected"


def _choice(kind: type[Enum], value, what: str):
    try:
        return kind(value)
    except ValueError:
        raise ValueError(f"{what} must be one of {', '.join(x.value for x in kind)}; got {value!r}") from None


def _single(value):
    """The first element of a sequence; None for an empty one."""
    if isinstance(value, Sequence) and not isinstance(value, str):
        return value[0] if value else None
    return value


def _finite(value) -> bool:
    return value is not None and math.isfinite(value)


@dataclass(frozen=True)
class SearchSpec:
    """A validated search.

    Thresholds are inclusive.  ``None``, an infinity or NaN switch a scalar
    threshold off; zero keeps exact matches; a negative one matches nothing.
    A sequence of two or more climate thresholds bounds each variable.
    """

    mode: Mode
    max_clim: float | tuple[float, ...] | None
    max_geog: float | None
    k: int | None
    weight: Weight | None
    theta: float | None
    report_dist: bool
    coord_type: Coords
    #: A bound on the climate distance beside ``max_clim``; operators set it.
    clim_radius: float | None = None

    @classmethod
    def make(cls, mode="knn_clim", max_clim=None, max_geog=None, k=None, weight=None, theta=None, report_dist=True, coord_type="auto", n_threads=None) -> SearchSpec:
        """``n_threads`` is accepted and ignored: the cluster sets the parallelism."""
        mode, coords = _choice(Mode, mode, "mode"), _choice(Coords, coord_type, "coord_type")
        if mode.nearest:
            if isinstance(k, Sequence) and len(k) != 1:
                raise ValueError("k must be a single number")
            k = _single(k)
            k = 1 if k is None else k
            if isinstance(k, bool) or not isinstance(k, Real) or not math.isfinite(k) or int(k) < 1:
                raise ValueError("k must be a single number of at least 1")
            k = int(k)
            if weight is not None or theta is not None:
                raise ValueError("weight and theta don't apply to nearest-neighbour modes")
        elif k is not None:
            raise ValueError("k applies to nearest-neighbour modes only")
        if mode in (Mode.ALL, Mode.COUNT) and (weight is not None or theta is not None):
            raise ValueError(f"weight and theta don't apply to mode {mode.value}")
        if mode.weighted:
            weight = Weight.UNIFORM if weight is None else _choice(Weight, weight, "weight")
            if weight is Weight.UNIFORM:
                if theta is not None:
                    raise ValueError("theta doesn't apply to uniform weights")
            elif theta is not None:
                if isinstance(theta, bool) or not isinstance(theta, Real) or math.isnan(theta) or theta <= 0:
                    raise ValueError("theta must be a single positive number")
                theta = float(theta)
        max_geog = _single(max_geog)
        max_geog = float(max_geog) if _finite(max_geog) else None
        if isinstance(max_clim, Sequence) and not isinstance(max_clim, str):
            max_clim = tuple(math.inf if v is None else float(v) for v in max_clim)
            if len(max_clim) < 2:
                max_clim = _single(max_clim)
        if not isinstance(max_clim, tuple):
            max_clim = float(max_clim) if _finite(max_clim) else None
        return cls(mode, max_clim, max_geog, k, weight, theta, bool(report_dist), coords)

    def check_arity(self, focal: int, ref: int) -> None:
        if focal != ref:
            raise ValueError(f"focal has {focal} climate variables, ref has {ref}")
        if isinstance(self.max_clim, tuple) and len(self.max_clim) != ref:
            raise ValueError(f"max_clim needs 1 or {ref} values; got {len(self.max_clim)}")

    def bands(self, variables: int) -> list[float | None]:
        """The bound of each climate variable that the thresholds imply; None: unbounded."""
        own = [None if math.isnan(t) or t == math.inf else t for t in self.max_clim] if isinstance(self.max_clim, tuple) else [self.max_clim] * variables
        return own if self.clim_radius is None else [self.clim_radius if t is None else min(t, self.clim_radius) for t in own]

    def within(self, radius: float) -> SearchSpec:
        """The search with the distance that ranks its neighbours bounded by ``radius``, too."""
        if self.mode is Mode.KNN_CLIM:
            return replace(self, clim_radius=radius)
        return replace(self, max_geog=radius if self.max_geog is None else min(radius, self.max_geog))

    def needs(self, variables: int) -> list[str]:
        """Columns that decide what matches, ranks or weighs: points that agree in them are alike to the search."""
        whole = self.mode is Mode.KNN_CLIM or self.weight is Weight.INVERSE_CLIM
        clim = [f"c{i}" for i, t in enumerate(self.bands(variables)) if whole or t is not None]
        place = self.max_geog is not None or self.mode is Mode.KNN_GEOG or self.weight is Weight.INVERSE_GEOG
        return [*(["x", "y"] if place else []), *clim]

    @property
    def unbounded(self) -> bool:
        """Whether no threshold is active."""
        clim = self.max_clim if isinstance(self.max_clim, tuple) else (self.max_clim,)
        return self.max_geog is None and all(t is None or math.isnan(t) or t == math.inf for t in clim)

    @property
    def nothing(self) -> bool:
        """Whether a negative threshold rejects every pair."""
        clim = self.max_clim if isinstance(self.max_clim, tuple) else (self.max_clim,)
        return any(t is not None and t < 0 for t in (*clim, self.max_geog))

    @property
    def epsilon(self) -> float:
        """What inverse weights add to a distance; fixed defaults."""
        default = 1e-12 if self.weight is Weight.INVERSE_CLIM else 1e-6
        return self.theta if _finite(self.theta) and self.theta > 0 else default
