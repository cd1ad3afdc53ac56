"""Parameters of the pipeline and the pipeline in one call."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from simplicia.functions.distances import DEFAULT, Distance
from simplicia.functions.linkage import METHODS, Provider, cluster
from simplicia.functions.scale import Danifold, FirstGap, Histogram, Selector
from simplicia.operators import colour
from simplicia.operators.cover import Filter, level_sets
from simplicia.operators.mapper import form_clusters, local_clusters, nerve


@dataclass(frozen=True)
class Params:
    filters: tuple[Filter, ...]
    distance: Distance = DEFAULT
    method: str = "single"
    scale: Selector = field(default_factory=Histogram)
    collapse: bool = True
    colouring: colour.Colouring = colour.nop
    provider: Provider = cluster

    def _filter(self, i: int, **changes) -> Params:
        """A parameter set with filter ``i`` changed; unchanged for a filter that isn't there."""
        if not 0 <= i < len(self.filters):
            return self
        return replace(self, filters=tuple(replace(f, **changes) if k == i else f for k, f in enumerate(self.filters)))

    def with_bins(self, i: int, bins: int) -> Params:
        return self._filter(i, bins=bins)

    def with_overlap(self, i: int, overlap: float) -> Params:
        return self._filter(i, overlap=overlap)

    def with_resolution(self, n: int) -> Params:
        kinds = {Histogram: lambda: Histogram(n), Danifold: lambda: Danifold(n), FirstGap: lambda: FirstGap(n)}
        make = kinds.get(type(self.scale))
        return replace(self, scale=make()) if make else self

    def with_collapse(self, collapse: bool) -> Params:
        return replace(self, collapse=collapse)

    def with_distance(self, distance: Distance) -> Params:
        return replace(self, distance=distance)

    def with_method(self, method: str) -> Params:
        """Another linkage; unchanged for one that isn't there."""
        return replace(self, method=method.lower()) if method.lower() in METHODS else self

    def with_colouring(self, colouring: colour.Colouring) -> Params:
        return replace(self, colouring=colouring)


@dataclass(frozen=True)
class Graph:
    clusters: DataFrame
    edges: DataFrame
    colours: DataFrame


def mapper(points: DataFrame, params: Params, frames: dict | None = None, knn: dict[str, DataFrame] | None = None) -> Graph:
    """Cover, cluster, collapse, connect and colour; nothing runs until a result is asked for.

    ``frames``: ready values of lenses. ``knn``: neighbour graphs by distance name, for lenses that read one."""
    cells = level_sets(points, params.filters, frames, knn)
    clusters = form_clusters(local_clusters(cells, params.distance, params.method, params.scale, params.provider), params.collapse)
    return Graph(clusters, nerve(clusters), params.colouring(points, clusters))
