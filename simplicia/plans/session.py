"""A session over one set of points: each stage is kept under what it depends on, and a change recomputes what follows it."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.functions.filters import LaplacianEigenVector, PrincipalComponent
from simplicia.operators.cover import level_sets
from simplicia.operators.mapper import cut, dendrograms, form_clusters, nerve
from simplicia.plans.pipeline import Graph, Params


@dataclass
class Session:
    points: DataFrame
    keep: int = 32  # stages remembered; the least recently used is unpersisted beyond that
    knn: dict = field(default_factory=dict)  # neighbour graphs by distance name
    memo: OrderedDict = field(default_factory=OrderedDict)
    computed: list = field(default_factory=list)  # names of stages in the order in which they were built

    def _stage(self, name: str, key: Hashable, build: Callable[[], DataFrame]) -> DataFrame:
        k = (name, key)
        if k in self.memo:
            self.memo.move_to_end(k)
            return self.memo[k]
        self.computed.append(name)
        self.memo[k] = build().persist()
        while len(self.memo) > self.keep:
            self.memo.popitem(last=False)[1].unpersist()
        return self.memo[k]

    def _frames(self, params: Params) -> dict:
        out = {}
        for f in params.filters:
            if f.lens.column() is not None:
                continue
            if isinstance(f.lens, PrincipalComponent | LaplacianEigenVector):
                graph = self.knn.get(f.lens.distance.name) if isinstance(f.lens, LaplacianEigenVector) else None
                build = (lambda f=f, g=graph: f.lens.all(self.points, g)) if graph is not None or isinstance(f.lens, LaplacianEigenVector) else (lambda f=f: f.lens.all(self.points))
                out[f.lens] = self._stage("lens", f.lens.key(), build).select("index", F.col("values")[f.lens.n].alias("value"))
            else:
                out[f.lens] = self._stage("lens", f.lens.key(), lambda f=f: f.lens.frame(self.points))
        return out

    def update(self, params: Params) -> Graph:
        """The graph of ``params``: lens, dendrograms, cut, collapse and colours each come from memory if what they need is unchanged."""
        cells = (params.filters,)
        way = (params.distance.name, params.method, params.provider)
        trees = self._stage("trees", (*cells, *way), lambda: dendrograms(level_sets(self.points, params.filters, self._frames(params)), params.distance, params.method, params.provider))
        at = (*cells, *way, params.scale)
        labelled = self._stage("cut", at, lambda: cut(trees, params.scale))
        clusters = self._stage("clusters", (*at, params.collapse), lambda: form_clusters(labelled, params.collapse))
        edges = self._stage("edges", (*at, params.collapse), lambda: nerve(clusters))
        colours = self._stage("colours", (*at, params.collapse, params.colouring), lambda: params.colouring(self.points, clusters))
        return Graph(clusters, edges, colours)

    def run(self, stream: Iterable[Params]) -> Iterator[Graph]:
        """One graph for each parameter set that differs from the one before."""
        last = None
        for params in stream:
            if params != last:
                last = params
                yield self.update(params)

    def close(self) -> None:
        for df in self.memo.values():
            df.unpersist()
        self.memo.clear()
