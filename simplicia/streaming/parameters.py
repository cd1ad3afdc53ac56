"""A stream of parameter messages drives a session: each micro-batch's messages update the graph in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from simplicia.functions.distances import NAMED
from simplicia.operators import colour
from simplicia.plans.pipeline import Graph, Params
from simplicia.plans.session import Session

SCHEMA = "seq long, setting string, filter int, value double, name string"
#: Colourings that a message may name; its value is the number of bins.
COLOURINGS = {"nop": lambda bins: colour.nop, "constant": lambda bins: colour.constantly(bins), "size": lambda bins: colour.cluster_size(bins)}


def apply_message(params: Params, setting: str, filter_: int | None, value: float | None, name: str | None = None) -> Params:
    """One message: bins, overlap, resolution or collapse by value, distance, linkage or colour by name. Unknown settings and names change nothing."""
    if setting == "distance":
        return params.with_distance(NAMED.get(name or "", params.distance))
    if setting == "linkage":
        return params.with_method(name or "")
    if setting == "colour":
        return params.with_colouring(COLOURINGS[name](int(value or 0))) if name in COLOURINGS else params
    if value is None:
        return params
    if setting == "bins":
        return params.with_bins(filter_ or 0, int(value))
    if setting == "overlap":
        return params.with_overlap(filter_ or 0, value)
    if setting == "resolution":
        return params.with_resolution(int(value))
    return params.with_collapse(bool(value)) if setting == "collapse" else params


@dataclass
class ParameterStream:
    session: Session
    params: Params
    on_graph: Callable[[Graph], None]

    def batch(self, messages: DataFrame, batch_id: int) -> None:
        """Fold a batch of messages, few by nature, and update once for each change."""
        def changes():
            for m in messages.orderBy("seq").collect():
                self.params = apply_message(self.params, m.setting, m["filter"], m.value, m.name)
                yield self.params

        for graph in self.session.run(changes()):
            self.on_graph(graph)

    def start(self, spark: SparkSession, folder: str, checkpoint: str) -> StreamingQuery:
        """Watch a folder of JSON messages."""
        return spark.readStream.schema(SCHEMA).json(folder).writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
