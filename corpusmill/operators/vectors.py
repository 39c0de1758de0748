"""Embeddings: exact nearest neighbours (voronoi), clusters at a cut and by density (density), projection, trajectories."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.shipping import ship

from . import control, density, voronoi
from .components import components

PROCESS_NOISE, MEASUREMENT_NOISE = 0.01, 0.1


def neighbours(vectors: DataFrame, k: int = 5, block: int = voronoi.BLOCK) -> DataFrame:
    """source, target, distance, rank: the k nearest others of each vector (id, embedding); ties by id."""
    return voronoi.neighbours(vectors, k, block)


def core_distances(near: DataFrame, samples: int = 5) -> DataFrame:
    """id, core: the distance to the samples-th nearest other."""
    return near.filter(F.col("rank") == samples).select(F.col("source").alias("id"), F.col("distance").alias("core"))


def cut(near: DataFrame, share: float = 0.9, samples: int = 5) -> float:
    """The core distance that a share of all is no greater than: exact, the discrete quantile; 0 without any.

    Core distances are numbered in their order by ranges, so that one row reaches the driver and no task holds all.
    """
    core = core_distances(near, samples)
    place = math.ceil(Fraction(str(share)) * core.count())
    found = density.numbered(core, "place", "core", "id").filter(F.col("place") == max(place, 1) - 1).first() if place else None
    return found["core"] if found else 0.0


def clusters(near: DataFrame, vectors: DataFrame, cut: float, samples: int = 5, least: int = 15) -> DataFrame:
    """id, cluster: single linkage over mutual reachability, cut at a distance; clusters below least members are noise (-1).

    A stand-in for density clustering with a chosen cut, on the neighbour graph.
    """
    core = core_distances(near, samples)
    reach = near.join(core.select(F.col("id").alias("source"), F.col("core").alias("c1")), "source").join(core.select(F.col("id").alias("target"), F.col("core").alias("c2")), "target")
    link = reach.filter(F.greatest("distance", "c1", "c2") <= cut).select(F.col("source").alias("u"), F.col("target").alias("v"))
    found = components(link)
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    kept = found.join(size, "component", "left_semi").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    return vectors.select("id").join(kept, "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def projected(vectors: DataFrame, dimensions: int = 2) -> DataFrame:
    """id, x, y: principal components, in place of a neighbourhood-preserving projection."""
    own = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    axes = vector_to_array(F.col("p"))
    found = PCA(k=dimensions, inputCol="v", outputCol="p").fit(own).transform(own)
    return found.select("id", axes[0].alias("x"), (axes[1] if dimensions > 1 else F.lit(0.0)).alias("y"))


def topology(near: DataFrame, cluster: DataFrame, place: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, x, y, cluster), edges (source, target, distance) and one row of counts. A step that gave nothing is an error."""
    for step, what in ((place, "projection"), (cluster, "clusters"), (near, "neighbours")):
        control.gate(step, f"{what} not found")
    node = place.join(cluster, "id")
    counts = node.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"))
    return node, near.select("source", "target", "distance"), counts.crossJoin(near.agg(F.count(F.lit(1)).alias("edges")))


def deviations(steps: DataFrame, trace: str, order: str, vector: str = "embedding") -> DataFrame:
    """trace, order, deviation, norm: a constant-gain-schedule Kalman filter along each trace.

    A trace is sequential by nature; its rows are sorted by Spark and streamed with the filter's state, so that no trace has
    to fit in memory. The filter starts again where the dimension changes.
    """
    ship(steps.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, estimate, spread = None, np.zeros(0), 1.0
        for batch in batches:
            traces, out = batch.column(0).to_pylist(), []
            for name, values in zip(traces, batch.column(2).to_pylist(), strict=True):
                z = np.asarray(values or [], np.float64)
                if name != now or len(z) != len(estimate):
                    now, estimate, spread = name, np.zeros(len(z)), 1.0
                wide = spread + PROCESS_NOISE
                gain = wide / (wide + MEASUREMENT_NOISE)
                off = z - estimate
                estimate, spread = estimate + gain * off, (1 - gain) * wide
                out.append((float(np.linalg.norm(off)), float(np.linalg.norm(z))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in zip(*out, strict=True))], ["trace", "step", "deviation", "norm"])

    own = steps.select(F.col(trace).cast("string").alias("trace"), F.col(order).cast("long").alias("step"), F.col(vector).cast("array<double>").alias("v"))
    return own.repartition("trace").sortWithinPartitions("trace", "step").mapInArrow(run, "trace string, step long, deviation double, norm double")
