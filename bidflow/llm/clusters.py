"""Centroid clustering of integer vectors in expressions of the JVM.

Distances to the centroids, which are literals of the plan, are ``aggregate``
over ``zip_with``; ``array_min`` of (distance, number) chooses the cluster, and
sums of single components, grouped by cluster, move the centroids. The driver
sees one row of sums for each cluster, never a vector beyond the first centroids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.shared import staged

SCALE = 256
# Squared distances of vectors within this limit fit a long; larger components are an error.
MOST = 1 << 27
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid")


def array_literal(values: list[int]) -> str:
    """An array that the optimizer makes one literal; written as text, it is a few nodes of the plan instead of one each."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)"


def whole(vector: Column, dims: int) -> Column:
    """True for vectors of ``dims`` finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x."""

    def of(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(scale))
        told = F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}")).cast("bigint")
        return F.when(F.abs(scaled) <= MOST, F.floor(scaled)).otherwise(told)

    return F.transform(vector, of)


def nearest(centroids: list[list[int]], vector: str = "v") -> Column:
    """(distance, cluster) of the nearest centroid; ties go to the smaller number."""
    away = [
        f"named_struct('distance', aggregate(zip_with({vector}, {array_literal(c)}, (a, b) -> (a - b) * (a - b)),"
        f" 0L, (s, x) -> s + x), 'cluster', {i})"
        for i, c in enumerate(centroids)
    ]
    return F.expr(f"array_min(array({', '.join(away)}))")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of seed and id; equal hashes by vector."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(draw.alias("draw"), "v").orderBy("draw", "v").limit(k)
    return [list(r["v"]) for r in rows.collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid that has vectors becomes the floor of their mean; the others stay."""
    dims = range(len(centroids[0]))
    sums = (
        vectors.select(nearest(centroids)["cluster"].alias("cluster"), "v")
        .groupBy("cluster")
        .agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in dims])
    )
    found = {r["cluster"]: [r[f"s{i}"] // r["n"] for i in dims] for r in sums.collect()}
    return [found.get(i, c) for i, c in enumerate(centroids)]


def clustered(
    rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Rows with a whole vector, with cluster, distance, cluster_inertia, inertia and centroid.

    Rows whose vector is null, has another length, or holds a null or non-finite
    component are left out. A null id counts as empty text in the draw of the
    first centroids; repeated ids and rows are vectors like any other, so two
    centroids may be equal: the second then stays empty. With fewer than ``k``
    vectors each is a centroid; an empty table gives an empty one. Other columns
    pass through, whatever their names; those named like the new ones are
    replaced. Components beyond ``MOST`` after scaling are an error, since their
    distances fit no long.
    """
    rest = rows.drop(*ADDED)
    kept = rest.where(whole(F.col(vector), dims)).select(
        F.struct(*rest.columns).alias("row"), F.col(id_column).alias("id"), integers(F.col(vector)).alias("v")
    )
    kept = staged(kept, "vectors")
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        kinds = dict(zip(ADDED, ("int", "bigint", "bigint", "bigint", "array<bigint>"), strict=True))
        return kept.select("row.*", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    assigned = staged(kept.select("row", nearest(centroids).alias("near")).select("row", "near.*"), "assigned")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    own = [sums.get(i, 0) for i in range(len(centroids))]
    return assigned.select(
        "row.*",
        "cluster",
        "distance",
        F.get(F.expr(array_literal(own)), F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(own)).cast("bigint").alias("inertia"),
        F.get(F.expr(f"array({', '.join(array_literal(c) for c in centroids)})"), F.col("cluster")).alias("centroid"),
    )
