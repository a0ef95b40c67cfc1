"""Centroid clustering by dimension-sharded Lloyd rounds in exact integers.

Vectors are cut into blocks of columns, one shard each. In a round, a shard's tasks know only their slice of the
centroids and give every vector's partial distances to it; partial distances are added by vector and the nearest
centroid is chosen; then each shard sums its own columns by cluster and updates its own slice. The centroids as a whole
are k x d numbers, bounded by parameters; vectors never meet in one task or on the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.operators.storage import local_table, shared_dir, written

CLUSTERS, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
#: Columns of a shard.
WIDTH = 16
#: Components beyond this have squares whose sums do not fit 64 bits.
LARGEST = 2**26

SCHEMA = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _partial_distances(centroids: np.ndarray):
    """Squared distances of a block of columns to one slice of the centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            parts = []
            for c in centroids:
                apart = x - c
                parts.append(pa.array(np.einsum("ij,ij->i", apart, apart)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], names=["row", *(f"d{i}" for i in range(len(parts)))])

    return run


def lloyd(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = "1") -> DataFrame:
    """Cluster the rows of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``size`` components, none null or non-finite; each becomes floor(scale x component).
    Centroids start as the ``clusters`` kept vectors with the smallest SHA-256 of ``seed:vec_id`` (ties, of repeated ids:
    the smaller vector; fewer vectors, fewer clusters; rows without an id are clustered and start none). Each round
    assigns every vector to the nearest centroid (ties: the smaller number), then every non-empty centroid becomes the
    componentwise floor of its vectors' mean; at last vectors are assigned once more. ``distance`` is squared,
    ``cluster_inertia`` and ``inertia`` are its sums over the cluster and over all, ``centroid_sha256`` is of the final
    centroid's components joined by commas. All arithmetic is exact. A vector with an integer beyond 2^26 is left out, as
    its squares would not fit. Repeated rows are rows of their own; an empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vec_id"]
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    sound = (F.size("embedding") == size) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) > float(LARGEST)))
    kept = vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", numbers.cast("array<long>").alias("v"))
    rows = written(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where("vec_id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], SCHEMA.format(kind))
    k = len(first)
    start = np.array([r["v"] for r in first], np.int64)

    # One folder for each shard, so that its tasks read nothing else.
    lows = range(0, size, WIDTH)
    path = f"{shared_dir(spark)}/playseq/shards-{uuid.uuid4().hex}"
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.slice("v", low + 1, WIDTH).alias("v")) for s, low in enumerate(lows)])
    rows.select("row", F.explode(shards).alias("s")).select("row", "s.*").write.partitionBy("shard").parquet(path)
    table = spark.read.schema("row long, v array<long>, shard int").parquet(path)
    slices = [start[:, low : low + WIDTH] for low in lows]

    def assigned() -> DataFrame:
        """Row, cluster and squared distance, with the slices as they are now."""
        names = [f"d{c}" for c in range(k)]
        parts = [table.where(F.col("shard") == s).select("row", "v").mapInArrow(_partial_distances(own), ", ".join(["row long", *(f"{n} long" for n in names)])) for s, own in enumerate(slices)]
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        total = every.groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
        nearest = F.array_min(F.array(*[F.struct(F.col(n).alias("distance"), F.lit(c).alias("cluster")) for c, n in enumerate(names)]))
        return written(total.select("row", nearest.alias("m")).select("row", "m.cluster", "m.distance"), "assigned")

    for _ in range(rounds):
        sums = table.join(assigned().select("row", "cluster"), "row").groupBy("shard", "cluster")
        n = F.count("*")
        floors = [((s := F.sum(F.get("v", F.lit(i)))) - F.pmod(s, n)).alias(f"s{i}") for i in range(WIDTH)]
        # One row for each shard and cluster.
        for r in sums.agg(n.alias("n"), *floors).collect():
            own = slices[r["shard"]]
            own[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(own.shape[1])]

    final = assigned()
    names = [(c, hashlib.sha256(",".join(str(x) for own in slices for x in own[c].tolist()).encode()).hexdigest()) for c in range(k)]
    inertia = final.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = final.agg(F.sum("distance")).first()[0]
    # At most ``clusters`` rows each.
    known = F.broadcast(local_table(spark, names, "cluster int, centroid_sha256 string"))
    out = rows.select("row", "vec_id").join(final, "row").join(F.broadcast(inertia), "cluster").join(known, "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")
