"""Clustering of embeddings: the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeloom.llm import drift_kmeans
from placeloom.llm.registry import query, table

SETTINGS = drift_kmeans.KMeansSettings(clusters=8, rounds=10, dimensions=64, scale=1024, salt="3:")


def _rounds(rounds: int) -> str:
    """The rounds one after the other: every vector to its nearest centroid, then the means."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, cluster, distance FROM (
    SELECT rid, cluster, distance, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS place
    FROM (SELECT rid, cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{r} c USING (i) GROUP BY ALL))
  WHERE place = 1)""")
        if r < rounds:
            parts.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, c.i, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c.x) AS x
  FROM c{r} c LEFT JOIN (
    SELECT cluster, i, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (rid) GROUP BY ALL) USING (cluster, i))""")
    return ",".join(parts)


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
v AS MATERIALIZED (
  SELECT rid, i, floor(1024 * x::DOUBLE)::BIGINT AS x
  FROM (SELECT rid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept)),
c0 AS MATERIALIZED (
  SELECT cluster::INTEGER AS cluster, i, x
  FROM (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM kept) JOIN v USING (rid)
  WHERE cluster < 8),{_rounds(10)},
sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a10 GROUP BY cluster),
shas AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY cluster)
SELECT vec_id, cluster, distance::BIGINT AS distance, cluster_inertia,
       (SELECT sum(cluster_inertia) FROM sums)::BIGINT AS inertia, centroid_sha256
FROM a10 JOIN kept USING (rid) JOIN sums USING (cluster) JOIN shas USING (cluster)
"""


@query("op12_centroid_clusters", OP12_SQL)
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = drift_kmeans.cluster(table(spark, sf_dir, "embeddings"), SETTINGS)
    # A row per centroid: eight.
    whole = centroids.select(
        "cluster",
        F.col("inertia").alias("cluster_inertia"),
        F.sum("inertia").over(Window.partitionBy()).alias("inertia"),
        drift_kmeans.centroid_digest(F.col("centroid")).alias("centroid_sha256"),
    )
    return members.join(F.broadcast(whole), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
