"""Cluster maps, weights, draws and ID mapping. Clusters are customers, members their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import clusters as C
from strandmill.operators.batches import epoch_shuffle
from strandmill.operators.idmapping import (
    idmapping_clusters, idmapping_filter, idmapping_key_count,
)
from strandmill.plans.catalog.registry import SEED, docs, query, sql_uniform, table
from strandmill.session import fresh_path
from strandmill.sources.clusters import explode_cluster_lines, read_cluster_store
from strandmill.sources.lookup_store import open_lookup_store, write_lookup_store
from strandmill.sources.writers import write_cluster_store

# A second source puts the orders above this price into one cluster per priority.
HIGH_PRICE = 200000


def _members(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = orders.select(
        F.lit(0).alias("source"), F.col("o_custkey").cast("string").alias("cluster_id"),
        F.col("o_orderkey").cast("string").alias("member_id"), F.col("o_orderkey").alias("ord"),
    )
    second = orders.filter(F.col("o_totalprice") > HIGH_PRICE).select(
        F.lit(1).alias("source"), F.col("o_orderpriority").alias("cluster_id"),
        F.col("o_orderkey").cast("string").alias("member_id"), F.col("o_orderkey").alias("ord"),
    )
    return first.unionByName(second)


def _dataset(spark, sf_dir):
    """The orders that are finished; members outside are filtered away."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("row_ord")
    )


_MEMBERS_SQL = f"""
    SELECT 0 AS source, CAST(o_custkey AS VARCHAR) AS cluster_id,
           CAST(o_orderkey AS VARCHAR) AS member_id, o_orderkey AS ord FROM orders
    UNION ALL
    SELECT 1, o_orderpriority, CAST(o_orderkey AS VARCHAR), o_orderkey FROM orders
    WHERE o_totalprice > {HIGH_PRICE}
"""
_DATASET_SQL = """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS row_ord FROM orders WHERE o_orderstatus = 'F'
"""
_KEPT_SQL = f"SELECT * FROM ({_MEMBERS_SQL}) WHERE member_id IN (SELECT id FROM ({_DATASET_SQL}))"
_SIZES_SQL = f"""
    SELECT source, cluster_id, count(*) AS n, 1 / (1 + ln(count(*))) AS weight
    FROM ({_KEPT_SQL}) GROUP BY source, cluster_id
"""
_WEIGHTS_SQL = f"""
    SELECT id, row_ord, coalesce(weight, 0) AS weight FROM ({_DATASET_SQL}) d LEFT JOIN (
      SELECT member_id, weight FROM (
        SELECT k.member_id, s.weight, row_number() OVER (
          PARTITION BY k.member_id ORDER BY k.source DESC, f.cluster_ord DESC, k.cluster_id DESC) AS rn
        FROM ({_KEPT_SQL}) k JOIN ({_SIZES_SQL}) s USING (source, cluster_id)
        JOIN (SELECT source, cluster_id, min(ord) AS cluster_ord FROM ({_MEMBERS_SQL}) GROUP BY ALL) f
        USING (source, cluster_id))
      WHERE rn = 1) w ON d.id = w.member_id
"""


@query("cluster_explode", """
    SELECT CAST(o_custkey AS VARCHAR) AS cluster_id, CAST(o_orderkey AS VARCHAR) AS member_id FROM orders
""")
def cluster_explode(spark, sf_dir):
    """Cluster lines of up to 64 consecutive order numbers, taken apart again."""
    lines = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.expr("o_orderkey div 64").alias("id"))
        .agg(F.array_sort(F.collect_list(F.col("o_orderkey"))).alias("keys"))
        .select("id", F.concat_ws(
            "\t", F.col("o_custkey").cast("string"), F.transform("keys", lambda k: k.cast("string"))
        ).alias("text"))
    )
    return explode_cluster_lines(lines).select("cluster_id", "member_id")


@query("cluster_members", f"""
    SELECT source, cluster_id, member_id, ord,
           min(ord) OVER (PARTITION BY source, cluster_id) AS cluster_ord
    FROM ({_MEMBERS_SQL})
""")
def cluster_members(spark, sf_dir):
    return C.cluster_members(_members(spark, sf_dir))


@query("cluster_filter", f"SELECT source, cluster_id, member_id, ord FROM ({_KEPT_SQL})")
def cluster_filter(spark, sf_dir):
    return C.cluster_filter(_members(spark, sf_dir), _dataset(spark, sf_dir))


@query("cluster_size_weight", f"""
    SELECT source, cluster_id, n, round(weight, 6) AS weight, round(n * weight, 6) AS mass FROM ({_SIZES_SQL})
""")
def cluster_size_weight(spark, sf_dir):
    kept = C.cluster_filter(_members(spark, sf_dir), _dataset(spark, sf_dir))
    return C.cluster_sizes(kept).withColumns(
        {"weight": F.round("weight", 6), "mass": F.round("mass", 6)}
    )


@query("cluster_count", f"SELECT count(*) AS n_clusters FROM ({_SIZES_SQL})")
def cluster_count(spark, sf_dir):
    return C.cluster_count(C.cluster_filter(_members(spark, sf_dir), _dataset(spark, sf_dir)))


@query("cluster_weights", f"SELECT id, row_ord, round(weight, 6) AS weight FROM ({_WEIGHTS_SQL})")
def cluster_weights(spark, sf_dir):
    weights = C.cluster_weights(_dataset(spark, sf_dir), _members(spark, sf_dir))
    return weights.withColumn("weight", F.round("weight", 6))


@query("unclustered_rows", f"""
    SELECT CAST(l_orderkey AS VARCHAR) AS id, l_linenumber AS row_ord FROM lineitem
    LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1) t USING (l_orderkey)
    LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > {HIGH_PRICE}) o ON o_orderkey = l_orderkey
    WHERE o_orderkey IS NULL OR l_linenumber < top
""")
def unclustered_rows(spark, sf_dir):
    """Order lines, several to an id, against the second cluster source alone."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").alias("row_ord")
    )
    return C.unclustered_rows(rows, _members(spark, sf_dir).filter("source = 1"))


@query("cluster_sample", f"""
    WITH rows AS (
      SELECT id, CAST(round(weight * 1000000) AS BIGINT) AS w,
             ('0x' || substr(md5(id), 1, 4))::BIGINT AS bucket
      FROM ({_WEIGHTS_SQL}) WHERE weight > 0),
    laid AS (SELECT id, sum(w) OVER (ORDER BY bucket, id) - w AS start FROM rows),
    draws AS (
      SELECT draw_id, floor({sql_uniform('draw', 'draw_id')} * (SELECT CAST(sum(w) AS DOUBLE) FROM rows)) AS at
      FROM (SELECT unnest(range((SELECT count(*) FROM ({_SIZES_SQL})))) AS draw_id))
    SELECT draw_id, id FROM draws ASOF JOIN laid ON draws.at >= laid.start
""")
def cluster_sample(spark, sf_dir):
    draws = C.balanced_sample(_dataset(spark, sf_dir), _members(spark, sf_dir), SEED)
    return draws.select("draw_id", "id")


@query("epoch_shuffle", f"""
    SELECT id, row_number() OVER (ORDER BY u, id) - 1 AS epoch_pos
    FROM (SELECT CAST(doc_id AS VARCHAR) AS id, {sql_uniform('epoch1', 'doc_id')} AS u FROM documents)
""")
def epoch_shuffle_query(spark, sf_dir):
    return epoch_shuffle(docs(spark, sf_dir), SEED, epoch=1)


ID_TYPE = "R"
KEY_FORMAT = "key_%s"


def _triples(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("key"), F.col("l_returnflag").alias("id_type"),
        F.col("l_partkey").cast("string").alias("value"),
    )


_PAIRS_SQL = f"""
    SELECT CAST(l_partkey AS VARCHAR) AS cluster_id, 'key_' || l_orderkey AS member_id
    FROM lineitem WHERE l_returnflag = '{ID_TYPE}'
"""


@query("idmapping_filter", _PAIRS_SQL)
def idmapping_filter_query(spark, sf_dir):
    return idmapping_filter(_triples(spark, sf_dir), ID_TYPE, KEY_FORMAT)


@query("idmapping_clusters", f"SELECT DISTINCT * FROM ({_PAIRS_SQL})")
def idmapping_clusters_query(spark, sf_dir):
    return idmapping_clusters(_triples(spark, sf_dir), ID_TYPE, KEY_FORMAT)


@query("idmapping_key_count", f"SELECT count(DISTINCT cluster_id) AS n_clusters FROM ({_PAIRS_SQL})")
def idmapping_key_count_query(spark, sf_dir):
    return idmapping_key_count(idmapping_filter(_triples(spark, sf_dir), ID_TYPE, KEY_FORMAT))


@query("cluster_store_roundtrip", f"SELECT DISTINCT * FROM ({_PAIRS_SQL})")
def cluster_store_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "store") + ".db"
    write_cluster_store(idmapping_filter(_triples(spark, sf_dir), ID_TYPE, KEY_FORMAT), path)
    return read_cluster_store(spark, path).select("cluster_id", "member_id")


@query("stored_cluster_filter", f"SELECT source, cluster_id, member_id, ord FROM ({_KEPT_SQL})")
def stored_cluster_filter(spark, sf_dir):
    """The members that are in the dataset, from a store of members that is not moved."""
    path = fresh_path(spark, "member-store")
    write_lookup_store(_members(spark, sf_dir), path, ["member_id"], ["source", "cluster_id", "ord"])
    ids = _dataset(spark, sf_dir).select(F.col("id").alias("member_id"))
    return open_lookup_store(spark, path).lookup(ids, "left_semi")
