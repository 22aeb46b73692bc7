import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandmill.operators import clusters as C
from strandmill.operators import idmapping as M
from strandmill.operators import rowid, skew
from strandmill.sources.clusters import read_cluster_map
from strandmill.sources.writers import write_cluster_store


def weight(n):
    return 1 / (1 + math.log(n))


def dataset(spark, ids):
    return spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, row_ord bigint")


def weights(spark, ids, paths):
    got = C.cluster_weights(dataset(spark, ids), read_cluster_map(spark, paths))
    return [r["weight"] for r in got.orderBy("row_ord").collect()]


def test_weights(spark, write):
    first = write("c.tsv", "c1\tA\tB\nc2\tC\nc1\tD\tZ\n")
    w3 = weight(3)
    assert weights(spark, "ABCDE", [first]) == pytest.approx([w3, w3, 1.0, w3, 0.0])
    kept = C.cluster_filter(read_cluster_map(spark, [first]), dataset(spark, "ABCDE"))
    assert C.cluster_count(kept).first()[0] == 2
    second = write("d.tsv", "c1\tA\n")
    assert weights(spark, "ABCDE", [first, second]) == pytest.approx([1.0, w3, 1.0, w3, 0.0])
    kept = C.cluster_filter(read_cluster_map(spark, [first, second]), dataset(spark, "ABCDE"))
    assert C.cluster_count(kept).first()[0] == 3


def test_repeats(spark, write):
    path = write("c.tsv", "c1\tA\n")
    assert weights(spark, "AA", [path]) == [0.0, 1.0]
    assert weights(spark, "A", [write("d.tsv", "c1\tA\tA\n")]) == pytest.approx([weight(2)])


def test_cluster_order_counts_lines_without_members(spark, write):
    """c1 appears first, as a line of its own, so c2 is the last to set the weight of A."""
    path = write("c.tsv", "c1\nc2\tA\nc1\tA\tB\n")
    assert weights(spark, "AB", [path]) == pytest.approx([1.0, weight(2)])


def test_store_order_is_by_id(spark, tmp_path):
    path = str(tmp_path / "s.db")
    pairs = spark.createDataFrame([("b", "A"), ("a", "A"), ("a", "B"), ("a", "B")], "cluster_id string, member_id string")
    write_cluster_store(pairs, path)
    assert weights(spark, "AB", [path]) == pytest.approx([1.0, weight(2)])
    with pytest.raises(Exception, match="(?i)exist"):
        write_cluster_store(pairs, path)


def brute(ids, members):
    row_of = {x: i for i, x in enumerate(ids)}
    first, kept = {}, defaultdict(list)
    for source, cluster, member, order in sorted(members, key=lambda m: (m[0], m[3])):
        first.setdefault((source, cluster), order)
        if member in row_of:
            kept[source, cluster].append(member)
    out = [0.0] * len(ids)
    for key in sorted(kept, key=lambda k: (k[0], first[k], k[1])):
        for member in kept[key]:
            out[row_of[member]] = weight(len(kept[key]))
    return out, len(kept)


def random_map(seed):
    rng = random.Random(seed)
    ids = [f"m{rng.randint(0, 60)}" for _ in range(80)]
    # One cluster and one member each hold a third of the rows.
    members = [
        (rng.randint(0, 1), "hot" if rng.random() < 0.33 else f"c{rng.randint(0, 20)}",
         "m1" if rng.random() < 0.33 else f"m{rng.randint(0, 80)}", i)
        for i in range(400)
    ]
    return ids, members


@pytest.mark.parametrize("hot_rows", [3, 50, 10_000])
def test_weights_against_brute_force(spark, hot_rows):
    ids, members = random_map(hot_rows)
    want, n = brute(ids, members)
    table = spark.createDataFrame(members, "source int, cluster_id string, member_id string, ord bigint")
    got = C.cluster_weights(dataset(spark, ids), table, hot_rows).orderBy("row_ord").collect()
    assert [r["weight"] for r in got] == pytest.approx(want)
    kept = C.cluster_filter(table, dataset(spark, ids), hot_rows)
    assert rows(kept.select(*table.columns)) == sorted((m for m in members if m[2] in ids), key=repr)
    assert C.cluster_count(kept).first()[0] == n
    loose = C.unclustered_rows(dataset(spark, ids), table, hot_rows)
    assert rows(loose) == sorted(((x, i) for i, x in enumerate(ids) if not want[i]), key=repr)
    listed = C.cluster_members(table, hot_rows)
    first = {}
    for s, c, _, o in members:
        first[s, c] = min(o, first.get((s, c), o))
    assert rows(listed.select(*table.columns, "cluster_ord")) == sorted(((*m, first[m[0], m[1]]) for m in members), key=repr)


def test_sample_follows_the_weights(spark):
    """Shares of draws, against weight over total weight."""
    w = {f"r{i}": weight(1 + i % 7) for i in range(40)}
    table = spark.createDataFrame([*w.items(), ("zero", 0.0)], "id string, weight double")
    k = 40_000
    draws = C.weighted_sample(table, k, seed=5).collect()
    assert sorted(r["draw_id"] for r in draws) == list(range(k))
    counts = Counter(r["id"] for r in draws)
    assert set(counts) == set(w)
    total = sum(w.values())
    chi2 = sum((counts[i] - k * w[i] / total) ** 2 / (k * w[i] / total) for i in w)
    assert chi2 < 75  # 39 degrees of freedom


def test_sample_does_not_depend_on_partitions(spark):
    table = spark.range(500).select(F.col("id").cast("string").alias("id"), (1 / (1 + F.col("id") % 5)).alias("weight"))
    got = [rows(C.weighted_sample(table.repartition(n), 300, 2)) for n in (1, 3)]
    assert got[0] == got[1]


def test_balanced_sample_draws_once_per_cluster(spark):
    ids, members = random_map(1)
    table = spark.createDataFrame(members, "source int, cluster_id string, member_id string, ord bigint")
    draws = C.balanced_sample(dataset(spark, ids), table, seed=1).collect()
    assert len(draws) == brute(ids, members)[1]
    reachable = {m[2] for m in members} & set(ids)
    assert {r["id"] for r in draws} <= reachable
    with pytest.raises(ValueError):
        C.balanced_sample(dataset(spark, ["none"]), table, seed=1)


def test_idmapping(spark):
    triples = spark.createDataFrame(
        [("P1", "UniRef50", "U"), ("P2", "UniRef50", "U"), ("P2", "UniRef90", "V"), ("P1", "UniRef50", "U")],
        "key string, id_type string, value string")
    pairs = M.idmapping_clusters(triples, "UniRef50", "UniRef50_%s")
    assert rows(pairs) == [("U", "UniRef50_P1"), ("U", "UniRef50_P2")]
    assert M.idmapping_key_count(pairs).first()[0] == 1


def test_store_is_globally_sorted_and_splits_a_hot_cluster(spark, tmp_path):
    path = str(tmp_path / "s.db")
    pairs = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("cluster_id"),
        F.col("id").cast("string").alias("member_id"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_cluster_store(pairs, path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    stored = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    spans = sorted(tuple(r) for r in stored.groupBy("file").agg(
        F.min(F.struct("cluster_id", "member_id")).alias("lo"), F.max(F.struct("cluster_id", "member_id")).alias("hi")).select("file", "lo", "hi").collect())
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    assert stored.filter("cluster_id = 'hot'").select("file").distinct().count() > 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_with_hot_and_null_keys(spark, how):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", None, None, *"abcdefgh"]), i) for i in range(300)]
    facts = spark.createDataFrame(data, "k string, i int")
    dim = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("zz", 4)], "k string, v int")
    plain = rows(facts.join(dim, ["k"], how))
    assert len(skew.hot_keys(facts, ["k"], 20)) >= 2
    assert rows(skew.lookup_join(facts, dim, ["k"], how, ["i"], hot_rows=20)) == plain


def test_hot_keys_spread_over_tasks(spark):
    facts = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    slices = skew.hot_keys(facts, ["k"], 2000)
    assert [r["k"] for r in slices] == ["hot"] and 4 <= slices[0]["_slices"] <= 10


def test_ordered_concat(spark):
    rng = random.Random(8)
    data = [(f"k{i % 3}", p, chr(97 + rng.randint(0, 25))) for p, i in enumerate(rng.sample(range(3000), 3000))]
    want = {k: "".join(c for _, _, c in sorted((d for d in data if d[0] == k), key=lambda d: d[1])) for k in ("k0", "k1", "k2")}
    df = spark.createDataFrame(data, "k string, pos bigint, c string")
    assert dict(rows(skew.ordered_concat(df, ["k"], "pos", "c", "t", span=16))) == want


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_row_ids_and_running_totals(spark, parts):
    rng = random.Random(1)
    data = [(f"f{rng.randint(0, 3)}", i, rng.randint(0, 9)) for i in rng.sample(range(1000), 1000)]
    df = spark.createDataFrame(data, "f string, i int, v int").repartition(parts)
    ordered = sorted(data)
    assert rows(rowid.with_row_id(df, ["f", "i"])) == sorted(((*d, n) for n, d in enumerate(ordered)), key=repr)
    total, before, upto = 0, [], []
    for d in ordered:
        before.append((*d, total))
        total += d[2]
        upto.append((*d, total))
    assert rows(rowid.running_total(df, ["f", "i"], "v", "t")) == sorted(before, key=repr)
    assert rows(rowid.running_total(df, ["f", "i"], "v", "t", inclusive=True)) == sorted(upto, key=repr)


def test_row_ids_over_several_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
        got = rowid.with_row_id(df, ["k"])
        assert got.filter("k <> row_id").count() == 0 and got.count() == 5000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_repeated_ids_are_drawn_by_their_last_row(spark):
    rows_in = spark.createDataFrame([("A", 0), ("A", 1), ("B", 2)], "id string, row_ord int")
    members = spark.createDataFrame([(0, "c", "A", 0)], "source int, cluster_id string, member_id string, ord bigint")
    assert rows(C.unclustered_rows(rows_in, members)) == [("A", 0), ("B", 2)]


def test_tiny_weights_are_drawn(spark):
    weights = spark.createDataFrame([("a", 4e-7), ("b", 1.2e-6), ("c", 0.0)], "id string, weight double")
    drawn = [r.id for r in C.weighted_sample(weights, 4000, 7).collect()]
    assert len(drawn) == 4000 and drawn.count("a") / 4000 == pytest.approx(0.25, abs=0.03)
    far = spark.createDataFrame([("a", 1.0), ("b", 1e-9)], "id string, weight double")
    with pytest.raises(Exception, match="millionth"):
        C.weighted_sample(far, 10, 7).collect()
