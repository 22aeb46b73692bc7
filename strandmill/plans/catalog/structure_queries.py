"""Residue tables made from the events: a chain is a user's events in blocks of 512 ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import residues as R
from strandmill.operators import structures as S
from strandmill.plans.catalog.registry import query, table
from strandmill.session import fresh_path
from strandmill.sources.lookup_store import open_lookup_store, write_lookup_store
from strandmill.sources.tables import read_corpus, read_structures

FILL = 1e-05
# Residue names in use; the last three are not standard.
NAMES = (*R.RESIDUE_LETTERS, "MSE", "SEC", "XXX")
MANY = 100


def residues(spark, sf_dir):
    """Coordinates by arithmetic; an atom is missing when (event + atom) divides by 9."""
    names = F.array(*[F.lit(n) for n in NAMES])
    name = F.expr(f"cast(event_id % {len(NAMES)} as int)")
    number = F.expr("event_id * 2 + 10 + event_id % 3")
    events = table(spark, sf_dir, "events")

    def atom(i: int):
        x = F.when(F.expr(f"(event_id + {i}) % 9 = 0"), F.lit(FILL)).otherwise(F.col("value") + F.lit(float(i)))
        return F.array(x, F.col("value") * F.lit(2.0) - F.lit(float(i)), F.col("value") - F.lit(0.5 * i))

    return events.select(
        F.col("event_type").alias("dataset"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.expr("event_id div 512").cast("string")).alias("chain_id"),
        F.col("event_id").alias("pos"),
        names[name].alias("residue_name"),
        F.expr("cast(event_id % 21 as int)").alias("residue_type"),
        F.concat_ws(":", F.lit("A"), names[name], number.cast("string")).alias("residue_id"),
        F.array(*[atom(i) for i in range(4)]).alias("coords"),
    )


def _atom_sql(i: int) -> str:
    return (
        f"[CASE WHEN (event_id + {i}) % 9 = 0 THEN {FILL} ELSE value + {i} END, "
        f"value * 2 - {i}, value - {0.5 * i}]"
    )


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_LETTERS_SQL = "[" + ", ".join(f"'{R.RESIDUE_LETTERS.get(n, 'A')}'" for n in NAMES) + "]"
_RES_SQL = f"""
    SELECT event_type AS dataset, CAST(user_id AS VARCHAR) || '-' || CAST(event_id // 512 AS VARCHAR) AS chain_id,
           event_id AS pos, ({_LETTERS_SQL})[event_id % {len(NAMES)} + 1] AS letter, ({_NAMES_SQL})[event_id % {len(NAMES)} + 1] AS residue_name,
           event_id % 21 AS residue_type, event_id * 2 + 10 + event_id % 3 AS num,
           [{', '.join(_atom_sql(i) for i in range(4))}] AS coords,
           [{', '.join(f'(event_id + {i}) % 9 <> 0' for i in range(4))}] AS mask, value
    FROM events
"""
_INDEX_SQL = f"""
    SELECT *, num - first_value(num) OVER (PARTITION BY dataset, chain_id ORDER BY pos) AS residue_idx
    FROM ({_RES_SQL})
"""


def _bits(mask):
    return F.array_join(F.transform(mask, lambda m: F.when(m, "1").otherwise("0")), "")


_BITS_SQL = "array_to_string(list_transform(mask, lambda m: CASE WHEN m THEN '1' ELSE '0' END), '')"


@query("residue_seq", f"""
    SELECT dataset, chain_id, string_agg(letter, '' ORDER BY pos) AS text FROM ({_RES_SQL}) GROUP BY ALL
""")
def residue_seq(spark, sf_dir):
    return S.residue_sequences(residues(spark, sf_dir))


@query("residue_index", f"SELECT dataset, chain_id, pos, residue_idx FROM ({_INDEX_SQL})")
def residue_index(spark, sf_dir):
    full = S.with_defaults(residues(spark, sf_dir), FILL)
    return S.relative_index(full).select("dataset", "chain_id", "pos", "residue_idx")


@query("coord_mask", f"SELECT dataset, chain_id, pos, {_BITS_SQL} AS mask FROM ({_RES_SQL})")
def coord_mask(spark, sf_dir):
    return residues(spark, sf_dir).select(
        "dataset", "chain_id", "pos", _bits(R.coord_mask(F.col("coords"), FILL)).alias("mask")
    )


_PB_SQL = "CASE WHEN residue_type = 7 THEN 2 ELSE 4 END"


@query("pseudo_beta", f"""
    SELECT dataset, chain_id, pos, round(coords[{_PB_SQL}][1], 6) AS x, round(coords[{_PB_SQL}][2], 6) AS y,
           round(coords[{_PB_SQL}][3], 6) AS z, mask[{_PB_SQL}] AS present
    FROM ({_RES_SQL})
""")
def pseudo_beta(spark, sf_dir):
    full = S.with_defaults(residues(spark, sf_dir), FILL)
    rows = full.select(
        "dataset", "chain_id", "pos",
        R.pseudo_beta(F.col("coords"), F.col("residue_type")).alias("pb"),
        R.pseudo_beta_mask(F.col("coord_mask"), F.col("residue_type")).alias("present"),
    )
    return rows.select(
        "dataset", "chain_id", "pos", *[F.round(F.col("pb")[i], 6).alias(n) for i, n in enumerate("xyz")], "present"
    )


# Atom name and its place in a coordinate array, in the order of the backbone output.
_BACKBONE = (("ca", R.CA), ("cb", R.CB), ("n", R.N), ("c", R.C))


def _backbone_columns():
    out = []
    for name, _ in _BACKBONE:
        atom = F.col(f"backbone.{name}")
        out.append(F.isnan(atom[0]).alias(f"{name}_missing"))
        out.append(F.round(F.nanvl(atom[0] + atom[1] + atom[2], F.lit(0.0)), 6).alias(f"{name}_sum"))
    return out


_BACKBONE_SQL = ", ".join(
    f"NOT mask[{i + 1}] AS {name}_missing, round(CASE WHEN mask[{i + 1}] THEN "
    f"coords[{i + 1}][1] + coords[{i + 1}][2] + coords[{i + 1}][3] ELSE 0 END, 6) AS {name}_sum"
    for name, i in _BACKBONE
)


@query("backbone_nan", f"SELECT dataset, chain_id, pos, {_BACKBONE_SQL} FROM ({_RES_SQL})")
def backbone_nan(spark, sf_dir):
    full = S.with_defaults(residues(spark, sf_dir), FILL)
    rows = full.withColumn("backbone", R.backbone(F.col("coords"), F.col("coord_mask")))
    return rows.select("dataset", "chain_id", "pos", *_backbone_columns())


@query("structure_features", f"""
    SELECT dataset, chain_id, pos, residue_idx, letter, {_BITS_SQL} AS mask,
           round(coords[{_PB_SQL}][1], 6) AS pb_x, mask[{_PB_SQL}] AS pb_present, {_BACKBONE_SQL}
    FROM ({_INDEX_SQL})
""")
def structure_features(spark, sf_dir):
    return S.structure_features(residues(spark, sf_dir), FILL).select(
        "dataset", "chain_id", "pos", "residue_idx", "letter", _bits(F.col("coord_mask")).alias("mask"),
        F.round(F.col("distogram.pseudo_beta")[0], 6).alias("pb_x"),
        F.col("distogram.mask").alias("pb_present"), *_backbone_columns(),
    )


_EXACT = "decimal(18,6)"


def _exact_sql(x: str) -> str:
    return f"CAST(CAST(round({x}, 6) AS {_EXACT}) AS VARCHAR)"


_PLACES_SQL = ", ".join(
    [f"string_agg({_exact_sql(f'coords[{_PB_SQL}][{k}]')}, ',' ORDER BY pos) AS pb_{n}" for k, n in enumerate("xyz", 1)]
    + [f"string_agg({_exact_sql(f'coords[{a}][{k}]')}, ',' ORDER BY pos) AS atom{a}_{n}"
       for a in range(1, 5) for k, n in enumerate("xyz", 1)]
    + [f"string_agg(CASE WHEN mask[{i + 1}] THEN {_exact_sql(f'coords[{i + 1}][{k}]')} ELSE 'NaN' END, ',' ORDER BY pos) AS {name}_{n}"
       for name, i in _BACKBONE for k, n in enumerate("xyz", 1)]
)


@query("chain_features", f"""
    SELECT dataset, chain_id, CAST(count(*) AS INTEGER) AS n_residues, string_agg(letter, '' ORDER BY pos) AS text,
           string_agg(CAST(residue_idx AS VARCHAR), ',' ORDER BY pos) AS residue_idx,
           string_agg({_BITS_SQL}, ',' ORDER BY pos) AS mask,
           {_PLACES_SQL}, string_agg(CASE WHEN mask[{_PB_SQL}] THEN '1' ELSE '0' END, '' ORDER BY pos) AS pb_mask
    FROM ({_INDEX_SQL}) GROUP BY ALL
""")
def chain_features(spark, sf_dir):
    chains = S.chain_features(residues(spark, sf_dir), FILL)
    text = lambda name, f: F.array_join(F.transform(name, lambda r: f(r)), ",")
    exact = lambda x: F.round(x, 6).cast(_EXACT).cast("string")
    return chains.select(
        "dataset", "chain_id", "n_residues", "text",
        text("residue_idx", lambda i: i.cast("string")).alias("residue_idx"),
        text("coord_mask", _bits).alias("mask"),
        *(text("pseudo_beta", lambda x, k=k: exact(x[k])).alias(f"pb_{n}") for k, n in enumerate("xyz")),
        *(text("coords", lambda x, a=a, k=k: exact(x[a][k])).alias(f"atom{a + 1}_{n}")
          for a in range(4) for k, n in enumerate("xyz")),
        *(text("backbone", lambda b, name=name, k=k: F.when(F.isnan(b[name][k]), "NaN").otherwise(exact(b[name][k])))
          .alias(f"{name}_{n}") for name, _ in _BACKBONE for k, n in enumerate("xyz")),
        F.array_join(F.transform("pseudo_beta_mask", lambda m: F.when(m, "1").otherwise("0")), "").alias("pb_mask"),
    )


_CHAINS_SQL = f"""
    SELECT dataset, chain_id, string_agg(letter, '' ORDER BY pos) AS text FROM ({_RES_SQL}) GROUP BY ALL
"""


def _stores(spark, sf_dir) -> dict[str, str]:
    """A store of residues per event type."""
    rows = residues(spark, sf_dir)
    folder = fresh_path(spark, "stores")
    rows.withColumn("store", F.col("dataset")).write.partitionBy("store").parquet(folder)
    names = [r[0] for r in rows.select("dataset").distinct().orderBy("dataset").collect()]
    return {name: f"{folder}/store={name}" for name in names}


@query("structure_corpus", f"SELECT chain_id AS id, dataset, text FROM ({_CHAINS_SQL})")
def structure_corpus(spark, sf_dir):
    """Stores of residues, one per event type, read as a corpus of texts."""
    corpus = read_corpus(spark, "foldcomp", list(_stores(spark, sf_dir).values()))
    return corpus.select("id", F.regexp_extract("dataset", "store=([a-z_]+)", 1).alias("dataset"), "text")


@query("indexed_corpus", f"SELECT chain_id AS id, dataset, text FROM ({_CHAINS_SQL}) WHERE length(text) % 2 = 0")
def indexed_corpus(spark, sf_dir):
    """The same stores, each with an index of the chains to read: those of even length."""
    stores = _stores(spark, sf_dir)
    index = fresh_path(spark, "chain-index")
    sizes = residues(spark, sf_dir).groupBy("dataset", F.col("chain_id").alias("id")).count()
    sizes.where("count % 2 = 0").write.partitionBy("dataset").option("header", True).csv(index)
    corpus = read_corpus(spark, "pdb", [f"{path}#{index}/dataset={name}" for name, path in stores.items()])
    return corpus.select("id", F.regexp_extract("dataset", "store=([a-z_]+)", 1).alias("dataset"), "text")


_WANTED_SQL = f"SELECT dataset, chain_id FROM ({_RES_SQL}) GROUP BY ALL HAVING max(value) > {MANY}"


def _wanted(spark, sf_dir):
    """Chains with a value above the mark."""
    events = residues(spark, sf_dir).withColumn("value", F.col("coords")[2][2] + F.lit(1.0))
    return events.groupBy("dataset", "chain_id").agg(F.max("value").alias("top")).filter(F.col("top") > MANY)


@query("structure_lookup", f"""
    SELECT dataset, chain_id, pos, residue_name FROM ({_RES_SQL})
    SEMI JOIN ({_WANTED_SQL}) w USING (dataset, chain_id)
""")
def structure_lookup(spark, sf_dir):
    index = _wanted(spark, sf_dir).select("dataset", F.col("chain_id").alias("id"))
    found = S.structure_lookup(index, residues(spark, sf_dir))
    return found.select("dataset", "chain_id", "pos", "residue_name")


def _chain_store(spark, sf_dir):
    path = fresh_path(spark, "chain-store")
    write_lookup_store(residues(spark, sf_dir), path, S.CHAIN, ["pos"])
    return open_lookup_store(spark, path)


@query("stored_structure_lookup", f"""
    SELECT dataset, chain_id, pos, residue_name FROM ({_RES_SQL})
    SEMI JOIN ({_WANTED_SQL}) w USING (dataset, chain_id)
""")
def stored_structure_lookup(spark, sf_dir):
    """As ``structure_lookup``, from a store that is not moved."""
    found = _chain_store(spark, sf_dir).lookup(_wanted(spark, sf_dir).drop("top"))
    return found.select("dataset", "chain_id", "pos", "residue_name")


POINTS = 5


@query("structure_points", f"""
    SELECT dataset, chain_id, pos, residue_name FROM ({_RES_SQL}) SEMI JOIN (
      SELECT dataset, chain_id FROM ({_RES_SQL}) GROUP BY ALL ORDER BY count(*) DESC, dataset, chain_id LIMIT {POINTS}) w
    USING (dataset, chain_id)
""")
def structure_points(spark, sf_dir):
    """The longest chains, one by one from the store."""
    store = _chain_store(spark, sf_dir)
    longest = store.table.groupBy(*S.CHAIN).count().orderBy(F.desc("count"), *S.CHAIN).limit(POINTS)
    return store.points(*longest.select(*S.CHAIN).collect()).select("dataset", "chain_id", "pos", "residue_name")


@query("id_list_restrict", f"""
    SELECT chain_id, pos, residue_name FROM ({_RES_SQL})
    WHERE chain_id IN (SELECT chain_id FROM ({_WANTED_SQL}))
""")
def id_list_restrict(spark, sf_dir):
    """A store on disk read through an id list with comment lines."""
    store, ids = fresh_path(spark, "residues"), fresh_path(spark, "ids")
    residues(spark, sf_dir).write.parquet(store)
    wanted = _wanted(spark, sf_dir).select("chain_id").distinct()
    comments = wanted.select(F.concat(F.lit("# "), "chain_id").alias("chain_id"))
    wanted.unionByName(comments).select(F.col("chain_id").alias("value")).write.text(ids)
    return read_structures(spark, f"{store}#{ids}").select("chain_id", "pos", "residue_name")
