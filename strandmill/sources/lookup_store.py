"""Tables laid out once for many lookups by key.

A store is a bucketed and sorted Parquet table. Its rows lie by one text made of their keys, so a
lookup moves only what is looked up, and a lookup of a few keys opens their buckets alone. Keys that
hold many rows are found when the store is written: their rows are dealt over slices, each a place
of its own, and whatever is looked up there is repeated per slice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators.skew import HOT_ROWS, NULL_SLICES, hot_keys

AT = "_at"
# Keys and slices of a place are set apart; these signs are written differently inside a key.
SEPARATOR, ESCAPE = "\x1f", "\x1e"
LAYOUT = "_layout"


def _escaped(key: Column) -> Column:
    text = F.replace(key.cast("string"), F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    return F.replace(text, F.lit(SEPARATOR), F.lit(ESCAPE + "1"))


def _place(keys: Sequence[Column], slice_no: Column) -> Column:
    """Where rows with these keys lie; NULL if a key is."""
    whole = F.concat(*[part for key in keys for part in (_escaped(key), F.lit(SEPARATOR))])
    return F.concat(whole, slice_no.cast("string"))


def _table_name(path: str) -> str:
    return f"lookup_{hashlib.md5(path.encode()).hexdigest()}"


def write_lookup_store(
    df: DataFrame, path: str, keys: Sequence[str], salt_on: Sequence[str],
    buckets: int | None = None, hot_rows: int = HOT_ROWS,
) -> None:
    """Write ``df`` as a store for lookups by ``keys``; an existing target is refused.

    ``salt_on`` names columns that tell the rows of a key apart. Rows with a null key are kept, and no
    lookup finds them. A bucket is one file; there are as many as shuffle partitions, if not given.
    """
    spark, keys = df.sparkSession, list(keys)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = [[*(str(r[k]) for k in keys), r["_slices"]] for r in hot_keys(df.dropna(subset=keys), keys, hot_rows)]
    row_hash = F.xxhash64(*salt_on)
    slices = _slices_of(spark, keys, hot)
    placed = df if slices is None else df.join(F.broadcast(slices), [F.col(k).cast("string") == F.col(f"_hot_{k}") for k in keys], "left")
    number = F.lit(0) if slices is None else F.pmod(row_hash, F.coalesce("_slices", F.lit(1)))
    lost = F.concat(F.lit(ESCAPE), F.pmod(row_hash, F.lit(NULL_SLICES)).cast("string"))
    placed = placed.withColumn(AT, F.coalesce(_place([F.col(k) for k in keys], number), lost)).select(*df.columns, AT)
    (
        placed.repartition(buckets, AT).write.format("parquet").bucketBy(buckets, AT).sortBy(AT)
        .option("path", path).saveAsTable(_table_name(path))
    )
    layout = json.dumps({"keys": keys, "buckets": buckets, "hot": hot})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.text(f"{path}/{LAYOUT}")


def _slices_of(spark: SparkSession, keys: list[str], hot: list[list]) -> DataFrame | None:
    if not hot:
        return None
    schema = ", ".join([*(f"_hot_{k} string" for k in keys), "_slices int"])
    return spark.createDataFrame([tuple(h) for h in hot], schema)


@dataclass(frozen=True)
class LookupStore:
    """A store as its layout says it is; ``rows`` has its columns and the place."""

    rows: DataFrame
    keys: list[str]
    hot: list[list]

    @property
    def table(self) -> DataFrame:
        return self.rows.drop(AT)

    def lookup(self, wanted: DataFrame, how: str = "inner") -> DataFrame:
        """Rows of the store joined to ``wanted``, which has the keys; the store is not moved.

        ``how`` is inner, left, left_semi or left_anti, with the store on the left. Other columns of
        ``wanted`` come along where the join has them.
        """
        slices = _slices_of(wanted.sparkSession, self.keys, self.hot)
        number = F.lit(0)
        if slices is not None:
            on = [F.col(k).cast("string") == F.col(f"_hot_{k}") for k in self.keys]
            last = F.coalesce("_slices", F.lit(1)) - F.lit(1)
            wanted = wanted.join(F.broadcast(slices), on, "left").withColumn(
                "_slice", F.explode(F.sequence(F.lit(0), last)))
            number = F.col("_slice")
        rest = [c for c in wanted.columns if c not in self.keys and not c.startswith(("_hot_", "_slice"))]
        placed = wanted.select(_place([F.col(k) for k in self.keys], number).alias(AT), *rest)
        return self.rows.join(placed, AT, how).drop(AT)

    def points(self, *keys: Sequence) -> DataFrame:
        """Rows of a few keys, each a sequence of values; only their buckets are opened."""
        slices = {tuple(h[:-1]): h[-1] for h in self.hot}
        places = []
        for key in keys:
            texts = [str(k).replace(ESCAPE, ESCAPE + "0").replace(SEPARATOR, ESCAPE + "1") for k in key]
            for n in range(slices.get(tuple(map(str, key)), 1)):
                places.append("".join(t + SEPARATOR for t in texts) + str(n))
        return self.rows.where(F.col(AT).isin(places)).drop(AT)


def open_lookup_store(spark: SparkSession, path: str) -> LookupStore:
    """A store that ``write_lookup_store`` wrote, in this or an earlier session."""
    layout = json.loads(spark.read.text(f"{path}/{LAYOUT}").first()["value"])
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({AT}) SORTED BY ({AT}) "
            f"INTO {layout['buckets']} BUCKETS LOCATION '{path}'"
        )
    return LookupStore(spark.table(name), layout["keys"], layout["hot"])
