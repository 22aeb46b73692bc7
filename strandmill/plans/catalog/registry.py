"""Named queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEED = 42


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL fragments

_BLANKS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"


def sql_body(x: str) -> str:
    """The text as a sequence: no blanks and no header marks."""
    return f"regexp_replace({x}, '[{_BLANKS}>]', '', 'g')"


def sql_uniform(salt: str, key: str, seed: int = SEED) -> str:
    return (
        f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', CAST({key} AS VARCHAR))), 1, 13))"
        "::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"
    )


def sql_randint(u: str, low: str, high: str) -> str:
    return f"CAST(({low}) + floor({u} * (({high}) - ({low}) + 1)) AS INTEGER)"


def sql_wrap(x: str, width: int = 60) -> str:
    pieces = f"list_transform(range(0, length({x}), {width}), lambda i: substr({x}, i + 1, {width}))"
    return f"array_to_string({pieces}, chr(10))"


def sql_arranged(
    source: str, spm_rate: float, fim_rate: float | None = None, max_length: int | None = None,
    wrap: bool = False, key: str = "id", batch_key: str | None = None, keep: str = "",
) -> str:
    """Query for ``id, text, is_fim, prefix, middle, suffix, spm`` of the rows ``id, text``.

    Without a rate every text is rearranged. ``key`` and ``batch_key`` name what draws depend on;
    ``keep`` lists more columns, each with a comma behind it.
    """
    wanted = "TRUE" if fim_rate is None else f"({sql_uniform('fim', batch_key or key)} < {fim_rate})"
    if max_length is None:
        cropped = f"SELECT {keep} id, text, {wanted} AS wanted FROM ({source})"
    else:
        limit = f"({max_length} - CASE WHEN {wanted} THEN 5 ELSE 2 END)"
        start = sql_randint(sql_uniform("crop", key), "0", f"length(text) - {limit}")
        cropped = (
            f"SELECT {keep} id, CASE WHEN {limit} < length(text) THEN substr(text, {start} + 1, {limit}) "
            f"ELSE text END AS text, {wanted} AS wanted FROM ({source})"
        )
    cut1 = sql_randint(sql_uniform("cut1", key), "0", "length(text) - 1")
    cut2 = sql_randint(sql_uniform("cut2", key), "cut1 + 1", "length(text)")
    first = (
        "CASE WHEN spm THEN '<fim_suffix>' || suffix || '<fim_prefix>' || prefix "
        "ELSE '<fim_prefix>' || prefix || '<fim_suffix>' || suffix END || '<fim_middle>' || middle"
    )
    out = f"CASE WHEN wanted THEN {first} ELSE text END"
    if wrap:
        out = f"'[BOS]' || {out} || '[EOS]'"
    return f"""
        SELECT {keep} id, {out} AS text, wanted AS is_fim, prefix, middle, suffix, spm FROM (
          SELECT *, substr(text, 1, cut1) AS prefix, substr(text, cut1 + 1, cut2 - cut1) AS middle,
                 substr(text, cut2 + 1) AS suffix, {sql_uniform('spm', key)} < {spm_rate} AS spm
          FROM (SELECT *, {cut2} AS cut2 FROM (SELECT *, {cut1} AS cut1 FROM ({cropped}))))
    """


DOCS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) id", "text")
    return spread(rows, ["id"])
