"""CSV and TSV with declared columns, and plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType, defaults: dict[str, object] | None = None, hex_columns: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """Columns by the header's names, in the schema's order and types.

    Unknown, missing and repeated names fail; an empty field takes its column's default; hex columns are read
    as hexadecimal integers.
    """
    quote = {} if sep == "," else {"quote": ""}
    head = spark.read.options(sep=sep, **quote).csv(path).limit(1).collect()
    names = [x for x in head[0] if x is not None] if head else []
    want = [f.name for f in schema.fields]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated columns in {names}")
    if set(names) != set(want):
        raise ValueError(f"columns {names} where {want} are declared")
    text = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.options(sep=sep, header=True, escape='"', multiLine=False, mode="FAILFAST", **quote).schema(text).csv(path)
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in hex_columns:
            c = F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, -10)
        c = c.cast(f.dataType)
        out.append(F.coalesce(c, F.lit((defaults or {}).get(f.name)).cast(f.dataType)).alias(f.name) if f.name in (defaults or {}) else c.alias(f.name))
    return rows.select(*out)


def read_fields_csv(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """A file whose columns a comment names, '#Fields: a,b'; all other lines that begin with # are comments.

    The columns may be declared in another order; unknown, missing and repeated names fail.
    """
    head = spark.read.text(path).where(F.col("value").startswith("#Fields:")).limit(1).collect()
    if not head:
        raise ValueError("no #Fields: line")
    names = [x.strip() for x in head[0].value.removeprefix("#Fields:").split(sep)]
    if len(set(names)) < len(names) or set(names) != set(schema.names):
        raise ValueError(f"columns {names} where {schema.names} are declared")
    text = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.options(sep=sep, comment="#", escape='"', mode="FAILFAST").schema(text).csv(path)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def write_fields_csv(df: DataFrame, path: str, comments: tuple[str, ...] = ()) -> None:
    """One partition a file, each with its comments and '#Fields:' line before the rows."""
    rows = df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"escape": '"'}).alias("value"))
    head = "\n".join([*(f"# {c}" for c in comments), "#Fields: " + ",".join(df.columns)])

    def run(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first:
                yield pa.RecordBatch.from_pydict({"value": [head]})
                first = False
            yield b

    rows.mapInArrow(run, "value string").write.text(path)


def read_column(spark: SparkSession, path: str, name: str, kind: str = "string") -> DataFrame:
    """A file with a header and a single column."""
    rows = spark.read.options(header=True, escape='"', mode="FAILFAST").csv(path)
    if rows.columns != [name]:
        raise ValueError(f"columns {rows.columns} where {name} is declared")
    return rows.select(F.col(f"`{name}`").cast(kind).alias(name))


def write_column(df: DataFrame, path: str, name: str) -> None:
    write_csv(df.select(f"`{name}`"), path)


def read_tsv(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """Tabs separate, all other white space counts."""
    return read_csv(spark, path, schema, sep="\t", **options)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Quotes are doubled; a line feed in a field fails, and so does a tab in one of a tab-separated file."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    for n in text:
        c = F.col(f"`{n}`")
        bad = c.contains("\n") | (c.contains("\t") if sep == "\t" else F.lit(False))
        df = df.withColumn(n, F.when(bad, F.raise_error(F.lit(f"a line feed or tab in column {n}"))).otherwise(c))
    df.write.options(header=True, sep=sep, **({"quote": ""} if sep == "\t" else {"escape": '"'})).csv(path)


def extract_columns(df: DataFrame, columns: list[str], plain: bool = False, escaped: bool = False) -> DataFrame:
    """The named columns in this order; plain gives one line of text a row, escaped backslashes its specials."""
    if len(set(columns)) < len(columns):
        raise ValueError(f"repeated columns in {columns}")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    from termweave.functions.text import escape

    cols = [escape(F.col(f"`{c}`").cast("string")) if escaped else F.col(f"`{c}`") for c in columns]
    if plain:
        return df.select(F.concat_ws(" ", *[c.cast("string") for c in cols]).alias("value"))
    return df.select(*[c.alias(n) for c, n in zip(cols, columns, strict=True)])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines, trimmed on both sides; empty ones stay."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "").alias("line"))


#: The tables of a statistics folder, and if there is one for each shard.
STATISTICS = {
    "DocFreqTable": True, "DocumentHistogram": False, "CumulativeTermCounts": True, "TermToText": False, "ShardDefinition": False, "RowDensities": True,
    "ColumnDensities": True, "ColumnDensitySummary": False, "Correlate": True, "QueryPipelineStatistics": False, "QuerySummaryStatistics": False, "QueryLog": False, "VerificationResults": False,
}


def save_statistics(df: DataFrame, folder: str, name: str, shard: int | None = None) -> None:
    if name not in STATISTICS or (shard is not None) != STATISTICS[name]:
        raise ValueError(f"no table {name} " + ("without a shard" if shard is None else "by shard"))
    df.write.mode("overwrite").parquet(f"{folder}/{name}" + ("" if shard is None else f"-{shard}"))


def load_statistics(spark: SparkSession, folder: str, name: str, shard: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}" + ("" if shard is None else f"-{shard}"))
