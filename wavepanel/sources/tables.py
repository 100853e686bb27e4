"""Panel readers, table sinks and previews."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# The default wide layout of a cutting experiment, one row per subject.
WAVES = (0, 1, 2, 3, 4, 5)


def panel_schema(id_type=None, waves=WAVES) -> StructType:
    """Explicit schema of the default wide panel, so that no inference scan is needed."""
    waves = list(waves)
    fields = [StructField("ID", id_type or StringType())]
    fields += [StructField(c, StringType()) for c in ("sp", "trat", "dom")]
    fields += [StructField(f"alt{w}", DoubleType()) for w in waves]
    fields += [StructField(f"sup{w}", IntegerType()) for w in waves[1:]]
    fields += [StructField(f"frutos{w}", IntegerType()) for w in waves]
    fields += [StructField(f"t{w}", DoubleType()) for w in waves]
    fields += [StructField("t0pond", DoubleType()), StructField("tocon0", DoubleType())]
    return StructType(fields)


def read_panel(spark: SparkSession, path: str, schema: StructType | str | None = None,
               format: str = "csv") -> DataFrame:
    """Read a panel. CSV has a header and ``NA`` for missing.

    CSV columns are matched by header name, so a schema may list any subset
    in any order. Without a schema the types are inferred, at the price of one
    more scan.
    """
    if format == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    options = dict(header=True, nullValue="NA", sep=",")
    if schema is None:
        return spark.read.csv(path, inferSchema=True, **options)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    text = spark.read.csv(path, **options)  # header only: reads one line
    missing = [f.name for f in schema.fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"columns not in {path}: {missing}")
    types = {f.name: f for f in schema.fields}
    full = StructType([types.get(c, StructField(c, StringType())) for c in text.columns])
    return spark.read.csv(path, schema=full, enforceSchema=False, **options).select(*types)


def read_checked(spark: SparkSession, path: str, schema: StructType | str, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV panel that fit the schema, and the others: ``reason, line``.

    A line is malformed where a value does not parse or the number of values is
    wrong, and incomplete where a column of ``required`` is missing. Both tables
    read the file when they are used; no line is lost between them. ``reason``
    names the malformed line as such, or the first missing column.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    options = dict(header=True, nullValue="NA", sep=",")
    text = spark.read.csv(path, **options)
    unknown = [f.name for f in schema.fields if f.name not in text.columns]
    if unknown:
        raise ValueError(f"columns not in {path}: {unknown}")
    bad = "_malformed"
    while bad in text.columns:
        bad += "_"
    types = {f.name: f for f in schema.fields}
    full = StructType([*[types.get(c, StructField(c, StringType())) for c in text.columns], StructField(bad, StringType())])
    # a value that no one reads must be parsed too: no pruning of columns, and all of them in the condition
    whole = F.size(F.array(*[F.col(c).isNull() for c in text.columns])) == len(text.columns)
    rows = spark.read.option("columnPruning", False).csv(path, schema=full, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, **options)
    reason = F.when(F.col(bad).isNotNull(), F.lit("malformed"))
    for c in required:
        reason = reason.when(F.col(c).isNull(), F.lit(f"missing {c}"))
    checked = rows.withColumn("__reason", reason)
    line = F.coalesce(F.col(bad), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in text.columns]))
    good = checked.where(F.col("__reason").isNull() & whole).select(*types)
    return good, checked.where(F.col("__reason").isNotNull() & whole).select(F.col("__reason").alias("reason"), line.alias("line"))


def quarantine(rejected: DataFrame, path: str) -> DataFrame:
    """Keep rejected rows as Parquet and count them: ``reason, n``."""
    rejected.write.mode("append").parquet(path)
    return rejected.sparkSession.read.parquet(path).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def read_tables(spark: SparkSession, directory: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{directory}/{n}.parquet") for n in names]


def write_table(df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite") -> None:
    """Write a result table; every task writes its own part file."""
    if format == "csv":
        df.write.mode(mode).csv(path, header=True, nullValue="NA")
    else:
        df.write.mode(mode).format(format).save(path)


def write_layers(layers: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> dict[str, str]:
    """Write the layers of one figure (points, ribbons, boxes, ...) as Parquet tables."""
    out = {}
    for name, df in layers.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(out[name])
    return out


def write_bundle(layers: Mapping[str, DataFrame], path: str) -> int:
    """Write the layers of a study as one version, which becomes visible as a whole.

    Every layer goes to a folder of the version. The manifest, one file that
    lists them with their row counts, is written last; readers know a version
    by its manifest only, so a failed write leaves nothing to be seen.
    """
    if not layers:
        raise ValueError("a bundle needs a layer")
    spark = next(iter(layers.values())).sparkSession
    root = path.rstrip("/")
    version = time.time_ns()
    entries = []
    for name, df in layers.items():
        place = f"layers/{version}/{name}"
        df.write.parquet(f"{root}/{place}")
        entries.append((version, name, place, spark.read.parquet(f"{root}/{place}").count()))
    table = spark.createDataFrame(entries, "version long, layer string, place string, n long")
    table.coalesce(1).write.json(f"{root}/manifests/{version}")
    return version


def read_bundle(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The layers of a version, of the newest complete one by default. A layer that has not its manifest's number of rows is an error."""
    root = path.rstrip("/")
    manifests = spark.read.json(f"{root}/manifests/*", schema="version long, layer string, place string, n long")
    chosen = manifests.agg(F.max("version")).first()[0] if version is None else version
    entries = manifests.where(F.col("version") == F.lit(chosen)).collect()                 # one row a layer
    if not entries:
        raise ValueError(f"no version {version or ''} in {path}")
    layers = {e["layer"]: spark.read.parquet(f"{root}/{e['place']}") for e in entries}
    for e in entries:
        if layers[e["layer"]].count() != e["n"]:
            raise ValueError(f"layer {e['layer']!r} of version {chosen} is not whole")
    return layers


def preview(df: DataFrame) -> DataFrame:
    """One row per column: type, non-missing count and numeric range, from a single scan."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = [(n, t, t in numeric or t.startswith("decimal")) for n, t in df.dtypes]
    nothing = F.lit(None).cast("double")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (name, _, is_num) in enumerate(kinds):
        c = df[name]
        aggs.append(F.struct(
            F.count(c).alias("n"),
            (F.min(c).cast("double") if is_num else nothing).alias("lo"),
            (F.avg(c) if is_num else nothing).cast("double").alias("mean"),
            (F.max(c).cast("double") if is_num else nothing).alias("hi"),
        ).alias(f"c{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("type"),
                     F.col(f"c{i}.n").alias("n"), (F.col("rows") - F.col(f"c{i}.n")).alias("n_missing"),
                     F.col(f"c{i}.lo").alias("min"), F.col(f"c{i}.mean").alias("mean"),
                     F.col(f"c{i}.hi").alias("max"))
            for i, (name, kind, _) in enumerate(kinds)]
    return one.select(F.inline(F.array(*rows)))
