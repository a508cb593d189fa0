"""Metadata, captions, class lists, predicate matrices, JSON lookups and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import row_index

# Default file and column names.
METADATA_FILE = "metadata.csv"
IMAGE_COLUMN, CAPTION_COLUMN, CAPTION_SEPARATOR = "filepath", "title", "\t"
IMAGE_NAME = r"\.(jpg|jpeg|png|ppm|bmp|pgm|tif|tiff|webp)$"


def number_lines(df: DataFrame, out: str = "row_id") -> DataFrame:
    """0-based number of each record of a file scan in file order: by file, by block of the file,
    then by place inside the block."""
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return row_index(placed, ["_file", "_block", "_at"], out).drop("_file", "_block", "_at")


def scan_metadata(spark: SparkSession, root: str, file: str = METADATA_FILE, numbered: bool = False) -> DataFrame:
    """Metadata CSV under ``root``: the first (index) column goes, nulls become ''. All columns
    are text except ``class_idx``."""
    raw = spark.read.option("header", True).option("escape", '"').csv(f"{root.rstrip('/')}/{file}")
    if "filepath" not in raw.columns[1:]:
        raise ValueError(f"{file} needs a filepath column")
    rows = raw.select(*raw.columns[1:]) if not numbered else number_lines(raw).drop(raw.columns[0])
    if "class_idx" in rows.columns:
        rows = rows.withColumn("class_idx", F.col("class_idx").cast("int"))
    return rows.na.fill("")


def scan_captions(
    spark: SparkSession, path: str, image: str = IMAGE_COLUMN, caption: str = CAPTION_COLUMN, sep: str = CAPTION_SEPARATOR
) -> DataFrame:
    """Image and caption columns of a delimited file as text; other columns are not parsed."""
    table = spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return table.select(F.col(image).cast("string").alias("image"), F.col(caption).cast("string").alias("caption"))


def scan_image_folder(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """``root/<class>/.../<file>`` as (path, class[, content]), image extensions in any case. Without ``content`` only the file
    listing is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .filter(F.lower("path").rlike(IMAGE_NAME))
    )
    below = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    return files.select("path", F.get(below, F.lit(0)).alias("class"), *(["content"] if content else []))


def scan_lines(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """(line_no, value), lines numbered from 0."""
    return number_lines(spark.read.text(path), "line_no").withColumnRenamed("value", value)


def scan_predicate_matrix(spark: SparkSession, classes_path: str, matrix_path: str, classes: DataFrame | None = None) -> DataFrame:
    """(line_no, class, attributes): line i of the matrix belongs to line i of the class list.
    Class lines may carry a number in front of the name. ``classes`` restricts the result."""
    names = scan_lines(spark, classes_path).select(
        "line_no", F.element_at(F.split(F.trim("value"), r"\s+"), -1).alias("class")
    )
    vectors = scan_lines(spark, matrix_path).select(
        "line_no", F.split(F.trim("value"), r"\s+").cast("array<int>").alias("attributes")
    )
    out = names.join(vectors, "line_no")
    return out if classes is None else out.join(classes.select("class"), "class", "left_semi")


def json_lookup(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False) -> DataFrame:
    """A JSON file as a table of the given schema; a missing file is an empty table."""
    try:
        return spark.read.schema(schema).option("multiLine", multiline).json(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def json_map_lookup(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """A JSON object file as (key, value) rows."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


FEATURE_COLUMNS = {"id": T.LongType, "features": T.ArrayType, "target": T.IntegralType}


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table (id, features, target[, path]); also accepts the layout of one row per
    file with parallel arrays ``features``, ``target``, ``samples``."""
    table = spark.read.parquet(path)
    types = {f.name: f.dataType for f in table.schema}
    nested = isinstance(types.get("features"), T.ArrayType) and isinstance(types["features"].elementType, T.ArrayType)
    if nested:
        entry = F.arrays_zip("features", "target", "samples")
        rows = table.select(
            F.col("_metadata.file_path").alias("_file"), F.posexplode(entry).alias("_i", "_e")
        )
        rows = rows.select("_file", "_i", "_e.features", "_e.target", F.col("_e.samples").alias("path"))
        return row_index(rows, ["_file", "_i"], "id").select("id", "path", "features", "target")
    wrong = [c for c, kind in FEATURE_COLUMNS.items() if c not in types or not isinstance(types[c], kind)]
    if wrong:
        raise ValueError(f"unsupported feature table: {', '.join(wrong)} missing or of another type")
    return table


def synthetic_source(spark: SparkSession, n: int, caption: str = "Dummy caption") -> DataFrame:
    """n identical samples."""
    return spark.range(n).select("id", F.lit(caption).alias("caption"))


def read_dataset(spark: SparkSession, path: str, kind: str = "auto", **options) -> DataFrame:
    """Reader by kind or by file extension: csv, tsv, tar (webdataset), synthetic."""
    from .tar import read_tar_samples

    if kind == "auto":
        kind = path.rsplit(".", 1)[-1].lower().rstrip("}") if "." in path else ""
    if kind in ("csv", "tsv"):
        options.setdefault("sep", "," if kind == "csv" else "\t")
        return scan_captions(spark, path, **options)
    if kind in ("tar", "webdataset"):
        return read_tar_samples(spark, path, **options)
    if kind == "synthetic":
        return synthetic_source(spark, **options)
    raise ValueError(f"cannot tell the dataset kind of {path!r} (kind={kind!r})")


def task_catalog(tasks: DataFrame, row: str = "row_idx") -> DataFrame:
    """(task, cluster, sub-cluster) from the first row of each task; an empty sub-cluster is
    written ``none``."""
    first = tasks.groupBy("task").agg(
        F.min_by("task_cluster", row).alias("task_cluster"), F.min_by("task_subcluster", row).alias("_s")
    )
    return first.select("task", "task_cluster", F.coalesce(F.nullif("_s", F.lit("")), F.lit("none")).alias("task_subcluster"))


def drop_null_traits(df: DataFrame, traits: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(traits))
