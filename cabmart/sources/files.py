"""File scans (S1-S6, U1): CSV lookups, preamble CSV, globs, parquet, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .schemas import schema as _schema


def _as_struct(s) -> StructType:
    if isinstance(s, StructType):
        return s
    if isinstance(s, str) and " " in s:
        return StructType.fromDDL(s)
    return _schema(s)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Header CSV with an explicit schema.

    The whitespace options make ``2, "Curb Mobility, LLC"`` one clean field
    (a blank before the quote would otherwise keep the quote and split).
    """
    return (spark.read.schema(_as_struct(schema))
            .option("header", True)
            .option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True)
            .option("mode", "PERMISSIVE")
            .csv(path))


def read_headed_folders(spark: SparkSession, path_glob: str, schema, tag_col: str, tag_regex: str,
                        tags: dict[str, str], other_prefix: str = "", header: str = r"^time\b",
                        data_line: str = r"^\d{4}-\d{2}-\d{2}") -> DataFrame:
    """CSV files with a preamble in one folder per tag, in one scan.

    ``tags`` maps a folder's name to its tag; of other folders ``other_prefix`` is
    cut off.  Every file's columns go by its own header line: files are joined
    to their header, and parsed by layout (a handful of distinct header lines
    comes to the driver).  A header with an unknown column raises.
    """
    st = _as_struct(schema)
    known = {f.name.lower(): f for f in st.fields}
    text = spark.read.text(path_glob).select("value", F.col("_metadata.file_path").alias("_path"))
    heads = text.filter(F.col("value").rlike(header)).select("_path", F.trim("value").alias("_head")).distinct()
    lines = text.filter(F.col("value").rlike(data_line)).join(heads, "_path")
    # paths are URL-encoded (a blank is %20, and a plus sign stays itself)
    folder = F.url_decode(F.replace(F.regexp_extract("_path", tag_regex, 1), F.lit("+"), F.lit("%2B")))
    named = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    tag = F.coalesce(F.try_element_at(named, folder), F.regexp_replace(folder, other_prefix, "")).alias(tag_col)
    out = None
    for row in heads.select("_head").distinct().collect():
        names = [n.strip() for n in row[0].split(",")]
        unknown = [n for n in names if n.lower() not in known]
        if unknown:
            raise ValueError(f"columns {unknown} of the header {row[0]!r} are not known")
        ddl = ", ".join(f"`{n}` {known[n.lower()].dataType.simpleString()}" for n in names)
        parsed = lines.filter(F.col("_head") == F.lit(row[0])).select(
            tag, F.from_csv("value", ddl, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm",
                                           "ignoreLeadingWhiteSpace": "true",
                                           "ignoreTrailingWhiteSpace": "true"}).alias("r"))
        have = {n.lower(): n for n in names}
        part = parsed.select(tag_col, *[
            (F.col(f"r.`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None))
            .cast(f.dataType).alias(f.name) for f in st.fields])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame(
        [], StructType([*StructType.fromDDL(f"{tag_col} string").fields, *st.fields]))


def same_types(spark: SparkSession, paths: list[str]) -> list[tuple[StructType, list[str]]]:
    """Groups of parquet files whose columns have equal types, with the merged schema of each.

    Spark's tasks read the footers of a whole group at once; only a group whose types differ
    is halved.  Files come sorted by name, so a type that changes once in a folder's history costs
    about as many jobs as the logarithm of its files.  Neighbours that agree are joined again.
    """
    def group(own: list[str]) -> list[tuple[StructType, list[str]]]:
        try:
            return [(spark.read.option("mergeSchema", True).parquet(*own).schema, own)]
        except Exception as e:
            if len(own) == 1 or "MERGE" not in str(e).upper():
                raise
        half = len(own) // 2
        return group(own[:half]) + group(own[half:])

    out: list[tuple[StructType, list[str]]] = []
    for schema, own in (group(paths) if paths else []):
        types = {f.name.lower(): f.dataType for f in schema.fields}
        for i, (have, held) in enumerate(out):
            if all(types.get(f.name.lower(), f.dataType) == f.dataType for f in have.fields):
                known = {f.name.lower() for f in have.fields}
                out[i] = (StructType(have.fields + [f for f in schema.fields if f.name.lower() not in known]), held + own)
                break
        else:
            out.append((schema, own))
    return out


def register_views(frames: dict[str, DataFrame]) -> None:
    """Named lazy views (S5); nothing is read until a query runs."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
