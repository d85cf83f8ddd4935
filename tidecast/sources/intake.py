"""Sales file intake: permissive CSV read, header resolution, row-wise validation.

Files are read with an all-STRING schema (no inference pass over the data);
types come from ``try_to_date`` / ``try_cast`` projections, so a bad cell is a
NULL, never a failed job. Validation splits the input into a *valid* and a
*rejected* DataFrame and produces the report counts in one aggregate.
Header resolution only looks at column names (driver-side metadata).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attach import attach_row
from ..functions.calendar import normalize_season
from ..functions.dates import parse_date, parse_sales
from ..schema import CSV_CONTRACT, all_string

CORRUPT = "_corrupt_record"
NO_SUCH_SOURCE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024


def read_csv(
    spark: SparkSession, path: str | Sequence[str], header: bool = True, schema=None, infer_schema: bool = False
) -> DataFrame:
    """src_csv: permissive CSV read. With ``schema=None`` and no inference every column is STRING."""
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    else:
        reader = reader.option("inferSchema", infer_schema)
    return reader.csv(path)


def contract_schema():
    """src_schema: the declared 4-column contract (Date string, Sales, Store, Weekly_Sales)."""
    return CSV_CONTRACT


def read_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Column names of a CSV file (reads the header line only)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


@dataclass(frozen=True)
class Resolved:
    date: str | None
    sales: str | None
    store: str | None
    rename: dict[str, str]


def resolve_columns(columns: Sequence[str]) -> Resolved:
    """Normalise names (lower/trim) and pick the first date / sales / store column by substring."""
    norm = {c: c.strip().lower() for c in columns}
    date = next((c for c in columns if "date" in norm[c]), None)
    sales = next((c for c in columns if "sales" in norm[c]), None)
    store = next((c for c in columns if "store" in norm[c] and c not in (date, sales)), None)
    return Resolved(date, sales, store, norm)


def validate_frame(raw: DataFrame, resolved: Resolved | None = None, default_store: str = "1"):
    """src_validate_csv core: returns ``(valid, rejected, report)`` DataFrames.

    valid: ``store STRING, date DATE, sales DOUBLE`` + every other column lower-cased.
    rejected: input rows whose date or sales did not parse, with a ``reason``.
    report: one row with counts and the validation message.
    """
    r = resolved or resolve_columns(raw.columns)
    if r.date is None:
        raise ValueError("Missing required column: Date.")
    if r.sales is None:
        raise ValueError("Missing required column: Sales.")
    extras = [c for c in raw.columns if c not in (r.date, r.sales, r.store) and c != CORRUPT]
    store_expr = F.trim(F.col(f"`{r.store}`").cast("string")) if r.store else F.lit(default_store)
    row = F.struct(
        store_expr.alias("store"),
        parse_date(F.col(f"`{r.date}`")).alias("date"),
        parse_sales(F.col(f"`{r.sales}`")).alias("sales"),
        F.col(f"`{r.date}`").cast("string").alias("__raw_date"),
        *[F.col(f"`{c}`").alias(r.rename[c]) for c in extras],
    )
    # one array element a row: no filter on what was parsed moves below it, where it would be parsed a second time
    typed = raw.select(F.inline(F.array(row)))
    if "season" in [r.rename[c] for c in extras]:
        typed = typed.withColumn("season", normalize_season("season"))
    ok = F.col("date").isNotNull() & F.col("sales").isNotNull()
    valid = typed.where(ok).drop("__raw_date")
    rejected = typed.where(~ok).withColumn(
        "reason",
        F.when(F.col("date").isNull() & F.col("sales").isNull(), "bad date and sales")
        .when(F.col("date").isNull(), "bad date")
        .otherwise("bad sales"),
    )
    report = validation_report(typed)
    return valid, rejected, report


def validation_report(typed: DataFrame) -> DataFrame:
    """Counts in ONE aggregate, plus the user-facing message."""
    rep = typed.agg(
        F.count(F.lit(1)).alias("records_in"),
        F.count_if(F.col("date").isNotNull() & F.col("sales").isNotNull()).alias("records_valid"),
        F.count_if(F.col("date").isNull()).alias("unparsed_dates"),
        F.count_if(F.col("sales").isNull()).alias("bad_sales"),
    ).withColumn("records_dropped", F.col("records_in") - F.col("records_valid"))
    msg = F.concat(
        F.format_string("CSV validated successfully. %d records available.", F.col("records_valid")),
        F.when(
            F.col("records_dropped") > 0,
            F.format_string(" %d invalid rows were removed (bad/missing dates or sales).", F.col("records_dropped")),
        ).otherwise(F.lit("")),
        F.when(
            (F.col("unparsed_dates") > 0) & (F.col("unparsed_dates") < F.col("records_in")),
            F.format_string(" Note: %d date values could not be parsed and were removed.", F.col("unparsed_dates")),
        ).otherwise(F.lit("")),
    )
    status = (
        F.when(F.col("records_in") == 0, "CSV file is empty.")
        .when(F.col("unparsed_dates") == F.col("records_in"), "Unable to parse any dates from the Date column.")
        .when(F.col("records_valid") == 0, "After removing invalid rows there is no data to process.")
    )
    return rep.withColumns({"is_valid": status.isNull(), "message": F.coalesce(status, msg)})


def date_parse_failures(raw: DataFrame, date_col: str, samples: int = 5) -> DataFrame:
    """src_parse_dates diagnostics: number of unparseable values and up to ``samples`` distinct examples."""
    bad = raw.select(F.col(f"`{date_col}`").cast("string").alias("value")).where(parse_date(F.col("value")).isNull())
    count = bad.agg(F.count(F.lit(1)).alias("unparsed"))
    examples = bad.where(F.col("value").isNotNull()).distinct().orderBy("value").limit(samples).agg(
        F.sort_array(F.collect_list("value")).alias("samples")
    )
    return attach_row(count, examples)


def first_lines(batches):
    """The first line of each file in a task's lines, which come in order; a block that begins a file is in one task."""
    seen = None
    for batch in batches:
        files = batch.column(0).to_pandas()
        starts = files.ne(files.shift())
        starts.iloc[:1] = files.iloc[:1].ne(seen)
        if len(files):
            seen = files.iloc[-1]
        if starts.any():
            yield batch.take(pa.array(starts.to_numpy().nonzero()[0]))


def files_by_header(spark: SparkSession, path: str | Sequence[str]) -> dict[str, list[str]]:
    """Header line -> files that begin with it. Only the files' first lines leave the tasks."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").select("file", F.col("value").alias("header")).mapInArrow(first_lines, "file string, header string")
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return {r.header: r.files for r in sorted(found, key=lambda r: r.files)}


def _canonical(raw: DataFrame, r: Resolved) -> DataFrame:
    """The columns of one header under common names, as text."""
    if r.date is None or r.sales is None:
        raise ValueError(f"Missing required column: {'Date' if r.date is None else 'Sales'}.")
    names = {r.date: "date", r.sales: "sales"} | ({r.store: "store"} if r.store else {})
    return raw.select(*[F.col(f"`{c}`").cast("string").alias(names.get(c, r.rename.get(c, c))) for c in raw.columns if c != CORRUPT])


def validate_csv(spark: SparkSession, path: str | Sequence[str], default_store: str = "1"):
    """src_validate_csv: string-schema read → resolve header → validate. Raises on missing columns.

    Every file's own header is resolved: files of other column orders or names are read with their
    columns and meet under common names; a file without a store column gets the default store.
    """
    headers = files_by_header(spark, path) if len(spark.read.text(path).inputFiles()) > 1 else {}
    if len(headers) <= 1:
        cols = read_header(spark, path)
        raw = read_csv(spark, path, header=True, schema=all_string(cols))
        return validate_frame(raw, resolve_columns(cols), default_store)
    whole = None
    for files in headers.values():
        cols = read_header(spark, files)
        part = _canonical(read_csv(spark, files, header=True, schema=all_string(cols)), resolve_columns(cols))
        part = part if "store" in part.columns else part.withColumn("store", F.lit(default_store))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return validate_frame(whole, resolve_columns(whole.columns), default_store)


def require_columns(df: DataFrame, required: Sequence[str] = ("store", "date", "sales")) -> DataFrame:
    """src_required: schema assertion (names only)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def load_with_fallback(spark: SparkSession, candidates: Sequence[str]):
    """src_fallback: the first candidate path that validates (exists, non-empty, parses) wins.

    Only a missing path, an empty file or a failed validation means "try the next source"; any
    other error (storage, permissions, the cluster) is raised, as serving other data would hide it.
    """
    last_error = None
    for path in candidates:
        try:
            valid, rejected, report = validate_csv(spark, path)
        except AnalysisException as e:
            if e.getCondition() not in NO_SUCH_SOURCE:
                raise
            last_error = e
            continue
        except ValueError as e:
            last_error = e
            continue
        if valid.limit(1).count() == 1:
            return path, valid, rejected, report
    raise ValueError(f"no usable source among {list(candidates)}: {last_error}")


def list_files(spark: SparkSession, landing: str) -> DataFrame:
    """(path, length) of every file under ``landing``, hidden ones (``_``/``.``) left out; no content is read.

    Spark's file index lists the folders (in tasks, where there are many) and hands over all names in one call. Lengths are a
    scan's metadata; scans skip files of no length, which are those that the listing alone has.
    """
    jvm = spark.sparkContext._jvm
    if not jvm.org.apache.hadoop.fs.Path(landing).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(landing)):
        raise FileNotFoundError(landing)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing)
    listed = jvm.org.apache.hadoop.util.StringUtils.join("\n", files._jdf.inputFiles())  # encoded, so without line ends
    names = spark.createDataFrame([(f,) for f in listed.split("\n") if f], "value string")
    plain = F.url_decode(F.replace(F.col("value"), F.lit("+"), F.lit("%2B")))  # a plus stands for itself in a path
    place = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    every = names.select(plain.alias("path"), place(plain).alias("place")).distinct()
    sized = files.select(place(F.col("path")).alias("place"), "length")
    return every.join(sized, "place", "left").select("path", F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def upload_manifest(spark: SparkSession, landing: str, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """src_manifest: accept/reject every file of a landing directory: .csv only, non-empty, at most ``max_bytes``."""
    files = list_files(spark, landing)
    name = F.element_at(F.split("path", "/"), -1)
    reason = (
        F.when(~F.lower(name).endswith(".csv"), "not a .csv file")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > max_bytes, "file too large")
    )
    return files.select(name.alias("file_name"), "path", "length", reason.alias("reject_reason")).withColumn(
        "accepted", F.col("reject_reason").isNull()
    )
