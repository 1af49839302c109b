"""Raw behaviour files to clean detail tables: header and row checks, sampling, strict decoding, classified rejects."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import ACTIONS, EVENT_YEAR, FILES, FileSpec
from ..functions.numbers import bad_int, bad_probability, blank, month_day, optional_int, probability
from ..sources.shared import new_folder, staged

#: Kinds of rejects.
HEADER, ROW_SHAPE, FIELD_TYPE, INVALID_DATE, INVALID_ACTION = "header", "row_shape", "field_type", "invalid_date", "invalid_action_type"
CORRUPT = "_corrupt"
#: Size of a table of blocks that is broadcast.
BROADCAST_BYTES = 32 << 20


class IngestError(ValueError):
    """An input that strict ingest refuses; category is one of the kinds of rejects."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category


def check_sampling(modulus: int, residue: int) -> None:
    if modulus <= 0 or not 0 <= residue < modulus:
        raise ValueError(f"residue {residue} doesn't fit modulus {modulus}")


def sampled(df: DataFrame, modulus: int, residue: int, user: str = "user_id") -> DataFrame:
    """Rows of the users in a stable sample: user modulo modulus is residue (never negative, as in a floored division)."""
    check_sampling(modulus, residue)
    return df.where(F.pmod(F.col(user).cast("long"), F.lit(modulus)) == residue)


def decode_action(code: Column) -> Column:
    """Action name of a raw code; null if there is none."""
    return F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.trim(code)]


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Normalised names in the first line of a file: trimmed, lower-case, without a byte order mark."""
    first = spark.read.text(path).limit(1).select(F.regexp_replace("value", "^﻿", "").alias("line")).head()
    return [] if first is None else [c.strip().strip('"').lower() for c in first["line"].split(",")]


def check_headers(spark: SparkSession, folder: str, specs: tuple[FileSpec, ...] = FILES) -> None:
    """Compares the headers of all files with their contracts, order included, before anything is written."""
    for spec in specs:
        try:
            found = header_of(spark, f"{folder}/{spec.file}")
        except Exception as e:  # a missing path is reported by Spark as an analysis error
            if "PATH_NOT_FOUND" not in str(e):
                raise
            raise IngestError(HEADER, f"{spec.file} is missing") from e
        if found != list(spec.header):
            raise IngestError(HEADER, f"{spec.file} has the header {found}, not {list(spec.header)}")


def raw(spark: SparkSession, folder: str, spec: FileSpec) -> DataFrame:
    """All columns of a file as text, with _corrupt set on rows that are too short or too long.

    The reader must parse every column to see that: nothing may be pruned below the check, so column pruning is off.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*spec.header, CORRUPT)])
    return spark.read.schema(schema).option("columnPruning", False).csv(f"{folder}/{spec.file}", header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def _offsets(placed: DataFrame, each_file: bool) -> DataFrame:
    """One row (_file, _start, _shift) for each block that a scan reads: what the identifiers of its rows lack to their numbers.

    Sums run over the blocks within each file, and over the files; only the latter, one row a file, meet in one task.
    """
    blocks = placed.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    blocks = blocks if each_file else staged(blocks, "counted")  # which are read twice, and the files once
    before = lambda n, order: F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = blocks.withColumn("_before", before("_n", Window.partitionBy("_file").orderBy("_start")))
    if each_file:
        return within.select("_file", "_start", (F.col("_before") - F.col("_first") + 1).alias("_shift"))
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_n")).select("_file", before("_n", Window.orderBy("_file")).alias("_files"))
    return within.join(files, "_file").select("_file", "_start", (F.col("_files") + F.col("_before") - F.col("_first") + 1).alias("_shift"))


def numbered(df: DataFrame, name: str = "source_row_number", each_file: bool = False) -> DataFrame:
    """Numbers the rows of a file scan from 1 in the order of the files' paths and of the rows within them; with each_file
    from 1 in every file.

    A scan reads a file in blocks, and keeps the order within each. A first pass, run here, counts the rows of the
    blocks; the rows then meet the table of their blocks, which is written to the shared folder. It is broadcast if it
    has at most BROADCAST_BYTES; a larger one (over 10**5 blocks) is joined by the block, and a block is bounded.
    """
    spark, at = df.sparkSession, [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    where = new_folder(spark, "blocks")
    _offsets(df.select(*at).withColumn("_id", F.monotonically_increasing_id()), each_file).write.parquet(where)
    offsets = spark.read.schema("_file string, _start long, _shift long").parquet(where)
    size = offsets.agg(F.coalesce(F.sum(F.length("_file") + 64), F.lit(0)).alias("n")).head()["n"]
    placed = df.select("*", *at).withColumn("_id", F.monotonically_increasing_id())
    found = placed.join(F.broadcast(offsets) if size <= BROADCAST_BYTES else offsets.hint("merge"), ["_file", "_start"])
    return found.withColumn(name, F.col("_id") + F.col("_shift")).drop("_file", "_start", "_id", "_shift")


@dataclass
class Decoded:
    """The judged rows of a file (its clean columns, and _row, _category, _column) and a counter filled by the first action.

    Rows outside the sample are in it only if they are rejected; a rejected row has a category and no clean column.
    """

    judged: DataFrame
    raw_count: Observation

    @property
    def rows(self) -> DataFrame:
        return self.judged.where("_category is null").drop("_row", "_category", "_column")

    @property
    def rejects(self) -> DataFrame:
        """Classified rejects: source_row, category, column."""
        return self.judged.where("_category is not null").select(F.col("_row").alias("source_row"), F.col("_category").alias("category"), F.col("_column").alias("column"))


def _decoded(df: DataFrame, rules: list[tuple[Column, str, str | None]], columns: dict[str, Column], seen: Observation) -> Decoded:
    """Judges each row by the first rule that it breaks.

    The verdict is inlined from an array of one: a filter on it stays above, where otherwise it would repeat all rules in
    a method too long to be compiled.
    """
    verdict = lambda kind, column: F.struct(F.lit(kind).cast("string").alias("_category"), F.lit(column).cast("string").alias("_column"))
    found = F.coalesce(*[F.when(bad, verdict(kind, column)) for bad, kind, column in rules], verdict(None, None))
    clean = [F.when(F.col("_category").isNull(), value).alias(name) for name, value in columns.items()]
    judged = df.select("*", F.inline(F.array(found))).select(*clean, F.col("source_row_number").alias("_row"), "_category", "_column")
    return Decoded(judged, seen)


def _sample(df: DataFrame, modulus: int, residue: int) -> DataFrame:
    """Rows in the sample, and rows whose width or user doesn't allow to tell: those are rejected later."""
    check_sampling(modulus, residue)
    user = F.trim("user_id").try_cast("bigint")
    return df.where(F.col(CORRUPT).isNotNull() | user.isNull() | (F.pmod(user, F.lit(modulus)) == residue))


def _no_short(value: Column) -> Column:
    """True for integers that a short can't hold."""
    return optional_int(value).isNotNull() & optional_int(value).try_cast("short").isNull()


def decode_users(df: DataFrame, modulus: int, residue: int) -> Decoded:
    """Users; every row is checked in full, whether or not it is in the sample."""
    check_sampling(modulus, residue)
    seen = Observation()
    df = df.observe(seen, F.count("*").alias("rows"))
    c = F.col
    rules = [(c(CORRUPT).isNotNull(), ROW_SHAPE, None), (bad_int(c("user_id"), True), FIELD_TYPE, "user_id"), *[(bad_int(c(n)) | _no_short(c(n)), FIELD_TYPE, n) for n in ("age_range", "gender")]]
    out = _decoded(df, rules, {"user_id": optional_int(c("user_id"))} | {n: optional_int(c(n)).try_cast("short") for n in ("age_range", "gender")}, seen)
    out.judged = out.judged.where(c("_category").isNotNull() | (F.pmod(c("user_id"), F.lit(modulus)) == residue))
    return out


def decode_events(df: DataFrame, modulus: int, residue: int, year: int = EVENT_YEAR) -> Decoded:
    """Behaviour events: sampled by user before the other fields are looked at; blank brands are null."""
    seen = Observation()
    df = _sample(df.observe(seen, F.count("*").alias("rows")), modulus, residue)
    c = F.col
    needed = [("user_id", "user_id"), ("item_id", "item_id"), ("cat_id", "category_id"), ("seller_id", "merchant_id")]
    rules = [
        (c(CORRUPT).isNotNull(), ROW_SHAPE, None),
        *[(bad_int(c(a), True), FIELD_TYPE, a) for a, _ in needed],
        (bad_int(c("brand_id")), FIELD_TYPE, "brand_id"),
        (month_day(c("time_stamp"), year).isNull(), INVALID_DATE, "time_stamp"),
        (decode_action(c("action_type")).isNull(), INVALID_ACTION, "action_type"),
    ]
    columns = {"source_row_number": c("source_row_number"), **{b: optional_int(c(a)) for a, b in needed}, "brand_id": optional_int(c("brand_id")), "event_date": month_day(c("time_stamp"), year), "action_type": decode_action(c("action_type"))}
    return _decoded(df, rules, columns, seen)


def decode_samples(df: DataFrame, split: str, modulus: int, residue: int) -> Decoded:
    """Train samples have a label (0 or 1), test samples a probability or none; the other column is null."""
    seen = Observation()
    df = _sample(df.observe(seen, F.count("*").alias("rows")), modulus, residue)
    c = F.col
    third = "label" if split == "train" else "prob"
    wrong = ~F.trim(c("label")).isin("0", "1") | blank(c("label")) if split == "train" else bad_probability(c("prob"))
    rules = [(c(CORRUPT).isNotNull(), ROW_SHAPE, None), (bad_int(c("user_id"), True), FIELD_TYPE, "user_id"), (bad_int(c("merchant_id"), True), FIELD_TYPE, "merchant_id"), (wrong, FIELD_TYPE, third)]
    columns = {
        "user_id": optional_int(c("user_id")),
        "merchant_id": optional_int(c("merchant_id")),
        "dataset_split": F.lit(split),
        "label": optional_int(c("label")).cast("short") if split == "train" else F.lit(None).cast("short"),
        "probability": F.lit(None).cast("decimal(8,7)") if split == "train" else probability(c("prob")),
    }
    return _decoded(df, rules, columns, seen)


@dataclass
class Silver:
    """The judged rows of the four files, and what follows from them: three clean tables, all rejects, and the counters."""

    parts: dict[str, Decoded]

    @property
    def users(self) -> DataFrame:
        return self.parts["users"].rows

    @property
    def user_events(self) -> DataFrame:
        return self.parts["events"].rows

    @property
    def repurchase_samples(self) -> DataFrame:
        return self.parts["train"].rows.unionByName(self.parts["test"].rows)

    @property
    def rejects(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.rejects.withColumn("file", F.lit(k)) for k, p in self.parts.items()])

    @property
    def raw_counts(self) -> dict[str, Observation]:
        return {k: p.raw_count for k, p in self.parts.items()}

    def staged(self, where: str) -> Silver:
        """The same, after writing the judged rows of each file below where.

        So a file is parsed twice in all, once to number its rows and once to judge them; clean rows, rejects and
        counts are then read from Parquet, each with its own columns.
        """
        spark = self.parts["users"].judged.sparkSession
        for key, part in self.parts.items():
            part.judged.write.mode("overwrite").parquet(f"{where}/{key}")
        return Silver({k: Decoded(spark.read.schema(p.judged.schema).parquet(f"{where}/{k}"), p.raw_count) for k, p in self.parts.items()})


def read_silver(spark: SparkSession, folder: str, modulus: int = 1, residue: int = 0, year: int = EVENT_YEAR) -> Silver:
    """Reads the four contracted files; but for headers and row numbers, nothing runs yet."""
    check_sampling(modulus, residue)
    check_headers(spark, folder)
    files = {s.key: numbered(raw(spark, folder, s)) for s in FILES}
    users, events = decode_users(files["users"], modulus, residue), decode_events(files["events"], modulus, residue, year)
    train, test = (decode_samples(files[k], k, modulus, residue) for k in ("train", "test"))
    return Silver({"users": users, "events": events, "train": train, "test": test})


def _refuse(file: str, row: int, category: str, column: str | None) -> None:
    raise IngestError(category, f"{file}, row {row}: {category} {column or ''}".rstrip())


def refuse_rejects(silver: Silver) -> None:
    """Strict mode: raises for the first rejected row."""
    first = silver.rejects.orderBy("file", "source_row").head()
    if first is not None:
        _refuse(first["file"], first["source_row"], first["category"], first["column"])


def dry_run(silver: Silver) -> dict[str, int]:
    """Runs all checks and counts without writing a table; raises as strict ingest would.

    One pass over each file judges, counts and finds its first reject.
    """
    found, row = {}, F.when(F.col("_category").isNotNull(), F.col("_row"))
    for key, part in silver.parts.items():
        seen = Observation()
        values = {"n": F.count_if(F.col("_category").isNull()), "row": F.min(row), "category": F.min_by("_category", row), "column": F.min_by("_column", row)}
        part.judged.observe(seen, *[v.alias(k) for k, v in values.items()]).write.format("noop").mode("overwrite").save()
        found[key] = seen.get
    for key, first in sorted(found.items()):
        if first["row"] is not None:
            _refuse(key, first["row"], first["category"], first["column"])
    counts = {"users": found["users"]["n"], "user_events": found["events"]["n"], "repurchase_samples": found["train"]["n"] + found["test"]["n"]}
    return counts | {f"raw_{k}": o.get["rows"] for k, o in silver.raw_counts.items()}


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those rows of new whose key is in neither; of rows of new with the same key one stays."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def upsert_latest(rows: DataFrame, keys: list[str], value: str, version: str, allowed: dict[str, list] | None = None) -> DataFrame:
    """The value with the largest version for each key (ties: the larger value), of allowed keys only."""
    for column, values in (allowed or {}).items():
        rows = rows.where(F.col(column).isin(list(values)))
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(version, value)).alias(value), F.max(version).alias(version))
