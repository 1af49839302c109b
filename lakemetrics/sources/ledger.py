"""Publishing of runs, the ledger of ingest attempts, and the decision whether to ingest at all."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import RUNS
from ..operators import gold, ingest
from .shared import remove

RUNNING, SUCCEEDED, FAILED = "running", "succeeded", "failed"
IMPORT, SKIP, REFUSE = "import", "skip", "refuse"
#: Hashes that are hashed together.
FAN = 4096


def _now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")


def fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, hash) of every file with a byte or more in the given folders and files: a hash of its bytes, not of its name.

    It is a tree over the file's lines, as bytes, and its size. FAN lines in a row are told by the sum of the hashes of
    these lines with their places, in five parts of 48 bits, so each task adds up its lines and one row for FAN of them is
    shuffled; above that, FAN hashes in a row are hashed together, level by level, until the file has one. The lines and
    the size together tell every byte (also whether there is a last line break, or a mark of byte order, which readers
    drop). So a file may have any size and be read in any splits, beside any other files, and no task holds more than FAN
    hashes of it at a time.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths)
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("_size"), "_metadata"]
    level = ingest.numbered(lines.select("value", *meta), "_i", each_file=True).withColumn("_i", F.col("_i") - 1)
    most = level.agg(F.coalesce(F.max("_i"), F.lit(0)).alias("n")).head()["n"] // FAN
    place = F.concat((F.col("_i") % FAN).cast("string"), F.lit(":")).cast("binary")
    lines = level.select("path", "_size", F.call_function("div", F.col("_i"), F.lit(FAN)).alias("_i"), F.sha2(F.concat(place, F.col("value").cast("binary")), 256).alias("_h"))
    parts = [F.sum(F.conv(F.substring("_h", 1 + 12 * k, 12), 16, 10).cast("long")) for k in range(5)]
    level = lines.groupBy("path", "_size", "_i").agg(F.sha2(F.concat_ws(":", *parts), 256).alias("_h"))
    while most > 0:
        hashes = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"])
        done = (F.count("*") == 1) & (F.max("_i") == 0)  # the file's only hash: levels that larger files need don't change it
        level, most = level.groupBy("path", "_size", F.call_function("div", F.col("_i"), F.lit(FAN)).alias("_i")).agg(F.when(done, F.first("_h")).otherwise(F.sha2(F.array_join(hashes, ""), 256)).alias("_h")), most // FAN
    return level.select("path", F.sha2(F.concat_ws(":", "_size", "_h"), 256).alias("hash"))


def fingerprint(spark: SparkSession, folder: str) -> str:
    """SHA-256 of the input: of the sorted hashes of its files, so that names don't matter."""
    return fingerprints(spark, folder).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), "\n"), 256).alias("h")).head()["h"]


class Log:
    """Numbered entries in a folder, each one JSON file that no other writer can have written too.

    An entry is written under a temporary name and renamed to its number, which fails if that number is taken. A writer
    that comes too late reads the log again and tries the next number, so entries are in one order for all, and what a
    writer has read is still true when its entry counts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"entry long, {schema}"

    def rows(self) -> DataFrame:
        try:
            found = self.spark.read.schema(self.schema).option("pathGlobFilter", "*.json").json(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], self.schema)
        return found

    def append(self, row: Callable[[DataFrame], dict], tries: int = 100) -> dict:
        """Adds row(all entries so far), and returns it with its number; computed anew when another writer was faster."""
        for _ in range(tries):
            rows = self.rows()
            number = (rows.agg(F.max("entry")).head()[0] or 0) + 1
            new = {"entry": number} | row(rows)
            if self._create(f"{number:012d}.json", json.dumps({k: v for k, v in new.items() if v is not None}, default=str)):
                return new
        raise RuntimeError(f"{self.path} is written to all the time")

    def _create(self, name: str, text: str) -> bool:
        fs = self.spark._jvm.org.apache.hadoop.fs
        folder, options = fs.Path(self.path), self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        conf = self.spark._jsc.hadoopConfiguration()
        system, context = folder.getFileSystem(conf), fs.FileContext.getFileContext(folder.toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        draft = fs.Path(folder, f".{name}-{uuid4().hex}")
        system.mkdirs(folder)
        with_bytes = system.create(draft, False)
        try:
            with_bytes.write(bytearray(text.encode()))
        finally:
            with_bytes.close()
        try:
            context.rename(draft, fs.Path(folder, name), none)
        except Py4JJavaError as e:
            system.delete(draft, False)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True


class Store:
    """A folder of run directories, and a log of what became of each run; the last success names the published directory.

    A run writes its tables to a directory of its own. One entry of the log then says that it has succeeded and is
    published, so there is no moment at which only one of both holds. Readers go through the log; a run that fails, or
    whose writer dies, leaves what they see untouched, and its input can be ingested again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, f"{self.root}/log", f"{RUNS}, directory string")

    def published(self) -> str | None:
        """Directory of the published run: that of the last success in the log."""
        return self.log.rows().where("directory is not null").agg(F.max_by("directory", "entry")).head()[0]

    def table(self, name: str) -> DataFrame | None:
        where = self.published()
        return self.spark.read.parquet(f"{where}/{name}") if where else None

    def ledger(self) -> DataFrame:
        """All rows ever written; failed attempts stay."""
        return self.log.rows().select(*[c.split()[0] for c in RUNS.split(", ")])

    def runs(self) -> DataFrame:
        """The current state of every run: its last row."""
        last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))
        return self.ledger().withColumn("_k", last).where("_k = 1").drop("_k")

    def open(self, file_name: str, sha256: str, modulus: int, residue: int) -> dict:
        """A new run, with a number that no other run has."""
        run = {"seq": 1, "file_name": file_name, "sha256": sha256, "sample_modulus": modulus, "sample_residue": residue, "status": RUNNING, "started_at": _now()}
        new = self.log.append(lambda rows: {"run_id": (rows.agg(F.max("run_id")).head()[0] or 0) + 1} | run)
        return {k: v for k, v in new.items() if k != "entry"}

    def succeed(self, run: dict, raw_rows: int, imported_rows: int, directory: str) -> None:
        """Publishes the run's directory and closes the run."""
        done = {"seq": 2, "status": SUCCEEDED, "raw_row_count": raw_rows, "imported_row_count": imported_rows, "finished_at": _now(), "directory": directory}
        self.log.append(lambda _: run | done)

    def fail(self, run: dict, category: str, message: str) -> None:
        self.log.append(lambda _: run | {"seq": 2, "status": FAILED, "error_category": category, "error_message": message[:500], "finished_at": _now()})

    def last_success(self, sha256: str, modulus: int, residue: int) -> DataFrame:
        """One row: the last successful run of this input and sample, or null."""
        same = (F.col("sha256") == sha256) & (F.col("sample_modulus") == modulus) & (F.col("sample_residue") == residue) & (F.col("status") == SUCCEEDED)
        return self.runs().where(same).agg(F.max("run_id").alias("run_id"))

    def decide(self, sha256: str, modulus: int, residue: int, replace: bool = False) -> DataFrame:
        """One row with the action: replacing imports; an input that succeeded and is present is skipped; other data that is
        present refuses; anything else imports."""
        events = self.table("user_events")
        present = events.limit(1).agg(F.count("*").alias("rows")) if events is not None else self.spark.range(1).select(F.lit(0).cast("long").alias("rows"))
        action = F.when(F.lit(replace), IMPORT).when(F.col("run_id").isNotNull() & (F.col("rows") > 0), SKIP).when(F.col("rows") > 0, REFUSE).otherwise(IMPORT)
        return self.last_success(sha256, modulus, residue).crossJoin(present).select(action.alias("action"), "run_id", "rows")  # one row each


def write_run(store: Store, run: dict, silver: ingest.Silver) -> tuple[str, dict[str, int]]:
    """Writes the clean tables and the six metric tables of a run to its directory; returns that and the rows by table.

    The metrics are computed from the events as written, so both belong to the same rows.
    """
    spark, where = store.spark, f"{store.root}/data/run-{run['run_id']}"
    ingest.refuse_rejects(silver)
    silver.users.write.mode("overwrite").parquet(f"{where}/users")
    # Rows of a day stay together, but for a day with so many that its partition is split.
    silver.user_events.hint("rebalance", "event_date").sortWithinPartitions("event_date", "merchant_id").write.mode("overwrite").parquet(f"{where}/user_events")
    silver.repurchase_samples.write.mode("overwrite").parquet(f"{where}/repurchase_samples")
    gold.write_tables(spark.read.parquet(f"{where}/user_events"), spark.read.parquet(f"{where}/repurchase_samples"), where)
    return where, {n: spark.read.parquet(f"{where}/{n}").count() for n in ("users", "user_events", "repurchase_samples", *gold.TABLES)}


def ingest_folder(store: Store, folder: str, modulus: int = 1, residue: int = 0, replace: bool = False, year: int = ingest.EVENT_YEAR) -> dict:
    """Ingests a folder of contracted files: decides, opens a ledger row, writes a run, publishes it and closes the row.

    A failure is recorded with its category, and what was published before stays. The judged rows of the files stand in
    a stage of the run until it has ended.
    """
    ingest.check_sampling(modulus, residue)
    sha256 = fingerprint(store.spark, folder)
    decision = store.decide(sha256, modulus, residue, replace).head()
    if decision["action"] == SKIP:
        return {"action": SKIP, "run_id": decision["run_id"]}
    if decision["action"] == REFUSE:
        raise ingest.IngestError("existing", "other data is published; replace it explicitly")
    run = store.open(folder.rstrip("/").rpartition("/")[2], sha256, modulus, residue)
    stage = f"{store.root}/stage/run-{run['run_id']}"
    try:
        silver = ingest.read_silver(store.spark, folder, modulus, residue, year).staged(stage)
        where, counts = write_run(store, run, silver)
        imported = sum(counts[n] for n in ("users", "user_events", "repurchase_samples"))
        store.succeed(run, sum(o.get["rows"] for o in silver.raw_counts.values()), imported, where)
    except Exception as e:
        store.fail(run, getattr(e, "category", "other"), str(e))
        raise
    finally:
        remove(store.spark, stage)
    return {"action": IMPORT, "run_id": run["run_id"], "counts": counts}
