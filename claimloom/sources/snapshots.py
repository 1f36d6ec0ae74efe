"""A store of derived tables that is brought up to date unit by unit, in generations that are switched at once.

A unit (a group of evidence, a claim) has a fingerprint of all that its rows are derived from. update() compares the
fingerprints with those of the last generation, has only the units that changed computed, and writes their rows and a new
manifest into folders of their own; rows of other units stay where they are. Last a file names the generation: readers see
the old tables until it is there, and a run that dies before leaves folders that nobody reads. If no unit has changed and
none is gone, nothing is written. One writer at a time: a second one of the same generation is an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.scratch import settle

MANIFEST = "unit string, h_1 long, h_2 long, n long, run string"


@dataclass(frozen=True)
class Update:
    generation: int
    touched: int
    gone: int


def fingerprints(rows: DataFrame, unit: str) -> DataFrame:
    """unit, h_1, h_2, n of rows in any order: sums of two hashes of each row wrap around, as equal rows must not cancel out."""
    of = [c for c in rows.columns if c != unit]
    # of 64-bit hashes by halves, modulo 2**62
    half = lambda h: F.struct(F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(2**32 - 1))).alias("low"))
    within = lambda t: F.pmod(t["high"] + F.shiftright(t["low"], 32), F.lit(2**30)) * F.lit(2**32) + t["low"].bitwiseAND(F.lit(2**32 - 1))
    hashed = rows.select(F.col(unit).cast("string").alias("unit"), F.xxhash64(*of).alias("a"), F.xxhash64(F.lit("second"), *reversed(of)).alias("b"))
    sums = hashed.groupBy("unit").agg(half(F.col("a")).alias("a"), half(F.col("b")).alias("b"), F.count(F.lit(1)).alias("n"))
    return sums.select("unit", within(F.col("a")).alias("h_1"), within(F.col("b")).alias("h_2"), "n")


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> dict[int, str]:
        """run of each generation that is complete."""
        path, fs = self._path("generations")
        if not fs.exists(path):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return {int(number): run for number, run in (n.split("-", 1) for n in names if n[0].isdigit())}

    def generation(self) -> int:
        return max(self._commits(), default=0)

    def manifest(self) -> DataFrame:
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{commits[max(commits)]}")

    def read(self, table: str) -> DataFrame:
        """The rows of the last generation, each unit's from the run that computed it."""
        valid = self.manifest().select("unit", "run")
        runs = [r.run for r in valid.select("run").distinct().collect()]  # a row for each generation that is still used
        paths = [f"{self.folder}/tables/{table}/run={run}" for run in runs]
        if not paths:
            raise FileNotFoundError(f"{self.folder}: no generation is complete")
        rows = self.spark.read.option("basePath", f"{self.folder}/tables/{table}").parquet(*paths)
        return rows.withColumn("run", F.col("run").cast("string")).join(valid, ["unit", "run"], "left_semi").drop("unit", "run")

    def update(self, now: DataFrame, compute: Callable[[DataFrame], dict[str, DataFrame]]) -> Update:
        """now: fingerprints. compute: from a table of units, tables with a column unit, with the rows of these units only."""
        commits = self._commits()
        last = max(commits, default=0)
        old = self.manifest().select(*[F.col(c).alias(f"old_{c}") for c in ("unit", "h_1", "h_2", "n", "run")])
        same = F.col("unit").eqNullSafe(F.col("old_unit")) & (F.col("h_1") == F.col("old_h_1")) & (F.col("h_2") == F.col("old_h_2")) & (F.col("n") == F.col("old_n"))
        # full outer on the unit, so that each is new, changed, the same or gone
        met = now.join(old, F.col("unit").eqNullSafe(F.col("old_unit")), "full")
        state = F.when(F.col("n").isNull(), "gone").when(F.coalesce(same, F.lit(False)), "same").otherwise("touched")
        met = settle(met.withColumn("state", state), "snapshot-units")
        count = {r.state: r.n for r in met.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
        if not count.get("touched") and not count.get("gone"):
            return Update(last, 0, 0)
        run = f"r{uuid.uuid4().hex}"
        for name, rows in compute(met.where("state = 'touched'").select("unit")).items():
            rows.write.parquet(f"{self.folder}/tables/{name}/run={run}")
        kept = met.where("state <> 'gone'").select("unit", "h_1", "h_2", "n", F.when(F.col("state") == "same", F.col("old_run")).otherwise(F.lit(run)).alias("run"))
        kept.write.parquet(f"{self.folder}/manifest/{run}")
        self._commit(last + 1, run)
        return Update(last + 1, count.get("touched", 0), count.get("gone", 0))

    def _commit(self, number: int, run: str) -> None:
        """The switch: a finished file gets its name at once."""
        folder, fs = self._path("generations")
        fs.mkdirs(folder)
        if number in self._commits():
            raise FileExistsError(f"{self.folder}: generation {number} is there already")
        draft, _ = self._path(f"generations/_{run}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"generation": number, "run": run}).encode()))
        out.close()
        named, _ = self._path(f"generations/{number:08d}-{run}")
        if not fs.rename(draft, named):
            raise OSError(f"{self.folder}: generation {number} could not be named")
