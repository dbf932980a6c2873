"""Loads that remember: a sync that skips what it has, and phases that are skipped, resumed and recorded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.sources.tables import materialised, spread
from quillon.sources.versions import VersionedTable

#: A range of the ledger holds two to this many posts.
BITS = 20
#: A block of posts that a task writes, two to this many.
BLOCK = 15
SYNCED = "post long, kind string, name string, sync int, range long"


def ledger(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, partition_by="range")


def sync(table: VersionedTable, rows: DataFrame, marks: Iterable[str] = ("exposure",)) -> dict:
    """Add the (post, kind, name) of posts that no earlier sync has taken in, and tell what was mapped and skipped.

    A post counts as taken in once it has a row of a kind in `marks`. As the default has it, a post that has conditions
    but no exposure is never marked, so each sync adds its conditions again; with both kinds it is added once.
    Repeated rows of a sync are one; rows without a post are left out. Of the ledger only the ranges between the least
    and the largest post of the rows are read. Tasks hold a number of rows that does not grow with them; what is added
    is written by blocks of posts, so that a range is a few files.
    """
    schema = StructType.fromDDL(SYNCED)
    rows = materialised(rows.where("post is not null").select(F.col("post").cast("long").alias("post"), "kind", "name").distinct(), "sync")
    span = rows.agg(F.min("post").alias("low"), F.max("post").alias("high")).first()
    m = table.manifest()
    number = m["note"].get("sync", 0) + 1
    if span["low"] is None:
        return {"sync": number - 1, "mapped": 0, "skipped": 0}
    old = table.read(m["version"] or None, schema).where(F.col("range").between(span["low"] >> BITS, span["high"] >> BITS))
    n = rows.count() + (old.count() if m["parts"] else 0)
    seen = spread(old.where(F.col("kind").isin(list(marks))).select("post"), n, "post").distinct().withColumn("seen", F.lit(True))
    told = spread(rows, n, "post").join(seen, "post", "left")
    posts = told.groupBy("post").agg(F.max("seen").alias("seen")).agg(F.count_if(F.col("seen").isNull()).alias("mapped"), F.count_if("seen").alias("skipped")).first()
    new = told.where("seen is null").select("post", "kind", "name", F.lit(number).alias("sync"), F.shiftright("post", BITS).alias("range"))
    done = {"sync": number, "mapped": posts["mapped"], "skipped": posts["skipped"]}
    table.append(spread(new, n, F.shiftright("post", BLOCK)), done)
    return done


@dataclass(frozen=True)
class Phase:
    """A table that is made of files and of earlier phases; `code` changes when what `make` does changes."""

    name: str
    make: Callable[[Callable[[str], DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    code: str = "1"


def files_digest(spark: SparkSession, path: str) -> str:
    """Changes when a file under the path comes, goes or is rewritten; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = files.select(F.xxhash64("path", "length", "modificationTime").alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{one['n']}:{one['x']}:{one['s']}"


_LOG = "run int, phase string, status string, n long, error string"


def run_phases(spark: SparkSession, folder: str, phases: list[Phase], skip: Iterable[str] = ()) -> list[dict]:
    """Run the phases in order, each a versioned table of the folder, and record what became of each.

    `kept`: made before of the same files, the same earlier phases and the same code; `skipped`: as asked for, later
    phases read its last version; `failed`: its last version stays in force, and the phases after it are `not run`.
    Run again, a load goes on at the phase that failed. The digest is part of the version's note, so a phase is never
    taken for done without its rows.
    """
    tables = {p.name: VersionedTable(spark, f"{folder}/{p.name}") for p in phases}
    read = lambda name: tables[name].read()
    digests: dict[str, str] = {}
    told: list[dict] = []
    broken = False
    for p in phases:
        row = {"phase": p.name, "status": "not run", "n": None, "error": None}
        told.append(row)
        if broken:
            continue
        note = tables[p.name].manifest()["note"]
        if p.name in set(skip):
            row["status"], digests[p.name] = "skipped", note.get("digest", "")
            continue
        try:
            parts = [p.name, p.code, *(files_digest(spark, i) for i in p.inputs), *(digests[n] for n in p.needs)]
            digests[p.name] = hashlib.sha256(json.dumps(parts).encode()).hexdigest()
            if note.get("digest") == digests[p.name]:
                row.update(status="kept", n=note["n"])
                continue
            made = _counted_write(tables[p.name], p.make(read), digests[p.name])
            row.update(status="done", n=made)
        except Exception as e:  # whatever a phase raises is its record
            row.update(status="failed", error=f"{type(e).__name__}: {e}"[:500])
            broken = True
    log = VersionedTable(spark, f"{folder}/_runs")
    run = log.manifest()["note"].get("run", 0) + 1
    log.append(spark.createDataFrame([(run, r["phase"], r["status"], r["n"], r["error"]) for r in told], _LOG).coalesce(1), {"run": run})
    return told


def _counted_write(table: VersionedTable, rows: DataFrame, digest: str) -> int:
    seen = Observation()
    note: dict = {}

    def noted() -> dict:
        note.update(digest=digest, n=seen.get.get("n", 0))
        return note

    table.write(rows.observe(seen, F.count(F.lit(1)).alias("n")), noted)
    return note["n"]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The record of all runs of a load."""
    return VersionedTable(spark, f"{folder}/_runs").read()
