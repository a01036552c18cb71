"""Files as rows: what lies in a folder beside its sidecars, and moves that tasks do and a rerun skips."""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.publishing import read_sidecars
from ..streaming.live import shared_path

#: Bytes under which a sound file holds no sound.
LEAST_BYTES = 200


def listing(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, name, bytes) of the files of a folder and all below; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def _walked(folder: str, glob: str):
    """Folders -> (path, name, bytes) of their files, those below too; a folder given with a slash at its end, without those."""
    begin = _begin(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        hidden = re.compile(r"(^|/)(\.|_[^=/]*(/|$))")  # what Spark doesn't read either
        for batch in batches:
            for own in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(own.rstrip("/"), allow_not_found=True, recursive=not own.endswith("/")))
                shown = [x for x in found if x.type == fs.FileType.File and fnmatch.fnmatchcase(x.base_name, glob) and not hidden.search(x.path[len(root):])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([begin + x.path for x in shown], pa.string()), pa.array([x.base_name for x in shown], pa.string()), pa.array([x.size for x in shown], pa.int64()),
                ], ["path", "name", "bytes"])

    return run


def _begin(folder: str) -> str:
    """What stands before a file system's own paths in its locations."""
    whole, root = folder.rstrip("/"), fs.FileSystem.from_uri(folder)[1].rstrip("/")
    return whole[:-len(root)] if whole.endswith(root) else ""


def walked(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, name, bytes) of the files of a folder and all below, as listing(), but listed by tasks, which are dealt the folders
    that lie in it: a reader's listing takes a task a folder, and all files pass the driver. The driver sees those folders' names."""
    system, root = fs.FileSystem.from_uri(folder)
    folders = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory]
    tops = spark.createDataFrame([(x,) for x in [root.rstrip("/") + "/", *folders]], "folder string")
    return tops.repartition(_tasks(spark), "folder").mapInArrow(_walked(folder, glob), "path string, name string, bytes long")


def _tasks(spark: SparkSession) -> int:
    """Files are few bytes to Spark but much work: tasks by cores, not by bytes."""
    return 4 * spark.sparkContext.defaultParallelism


def _moved(source: str, target: str):
    begin = len(_begin(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(target)
        system.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for path, name, first in zip(*(c.to_pylist() for c in batch.columns)):
                there = f"{root}/{name}"
                if not first:
                    done.append("skipped")
                    continue
                at, new = system.get_file_info([path[begin:], there])
                if at.type == fs.FileType.NotFound:
                    done.append("moved")  # by an attempt of this task that was lost after its move
                elif new.type != fs.FileType.NotFound:
                    done.append("skipped")
                else:
                    system.move(path[begin:], there)
                    done.append("moved")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string())], ["path", "name", "state"])

    return run


def moved_flat(spark: SparkSession, source: str, glob: str, target: str, rename: Column | None = None) -> DataFrame:
    """(path, name, state): files below a folder, moved into one folder of the same file system, in tasks.

    A name that is there already is skipped, as are all but the first path of those that would get one name. The files are
    listed when this is called, into a table of their own, so a task that runs again is dealt the same ones. The rows
    must be written or cached once: each action moves what is still to be moved.
    """
    listed = shared_path(spark, "listing")
    walked(spark, source, glob).withColumn("name", F.col("name") if rename is None else rename).write.parquet(listed)
    files = spark.read.parquet(listed)
    firsts = files.groupBy("name").agg(F.min("path").alias("first"))
    rows = files.join(firsts, "name").select("path", "name", (F.col("path") == F.col("first")).alias("first"))
    return rows.repartition(_tasks(spark), "path").mapInArrow(_moved(source, target), "path string, name string, state string")


def _lines(folder: str):
    """Rows (name, line), those of a name together -> (name, lines): each name's lines as a file, which shows when it is whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        name = out = part = None
        n, done = 0, []

        def finish() -> None:
            if out is not None:
                out.close()
                system.move(part, posixpath.join(root, name))
                done.append((name, n))

        def collected() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["name", "lines"])

        for batch in batches:
            for own, line in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name:
                    finish()
                    name, n = own, 0
                    above = posixpath.dirname(posixpath.join(root, name))
                    if above not in made:
                        system.create_dir(above, recursive=True)
                        made.add(above)
                    part = posixpath.join(above, f".{uuid.uuid4().hex}")
                    out = system.open_output_stream(part)
                out.write(line.encode() + b"\n")
                n += 1
            yield collected()
            done.clear()
        finish()
        yield collected()

    return run


def write_lines(rows: DataFrame, folder: str, name: str = "name", line: str = "line") -> DataFrame:
    """(name, lines): the lines of each name as a file of that name below the folder, written line by line by tasks.

    Spark's own writer sets each file's rights by a process of its own where no native library is at hand, and its commit moves
    all files on the driver. The result does the writing and must be written or counted once.
    """
    named = rows.select(F.col(name).alias("name"), F.col(line).alias("line")).repartition(_tasks(rows.sparkSession), "name")
    return named.sortWithinPartitions("name").mapInArrow(_lines(folder), "name string, lines long")


def inventory_report(spark: SparkSession, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(scenario_id, bytes, duration_s, n_words, reasons): sound files and sidecars of a folder side by side, with all that
    is wrong with each; an orphaned sidecar has no bytes."""
    wavs = listing(spark, folder, "*.wav").select(F.regexp_replace("name", r"\.wav$", "").alias("scenario_id"), "bytes")
    cars = read_sidecars(spark, folder).withColumn("has_car", F.lit(True))
    both = wavs.join(cars, "scenario_id", "full_outer").withColumn("n_words", F.coalesce(F.size("words"), F.lit(0)))
    size, seconds, car = F.col("bytes"), F.col("duration_s"), F.coalesce("has_car", F.lit(False))
    broken = car & seconds.isNull() & F.col("words").isNull()
    checks = [
        (size.isNull(), F.lit("sidecar without sound")), (size < least_bytes, F.concat(F.lit("too small ("), size.cast("string"), F.lit(" bytes)"))),
        (~car, F.lit("no sidecar")), (broken, F.lit("sidecar unreadable")), (seconds <= 0, F.lit("no duration")),
        (car & (F.col("n_words") <= 0) & (seconds > 0), F.lit("no words in spite of a duration")),
    ]
    return both.select("scenario_id", "bytes", "duration_s", "n_words", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks])).alias("reasons"))
