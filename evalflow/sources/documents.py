"""Source documents: listing and loading the files of one or more datasets.

A dataset's files are those of its folder whose names do not begin with a
dot. Spark's readers also hide names that begin with ``_``; these are found
by the Hadoop file system's own listing (names alone reach the driver) and
read in tasks through pyarrow's file systems.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _globs(folders: Sequence[str], pattern: str) -> list[str]:
    return [f"{f.rstrip('/')}/{pattern}" for f in folders]


def underscore_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """(path): the files of the folders whose names begin with ``_``, each once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = set()
    for pattern in _globs(folders, "_*"):
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = p.getFileSystem(conf)
        found |= {st.getPath().toUri().toString() for st in fs.globStatus(p) or [] if st.isFile()}
    return spark.createDataFrame([(x,) for x in sorted(found)], "path string")


def _read_whole(paths: DataFrame) -> DataFrame:
    """(path, text) of whole files, read one at a time where the task runs."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                with system.open_input_stream(name) as f:
                    text = f.read().decode(errors="replace")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string())], names=["path", "text"])

    return paths.mapInArrow(run, "path string, text string")


def _uri(path: str) -> F.Column:
    """One spelling of local paths: file:///name."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def load_documents(spark: SparkSession, folders: Sequence[str], pattern: str = "[!._]*") -> DataFrame:
    """One row per source file over the given dataset folders (not
    recursive; dot files excluded), de-duplicated by path when folders
    overlap: doc_id (= path), path, text (whole file). A ``pattern`` of
    one's own takes what it matches; the default takes all files, those
    whose names begin with ``_`` included."""
    raw = spark.read.option("recursiveFileLookup", False).option("ignoreMissingFiles", True)
    docs = raw.text(_globs(folders, pattern), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if pattern == "[!._]*":
        docs = docs.unionByName(_read_whole(underscore_files(spark, folders)))
    docs = docs.withColumn("path", _uri("path"))
    return docs.dropDuplicates(["path"]).select(F.col("path").alias("doc_id"), "path", "text")


def list_sources(spark: SparkSession, folders: Sequence[str], pattern: str = "[!._]*") -> DataFrame:
    """Distinct source file paths (no contents read) for ingest functions."""
    files = spark.read.format("binaryFile").load(_globs(folders, pattern)).select("path")
    if pattern == "[!._]*":
        files = files.unionByName(underscore_files(spark, folders))
    return files.distinct()
