"""RunStore: evaluation results as partitioned Parquet tables with one commit log.

``records`` and ``feedbacks`` are partitioned by (dataset, recipe, commit),
``runs`` by (recipe, commit) and ``chunks`` by (bucket, commit), so a
recipe/dataset filter prunes directories before any file is opened.

Rows are written under the id of their commit and show once the commit has
its entry in ``commits``: one small file, written last, whose creation
either succeeds or does not. Readers join on it, so what a stopped writer
left behind never shows, and tables written in one ``commit()`` show
together. An entry may also name partitions that it replaces: rows of
earlier commits there no longer show. ``reset``, ``replace_feedbacks`` and
``upsert_chunks`` are such entries; files of other partitions keep their
names. ``clean`` deletes files that cannot show any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT = T.StructType([T.StructField("page_content", T.StringType()), T.StructField("metadata", T.StringType())])
CALL = T.StructType(
    [
        T.StructField("reason", T.StringType()),
        T.StructField("reasons", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("contexts", T.ArrayType(CONTEXT)),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("error", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("recipe", T.StringType()),
    ]
)
FEEDBACKS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("result", T.DoubleType()),
        T.StructField("calls", T.ArrayType(CALL)),
        T.StructField("last_ts", T.TimestampNTZType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("recipe", T.StringType()),
    ]
)
RUNS = T.StructType(
    [
        T.StructField("recipe", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)
#: What the partitions of each table are named by, besides the commit.
PARTS = {"records": ("dataset", "recipe"), "feedbacks": ("dataset", "recipe"), "runs": ("recipe",), "chunks": ("bucket",)}
#: An entry of the log.
COMMIT = T.StructType(
    [
        T.StructField("commit", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField(
            "replaced",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("table", T.StringType()),
                        T.StructField("dataset", T.StringType()),
                        T.StructField("recipe", T.StringType()),
                        T.StructField("bucket", T.IntegerType()),
                    ]
                )
            ),
        ),
    ]
)
#: Chunk buckets of a new store.
BUCKETS = 64


class Commit:
    """Rows written here show together, once the ``commit()`` block ends well."""

    def __init__(self, store: RunStore) -> None:
        self.store, self.id = store, f"c{uuid.uuid4().hex}"
        self.replaced: list[dict] = []

    def _append(self, df: DataFrame, table: str, schema: T.StructType | None = None, buckets: int | None = None, lie: bool = False) -> None:
        if schema is not None:
            df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        parts = PARTS[table]
        # rows of a partition meet in as few tasks as their size asks for: few
        # files, no hot task; unless they ``lie`` together as read from files
        packed = (df if lie else df.hint("rebalance", *parts)).withColumn("commit", F.lit(self.id))
        path = self.store.path(table) if buckets is None else self.store.bucket_path(buckets)
        packed.write.mode("append").partitionBy(*parts, "commit").parquet(path)

    def write_records(self, df: DataFrame) -> None:
        self._append(df, "records", RECORDS)

    def write_feedbacks(self, df: DataFrame, lie: bool = False) -> None:
        self._append(df, "feedbacks", FEEDBACKS, lie=lie)

    def write_runs(self, df: DataFrame) -> None:
        self._append(df, "runs", RUNS)

    def replace(self, table: str, **part) -> None:
        """Rows that earlier commits wrote to this partition of ``table`` show no longer."""
        self.replaced.append({"table": table, **part})


class RunStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # ------------------------------------------------------------ paths / fs
    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> bool:
        fs, p = self._fs(path)
        return bool(fs.delete(p, True))

    def _sub_folders(self, path: str, column: str) -> list[tuple[str, str]]:
        """(value, folder) of the ``column=value`` folders under ``path``."""
        if not self._exists(path):
            return []
        fs, p = self._fs(path)
        found = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith(column + "="):
                found.append((unquote(name[len(column) + 1 :]), st.getPath().toString()))
        return found

    # ------------------------------------------------------------ log
    def log(self) -> DataFrame:
        """(commit, seq, replaced) of every commit; ``seq`` is their order."""
        path = self.path("commits")
        if not self._exists(path):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(path)

    @contextmanager
    def commit(self) -> Iterator[Commit]:
        own = Commit(self)
        yield own
        self._enter(own)

    def _enter(self, commit: Commit) -> int:
        """Write the log entry under the next free number; a writer that was faster leaves the one after."""
        fs, folder = self._fs(self.path("commits"))
        fs.mkdirs(folder)
        seq = max((int(st.getPath().getName().split(".")[0]) for st in fs.listStatus(folder) if st.getPath().getName()[0].isdigit()), default=-1)
        while True:
            seq += 1
            _, path = self._fs(f"{self.path('commits')}/{seq:012d}.json")
            try:
                out = fs.create(path, False)
            except Py4JJavaError:
                if not fs.exists(path):
                    raise
                continue
            out.write(bytearray((json.dumps({"commit": commit.id, "seq": seq, "replaced": commit.replaced}) + "\n").encode()))
            out.close()
            return seq

    def visible(self, rows: DataFrame, table: str) -> DataFrame:
        """``rows`` of a table, with their ``commit``, that are committed and not replaced; adds ``seq``."""
        log = self.log()
        parts = PARTS[table]
        replaced = log.select("seq", F.explode("replaced").alias("r")).where(F.col("r.table") == table)
        since = replaced.groupBy(*[F.col(f"r.{p}").alias(f"_{p}") for p in parts]).agg(F.max("seq").alias("_since"))
        same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts])
        shown = rows.join(log.select("commit", "seq"), "commit").join(since, same, "left")
        return shown.where(F.col("_since").isNull() | (F.col("seq") >= F.col("_since"))).drop("_since", *[f"_{p}" for p in parts])

    # ------------------------------------------------------------ reads
    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        path = self.path(table)
        with_commit = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
        if not self._exists(path):
            return self.spark.createDataFrame([], T.StructType([*with_commit.fields, T.StructField("seq", T.LongType())]))
        return self.visible(self.spark.read.schema(with_commit).option("basePath", path).parquet(path), table)

    def records(self, commits: DataFrame | None = None) -> DataFrame:
        """All records, or those of the given commits (a frame with ``commit``)."""
        rows = self._read("records", RECORDS)
        if commits is not None:
            rows = rows.join(commits.select("commit"), "commit", "left_semi")
        return rows.select(*RECORDS.names)

    def feedbacks(self) -> DataFrame:
        return self._read("feedbacks", FEEDBACKS).select(*FEEDBACKS.names)

    def runs(self) -> DataFrame:
        """One row for each recipe and dataset: that of the last commit."""
        rows = self._read("runs", RUNS).groupBy("recipe", "dataset").agg(F.max_by(F.struct("metadata"), F.struct("seq", "metadata")).alias("r"))
        return rows.select("recipe", "dataset", "r.metadata")

    def recipes(self) -> DataFrame:
        return self.runs().select("recipe").distinct()

    def datasets_and_metadata(self, recipe: str) -> DataFrame:
        return self.runs().where(F.col("recipe") == recipe).select("dataset", "metadata")

    def metric_names(self, recipe: str) -> DataFrame:
        return self.feedbacks().where(F.col("recipe") == recipe).select("name").distinct()

    # ------------------------------------------------------------ writes
    def write_records(self, df: DataFrame) -> None:
        with self.commit() as c:
            c.write_records(df)

    def write_feedbacks(self, df: DataFrame) -> None:
        with self.commit() as c:
            c.write_feedbacks(df)

    def write_runs(self, df: DataFrame) -> None:
        with self.commit() as c:
            c.write_runs(df)

    def replace_feedbacks(
        self, df: DataFrame, partitions: Sequence[tuple[str | None, str | None]], untouched: DataFrame | None = None
    ) -> None:
        """The whole new content of the feedback partitions (dataset, recipe)
        named, in one step. ``untouched`` are rows of it as ``feedbacks()``
        reads them: they are written from where they lie, without a shuffle."""
        with self.commit() as c:
            c.write_feedbacks(df)
            if untouched is not None:
                c.write_feedbacks(untouched, lie=True)
            for dataset, recipe in partitions:
                c.replace("feedbacks", dataset=dataset, recipe=recipe)

    def _recipe_folders(self, recipe: str) -> list[tuple[str, str | None, str]]:
        """(table, dataset, folder) of a recipe's records, feedbacks and runs. Names are compared decoded: no character is special."""
        found = []
        for table in ("records", "feedbacks"):
            for dataset, parent in self._sub_folders(self.path(table), "dataset"):
                found += [(table, dataset, folder) for value, folder in self._sub_folders(parent, "recipe") if value == recipe]
        return found + [("runs", None, folder) for value, folder in self._sub_folders(self.path("runs"), "recipe") if value == recipe]

    def reset(self, recipe: str) -> int:
        """Remove every record, feedback and run row of exactly ``recipe``
        (all datasets): one log entry hides them, then their folders go and
        nothing is rewritten. Returns the number of record and feedback
        folders deleted."""
        folders = self._recipe_folders(recipe)
        if folders:
            with self.commit() as c:
                for table, dataset, _ in folders:
                    null = dataset is None or dataset == "__HIVE_DEFAULT_PARTITION__"
                    c.replace(table, recipe=recipe, **({} if null else {"dataset": dataset}))
        removed = 0
        for table, _, folder in folders:
            removed += self._delete(folder) and table != "runs"
        return removed

    def clean(self, older_than: float = 86_400.0) -> int:
        """Delete files that cannot show: of commits without an entry that
        are older than ``older_than`` seconds, and of replaced ones. Returns
        the number of folders deleted."""
        import time

        log = self.log().collect()  # an entry for each append
        seq = {r["commit"]: r["seq"] for r in log}
        since: dict[tuple, int] = {}
        for r in log:
            for x in r["replaced"] or []:
                key = (x["table"], *(x[p] for p in PARTS[x["table"]]))
                since[key] = max(since.get(key, -1), r["seq"])
        gone = 0
        for table, parts in PARTS.items():
            pattern = "/".join([self.path(table), *(["buckets=*"] if table == "chunks" else []), *[f"{p}=*" for p in parts], "commit=*"])
            fs, p = self._fs(pattern)
            for st in fs.globStatus(p) or []:
                names = [unquote(x.partition("=")[2]) for x in st.getPath().toString().split("/")[-1 - len(parts) :]]
                values = [None if v == "__HIVE_DEFAULT_PARTITION__" else int(v) if q == "bucket" else v for v, q in zip(names, parts)]
                entered = seq.get(names[-1])
                stale = entered is None and time.time() - st.getModificationTime() / 1000 > older_than
                if stale or entered is not None and entered < since.get((table, *values), -1):
                    gone += self._delete(st.getPath().toString())
        return gone

    def export_results(self, df: DataFrame, path: str) -> None:
        """Records with their scores as JSON lines, one folder per dataset."""
        df.write.mode("overwrite").partitionBy("dataset").json(path)

    # ------------------------------------------------------------ chunks
    def bucket_path(self, buckets: int) -> str:
        return f"{self.path('chunks')}/buckets={buckets}"

    def _buckets(self) -> int | None:
        return next((int(n) for n, _ in self._sub_folders(self.path("chunks"), "buckets")), None)

    def chunks(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """All chunks, or those of the given buckets; None before the first upsert."""
        n = self._buckets()
        if n is None or not self._sub_folders(self.bucket_path(n), "bucket"):
            return None
        rows = self.spark.read.option("basePath", self.bucket_path(n)).parquet(self.bucket_path(n))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(list(buckets)))
        return self.visible(rows, "chunks").drop("commit", "seq", "bucket")

    def upsert_chunks(self, new: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> int:
        """Replace the chunks of every document in ``new``, keep the rest.

        The table is dealt to buckets by a hash of the document; only the
        buckets of new documents are read and written again, and one log
        entry switches them over. ``buckets`` counts for a new table.
        Returns the number of upserts before this one."""
        from evalflow.operators.ingest import upsert_chunks

        n = self._buckets() or buckets
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
        touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most n numbers
        done = self.log().where(F.exists("replaced", lambda r: r["table"] == "chunks")).count()
        current = self.chunks(touched)
        merged = new if current is None else upsert_chunks(current, new, key)
        with self.commit() as c:
            c._append(merged.withColumn("bucket", bucket), "chunks", buckets=n)
            for b in touched:
                c.replace("chunks", bucket=b)
        return done
