"""Exact dedup against a persistent digest index, bucketed and sorted by the digest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin, union_all, work_dir

# characters that equality ignores: space, tab, line feed, vertical tab, form feed, carriage return
IGNORED = " \t\n\x0b\f\r"


def digest(text) -> F.Column:
    """Lower-case sha256 of the text without white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), IGNORED, "").cast("binary"), 256)


class DigestIndex:
    """Digests of all texts kept so far, as a table in buckets sorted by digest.

    The files live in `path` (by default a new folder in the shared work folder). The number of
    buckets is stored with them: a later session reads it, whatever its own settings are, and
    another number is refused. New batches are matched by a sort-merge anti-join on the
    buckets, so the index itself is never shuffled.

    path/state has a row per generation (the last one counts), path/gen-N its files. Every
    batch appends a file per bucket; compact() writes them anew as one file per bucket.
    """

    def __init__(self, spark: SparkSession, id_type: str = "bigint", path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{work_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self.table = ""
        state = self._state() if path else None
        if state:
            self.generation, self.buckets, self.id_type = state
            if buckets and buckets != self.buckets:
                raise ValueError(f"the index in {path} has {self.buckets} buckets, not {buckets}")
            if path and id_type != self.id_type:
                raise ValueError(f"the index in {path} holds ids of type {self.id_type}, not {id_type}")
        else:
            self.generation, self.id_type = 0, id_type
            self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
            self._note()
        self._open()

    def _state(self) -> tuple[int, int, str] | None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/state").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        last = max(rows, key=lambda r: r["generation"])
        return last["generation"], last["buckets"], last["id_type"]

    def _note(self) -> None:
        row = [(self.generation, self.buckets, self.id_type)]
        self.spark.createDataFrame(row, "generation int, buckets int, id_type string").coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def _open(self) -> None:
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"create table {self.table} (digest string, keep_id {self.id_type}) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}/gen-{self.generation}'"
        )

    def _append(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("append").insertInto(self.table)

    def compact(self) -> None:
        """Write all files of a bucket as one. The old files stay until the folder is removed: a reader may hold them."""
        rows = self.spark.table(self.table)
        old = self.table
        self.generation += 1
        self._open()
        self._append(rows)
        self._note()
        self.spark.sql(f"drop table if exists {old}")

    def close(self) -> None:
        """Forget the table's name in this session; the files stay."""
        self.spark.sql(f"drop table if exists {self.table}")

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """Ingest a batch and return the rows that stay, with all their columns.

        The decisions are those of ingest_table(), in two batches. Rows meet their decision by digest, id and length
        together, so a frequent text is dealt out by its ids; repeated rows are first reduced
        to one within each task.
        """
        decided = self.ingest_table(docs, 2, id_col, text).filter("kept")
        name = lambda value, n, ident: F.concat_ws(":", value, n.cast("string"), F.coalesce(ident.cast("string"), F.lit("")), ident.isNull().cast("string"))
        kept = decided.select(name(F.col("text_sha256"), F.col("n_chars"), F.col("doc_id")).alias("digest_key"))
        own = F.coalesce(F.char_length(text), F.lit(0))
        key = "digest_key"
        while key in docs.columns:
            key += "_"
        rows = docs.withColumn(key, name(digest(text), own, F.col(id_col))).dropDuplicates([key])
        return rows.join(kept.withColumnRenamed("digest_key", key), key, "left_semi").drop(key)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """Decide every row of a batch, then append the digests that are new.

        Returns one row per row of docs: doc_id, keep_id (the row that stays for its digest),
        group_size (rows of the batch with that digest), kept, text_sha256, n_chars. Of equal texts in
        a batch the row with the most code points stays, then the smallest id; a null id comes
        last, and of wholly equal rows one stays. A text that the index holds already keeps
        the indexed row, so nothing of a later batch stays for it; the indexed row itself, met
        again when a batch is repeated after a failure, stays. Null counts as empty, and empty
        texts are equal. Other columns are not read.
        """
        rows = pin(docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
            F.coalesce(F.char_length(text), F.lit(0)).alias("n"), digest(text).alias("digest"),
        ))
        best = F.struct((-F.col("n")).alias("n"), F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
        winners = pin(rows.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("group_size")).select(
            "digest", "group_size", F.col("best.doc_id").alias("own_id"), F.col("best.row").alias("own_row")))
        index = self.spark.table(self.table)
        fresh = pin(winners.join(index.hint("merge"), "digest", "left_anti"))
        old = winners.join(index.hint("merge"), "digest").withColumn(
            "own_row", F.when(F.col("own_id").eqNullSafe(F.col("keep_id")), F.col("own_row")))
        chosen = fresh.withColumn("keep_id", F.col("own_id")).unionByName(old.select(*fresh.columns, "keep_id"))
        decided = pin(rows.join(chosen, "digest").select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("own_row"), F.lit(False)).alias("kept"),
            F.col("digest").alias("text_sha256"), F.col("n").alias("n_chars"),
        ))
        self._append(fresh.select("digest", F.col("own_id").alias("keep_id")))
        return decided

    def ingest_table(self, docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """Decide a whole table in several batches, the longest texts first.

        Returns what ingest() does; group_size counts the rows of the whole table. The row that
        stays for a digest is the longest, so it is in the first batch that holds the digest, and
        the anti-join against the index decides all later ones. The lengths that part the
        batches are approximate quantiles: any lengths give the same rows. Batches share no
        length, so ties meet in one.
        """
        length = F.coalesce(F.char_length(text), F.lit(0))
        cuts = docs.select(length.alias("n")).approxQuantile("n", [k / batches for k in range(1, batches)], 0.01)
        cuts = sorted({int(c) for c in cuts}, reverse=True)
        part = F.lit(len(cuts))
        for k in range(len(cuts) - 1, -1, -1):
            part = F.when(length > cuts[k], k).otherwise(part)
        done = [self.ingest(docs.filter(part == k), id_col, text) for k in range(len(cuts) + 1)]
        every = union_all(*done)
        sizes = every.groupBy("text_sha256").agg(F.count("*").alias("group_size"))
        return every.drop("group_size").join(sizes, "text_sha256").select(done[0].columns)
