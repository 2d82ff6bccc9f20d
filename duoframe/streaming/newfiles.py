"""New raw files only: a file stream that keeps the catalogue table up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import is_tiff
from ..sources.catalog import classify_files, group_pairs, pair_state

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
CATALOGUE = "path string, sample string, basename string, length bigint, code string, kind string, dye string"


def _named_files(spark: SparkSession, raw: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(raw)
    parts = F.split("path", "/")
    return files.select("path", "length").withColumn("basename", F.element_at(parts, -1)).withColumn(
        "sample", F.element_at(parts, -2)
    ).filter(is_tiff(F.col("basename")))


def follow_new_files(spark: SparkSession, raw: str, catalogue: str, checkpoint: str) -> StreamingQuery:
    """Classify the files that arrived since the last run and append them to the catalogue.

    The stream's checkpoint remembers what was seen, so a restart handles each file once;
    content is never read. Runs until all present files are handled.
    """
    named = _named_files(spark, raw)

    def append(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch: a repeated epoch after a failure replaces its own rows
        out = classify_files(batch).select("path", "sample", "basename", "length", "code", "kind", "dye")
        out.write.mode("overwrite").parquet(f"{catalogue}/epoch={epoch}")

    return named.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_catalogue(spark: SparkSession, catalogue: str) -> DataFrame:
    return spark.read.schema(CATALOGUE).parquet(catalogue)


def new_tasks(catalogue: DataFrame, results: DataFrame) -> DataFrame:
    """Complete pairs of the catalogue without a finished result."""
    done = results.filter("status = 'complete'").select("sample", "dye")
    ok = pair_state(group_pairs(catalogue)).filter("state = 'ok'").select("sample", "dye")
    return ok.join(done, ["sample", "dye"], "left_anti")


PAIR_STATE = "n_pre bigint, n_post bigint, pre_path string, post_path string, version int"
PAIR_EVENT = f"sample string, dye string, state string, {PAIR_STATE}"


def pair_events(classified: DataFrame) -> DataFrame:
    """I10 with state: one event whenever a pair of a stream of classified files becomes ok or duplicate.

    The state of a pair is two counts and the first path of each side, so it stays small however
    many files a pair has; files that are already in the state are never read again. A late
    file completes its pair in the run in which it comes, and a pair says each of its states
    once: version 1 when both sides are there, a later version when a second file makes it a
    duplicate. Files with a naming defect belong to no pair; incomplete pairs say nothing. A
    file seen twice counts twice, as in the catalogue.
    """

    def step(key: tuple, files: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n_pre, n_post, pre, post, version = state.get if state.exists else (0, 0, None, None, 0)
        before = _pair_name(n_pre, n_post)
        for pdf in files:
            is_pre = pdf["kind"] == "pre"
            n_pre, n_post = n_pre + int(is_pre.sum()), n_post + int((~is_pre).sum())
            pre = min([p for p in (pre, *pdf.loc[is_pre, "path"]) if p is not None], default=None)
            post = min([p for p in (post, *pdf.loc[~is_pre, "path"]) if p is not None], default=None)
        now = _pair_name(n_pre, n_post)
        said = now != before and now != "incomplete"
        version += said
        state.update((n_pre, n_post, pre, post, version))
        if said:
            yield pd.DataFrame([(*key, now, n_pre, n_post, pre, post, version)], columns=["sample", "dye", "state", "n_pre", "n_post", "pre_path", "post_path", "version"])

    good = classified.filter("code is null").select("sample", "dye", "kind", "path")
    return good.groupBy("sample", "dye").applyInPandasWithState(step, PAIR_EVENT, PAIR_STATE, "append", GroupStateTimeout.NoTimeout)


def _pair_name(n_pre: int, n_post: int) -> str:
    return "incomplete" if not (n_pre and n_post) else "duplicate" if max(n_pre, n_post) > 1 else "ok"


def write_pair_events(classified: DataFrame, events: str, checkpoint: str) -> StreamingQuery:
    """Handle all present files of a stream and write the events of their pairs, a folder per epoch."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{events}/epoch={epoch}")

    return pair_events(classified).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_pairs(spark: SparkSession, raw: str, events: str, checkpoint: str) -> StreamingQuery:
    """Events of the pairs that the raw files which came since the last run completed or doubled."""
    return write_pair_events(classify_files(_named_files(spark, raw)), events, checkpoint)


def current_pairs(spark: SparkSession, events: str) -> DataFrame:
    """The last state of every pair that has had both sides."""
    rows = spark.read.schema(PAIR_EVENT).parquet(events)
    last = F.max_by(F.struct("state", "n_pre", "n_post", "pre_path", "post_path", "version"), "version")
    return rows.groupBy("sample", "dye").agg(last.alias("_p")).select("sample", "dye", "_p.*")
