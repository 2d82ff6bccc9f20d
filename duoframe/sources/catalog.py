"""File catalogue: listing, name classification, pairing, layout and request reports (A1 to A10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_tiff, stem
from ..session import attach, pin


def list_raw_files(spark: SparkSession, root: str) -> DataFrame:
    """A2: raw TIFF files below root; only names and sizes are read, never the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    return (
        files.select("path", "length", F.col("modificationTime").alias("mtime"))
        .withColumn("basename", F.element_at(parts, -1))
        .withColumn("sample", F.element_at(parts, -2))
        .filter(is_tiff(F.col("basename")))
        .select("path", "sample", "basename", "length", "mtime")
    )


def classify_files(files: DataFrame) -> DataFrame:
    """A4: kind and dye of each TIFF file, or the code of its naming defect.

    The stain marker is a substring test, in this order of checks.
    """
    s = stem(F.col("basename"))
    low = F.lower(s)
    pre, post = F.contains(low, F.lit("pre")), F.contains(low, F.lit("post"))
    dye = F.substring_index(s, "_", -1)
    code = (
        F.when(pre & post, "AMBIGUOUS")
        .when(~pre & ~post, "NO STAIN MARKER")
        .when(~F.contains(s, F.lit("_")), "NO UNDERSCORE")
        .when(dye == "", "EMPTY DYE")
    )
    return files.filter(is_tiff(F.col("basename"))).select(
        "*", code.alias("code"), F.when(code.isNull(), F.when(pre, "pre").otherwise("post")).alias("kind"),
        F.when(code.isNull(), dye).alias("dye"),
    )


def name_warnings(classified: DataFrame) -> DataFrame:
    """Readable defect of each file that could not be classified."""
    text = (
        F.when(F.col("code") == "AMBIGUOUS", "name holds both 'pre' and 'post'")
        .when(F.col("code") == "NO STAIN MARKER", "name holds neither 'pre' nor 'post'")
        .when(F.col("code") == "NO UNDERSCORE", "name must end in _<dye>.tif or _<dye>.tiff")
        .otherwise("nothing follows the last underscore")
    )
    return classified.filter("code is not null").select("sample", "path", "code", text.alias("message"))


def group_pairs(classified: DataFrame) -> DataFrame:
    """A5: one row per (sample, dye): how many files per side, and the first path of each."""
    side = lambda k: F.col("kind") == k
    return classified.filter("code is null").groupBy("sample", "dye").agg(
        F.count_if(side("pre")).alias("n_pre"), F.count_if(side("post")).alias("n_post"),
        F.min(F.when(side("pre"), F.col("path"))).alias("pre_path"),
        F.min(F.when(side("post"), F.col("path"))).alias("post_path"),
        F.min_by("length", F.when(side("post"), F.col("path"))).alias("post_length"),
    )


def pair_members(classified: DataFrame) -> DataFrame:
    """A5: every file of every pair in long form with the counts of its pair.

    Candidate lists stay rows, so a pair with very many duplicates is no large array.
    """
    good = classified.filter("code is null")
    counts = group_pairs(classified).select("sample", "dye", "n_pre", "n_post")
    return good.select("sample", "dye", "kind", "path").join(counts, ["sample", "dye"])


def pair_state(pairs: DataFrame) -> DataFrame:
    """Ok, incomplete or duplicate, with the reason."""
    n_pre, n_post = F.col("n_pre"), F.col("n_post")
    incomplete, duplicate = (n_pre == 0) | (n_post == 0), (n_pre > 1) | (n_post > 1)
    missing = F.when(n_pre == 0, "pre-stain").otherwise("post-stain")
    # Fixed formats: reason texts.
    reason = F.when(
        incomplete, F.format_string("incomplete pair — %s file is missing (found %d pre, %d post)", missing, n_pre, n_post)
    ).when(
        duplicate, F.format_string("duplicate files — found %d pre and %d post for this dye, expected 1+1", n_pre, n_post)
    )
    return pairs.withColumn(
        "state", F.when(incomplete, "incomplete").when(duplicate, "duplicate").otherwise("ok")
    ).withColumn("reason", reason)


def complete_dyes(pairs: DataFrame) -> DataFrame:
    """Dyes that occur in at least one complete pair."""
    return pair_state(pairs).filter("state <> 'incomplete'").select("dye").distinct()


def layout_report(roots: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """Verdict on each raw folder.

    roots: root, exists, is_dir. entries: root, name, is_dir (direct children).
    files: root, subdir, basename (files inside the subfolders).
    """
    visible = entries.filter(~F.col("name").startswith("."))
    n = visible.groupBy("root").agg(
        F.count("*").alias("n_entries"), F.count_if("is_dir").alias("n_subdirs"),
        F.count_if(is_tiff(F.col("name")) & ~F.col("is_dir")).alias("n_loose"),
    )
    filled = (
        files.filter(is_tiff(F.col("basename"))).select("root", F.col("subdir").alias("name")).distinct()
        .join(visible.filter("is_dir").select("root", "name"), ["root", "name"], "left_semi")
        .groupBy("root").agg(F.count("*").alias("n_filled"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = roots.join(n, "root", "left").join(filled, "root", "left").select(
        "root", "exists", "is_dir", zero("n_entries"), zero("n_subdirs"), zero("n_loose"), zero("n_filled")
    )
    code = (
        F.when(~F.col("exists"), "missing").when(~F.col("is_dir"), "not a directory")
        .when(F.col("n_entries") == 0, "empty")
        .when((F.col("n_loose") > 0) & (F.col("n_subdirs") == 0), "loose files only")
        .when((F.col("n_subdirs") > 0) & (F.col("n_filled") == 0), "no files in subfolders")
        .when(F.col("n_loose") > 0, "loose files ignored").otherwise("ok")
    )
    return out.select(
        "root", "n_subdirs", "n_loose", (F.col("n_subdirs") - F.col("n_filled")).alias("n_empty_subdirs"),
        code.alias("code"), code.isin("ok", "loose files ignored").alias("ok"),
    )


def layout_entries(entries: DataFrame, files: DataFrame) -> DataFrame:
    """The children of each raw folder with their role."""
    filled = files.filter(is_tiff(F.col("basename"))).select("root", F.col("subdir").alias("name")).distinct().withColumn(
        "_filled", F.lit(True)
    )
    role = (
        F.when(F.col("is_dir") & F.col("_filled").isNotNull(), "subdir")
        .when(F.col("is_dir"), "empty_subdir").when(is_tiff(F.col("name")), "loose_tiff").otherwise("other")
    )
    return entries.filter(~F.col("name").startswith(".")).join(filled, ["root", "name"], "left").select(
        "root", "name", role.alias("role")
    )


def request(samples: DataFrame, dyes: Sequence[str]) -> DataFrame:
    """Requested tasks: every sample with every dye of the argument list."""
    return samples.select("sample").distinct().withColumn("dye", F.explode(F.array(*[F.lit(d) for d in dyes])))


def resolve_request(requested: DataFrame, pairs: DataFrame, folders: DataFrame, raw_dir: str = "raw") -> DataFrame:
    """Requested (sample, dye) rows with state present or skipped and the reason.

    folders lists the samples that have a folder. The joins follow the measured sizes.
    """
    dyes = pairs.groupBy("sample").agg(F.array_join(F.array_sort(F.collect_set("dye")), ", ").alias("_dyes"))
    known = pair_state(pairs).select("sample", "dye", "state", F.col("reason").alias("_why"))
    folder = F.concat(F.lit(f"{raw_dir}/"), "sample")
    out = (
        requested.join(folders.select("sample").distinct().withColumn("_has", F.lit(True)), "sample", "left")
        .join(dyes, "sample", "left").join(known, ["sample", "dye"], "left")
    )
    # Fixed formats: reason texts.
    reason = (
        F.when(F.col("_has").isNull(), F.format_string("sample directory '%s' does not exist", folder))
        .when(F.col("_dyes").isNull(), F.format_string("no validly-named raw files in '%s'", folder))
        .when(F.col("state").isNull(), F.format_string("no '%s' files in this sample (dyes present: %s)", F.col("dye"), F.col("_dyes")))
        .otherwise(F.col("_why"))
    )
    return out.select("sample", "dye", reason.alias("reason")).withColumn(
        "status", F.when(F.col("reason").isNull(), "present").otherwise("skipped")
    )


class RequestError(ValueError):
    """Requested pairs that cannot run."""


def enforce(resolved: DataFrame, strict: bool = True, shown: int = 20) -> DataFrame:
    """Present tasks; in strict mode any skipped task is an error that names the first ones."""
    if strict:
        skipped = resolved.filter("status = 'skipped'")
        sample = skipped.orderBy("sample", "dye").limit(shown).collect()
        if sample:
            total = skipped.count()
            lines = "\n".join(f"  {r['sample']} / {r['dye']}: {r['reason']}" for r in sample)
            raise RequestError(f"{total} of the requested pairs cannot run:\n{lines}")
    return resolved.filter("status = 'present'").select("sample", "dye")


def load_pairs_and_frames(spark: SparkSession, tasks: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10: pixels (sample, dye, kind, r, c, v) of exactly one pre and one post file per task, and their frames.

    frames: sample, dye, kind, path, height, width, error; with px it is what run_batch takes. A file that cannot
    be read has an error and no pixels, the others are not affected.
    """
    from .rasters import decode_frames

    ok = pair_state(pairs).filter("state = 'ok'").join(tasks, ["sample", "dye"], "left_semi")
    paths = pin(ok.select("sample", "dye", F.explode(F.array(
        F.struct(F.lit("pre").alias("kind"), F.col("pre_path").alias("path")),
        F.struct(F.lit("post").alias("kind"), F.col("post_path").alias("path")),
    )).alias("f")).select("sample", "dye", "f.kind", "f.path"))
    px, frames = decode_frames(spark, paths)
    return attach(px, paths, ["path"], "inner").drop("path"), paths.join(frames, "path")


def load_pairs(spark: SparkSession, tasks: DataFrame, pairs: DataFrame) -> DataFrame:
    """A10: the pixels alone."""
    return load_pairs_and_frames(spark, tasks, pairs)[0]
