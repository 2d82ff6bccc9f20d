"""Files, store, stream, parameters and whole runs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoframe.plans import params as P
from duoframe.plans import reports as B
from duoframe.plans.batch import Store, run_batch, run_pair, suffixes
from duoframe.sources import catalog as C
from duoframe.sources import rasters as R
from duoframe.sources import store as S
from duoframe.streaming.newfiles import current_pairs, follow_new_files, follow_pairs, new_tasks, read_catalogue


def write_tiff(path, rgb):
    """Uncompressed 8-bit RGB TIFF with one strip."""
    h, w, _ = rgb.shape
    data = rgb.astype(np.uint8).tobytes()
    tags = [
        (256, 3, 1, w), (257, 3, 1, h), (258, 3, 3, 8), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 0),
        (277, 3, 1, 3), (278, 3, 1, h), (279, 4, 1, len(data)),
    ]
    bits_at = 8 + 2 + 12 * len(tags) + 4
    tags = [(t, ty, n, bits_at if t == 258 else bits_at + 6 if t == 273 else v) for t, ty, n, v in tags]
    body = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags))
    body += b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0) + struct.pack("<3H", 8, 8, 8)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body + data)


def image(seed):
    rng = np.random.default_rng(seed)
    rgb = np.zeros((40, 50, 3), np.uint8)
    rgb[5:30, 8:40, 1] = rng.integers(1, 255, (25, 32))
    return rgb


@pytest.fixture()
def raw(tmp_path):
    for i, name in enumerate(["a/x_PreStain_DAPI.tif", "a/x_PostStain_DAPI.TIFF", "a/y_pre_Cy5.tif", "b/z_prepost_DAPI.tif"]):
        write_tiff(tmp_path / "raw" / name, image(i))
    return tmp_path / "raw"


def test_list_decode_and_pick(spark, raw):
    files = C.list_raw_files(spark, str(raw))
    assert sorted(r["basename"] for r in files.collect()) == ["x_PostStain_DAPI.TIFF", "x_PreStain_DAPI.tif", "y_pre_Cy5.tif", "z_prepost_DAPI.tif"]
    px = R.decode_raster(spark, str(raw / "a" / "x_PreStain_DAPI.tif"))
    got = np.zeros((40, 50))
    p = px.filter("ch = 'G'").toPandas()
    got[p["r"], p["c"]] = p["v"]
    assert np.array_equal(got, image(0)[:, :, 1])
    assert px.filter("ch <> 'G'").count() == 0


def test_damaged_and_black_files_are_reported(spark, tmp_path):
    write_tiff(tmp_path / "ok.tif", image(1))
    write_tiff(tmp_path / "black.tif", np.zeros((7, 9, 3), np.uint8))
    (tmp_path / "bad.tif").write_bytes(b"II*\0" + b"\1" * 40)
    got = {r["path"].rsplit("/", 1)[1]: (r["height"], r["width"], r["error"]) for r in R.raster_frames(spark, str(tmp_path)).collect()}
    assert got == {"ok.tif": (40, 50, None), "black.tif": (7, 9, None), "bad.tif": (None, None, "unreadable raster")}
    assert {r["path"].rsplit("/", 1)[1] for r in R.decode_raster(spark, str(tmp_path)).select("path").distinct().collect()} == {"ok.tif"}


def test_load_pair_and_strict_mode(spark, raw):
    files = C.list_raw_files(spark, str(raw))
    pairs = C.group_pairs(C.classify_files(files))
    asked = C.request(files.select("sample"), ["DAPI", "Cy5"])
    resolved = C.resolve_request(asked, pairs, files)
    with pytest.raises(C.RequestError, match="cannot run"):
        C.enforce(resolved, strict=True)
    tasks = C.enforce(resolved, strict=False)
    assert [tuple(r) for r in tasks.collect()] == [("a", "DAPI")]
    px = C.load_pairs(spark, tasks, pairs)
    assert px.groupBy("kind").count().count() == 2
    assert px.filter("kind = 'pre'").agg(F.sum("v")).first()[0] == float(image(0).sum())


def test_store_round_trip(spark, tmp_path):
    px = spark.createDataFrame([("a", "D", 1, 2, 3.5), ("b", "D", 0, 0, 1.0)], "sample string, dye string, r int, c int, v double")
    path = str(tmp_path / "store")
    assert S.read_stage(spark, path, 1, "post") is None
    S.write_stage(px, path, 1, "post")
    S.write_stage(px.filter("sample = 'a'").withColumn("v", F.lit(9.0)), path, 1, "post")
    assert S.read_stage(spark, path, 1, "post", sample="a").first()["v"] == 9.0
    assert S.read_stage(spark, path, 1, "post", sample="b").first()["v"] == 1.0
    assert S.read_stage(spark, path, 2, "pre") is None
    assert S.manifest_from_store(spark, path).count() == 2


def test_stream_handles_each_file_once(spark, raw, tmp_path):
    cat, chk = str(tmp_path / "cat"), str(tmp_path / "chk")
    follow_new_files(spark, str(raw), cat, chk).awaitTermination()
    assert read_catalogue(spark, cat).count() == 4
    write_tiff(raw / "a" / "y_post_Cy5.tif", image(9))
    follow_new_files(spark, str(raw), cat, chk).awaitTermination()
    rows = read_catalogue(spark, cat)
    assert rows.count() == 5
    done = spark.createDataFrame([("a", "DAPI", "complete")], "sample string, dye string, status string")
    assert [tuple(r) for r in new_tasks(rows, done).collect()] == [("a", "Cy5")]


def test_late_files_complete_a_pair_once(spark, raw, tmp_path):
    events, chk = str(tmp_path / "events"), str(tmp_path / "pairs-chk")

    def run():
        follow_pairs(spark, str(raw), events, chk).awaitTermination()
        rows = spark.read.parquet(events)
        return sorted((r["sample"], r["dye"], r["state"], r["version"]) for r in rows.collect())

    first = run()
    assert ("a", "Cy5") not in {x[:2] for x in first}
    write_tiff(raw / "a" / "y_post_Cy5.tif", image(9))
    assert run() == sorted([*first, ("a", "Cy5", "ok", 1)])  # by the state of the earlier run
    assert run() == sorted([*first, ("a", "Cy5", "ok", 1)])
    write_tiff(raw / "a" / "z_post_Cy5.tif", image(9))
    assert run() == sorted([*first, ("a", "Cy5", "duplicate", 2), ("a", "Cy5", "ok", 1)])
    last = current_pairs(spark, events).filter("dye = 'Cy5'").first()
    assert (last["state"], last["n_pre"], last["n_post"]) == ("duplicate", 1, 2)


def test_parameters(spark):
    with pytest.raises(ValueError, match="unknown parameter"):
        suffixes(spark, {"paddd": 3})
    with pytest.raises(ValueError, match="not a number"):
        P.require_valid(P.params_table(spark, {"pad": "wide"}))
    suf = suffixes(spark, {"boundary_width": 20, "manual_scale": 1.5, "use_edges": False, "scale_min": 0.850})
    assert suf == {1: "", 2: "_ue0_bw20", 3: "_ue0_bw20", 4: "_ue0_bw20_msc1.5"}
    back = P.parse_suffix(spark.createDataFrame([(0, suf[4])], "run_id bigint, suffix string"))
    assert {r["name"]: r["value"] for r in back.collect()} == {"use_edges": "false", "boundary_width": "20", "manual_scale": "1.5"}


def test_budget_and_log(spark, tmp_path):
    est = spark.createDataFrame([(90,)], "bytes bigint")
    assert B.preflight(est, "bytes", 100).first()["band"] == "warn"
    with pytest.raises(B.BudgetError):
        B.preflight(est, "bytes", 80)
    assert B.preflight(est, "bytes", 80, force=True).first()["band"] == "forced"
    log = str(tmp_path / "log")
    rows = spark.range(20).select(F.col("id").alias("seq"), F.current_timestamp().alias("ts"), F.lit("s").alias("section"), F.lit("x").alias("line"))
    B.append_log(spark, log, rows)
    B.append_log(spark, log, rows.withColumn("seq", F.col("seq") + 20))
    assert [r["seq"] for r in B.log_tail(spark.read.parquet(log), 3).collect()] == [39, 38, 37]
    B.clear_log(log, spark)
    assert spark.read.parquet(log).count() == 0


def planted(spark, shift=(3, -2)):
    rng = np.random.default_rng(3)
    r, c = np.mgrid[0:96, 0:96]
    blob = (np.hypot(r - 50, (c - 44) / 1.2) < 28) & ~(np.hypot(r - 40, c - 60) < 9)
    base = np.where(blob, rng.integers(60, 160, blob.shape), 0)
    pre = np.roll(base, shift, (0, 1))
    post = np.rint(1.3 * base)
    rows = [("s1", "DAPI", k, int(i), int(j), float(a[i, j])) for k, a in (("post", post), ("pre", pre)) for i, j in zip(*np.nonzero(a))]
    # pairs that cannot run: a pixel outside the frame, values that are no numbers, no frame, a file that could not be read
    rows += [("out", "DAPI", k, 96, 3, 7.0) for k in ("post", "pre")] + [("nan", "DAPI", k, 4, 3, float("nan")) for k in ("post", "pre")]
    rows += [(s, "DAPI", k, 4, 3, 7.0) for s in ("sizeless", "torn") for k in ("post", "pre")]
    px = spark.createDataFrame(rows + [("s2", "DAPI", "post", 1, 1, 5.0)], "sample string, dye string, kind string, r int, c int, v double")
    frames = px.select("sample", "dye", "kind").distinct().withColumn("height", F.lit(96)).withColumn("width", F.lit(96))
    frames = frames.filter("sample <> 'sizeless'").withColumn("error", F.when((F.col("sample") == "torn") & (F.col("kind") == "pre"), "strip 3 is damaged"))
    return px, frames


OPTIONS = dict(pad=16, rotation_search=False, scale_search=False, boundary_width=4, boundary_smooth=2, down_scale=4.0, interior_ecc=False)


def test_batch_aligns_scales_and_resumes(spark, tmp_path):
    px, frames = planted(spark)
    tasks = spark.createDataFrame([(s, "DAPI") for s in ("s1", "s2", "s3", "out", "nan", "sizeless", "torn")], "sample string, dye string")
    path = str(tmp_path / "out")
    res = {r["sample"]: r for r in run_batch(px, frames, tasks, path, OPTIONS).collect()}
    assert res["s1"]["status"] == "complete" and abs(res["s1"]["scale_estimate"] - 1.3) < 0.1
    assert res["s2"]["status"] == "error: pre frame has no signal"
    assert res["s3"]["status"] == "error: no raw pixels"
    errors = {"out": "pixels outside the frame", "nan": "values that are not finite", "sizeless": "no frame size", "torn": "strip 3 is damaged"}
    assert {s: res[s]["status"] for s in errors} == {s: f"error: {e}" for s, e in errors.items()}
    store, suf = Store(spark, path), suffixes(spark, OPTIONS)
    m = store.transforms(tasks, 3, suf[3]).first()["m"]
    assert abs(m[2] + 2) < 0.7 and abs(m[5] - 3) < 0.7
    # everything is there now: nothing is planned again
    assert B.plan_stages(tasks.filter("sample = 's1'"), store.manifest(suf)).filter("run").count() == 0
    # every diagnostic of the finished pair is a table, and the report finds it complete
    report = B.status_report(tasks.filter("sample = 's1'"), store.manifest(suf)).collect()
    assert all(r["exists"] for r in report) and len(report) == 11
    assert store.table("pre_post_heatmap", suf[4]).filter("sample = 's1'").count() > 0
    with pytest.raises(ValueError, match="not built"):
        run_batch(px, frames, tasks, path, {**OPTIONS, "fine_ecc": True})
    again = run_pair(px, frames, "s1", "DAPI", path, params=OPTIONS).first()
    assert again["scale_estimate"] == res["s1"]["scale_estimate"]


def test_a_pair_that_raises_in_the_search_leaves_the_others(spark):
    from duoframe.operators.register import best_candidate, coarse_search

    rows = [(s, k, r, 5 + r % 3 + (k == "pre"), 1.0) for s in ("good", "bad") for k in ("post", "pre") for r in range(4, 20)]
    rows.append(("bad", "pre", 40, 2, 1.0))  # beyond the frame
    rings = spark.createDataFrame(rows, "s string, kind string, r int, c int, v double")
    got = coarse_search(rings, ["s"], (24, 24), [(1.0, 0.0), (1.0, 1.0)])
    assert {r["s"]: (r["error"] or "")[:10] for r in got.collect()} == {"good": "", "bad": "IndexError"}
    assert [(r["s"], round(r["dx"])) for r in best_candidate(got, ["s"]).collect()] == [("good", 1)]
