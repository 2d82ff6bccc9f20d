"""The pipeline's stages against plain versions of their decisions, and the registration."""

import re

import __spark_entry__
import corpus_pipeline
from llm_cases import FOLDER
from test_brute_force import brute_classes, brute_hits

from duoframe.session import pin


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_stages(spark):
    docs = pin(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        docs = pin(stage(spark, docs, FOLDER))
        if name == "packing":
            continue
        assert docs.columns == columns
        after = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        if name == "exact dedup":
            best = {}
            for i, t in before:
                k = re.sub("[\x20\x09-\x0d]", "", t or "")
                best[k] = min(best.get(k, (0, 1 << 60)), (-len(t or ""), i))
            assert [i for i, _ in after] == sorted(i for _, i in best.values())
        elif name == "near dedup":
            assert [i for i, _ in after] == sorted({before[c][0] for c in brute_classes(before)})
        elif name == "decontamination":
            assert after == [(i, t) for i, t in before if not brute_hits(t, items)[1]]
    pieces = docs.toPandas()
    assert set(pieces["doc_id"]) == {i for i, _ in after}
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048
