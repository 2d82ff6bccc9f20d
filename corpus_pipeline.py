"""The corpus pipeline over all documents: toxicity, exact dedup, near-dedup, decontamination, packing.

Each stage works on all that the one before kept and drops rows, never columns; the last
returns the pieces of every remaining document with their places in the sequences.
"""

from __future__ import annotations

from duoframe.llm.contamination import drop_contaminated
from duoframe.llm.exact import DigestIndex
from duoframe.llm.near import drop_near_duplicates
from duoframe.llm.packing import pack
from duoframe.llm.queries import table, tokenizer
from duoframe.llm.toxicity import drop_toxic, fit_toxicity
from duoframe.session import pin


def toxicity(spark, docs, sf_dir):
    """Documents that the ordinal model, fitted on the labelled ones, does not reject."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark, docs, sf_dir):
    """Of texts that are equal but for white space, the longest."""
    index = DigestIndex(spark, docs.schema["doc_id"].dataType.simpleString())
    kept = index.dedup(docs)
    index.close()
    return kept


def near_dedup(spark, docs, sf_dir):
    """Of every class of near-duplicates, the document with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without any window of ten words of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """Pieces of the documents, packed into sequences of 2048 tokens."""
    return pack(docs, tokenizer("byte_bpe_50k.json"), 2048, 0)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# The toxicity model and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to the documents of sf_dir, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
