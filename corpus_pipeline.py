"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Every
stage works on all rows that the one before kept.

Defined results, in every stage: texts of any length are taken whole; extra columns pass through unchanged, whatever their
names; an empty table gives an empty result. Stage by stage:

* quality_rules: a null, empty or blank text has no words and goes; null languages and sources are groups of their own;
  repeated ids and rows are judged each.
* near_dedup: null, empty and blank texts are one group; rows without an id stay only where their group has no id; of rows
  with the smallest id any one stays.
* decontamination: null and empty texts never match and stay; repeated rows go or stay together.
* personal_data: null texts stay null, texts without spans stay as they are; where spans overlap the earlier one names the
  place; n_chars follows the text where it isn't null.
* best_fit_packing: a null or empty text is one piece of one token; repeated ids and rows have pieces of their own.
"""

from __future__ import annotations

from strataq.llm import decontaminate, packing, pii, quality, scratch, simhash

ORACLE_SQL = None  # sketches, LSH and packing are not SQL-expressible together; tests/llm compares run() with brute force


def quality_rules(spark, docs, sf_dir):
    """Rejected documents go."""
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays, the one of the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that leak an item of `benchmark` go."""
    return decontaminate.remove_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs, sf_dir):
    """Spans of personal data become their kind in angle brackets."""
    return pii.redact(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of at most 2048 tokens, packed into sequences."""
    return packing.pack_pieces(packing.piece_rows(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark, sf_dir):
    """Applies the stages to documents, each written as Parquet and read again.

    What a stage wrote on its way, its input included, is deleted once its result is written; what the last stage's rows are
    read from stays for the caller (`scratch.drop_scratch`).
    """
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.mark(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.materialize(docs, name)
            scratch.drop_scratch(spark, begun, keep=docs)
    return docs
