"""A corpus in, a mixed and tokenised corpus out: STAGES in order, each written as Parquet and read again as the next one's docs."""

import public_tokenizers
from pyspark.sql import functions as F

from mediacairn.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from mediacairn.llm.common import stored, table, work_dir

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def reject_toxic(spark, docs, sf_dir):
    """Documents that the classifier chain calls toxic go; it learns from the labels of the documents it gets."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    """Of documents with equal text, but for A-Z and a-z, the one with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of every group of near copies (similarity 0.8 on shingles of five words) the one with the smallest doc_id stays."""
    return near_dedup.near_dedup(docs, width=SHINGLE, percent=80)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as they are drawn, up to twice, so that sources come near their target shares of words."""
    return mixing.mix(docs)


def tokenise(spark, docs, sf_dir):
    """doc_id, lang, source, n_tokens, ids (little-endian 32-bit integers), decoded (what the ids read as)."""
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("row.doc_id", "row.lang", "row.source", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: A trained model and byte-pair merges have no SQL form; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), work_dir(spark, "pipeline-" + name.replace(" ", "-")))
    return docs
