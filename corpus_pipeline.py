"""A corpus pipeline over the text operators: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; where a text changes, n_chars is set anew.

In all stages null and empty texts stay as they are, rows with a null id stay, further columns are carried along
whatever their names, texts are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import Scratch, fresh
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import ngram_jaccard_join
from tidemark.llm.toxicity import fit_severity, without_toxic

#: A document of whose words other documents have this share, line by line, is a copy and goes as a whole.
COPY_SHARE = 0.8
#: Documents are near duplicates from this Jaccard similarity of their 5-word shingles on, in percent.
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among them, calls toxic go.

    A probability of one half itself counts as toxic. Equal texts go or stay together. Null texts have no features.
    """
    model = fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go; so do documents that lose COPY_SHARE of their words to other documents.

    Earlier is by document id, then by line; null ids come last. Rows with equal id and text are one document.
    """
    out, (kept, removed, share) = dedup_lines(docs)
    changed = F.size(removed) > 0
    out = out.filter(F.col(share) < COPY_SHARE).withColumns({"n_chars": F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars")), "text": F.col(kept)})
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays.

    Rows that repeat an id are one document here: they stay or go together, copies under one id included.
    """
    found = ngram_jaccard_join(docs, n=5, percent=NEAR_PERCENT)
    # a table of its own: its size tells whether it is broadcast or the texts are shuffled
    gone = Scratch(spark).cut(found.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items go; documents that consist mostly of them go as a whole.

    Half of the words is not yet mostly. Texts without words stay.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, with their positions.

    A null source is a source of its own. Positions are unique; rows that are equal in every column are interchangeable.
    """
    out, (leg, block, slot, position) = mix_sources(docs)
    (name,) = fresh(docs, "position")
    out = out.select(*docs.columns, F.col(position).alias(name))
    return out.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), name).sortWithinPartitions(name)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

#: The first stage scores with a fitted model, which SQL cannot express; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written and read again."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
