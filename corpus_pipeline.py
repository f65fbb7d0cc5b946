"""A corpus pipeline: quality, line dedup, near copies, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it
returns is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from tessera.llm.common import cut, long_texts, read_table
from tessera.llm.queries import RANKS


def beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], *results: str) -> DataFrame:
    """The columns of docs after a stage that adds columns of these names: those that docs has itself are set aside and come back."""
    aside = {c: f"{c}__own" for c in docs.columns if c.lower() in results}
    done = stage(docs.withColumnsRenamed(aside))
    return done.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, by texts, labels and sites.

    Null and empty texts are judged as empty ones, very long ones whole; repeated rows are judged
    alike; a posterior that ties with the threshold keeps its document; no rows give none.
    """
    long_texts(spark)
    labels = read_table(spark, sf_dir, "labels")
    return beside(docs, lambda d: quality.classify(d, labels).where("keep"), "evidence", "host_rate", "path_rate", "p_good", "keep")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that stand in ten documents or more; n_chars is counted anew.

    Every row stays: a null text becomes an empty one, as does a text of such lines alone; repeated
    rows count as documents of their own; very long texts and lines are handled whole.
    """
    long_texts(spark)
    return beside(docs, lambda d: line_dedup.dedup_lines(d).withColumn("n_chars", F.length("text").cast("long")), "n_lines", "n_dropped")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a similarity of 0.8: that of the least doc_id.

    Of repeated rows with one key one stays; rows without a key or without words all stay; sets that
    tie with the similarity link; very long texts count whole.
    """
    long_texts(spark)
    return jaccard_join.keep_one(docs, jaccard_join.Measure(5, 80, 100))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; very long ones are searched whole; repeated rows and rows without
    a key are judged like any other; an edit distance that ties with the allowed one drops its row.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and a digest of what they decode to, one row for each.

    Null and empty texts have no ids; very long ones are encoded whole; other columns are left out.
    """
    import public_tokenizers

    long_texts(spark)
    path = public_tokenizers.path(RANKS)
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, keys=("doc_id", "lang", "source"))
    return bpe.decode(ids, bpe.token_table(spark, path)).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_copy_stage), ("benchmark decontamination", benchmark_stage), ("byte-level BPE", token_stage)]
#: SQL can express neither the classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
