"""A training-data pipeline over documents: quality, lines, near copies, mixing, packing.

Each stage takes what its predecessor kept and returns a table; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.llm._shared import discard, materialize, work_path, work_tables
from gaugelake.llm.line_dedup import dedup_lines
from gaugelake.llm.minhash_dedup import near_duplicates
from gaugelake.llm.mixing import SHARDS, mix_sources
from gaugelake.llm.packing import pack_documents
from gaugelake.llm.pretokens import tokenizer_path
from gaugelake.llm.quality_rules import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie close to their language.

    A null text fails the base rules; a null or unknown language has the reference of all such texts; repeated rows get equal verdicts; a value at its
    threshold passes; no rows give no rows; further columns are kept.
    """
    return quality_rules(docs).where("quality.kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sources share, but for each line's first place; those left empty go.

    A null text stays as it is; a null source is no site; rows equal in id and text are treated alike; of rows of a line, the least id comes first, null
    last; no rows give no rows; further columns are kept.
    """
    left = dedup_lines(docs)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    found = left.where("NOT (n_removed_lines > 0 AND text = '')").select(*own, "text", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"))
    return found.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share 80 % of their five-word shingles: that of the least id (null last), of equal ones any.

    Rows are numbered and compared as such, so rows that share an id, or have none, are documents like others. Texts without words are
    copies of nothing and stay; no rows give no rows; further columns are kept.
    """
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows, _ = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "rows")  # written: a number must not change when a task runs again
    found = near_duplicates(rows, id_col=number, width=5, percent=80).select(F.col("doc_id").alias(number), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(number).alias("number"))
    kept = rows.select("doc_id", number).join(found, number).groupBy("_group").agg(F.min(order).alias("first")).select(F.col("first.number").alias(number))
    return rows.join(kept.hint("merge"), number, "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each of its shards in one partition and shuffled there.

    A null text has size 0, a null source is a source of its own, the last; rows without an id and repeated rows are documents like others, the latter
    drawn alike; ties in the order go by id and size; no rows give no rows; further columns are kept.
    """
    _, draws, _ = mix_sources(docs)
    return draws.repartitionById(SHARDS, "shard").sortWithinPartitions("place", "pass").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 token ids, in the order of the rows.

    A null text is empty and has the end id alone; repeated rows and rows without an id are packed like others; no rows give no pieces; columns
    beside doc_id and text are not read.
    """
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near copies", near_copies), ("mixing", mixture), ("packing", packed)]

#: Shingle components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = work_tables()
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(*(work_tables() - before - {path}))  # what this stage was made from
        docs = spark.read.parquet(path)
    return docs
