"""From raw documents to packed training sequences, one operator a stage.

Every stage works on all that its predecessor kept; all but the last return documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.llm import langid
from latticeflow.llm.common import staged
from latticeflow.llm.mixing import mixed_documents
from latticeflow.llm.ngram_join import ngram_classes
from latticeflow.llm.packing import pack
from latticeflow.llm.toxicity import fit, scored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, ``lang`` set to it.

    The text is weighed with the declared ``lang`` and the ``source``'s prior.
    """
    out = langid.identified(docs, langid.fit(docs), "text", "source", "lang", None)
    kept = out.where("lid_accepted")
    return kept.withColumn("lang", F.col("lid_lang")).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.  A row without doc_id is kept or dropped by its own text, too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    numbered = docs.withColumn("__own", F.xxhash64("doc_id", "text"))
    index = fit(docs, labels)
    bad = scored(numbered.select(F.col("__own").alias("doc_id"), "text"), index).where("predicted = 1").select(F.col("doc_id").alias("__own")).distinct()
    return numbered.join(staged(bad, "toxic"), "__own", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest doc_id.

    Documents without words are a group of their own each.
    """
    numbered = docs.withColumn("__own", F.xxhash64("doc_id", "text"))
    rows, components = ngram_classes(numbered.select(F.col("__own").alias("doc_id"), "text"))
    rooted = rows.where("n > 0").join(components.withColumnRenamed("node", "key").hint("merge"), "key", "left").select(F.col("doc_id").alias("__own"), F.coalesce("component", "key").alias("root"))
    named = rooted.join(numbered.select("__own", F.col("doc_id").alias("__id")).hint("merge"), "__own").groupBy("root").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__own")).alias("m"))
    first = named.select(F.col("m.__own").alias("__own"))
    worded = staged(first.unionByName(rows.where("n = 0").select(F.col("doc_id").alias("__own"))).distinct(), "kept")
    return numbered.join(worded, "__own", "left_semi").dropDuplicates(["__own"]).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, as documents: texts as often, and as far, as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return pack(docs)


STAGES = [("language ID", language_id), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("mixing", mixing), ("best-fit packing", packing)]

#: Classifiers, hash permutations and tokenisation are beyond SQL; see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each hands on a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
