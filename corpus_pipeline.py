"""A training corpus in five stages: quality rules, language, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last keep the columns of `documents`;
n_chars follows the text. Every column may be null and every table empty; rows that repeat
each other survive up to the near-duplicate stage, which keeps one of them."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gridlake.llm.jaccard import similarity_components
from gridlake.llm.langid import identified, train
from gridlake.llm.packing import packed
from gridlake.llm.quality import quality_cascade
from gridlake.llm.shared import shared_path
from gridlake.llm.suffix_dedup import deduplicated

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a text's letters that its main language must have; mixtures below go.
MAIN_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade keeps."""
    return quality_cascade(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; `lang` becomes the language found, if any was learned.

    The model learns from the stage's own labelled documents (a bounded sample). Without a
    label in the table nothing can be told and all documents stay."""
    model = train(docs)
    if not model.languages:
        return docs.select(*COLUMNS)
    rows = identified(docs.select(*COLUMNS), model)
    return rows.filter((F.col("lang_pred") != "und") & (F.col("score") >= MAIN_SHARE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near duplicates; one row of rows that repeat an id.

    Only ids are shuffled for the choice; of equal ids the first by text stays."""
    components = similarity_components(docs.select("doc_id", "text"))
    others = components.filter("doc_id <> component_id").select("doc_id").distinct()
    rows = docs.select(*COLUMNS).join(others, "doc_id", "left_anti")
    # the groups are the rows of one id; a null id tells nothing, and all such rows stay
    one = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text", "lang", "source", "n_chars")
    return rows.withColumn("_row", F.row_number().over(one)).filter("_row = 1 or doc_id is null").select(*COLUMNS)


@F.pandas_udf(StringType())
def whole_characters(kept: pd.Series) -> pd.Series:
    """UTF-8 text without the bytes of cut characters."""
    return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages; bytes of a character cut in two are dropped. Texts left empty go."""
    rows = deduplicated(docs.select(*COLUMNS))
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(whole_characters("kept"))
    return rows.withColumn("text", text).filter(F.octet_length("text") > 0).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packed(docs).drop("ids")


STAGES = [("quality rules", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates),
          ("suffix-array dedup", passages), ("packing", packing)]

#: Viterbi labels, tokenizer ids and retrieval packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
