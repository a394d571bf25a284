"""Training-data pipeline over the documents table: each stage's result is written as Parquet and read as the next one's input.

A row is known by a hash of its id and its text, so rows that share an id but not
a text are documents of their own. Stages need doc_id, text and source; n_chars is
kept in step with the text where it is there, and all other columns come through
unchanged, whatever their names. Nulls in any column, empty and very long texts
and empty tables are fine in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.mixing import mix_sources
from pairlens.llm.near_dedup import near_duplicates
from pairlens.llm.packing import pack_documents
from pairlens.llm.session import shared_dir
from pairlens.llm.substring_dedup import remove_repeats
from pairlens.llm.toxicity import toxicity

#: Words of a passage that may stand in one document only.
PASSAGE_WORDS = 50


def _rows(docs: DataFrame) -> DataFrame:
    """(record, id, text, source, row): all columns in a struct beside those that stages use."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col("doc_id").alias("id"), F.col("text").alias("text"), F.col("source").alias("source"), F.xxhash64("doc_id", "text").alias("row"))


def _fields(names: list[str], new: dict[str, Column] | None = None) -> list[Column]:
    """The columns of a struct ``record`` under their names, some replaced."""
    return [(new or {}).get(c, F.col("record").getField(c)).alias(c) for c in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Texts without words score as a neutral text; equal texts score alike. Without
    labels of both classes nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trainable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    return toxicity(docs, labels, trainable, carry=True).where("predicted = 0").select(*_fields(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, null ids last, the smaller hash among equal ids.

    Texts without words are near nothing and stay. Of rows with one id and one
    text one stays.
    """
    rows = _rows(docs)
    groups = near_duplicates(rows.select("row", "text"), id_col="row", shingle_words=5, percent=80).where("component_id is not null")
    grouped = groups.groupBy("component_id").agg(F.count_distinct("row").alias("n")).where("n > 1").select("component_id")
    members = groups.join(grouped, "component_id").select("component_id", "row").distinct().join(rows.select("row", "id").distinct(), "row")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    best = members.groupBy("component_id").agg(F.min(order).alias("best"))
    gone = members.join(best, "component_id").where(F.col("row") != F.col("best.row")).select("row").distinct()
    left = rows.join(gone, "row", "left_anti")
    if not rows.groupBy("row").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["row"])
    return left.select(*_fields(docs.columns))


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has; those of which nothing is left go.

    Texts without words stay as they are. A null id ranks last. Rows that share
    an id keep what only they share.
    """
    cleaned = remove_repeats(docs, min_words=PASSAGE_WORDS, carry=True).where("n_removed = 0 or n_removed < n_words")
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("record").getField("n_chars")).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*_fields(docs.columns, new))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without words once. Null sources are a source of their own. Rows with one id and one text are taken equally often."""
    rows = _rows(docs)
    taken = mix_sources(rows.select("row", "text", "source"), id_col="row")
    copies = taken.groupBy("row").agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    return rows.join(copies, "row").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*_fields(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of 1024 at most with their places in sequences; a text without words is its end token."""
    return pack_documents(docs, length=1024, end_id=2, group_pieces=10_000)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", remove_passages), ("mixing", mix), ("packing", pack)]

#: The model of the first stage cannot be put in SQL; stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages, each written to the shared folder and read again.

    A run with a name that failed goes on, when it is started again, from its last
    finished stage. A stage's result is deleted once the next one's is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{name or uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [f"{folder}/{number}-{stage}" for number, (stage, _) in enumerate(STAGES)]
    done = max((n + 1 for n, p in enumerate(paths) if files.exists(place(f"{p}/_SUCCESS"))), default=0)
    for number, (_, stage) in enumerate(STAGES):
        if number >= done:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[number])
        if number + 1 >= done:
            docs = spark.read.parquet(paths[number])
            if number:
                files.delete(place(paths[number - 1]), True)
    return docs
