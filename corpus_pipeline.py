"""A corpus made ready for training: stages over `documents`, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from fieldlens.llm.ngram_join import text_key
from fieldlens.llm.shared import broadcast_if_small, documents, shared_folder, small_batches

READ = ("doc_id", "text", "source")
HAS_WORD = r"[^\x20\x09-\x0D]"


def _packed(docs: DataFrame) -> DataFrame:
    """What the operators read, and all other columns as one, so that no name meets a name of theirs."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in READ]
    return docs.select(*READ, F.struct(*rest).alias("_rest") if rest else F.lit(None).cast("string").alias("_rest"))


def _unpacked(df: DataFrame, docs: DataFrame, text=None, more=()) -> DataFrame:
    """The columns of `docs` again, with a new text and its length where one is given."""
    columns = {c: F.col(c) if c in READ else F.col(f"_rest.{c}") for c in docs.columns}
    if text is not None:
        columns["text"] = text
        if "n_chars" in columns:
            columns["n_chars"] = F.when(text.eqNullSafe(F.col("text")), columns["n_chars"]).otherwise(F.length(text))
            columns["n_chars"] = columns["n_chars"].cast(dict(docs.dtypes)["n_chars"])
    return df.select(*[x.alias(c) for c, x in columns.items()], *more)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    A null or empty text scores what the share of labels says. Each row is judged by its own text, whatever its id.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(toxicity.with_scores(_packed(docs), model).filter("score < 0.5"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so does a document that had words and has none left.

    A line that rows of one id repeat counts as in one document. Rows without an id neither own nor lose lines; null
    texts stay null, and an empty table stays empty.
    """
    found = line_dedup.dedup_lines(_packed(docs))
    found = found.filter((F.col("n_dropped") == 0) | F.col("kept_text").rlike(HAS_WORD))
    return _unpacked(found, docs, F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the rows with its smallest doc_id stay.

    A row goes by its id and its text, so another text with the id of a near copy stays. Rows without an id go if they are
    near to one that has an id. Texts without words and empty tables stay as they are.
    """
    found = ngram_join.similar_components(docs).filter(~F.col("component_id").eqNullSafe(F.col("doc_id")))
    gone = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    packed = _packed(docs).withColumn("_own", text_key())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key"))
    return _unpacked(packed.join(broadcast_if_small(gone), same, "left_anti"), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside passages of test items are cut out; a document that has none left goes.

    Each row is searched by its own text, whatever its id; null and empty texts stay, and so do all without items.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(_packed(docs), items, clean=True)
    found = found.withColumn("_hit", decontaminate.n_hit())
    clean = F.coalesce("clean", "text")
    found = found.filter((F.col("_hit") == 0) | (F.col("_hit") < F.col("n_words")))
    return _unpacked(found, docs, clean)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix with copies (how often), taken (words) and finish (the first copy's place in the order).

    Rows of equal id, text and source come as one row with the copies of all. Columns of these three names give way to
    the stage's own. An empty table gives an empty one.
    """
    mixed = mixing.mix(docs.select(*READ)).filter("copies > 0").groupBy("draw", F.col("source").alias("_source"))
    mixed = mixed.agg(
        F.sum("copies").alias("copies"),
        F.sum("taken").alias("taken"),
        F.min(F.get("finishes", F.lit(0))).alias("finish"),
    )
    more = ("copies", "taken", "finish")
    docs = docs.drop(*more)
    named = _packed(docs).withColumn("_draw", mixing.draw()).dropDuplicates(["_draw", "source"])
    joined = named.join(mixed, (F.col("_draw") == F.col("draw")) & F.col("source").eqNullSafe(F.col("_source")))
    return _unpacked(joined, docs, more=more)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("mix_sources", mixing_stage),
]
# no stage before the last can be put in SQL: the first one's scores come from a fitted model
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
