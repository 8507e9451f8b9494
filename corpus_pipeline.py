"""From raw documents to a training mix: five stages, each one an operator of ``opinara.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each result as Parquet
to the shared folder and reads it back as the next stage's documents.  What a stage wrote on the way is deleted when its
result stands.  All stages but the last return the columns of ``documents``, and columns of any other name beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import decontam, mixing, ngram_join, quality, substring_dedup
from opinara.llm.joins import broadcast_if_few, packed, unpacked
from opinara.session import Scratch, cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def sheltered(docs: DataFrame) -> tuple[DataFrame, list[str], list]:
    """``docs`` as doc_id, text and one struct of all other columns, whose names then clash with nothing; the name of that
    struct (if there are other columns), and the columns that bring ``docs`` back."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *([F.struct(*[F.col(f"`{c}`") for c in other]).alias("carried")] if other else []))
    return plain, ["carried"] if other else [], [F.col(c) if c in ("doc_id", "text") else F.col("carried").getField(c).alias(c) for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quadratic discriminant rejects (score below 0.5); fitted on labelled documents of its input.

    Null and empty texts are judged by the statistics of no words; repeated rows get one judgement; a null doc_id has no
    label and is judged like any other; without labels of both classes all documents stay; an empty table stays empty."""
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, carried, back = sheltered(docs)
    return quality.classify(plain, model, keep=("text", *carried)).where("predicted = 1").select(*back)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near duplicates (five-word shingles, similarity 0.8).

    The first is the one of least doc_id, null ids last; ties go by a hash of the text.  Of identical rows one stays.  Null,
    empty and wordless texts are near nothing and all stay; an empty table stays empty."""
    return ngram_join.keep_first(docs)


def repeated_text_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of repeated passages; a document all of whose text went is dropped.

    Null and empty texts lose nothing and stay (null becomes empty text); rows with a null doc_id come last; of identical
    rows the first keeps its text and the others, if of 100 bytes or more, go; n_chars, where there is one, is counted
    anew; an empty table stays empty."""
    plain, carried, back = sheltered(docs)
    cut = substring_dedup.remove_repeats(plain, keep_text=True, carry=tuple(carried))
    # Texts that were empty before stay; n_removed tells them from those that became empty.
    kept = cut.where("n_removed < n_bytes or n_bytes = 0").withColumn("text", F.col("kept")).select(*back)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null, empty and wordless texts hold none and stay; rows of one doc_id, or of none, are judged by their own text; an item
    without an id counts as much as any other; without items all documents stay; an empty table stays empty."""
    own = F.xxhash64("doc_id", "text")
    found = decontam.decontaminate(docs.select(own.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), span=None)
    found = cut_lineage(found.where("contaminated").select(F.col("doc_id").alias("bad")).distinct(), "contaminated")
    return unpacked(packed(docs, own=own).join(broadcast_if_few(found), F.col("own") == F.col("bad"), "left_anti"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents to flattened source weights and shuffles them; adds copy_no and mix_key.

    A null source is a source of its own; texts of any kind, null or empty, are copied as they are; rows of one doc_id get the
    same count; an empty table stays empty."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("suffix-array dedup", repeated_text_removal),
    ("benchmark decontamination", benchmark_filter),
    ("mixing sources to target weights", source_mix),
]

#: The classifier and the suffix arrays have no SQL form; tests compare with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table; the table that the last stage reads stays in the shared folder."""
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:
            before, docs = docs, scratch.store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            scratch.clear(docs)
        own.drop(before)
        own.tables += scratch.tables
    return STAGES[-1][1](spark, docs, sf_dir)
