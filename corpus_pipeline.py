"""A training-data pipeline over ``documents``: five stages, each one of the operators of ``tidemark.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, one_text_each, table, text_of, written
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.lines import line_dedup
from tidemark.llm.mixing import mix, with_domain
from tidemark.llm.nearcopy import near_duplicates
from tidemark.llm.quality import quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, ``n_chars`` following the text."""
    return df.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that break a rule.

    Null, empty and wordless texts are rejected, repeated rows are judged alike, an empty table gives an empty result;
    columns besides those of documents go.
    """
    return _documents(quality(docs).where("kept").withColumn("text", F.col("clean_text")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines are cut out.

    No document goes, not even one that comes back empty. A null source counts for no spread; a line on exactly the
    least number of sites is cut; repeated rows are cleaned alike; an empty table gives an empty result.
    """
    return _documents(line_dedup(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (5-word shingles, a similarity of 0.8 or more): that with the smallest doc_id.

    Of the rows of one doc_id that with the longest text stays, then that with the largest SHA-256. Rows without an id
    stay, as do texts without words, which are near copies of nothing. An empty table gives an empty result.
    """
    docs = one_text_each(docs.withColumn("text", text_of()), "doc_id", "text")
    gone = near_duplicates(docs).where("NOT kept").select("doc_id")
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go.

    Null and empty texts and items match nothing; rows without an id stay, as they can't be told apart; all rows of a
    contaminated doc_id go; an empty table, or an empty benchmark, takes nothing out.
    """
    return _documents(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with how often.

    Nulls in language and source are branches of their own, a null text has no tokens; rows of one place in a leaf's
    order are taken or left together; an empty table gives an empty result.
    """
    mixed = mix(with_domain(docs)).where("times > 0")
    return mixed.select(*COLUMNS, "domain", "n_tokens", "times")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: BM25 retrieval with its overlap check isn't expressed in SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's rows. Each stage's table goes when the next one is written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
            if read is not None:
                dropped(read)
            read = docs
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
