"""A corpus pipeline of five stages, each the work of one operator on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skirmish.llm import decontaminate, line_dedup, mixing, ngram_jaccard, quality_rules
from skirmish.llm.common import cut, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected."""
    return quality_rules.passed(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; documents that were nothing else go."""
    return line_dedup.deduped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return ngram_jaccard.representatives(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic reach their target shares of tokens."""
    return mixing.mixed(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_free), ("mixing to target weights", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = f"""
WITH s1 AS MATERIALIZED (SELECT d.* FROM documents d JOIN ({quality_rules.sql()}) q USING (doc_id) WHERE q.kept),
s2 AS MATERIALIZED (SELECT s1.doc_id, x.text, s1.lang, s1.source, CASE WHEN x.n_deleted > 0 THEN length(x.text) ELSE s1.n_chars END::BIGINT AS n_chars
  FROM s1 JOIN ({line_dedup.sql("s1")}) x USING (doc_id) WHERE x.n_deleted = 0 OR x.n_deleted < x.n_lines),
s3 AS MATERIALIZED (SELECT s2.* FROM s2 JOIN ({ngram_jaccard.sql("s2")}) g USING (doc_id) WHERE g.component_id = s2.doc_id),
s4 AS MATERIALIZED (SELECT s3.* FROM s3 JOIN ({decontaminate.sql("s3")}) c USING (doc_id) WHERE NOT c.contaminated)
SELECT s4.* FROM s4 JOIN ({mixing.sql("s4")}) m USING (doc_id) WHERE m.kept"""
