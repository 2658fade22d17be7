"""From raw documents to packed sequences: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; its result is written as
Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from policyframe.llm.decontaminate import contaminated_out
from policyframe.llm.lines import without_repeated_lines
from policyframe.llm.pack import packed
from policyframe.llm.shared import cut, done, table
from policyframe.llm.simhash import one_of_each_group
from policyframe.llm.toxicity import toxic_out

STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", contaminated_out),
    ("packing", packed),
]

#: Training a classifier, fingerprints' components and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        done(*before)
        before = [docs]
    return docs
