"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and hands the documents it keeps to the next one.

Stages: toxicity (documents predicted toxic go), near-dedup (one document of each near-duplicate class stays),
benchmark decontamination (documents with a benchmark window go), secret scans (secrets are masked in the text), and
mixing (documents are read, and repeated, to the target weights of their sources). All but the last return the columns
of documents. Rows are judged and removed as rows: of two that share a doc_id, or have none, one may go and the other
stay; rows with the same id and text are copies of each other. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.common import cut, shared_dir, table
from tessaria.llm.decontaminate import decontaminate
from tessaria.llm.mixing import mix
from tessaria.llm.near_dedup import near_duplicates
from tessaria.llm.secrets import scan_secrets
from tessaria.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Up to so many ids (8 MB) are broadcast to drop their documents where they are read; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Near-duplicates share this much of their five-word shingles (op1_near_dedup has a contract of its own, 85).
NEAR_PERCENT = 80


#: Row ids that stand for rows without an id of their own lie below this.
LOWEST_ID = -(1 << 62)


def _without(docs: DataFrame, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """docs without the rows that have the same keys (never null) as a row of rows."""
    rows = cut(rows.select(*keys).distinct(), shared_dir(docs.sparkSession), name)
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, keys, "left_anti").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with row_id: their doc_id where it comes once; rows that share one, or have none, get a number by id and text below all ids, equal rows once."""
    ids = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("again"))
    ids = cut(ids, shared_dir(docs.sparkSession), "repeated")
    if ids.isEmpty():
        return docs.withColumn("row_id", F.col("doc_id"))
    shared = docs.join(ids, docs.doc_id.eqNullSafe(ids.again), "left_semi").withColumn("row_id", F.lit(LOWEST_ID) - F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2))
    own = docs.join(ids, docs.doc_id.eqNullSafe(ids.again), "left_anti").withColumn("row_id", F.col("doc_id"))
    return own.unionByName(shared.dropDuplicates(["row_id"]))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _numbered(docs)
    found = near_duplicates(docs.select(F.col("row_id").alias("doc_id"), "text"), percent=NEAR_PERCENT)
    return _without(docs, found.filter("not kept").select(F.col("doc_id").alias("row_id")), ["row_id"], "copies")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    return _without(docs.withColumn("text_key", F.xxhash64("doc_id", "text")), found, ["text_key"], "contaminated")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = scan_secrets(docs, with_text=True, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.size("spans") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, max_repeat=4.0, carry=("text", "lang", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
]
#: SQL can't express the stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, folder, name)
    return docs
