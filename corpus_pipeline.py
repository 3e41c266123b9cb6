"""From raw documents to training shards, in five stages; each one's rows are stored before the next one reads them.

Documents that the quality classifier rejects go; one document of each near-duplicate group stays; documents that
hold benchmark items go; sources are brought to their target weights in blocks of BLOCK_WORDS words, so what goes on is
pieces of documents, each up to twice or not at all; and these are dealt into shards, which the last stage returns with
the text.

Defined results, in every stage: a null text is an empty one; it has no quality to speak of, no copies, no benchmark items
and no words, so it goes in the first stage or at last in the mix. Documents without a doc_id are judged by their own
text, are no one's copies and are never held out. Rows that share a doc_id are one document to the second stage and are
kept or dropped together; the others judge each row. Of equal texts the least doc_id stays. Columns that are not used
here are carried through, whatever their names (the last stage puts `doc_` before names that it makes itself). Empty
tables give empty results; without labels, all documents get the same score; without a benchmark all documents stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import noted, release, shared_dir, table
from quern.llm.decontaminate import drop_contaminated
from quern.llm.gam import keep_good, train
from quern.llm.mixing import mixed
from quern.llm.near_dup import near_duplicates
from quern.llm.sharding import shard

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BLOCK_WORDS = 512

_helpers: dict[str, list[str]] = {}


def _stage(after: str | None) -> Callable[[Stage], Stage]:
    """A stage's docs are stored, so the helper tables of the stage before are no longer needed.

    Those of the last stage stay, as its result may be read at any time.
    """

    def wrap(function: Stage) -> Stage:
        @wraps(function)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            release(spark, _helpers.pop(after, []))
            with noted() as paths:
                out = function(spark, docs, sf_dir)
            _helpers.setdefault(function.__name__, []).extend(paths)
            return out

        return run_stage

    return wrap


@_stage(after=None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


@_stage(after="quality")
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_stage(after="near_dedup")
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage(after="decontamination")
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixed(docs, block_words=BLOCK_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage(after="mixture")
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs, keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_sources", mixture),
    ("sharding", shards),
]

#: The stages can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark).rstrip('/')}/quern-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        schema = out.schema
        out.write.parquet(f"{top}/{name}")
        docs = spark.read.schema(schema).parquet(f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
