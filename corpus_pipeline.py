"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are cut
out, documents are taken at rates that meet domain targets, and what is left is encoded.

Every stage takes any table with the columns of `documents`, whatever further columns are called; all but
the last return its columns. An empty table gives an empty result. Null texts count as empty ones: they
are not toxic, are in no group, lose nothing, have no tokens. Rows without a doc_id are rows like any
other; repeated rows are told apart where that matters (see each stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlake.llm.bpe import encode_decode, public_vocabulary
from voxlake.llm.common import forget, stored, table
from voxlake.llm.jaccard import keep_one_each
from voxlake.llm.mixing import domains_of_labels, mixed
from voxlake.llm.suffixes import drop_repeats
from voxlake.llm.toxicity import reject_toxic

#: Target shares of the token budget (of the labelled rows about a tenth of the tokens is low), and the budget in units of the tokens at hand.
TARGETS, BUDGET = {"high": 0.95, "low": 0.05}, 1.0


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.3 or more go, repeated ones together; labels of the held-out fold are not looked at."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest doc_id, null last, then text hash; texts without words all stay."""
    return keep_one_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur elsewhere are cut out of text; rows stay even if nothing of their text does."""
    return drop_repeats(docs)


def at_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is taken as often as its rate says; repeated ids share their mean rate, rows without an id are taken once."""
    labelled = domains_of_labels(table(spark, sf_dir, "labels")).filter("domain <> 'toxic'")
    return mixed(docs, labelled, TARGETS, BUDGET)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and digests, and whether the text came back, for every row."""
    return encode_decode(docs, public_vocabulary(), with_ids=True).drop("decoded")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("mixing", at_target_weights),
    ("bpe", encoded),
]
#: The stages learn, search and iterate; tests/llm checks them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    held = None
    for name, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir), name), held
        held = docs
        if before is not None:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
