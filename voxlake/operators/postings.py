"""A stored trigram index: posting blocks of sorted packed places, hot trigrams split by ranges of places, intersected block by block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from voxlake.operators.search import FIELD_COLUMNS, _grams, terms_of

#: Places of a range: a block holds at most 2**RANGE_BITS of them, two bytes each.
RANGE_BITS = 16
BUCKETS = 64


@F.pandas_udf(BinaryType())
def _packed(places: pd.Series) -> pd.Series:
    return places.map(lambda p: np.sort(np.asarray(p, np.uint16)).tobytes())


def _places(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint16)


@dataclass
class TrigramIndex:
    """The index below a folder of the shared store. Documents are numbered by place; texts lie in the order of places, so that few are read.

    documents: (place, and all columns of the folded documents); blocks: (trigram, field, range, n, places), partitioned by bucket, sorted by trigram.
    """

    spark: SparkSession
    path: str

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def build(self, documents: DataFrame) -> TrigramIndex:
        """Number and store folded documents, and the blocks of their fields' trigrams. A block is one group, bounded by its range whatever the trigram."""
        documents.withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{self.path}/documents")
        fields = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("field"), F.col(f"{c}_fold").alias("text")) for i, c in enumerate(FIELD_COLUMNS)))).alias("f")
        grams = self.documents.select("place", fields).filter(F.length("f.text") >= 3).select("place", "f.field", F.explode(_grams("f.text")).alias("trigram"))
        low = F.col("place").bitwiseAND((1 << RANGE_BITS) - 1).cast("int")
        blocks = grams.groupBy("trigram", "field", F.shiftright("place", RANGE_BITS).alias("range")).agg(F.collect_list(low).alias("p"))
        blocks = blocks.select("trigram", "field", "range", F.size("p").alias("n"), _packed("p").alias("places"), F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        blocks.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "trigram", "field", "range").write.partitionBy("bucket").parquet(f"{self.path}/blocks")
        return self

    def candidates(self, query: str) -> DataFrame:
        """place of documents of which each term of three characters or more has all its trigrams in one field; shorter terms narrow nothing.

        Reads the query's trigrams from their buckets. For each range of places one group intersects and unites its blocks, so the work of
        a hot trigram is spread over ranges.
        """
        terms = [t for t in terms_of(query) if len(t) >= 3]
        if not terms:
            return self.documents.select("place")
        grams = {t: sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in terms}
        wanted = sorted({g for gs in grams.values() for g in gs})
        buckets = self.spark.createDataFrame([(g,) for g in wanted], "trigram string").select(F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int")).distinct()
        held = self.blocks.filter(F.col("trigram").isin(wanted) & F.col("bucket").isin([r[0] for r in buckets.collect()])).select("range", "trigram", "field", "places")

        def meet(df: pd.DataFrame) -> pd.DataFrame:
            blocks = {(g, f): _places(p) for g, f, p in zip(df["trigram"], df["field"], df["places"])}
            found = None
            for gs in grams.values():
                either = np.empty(0, np.uint16)
                for field in range(len(FIELD_COLUMNS)):
                    own = [blocks.get((g, field)) for g in gs]
                    if all(o is not None for o in own):
                        all_of = own[0]
                        for o in sorted(own[1:], key=len):
                            all_of = np.intersect1d(all_of, o, assume_unique=True)
                        either = np.union1d(either, all_of)
                found = either if found is None else np.intersect1d(found, either, assume_unique=True)
            return pd.DataFrame({"place": (int(df["range"].iloc[0]) << RANGE_BITS) + found.astype(np.int64)})

        return held.groupBy("range").applyInPandas(meet, "place long")

    def matching(self, query: str) -> DataFrame:
        """The stored documents that candidates() leaves: only their rows are read again for the exact tests, which the caller makes."""
        return self.documents.join(self.candidates(query), "place", "left_semi")
