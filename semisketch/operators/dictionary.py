"""A growing dictionary of token vectors.

A bucketed table: tokens lie in files by the hash of the token, so a join with other
tokens moves those alone, never the dictionary, and loads that bring the same tokens
again compute nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import Encoding, token_vector
from ..session import materialize


@dataclass(frozen=True)
class TokenDictionary:
    """Vectors of one length and encoding in the table ``name``, kept under ``path`` where
    one is given.  ``buckets`` is set by the first load.  One writer at a time."""

    spark: SparkSession
    name: str
    length: int
    encoding: Encoding = Encoding()
    buckets: int = 64
    path: str | None = None

    def vectors(self) -> DataFrame:
        """``(token, vec)``, each token once."""
        if self.spark.catalog.tableExists(self.name):
            return self.spark.table(self.name)
        return self.spark.createDataFrame([], "token string, vec array<double>")

    def add(self, tokens: DataFrame) -> int:
        """Add the tokens (column ``token``) that are not in the dictionary, and return
        how many they are; only their vectors are computed.  Nulls are passed over."""
        wanted = tokens.select("token").where("token is not null").distinct()
        if self.spark.catalog.tableExists(self.name):
            wanted = wanted.hint("shuffle_hash").join(self.vectors().select("token"), "token", "left_anti")
        new = materialize(wanted)
        count = new.count()
        if count or not self.spark.catalog.tableExists(self.name):
            rows = new.select("token", token_vector(F.col("token"), self.length, self.encoding).alias("vec"))
            # one file a bucket for each load
            rows = rows.repartition(self.buckets, "token")
            writer = rows.write.mode("append").format("parquet").bucketBy(self.buckets, "token").sortBy("token")
            (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)
        return count

    def of(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` with their ``vec``; the dictionary stays where it is."""
        return tokens.hint("merge").join(self.vectors(), "token")
