"""Frequency of every distinct term, kept up to date by signed deltas.

A ``TermCounts`` store holds, per (field, term), the number of occurrences and of records, in persistent buckets by a
hash of the term, and per field the number of records.  A change set brings records that were added (+1) or deleted
(-1); a changed record is both.  ``apply`` reads the change set once, reduces it to one signed row per term, map-side
first, and merges it with the buckets that it touches; other buckets keep their files.  The whole collection is never
counted again.

The state is in the folder alone: a manifest names, for a version, the number of buckets and the folder of each.  A
version is committed by renaming its manifest into place, which fails if another writer has committed that version;
whoever opens the path sees the newest version, and an ``apply`` that broke off leaves no trace in it.  ``vacuum``
deletes folders that the newest version does not use.

Defined cases: a null text counts as a record without terms; an empty or blank text too; a term may be any length;
repeated terms count as occurrences but once as a record; terms whose counts return to zero leave the store; an empty
change set leaves it as it was; clashing names of further columns do not matter, as only the named columns are read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import workspace

#: ASCII white space, the only separator of terms
WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def white_space_terms(text: Column) -> Column:
    """Terms of a text, split at ASCII white space, case kept."""
    return F.array_remove(F.split(text, WHITE), "")


def changes(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(text, sign) that turn snapshot ``old`` into ``new``: -1 for deleted and changed, +1 for added and changed."""
    a = old.select(F.col(key).alias("k"), F.col(text).alias("was"), F.lit(True).alias("in_old"))
    b = new.select(F.col(key).alias("k"), F.col(text).alias("is"), F.lit(True).alias("in_new"))
    both = a.join(b, "k", "full").filter(F.col("in_old").isNull() | F.col("in_new").isNull() | ~F.col("was").eqNullSafe(F.col("is")))
    signed = F.array(
        F.when(F.col("in_old"), F.struct(F.col("was").alias("text"), F.lit(-1).alias("sign"))),
        F.when(F.col("in_new"), F.struct(F.col("is").alias("text"), F.lit(1).alias("sign"))),
    )
    return both.select(F.explode(F.filter(signed, lambda x: x.isNotNull())).alias("c")).select("c.text", "c.sign")


def term_deltas(change: DataFrame) -> DataFrame:
    """One row per (field, term): signed change of occurrences and of records; a null term counts the records themselves.

    change: field, terms, sign.
    """
    s = F.sort_array("terms")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    terms = F.when(F.size("terms") > 0, F.arrays_zip(s.alias("t"), before.alias("p")))
    record = F.array(F.struct(F.lit(None).cast("string").alias("t"), F.lit("").alias("p")))
    each = change.select("field", "sign", F.explode(F.concat(record, F.coalesce(terms, F.slice(record, 1, 0)))).alias("x"))
    first = F.when(F.col("x.t").eqNullSafe(F.col("x.p")), 0).otherwise(F.col("sign"))
    return each.groupBy("field", F.col("x.t").alias("term")).agg(F.sum("sign").alias("occurrences"), F.sum(first).alias("records"))


class TermCounts:
    """Persistent partitioned counts; each ``apply`` writes a new version of the touched buckets."""

    COLUMNS = ("field", "term", "occurrences", "records")
    SCHEMA = "field string, term string, occurrences long, records long"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Opens the newest version at the path; a store that is not there yet has no terms.

        ``buckets`` counts for a new store alone.  Its default are the shuffle partitions: a task of the final aggregation
        then holds whole buckets, so each is written once and without another shuffle.
        """
        self.spark, self.path = spark, path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.buckets = 0, {}
        self.n_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(path))] if self._fs.exists(self._at(path)) else []
        versions = sorted(x for x in names if x.startswith("manifest-"))
        if versions:
            got = json.loads(spark.read.text(f"{path}/{versions[-1]}", wholetext=True).first()[0])
            self.version, self.n_buckets = got["version"], got["n_buckets"]
            self.buckets = {int(k): v for k, v in got["buckets"].items()}  # bucket -> its folder below the path

    def _at(self, path: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _commit(self, version: int, buckets: dict[int, str]) -> None:
        draft, final = self._at(f"{self.path}/v{version}/manifest"), self._at(f"{self.path}/manifest-{version:010d}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "n_buckets": self.n_buckets, "buckets": buckets}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")
        self.version, self.buckets = version, buckets

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows of some buckets, or of all; the null term counts records."""
        folders = sorted(f for b, f in self.buckets.items() if buckets is None or b in buckets)
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def counts(self) -> DataFrame:
        return self._rows().filter(F.col("term").isNotNull())

    def record_totals(self) -> DataFrame:
        """(field, n) - a row per field."""
        return self._rows().filter(F.col("term").isNull()).select("field", F.col("records").alias("n"))

    def apply(self, change: DataFrame) -> TermCounts:
        """Merges a change set (field, terms array<string>, sign) into the store."""
        version = self.version + 1
        bucket = F.pmod(F.hash("field", "term"), F.lit(self.n_buckets))
        merged = delta = term_deltas(change)
        touched: list[int] = []
        if self.buckets:
            delta = workspace.materialise(delta, "delta")
            touched = [r[0] for r in delta.select(bucket.alias("b")).distinct().collect()]  # at most n_buckets numbers
            merged = delta.unionByName(self._rows(touched)).groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        merged = merged.filter((F.col("occurrences") != 0) | (F.col("records") != 0))
        home = f"v{version}-{uuid.uuid4().hex[:8]}"
        merged.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.path}/{home}")
        there = [x.getPath().getName() for x in self._fs.listStatus(self._at(f"{self.path}/{home}"))]
        kept = {b: f for b, f in self.buckets.items() if b not in set(touched)}
        self._commit(version, kept | {int(x[7:]): f"{home}/{x}" for x in there if x.startswith("bucket=")})
        workspace.discard(delta)
        return self

    def vacuum(self) -> None:
        """Deletes the folders of buckets, and the manifests, that the newest version does not use."""
        used = set(self.buckets.values())
        for at in self._fs.listStatus(self._at(self.path)):
            name = at.getPath().getName()
            if name.startswith("manifest-"):
                if int(name[9:]) < self.version:
                    self._fs.delete(at.getPath(), False)
                continue
            inside = [x.getPath() for x in self._fs.listStatus(at.getPath()) if x.getPath().getName().startswith("bucket=")]
            for p in inside:
                if f"{name}/{p.getName()}" not in used:
                    self._fs.delete(p, True)
            if not any(f.startswith(f"{name}/") for f in used):
                self._fs.delete(at.getPath(), True)

    def marked(self, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
        """Counts with ``mark``: rare (fewer occurrences than rare_below), else common (in more than common_share of the
        field's records), else null."""
        # one row per field, so the broadcast side is bounded by the number of fields
        both = self.counts().join(F.broadcast(self.record_totals()), "field")
        mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > common_share * F.col("n"), "common")
        return both.withColumn("mark", mark)
