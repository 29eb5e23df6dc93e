"""Top N items within every group by statistics-guided skipping.

1. *Cluster.* The rows are range-partitioned and sorted by (group, score descending, item) and written with small row
   groups.  A group of any size spreads over as many partitions as its rows need, so no task holds a whole group.  The
   clustered table is kept as long as its ``Clustered`` object and answers any number of calls, with any N.
2. *Index.* The footers of the files give, per row group, the lowest and highest group key and the maximum score.
3. *Waves.* Row groups are read in descending maximum score within their group, in waves of 1, 1, 2, 4, 8 ... row
   groups.  Before a wave, each row group whose maximum is strictly below the current N-th score of every group that it
   contains is skipped; a row group with equal maximum is read, because the tie rule may prefer its items.  A group
   of which nothing has been read has no N-th score yet, and a row group that holds several groups holds the first rows of
   all but its first one, so all such row groups are in the first wave; what can be skipped are the later row groups of
   groups larger than a row group.  That is why row groups are small.

Only N rows per group and row group leave a task.  Defined cases: rows with a null group or item, or a score that is
null, NaN, infinite or not above ``floor`` never count; an item that occurs more than once in a group has the highest of
its scores; equal scores go to the smaller item; a group with fewer than N items gives them all; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import workspace


#: bytes of a row group: the smallest stretch of a group that can be skipped
ROW_GROUP = 128 << 10


def cluster_by_group(df: DataFrame, path: str, row_group_bytes: int = ROW_GROUP) -> None:
    """Writes (grp, item, score) sorted by group, descending score and item, in small row groups."""
    order = [F.col("grp").asc(), F.col("score").desc(), F.col("item").asc()]
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", max(4096, row_group_bytes // 8))
        .parquet(path)
    )


def _open(uri: str):  # noqa: ANN202
    """An Arrow input file of a Hadoop-style URI, on whatever file system the shared folder is."""
    from pyarrow import fs

    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(hadoop):
            uri = arrow + uri[len(hadoop) :]
    where, name = fs.FileSystem.from_uri(uri)
    return where.open_input_file(name)


def row_group_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, rg, n_rows, n_bytes, lo, hi, top) of every row group, read from the footers by the executors."""
    files = spark.read.parquet(path).inputFiles()
    key = dict(spark.read.parquet(path).dtypes)["grp"]

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for pdf in batches:
            out = []
            for uri in pdf.path:
                with _open(uri) as f:
                    meta = pq.ParquetFile(f).metadata
                cols = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
                for k in range(meta.num_row_groups):
                    g = meta.row_group(k)
                    grp, top = g.column(cols["grp"]).statistics, g.column(cols["score"]).statistics
                    out.append((uri, k, g.num_rows, g.total_byte_size, grp.min, grp.max, top.max))
            yield pd.DataFrame(out, columns=["path", "rg", "n_rows", "n_bytes", "lo", "hi", "top"])

    listed = spark.createDataFrame([(x,) for x in files], "path string")
    n = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    return listed.repartition(n).mapInPandas(footers, f"path string, rg int, n_rows long, n_bytes long, lo {key}, hi {key}, top double")


def _read_row_groups(chosen: DataFrame, schema: str, n: int, tasks: int) -> DataFrame:
    """The best n items of every group within each chosen row group."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for pdf in batches:
            for uri, mine in pdf.groupby("path", sort=False):
                with _open(uri) as f:
                    pf = pq.ParquetFile(f)
                    for rg in mine.rg:
                        rows = pf.read_row_group(rg, columns=["grp", "item", "score"], use_threads=False).to_pandas()
                        # sorted by descending score: the first of equal items has the highest score
                        rows = rows.drop_duplicates(["grp", "item"])
                        yield rows[rows.groupby("grp").cumcount() < n]

    spread = chosen.select("path", "rg").repartition(tasks, "path", "rg")
    return spread.mapInPandas(read, schema)


class Clustered:
    """A clustered copy of scored rows with its index, in the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        types = dict(spark.read.parquet(f"{path}/rows").dtypes)
        self.schema = f"grp {types['grp']}, item {types['item']}, score double"
        self.index = spark.read.parquet(f"{path}/index")
        #: row groups, their rows and bytes: of the table, and read by the last call
        self.whole = self._size(self.index)
        self.read = (0, 0, 0)

    @classmethod
    def build(cls, df: DataFrame, group: str, item: str, score: str, floor: float = 0.0, row_group_bytes: int = ROW_GROUP) -> Clustered:
        spark = df.sparkSession
        s = F.col(score).cast("double")
        rows = df.select(F.col(group).alias("grp"), F.col(item).alias("item"), s.alias("score")).filter(
            F.col("grp").isNotNull() & F.col("item").isNotNull() & (F.col("score") > floor) & (F.col("score") < float("inf"))
        )
        path = workspace.new_dir(spark, "topn")
        cluster_by_group(rows.filter(~F.isnan("score")), f"{path}/rows", row_group_bytes)
        # the rank of a row group among those that hold one group alone; the others belong to the first wave
        by_top = Window.partitionBy("lo", "hi").orderBy(F.col("top").desc(), "path", "rg")
        index = row_group_index(spark, f"{path}/rows").withColumn("nth", F.when(F.col("lo") == F.col("hi"), F.row_number().over(by_top)).otherwise(F.lit(1)))
        index = index.withColumn("wave", F.when(F.col("nth") == 1, 0).otherwise(F.floor(F.log2(F.col("nth") - 1)).cast("int") + 1))
        index.write.parquet(f"{path}/index")
        return cls(spark, path)

    @staticmethod
    def _size(index: DataFrame) -> tuple[int, int, int]:
        got = index.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
        return got[0], got[1], got[2]

    def top(self, n: int) -> DataFrame:
        """(grp, item, score, rank) of the n best items of every group, in a table of its own."""
        best_path = workspace.new_dir(self.spark, "topn-best")
        waves = dict(self.index.groupBy("wave").agg(F.count("*")).collect())  # a few numbers: waves double in size
        self.read = (0, 0, 0)
        done: list[int] = []

        def parts() -> DataFrame:
            return self.spark.read.schema(self.schema).parquet(*[f"{best_path}/wave={w}" for w in done])

        for wave in sorted(waves):
            chosen = self.index.filter(F.col("wave") == wave)
            if done:  # each row group of a later wave holds one group, of which the first wave read the best
                nth = _best(parts(), n).groupBy("grp").agg(F.min("score").alias("nth_score"), F.count("*").alias("n"))
                nth = nth.filter(F.col("n") >= n).select("grp", "nth_score")
                chosen = chosen.join(nth, chosen.lo == nth.grp, "left").filter(F.col("nth_score").isNull() | (F.col("top") >= F.col("nth_score")))
                chosen = workspace.materialise(chosen.select("path", "rg", "n_rows", "n_bytes"), "topn-wave")
            size = self._size(chosen)
            self.read = tuple(a + b for a, b in zip(self.read, size, strict=True))
            if size[0]:
                tasks = max(1, min(size[0], self.spark.sparkContext.defaultParallelism * 8))
                _read_row_groups(chosen, self.schema, n, tasks).write.parquet(f"{best_path}/wave={wave}")
                done.append(wave)
            workspace.discard(chosen)
            if not size[0]:
                break  # the row groups of later waves have no greater maxima
        if not done:
            return self.spark.createDataFrame([], f"{self.schema}, rank int")
        return _best(parts(), n)

    def remove(self) -> None:
        """Deletes the clustered table; results of ``top`` stay."""
        workspace.remove(self.spark, self.path)


def top_n_per_group(
    df: DataFrame, group: str, item: str, score: str, n: int = 5, floor: float = 0.0, row_group_bytes: int = ROW_GROUP
) -> DataFrame:
    """(group, item, score, rank) of the n best items of every group; see the module's text for the defined cases."""
    rows = Clustered.build(df, group, item, score, floor, row_group_bytes)
    best = rows.top(n)
    rows.remove()
    return best.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")


def _best(parts: DataFrame, n: int) -> DataFrame:
    one = parts.groupBy("grp", "item").agg(F.max("score").alias("score"))
    w = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("item").asc())
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
