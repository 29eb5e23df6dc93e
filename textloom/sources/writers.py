"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom import workspace


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token columns as one columnar table; readers prune to the columns that they need."""
    tokens.write.mode("overwrite").parquet(path)


def write_blocks(annotated: DataFrame, path: str, blocks: int) -> None:
    """Annotation in blocks of sentences, sorted by sentence and token within."""
    annotated.repartitionByRange(blocks, "sent_uid").sortWithinPartitions("sent_uid", "token_pos").write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def libsvm_lines(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(value): 'label 1:x 2:y ...' with the components that are not 0."""
    parts = F.filter(F.transform(vector, lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), lambda p: p.x != 0)
    return df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p.i.cast("string"), p.x.cast("string"))), " ")).alias("value"))


def convert(df: DataFrame, casts: dict[str, str], path: str) -> None:
    """Writes with other column types."""
    df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()}).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by a key: later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)


def chunk_index(rows: DataFrame, column: str, row: str, idx: str) -> DataFrame:
    """(chunk_idx, column_uid, row_uid, row_idx): where every chunk of text comes from, numbered from 0 in order of column and row.

    Numbers come from written ranges: the sizes of the ranges are few, and ranks are taken within a range.
    """
    ranged = rows.select(F.col(column).alias("column_uid"), F.col(row).alias("row_uid"), F.col(idx).alias("row_idx")).repartitionByRange("column_uid", "row_uid")
    ranged = workspace.materialise(ranged.withColumn("part", F.spark_partition_id()), "chunks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("column_uid", "row_uid", "row_idx")) - 1
    return ranged.withColumn("k", rank).join(F.broadcast(bases), "part").select((F.col("base") + F.col("k")).alias("chunk_idx"), "column_uid", "row_uid", "row_idx")


def write_chunk_index(rows: DataFrame, column: str, row: str, idx: str, path: str) -> None:
    chunk_index(rows, column, row, idx).write.mode("overwrite").parquet(path)
