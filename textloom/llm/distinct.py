"""How distinctive a term is per record: tf * idf and residual inverse document frequency.

For every record and term: tf (occurrences in the record), df (rows with the term), cf (occurrences in all), D
(rows whose field is not null), and

* ``observed`` = ln(D / df), the inverse document frequency;
* ``expected`` = -ln(1 - exp(-cf / D)), what a Poisson spread of the cf occurrences over D records would give;
* ``tf_idf`` = tf * observed and ``residual`` = tf * (observed - expected), which rewards terms that are concentrated in
  few records.

Statistics cover all records.  Counting aggregates map-side before its shuffle.  For scoring, texts are hashed by record
once, so term frequencies and the ranking within a record need no further shuffle.  Keys that occur more than once are
found by their keys alone; the texts of such a record are counted map-side and not brought to one task.  The table of term statistics is
broadcast if it has at most ``broadcast_terms`` rows; beyond that the terms that are in more than a 1 / ``hot_shares``
share of the records (their number is bounded by that share and the mean length of a record) are broadcast and all others
joined by a shuffle in which no term can be hot.

Defined cases: null texts are no records; a text without letters has no terms; a term in fewer than ``min_df`` records
does not compete; equal scores (rounded to 6 digits) go to the term that sorts first by code point; the rows of a repeated
key are ranked as one record, whose tf counts all their texts, while df and D count rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import workspace


def letter_terms(text: Column) -> Column:
    """Maximal runs of letters (Unicode category L)."""
    return F.regexp_extract_all(text, F.lit("(\\p{L}+)"), F.lit(1))


def _repeated(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Records of keys that occur once, and those of keys that occur more often, if there are such."""
    keys = records.groupBy("src_field", "rec_key").agg(F.count("*").alias("_tx_n")).filter("_tx_n > 1").drop("_tx_n")
    keys = workspace.materialise(keys, "repeated-keys")
    if keys.isEmpty():
        return records, None
    same = records.src_field.eqNullSafe(keys.src_field) & records.rec_key.eqNullSafe(keys.rec_key)
    return records.join(keys, same, "left_anti"), records.join(keys, same, "left_semi")


def _counted(records: DataFrame) -> DataFrame:
    """(src_field, rec_key, term, tf), counted map-side first."""
    terms = records.select("src_field", "rec_key", F.explode(letter_terms(F.col("text"))).alias("term"))
    return terms.groupBy("src_field", "rec_key", F.lower("term").alias("term")).agg(F.count("*").alias("tf"))


def term_statistics(records: DataFrame, min_df: int) -> DataFrame:
    """(src_field, term, df, cf) of terms in at least min_df rows.  records: src_field, rec_key, text."""
    s = F.sort_array("t")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    terms = records.select("src_field", F.transform(letter_terms(F.col("text")), F.lower).alias("t"))
    each = terms.filter(F.size("t") > 0).select("src_field", F.explode(F.arrays_zip(s.alias("t"), before.alias("p"))).alias("x"))
    new = F.when(F.col("x.t").eqNullSafe(F.col("x.p")), 0).otherwise(1)
    return each.groupBy("src_field", F.col("x.t").alias("term")).agg(F.sum(new).alias("df"), F.count("*").alias("cf")).filter(F.col("df") >= min_df)


def distinctive_terms(
    records: DataFrame,
    top: int = 3,
    min_df: int = 3,
    by: str = "residual",
    broadcast_terms: int = 500_000,
    hot_shares: int = 200,
) -> DataFrame:
    """(src_field, rec_key, term, tf, df, cf, tf_idf, residual, rank) of the ``top`` terms by ``by`` of every record."""
    records = records.filter(F.col("text").isNotNull())
    once, often = _repeated(records.select("src_field", "rec_key", "text"))
    sizes = records.groupBy("src_field").agg(F.count("*").cast("double").alias("n"))  # a row per field
    stats = term_statistics(records, min_df).join(F.broadcast(sizes), "src_field")
    observed = F.log(F.col("n") / F.col("df"))
    expected = -F.log1p(-F.exp(-F.col("cf") / F.col("n")))
    stats = stats.select("src_field", "term", "df", "cf", observed.alias("observed"), (observed - expected).alias("over"), (F.col("df") / F.col("n")).alias("share"))
    stats = workspace.materialise(stats, "term-stats")
    tf = _counted(once.repartition("src_field", "rec_key"))
    if often is not None:
        tf = tf.unionByName(_counted(often))
    on = ["src_field", "term"]
    if stats.count() <= broadcast_terms:
        joined = tf.join(F.broadcast(stats), on)
    else:
        # at most hot_shares * (mean number of terms of a record) terms per field
        hot = stats.filter(F.col("share") > 1 / hot_shares)
        rare = stats.filter(F.col("share") <= 1 / hot_shares)
        joined = tf.join(F.broadcast(hot), on).unionByName(tf.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rare, on))
    scored = joined.select(
        "src_field",
        "rec_key",
        "term",
        "tf",
        "df",
        "cf",
        F.round(F.col("tf") * F.col("observed"), 6).alias("tf_idf"),
        F.round(F.col("tf") * F.col("over"), 6).alias("residual"),
    )
    w = Window.partitionBy("src_field", "rec_key").orderBy(F.col(by).desc(), F.col("term").asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
