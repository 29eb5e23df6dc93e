"""Token and sentence tables of documents.

There is no parser here: the head of a token is the next token of its sentence, the last one is the root (-1), and a word
of letters longer than three, or one with a capital, counts as a noun.  A real parser's output (see sources.parser) gives
the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import workspace
from textloom.functions import text as T

#: sentence numbers of a chunk stay below this
SENTENCES_PER_CHUNK = 1_000_000


def sentence_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk_idx, sent_idx, sent_uid, sentence): without a shuffle, as numbers come from positions in the document."""
    rows = docs.select(F.col(key).alias("chunk_idx"), F.posexplode(T.sentences(F.col(text))).alias("sent_idx", "sentence"))
    return rows.select("chunk_idx", "sent_idx", (F.col("chunk_idx") * SENTENCES_PER_CHUNK + F.col("sent_idx")).alias("sent_uid"), "sentence")


def token_table(sentences: DataFrame) -> DataFrame:
    """(sent_uid, chunk_idx, pos, word, head_pos, head_word): heads are stored beside their tokens, so no self-join."""
    ws = T.words(F.col("sentence"))
    rows = sentences.select("sent_uid", "chunk_idx", ws.alias("ws"))
    n = F.size("ws")
    rows = rows.select("sent_uid", "chunk_idx", "ws", F.posexplode("ws").alias("pos", "word"))
    last = F.col("pos") == n - 1
    return rows.select(
        "sent_uid",
        "chunk_idx",
        "pos",
        "word",
        F.when(last, F.lit(-1)).otherwise(F.col("pos") + 1).alias("head_pos"),
        F.when(~last, F.get("ws", F.col("pos") + 1)).alias("head_word"),
    )


def is_noun(word: Column) -> Column:
    return word.rlike("^[A-Z]") | word.rlike("^[A-Za-z]{4,}$")


def dense_numbers(sentences: DataFrame, first: int = 0) -> DataFrame:
    """(sent_uid, sent_no): dense numbers of sentences (chunk_idx, sent_uid) in order, continuing from ``first``.

    Sentences are sorted in ranges and numbered as they are written; a range then starts at the size of those before it, so
    no task sorts all rows and nothing is joined but the few sizes.
    """
    order = [F.col("chunk_idx").asc_nulls_last(), F.col("sent_uid").asc_nulls_last()]
    ranged = sentences.select("chunk_idx", "sent_uid").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    # part << 33 | place; written, as a range's number holds for one run alone
    ranged = workspace.materialise(ranged.select("sent_uid", F.monotonically_increasing_id().alias("at")), "ranged")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    totals = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return ranged.withColumn("part", part).join(F.broadcast(totals), "part").select("sent_uid", (F.col("base") + place + first).alias("sent_no"))


def dense_sentence_uid(tokens: DataFrame, first: int = 0) -> DataFrame:
    """sent_no: dense numbers of sentences in order of (chunk, sentence), continuing from ``first``, beside every token."""
    return tokens.join(dense_numbers(tokens, first), "sent_uid")


def ngram_rows(df: DataFrame, ws: str, n: int) -> DataFrame:
    """(gram): a row per run of n words of the word list; the words are joined after the explode, in generated code."""
    count = F.size(ws) - (n - 1)
    shifted = F.arrays_zip(*[F.slice(ws, i + 1, count).alias(f"w{i}") for i in range(n)])
    return df.filter(F.size(ws) >= n).select(F.explode(shifted).alias("z")).select(F.concat_ws(" ", *[F.col(f"z.w{i}") for i in range(n)]).alias("gram"))


def context_pairs(tokens: DataFrame, k: int) -> DataFrame:
    """(sent_uid, pos, word, context): every word with the words at most k positions away in its sentence, itself excluded."""
    per = tokens.groupBy("sent_uid").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("ws"))
    # positions of a token table may have gaps, so they are compared and not counted
    each = per.select("sent_uid", "ws", F.explode("ws").alias("t"))
    lo = F.greatest(F.col("t.pos") - k, F.lit(0))
    near = F.filter(F.slice("ws", lo + 1, 2 * k + 1), lambda x: (x.pos != F.col("t.pos")) & (x.pos <= F.col("t.pos") + k))
    return each.select("sent_uid", F.col("t.pos").alias("pos"), F.col("t.word").alias("word"), F.explode(near).alias("c")).select("sent_uid", "pos", "word", F.col("c.word").alias("context"))


def contexts(sentences: DataFrame, k: int) -> DataFrame:
    """(sent_uid, pos, word, context) as by ``context_pairs``, of whole word lists (sent_uid, ws): without a shuffle."""
    each = sentences.select("sent_uid", "ws", F.posexplode("ws").alias("pos", "word"))
    before = F.slice("ws", F.greatest(F.col("pos") - k, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(k)))
    after = F.slice("ws", F.col("pos") + 2, k)
    return each.select("sent_uid", "pos", "word", F.explode(F.concat(before, after)).alias("context"))


def consecutive_ranges(df: DataFrame, key: str, order: str, within: str) -> DataFrame:
    """(within, key, begin, end): runs of equal keys in order, half open."""
    w = Window.partitionBy(within).orderBy(order)
    flag = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    runs = df.withColumn("_tx_flag", flag).withColumn("run", F.sum("_tx_flag").over(w))
    return runs.groupBy(within, "run", key).agg(F.min(order).alias("begin"), (F.max(order) + 1).alias("end"))
