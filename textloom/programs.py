"""Whole programs over a table of texts: indexing, annotating, and a stress workload."""

from __future__ import annotations

import time
from collections.abc import Iterable
from itertools import cycle, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import entities, importance, tokens, vocabulary
from textloom.session import Session
from textloom.sources import writers
from textloom.workspace import materialise


def index_texts(rows: DataFrame, column: str, row: str, idx: str, text: str, path: str) -> dict[str, int]:
    """Writes below the path: chunks (chunk_idx and where it comes from), sentences, tokens and vocabulary (word, n, df).

    Each text is a chunk; empty and null ones have no sentences but keep their chunk.  Returns the numbers of rows.
    """
    spark = rows.sparkSession
    writers.write_chunk_index(rows, column, row, idx, f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    texts = rows.select(F.col(column).alias("column_uid"), F.col(row).alias("row_uid"), F.col(idx).alias("row_idx"), F.col(text).alias("text"))
    texts = texts.join(chunks, ["column_uid", "row_uid", "row_idx"]).filter("text is not null")
    sentences = tokens.sentence_table(texts, "chunk_idx", "text")
    sentences.write.mode("overwrite").parquet(f"{path}/sentences")
    sentences = spark.read.parquet(f"{path}/sentences")
    writers.write_tokens(tokens.token_table(sentences), f"{path}/tokens")
    words = spark.read.parquet(f"{path}/tokens").groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("chunk_idx").alias("df"))
    words.write.mode("overwrite").parquet(f"{path}/vocabulary")
    return {t: spark.read.parquet(f"{path}/{t}").count() for t in ("chunks", "sentences", "tokens", "vocabulary")}


def annotate_texts(sentences: DataFrame, names: DataFrame, instances: DataFrame, word_scores: DataFrame, listed: DataFrame, path: str, blocks: int = 16) -> dict[str, int]:
    """Writes below the path: spans (entities of sentences that stay, in blocks of sentences) and postings (entity_uid,
    sent_uid, token_pos, score of an entity, its classes included).

    sentences: sent_uid, sentence.  names: entity_uid, ws.  instances: entity_uid, class_uid.  word_scores: word, score.
    listed: entity_uid that are named entities by a list.
    """
    spark = sentences.sparkSession
    s = sentences.select("sent_uid", X.words(F.col("sentence")).alias("ws"))
    found = materialise(entities.annotate(s, names), "spans")
    named = entities.named_entities(names, listed).filter("named").select("entity_uid")
    nouns = s.select("sent_uid", F.posexplode("ws").alias("token_pos", "word")).filter(tokens.is_noun(F.col("word"))).select("sent_uid", "token_pos")
    kept = entities.keep_true_entities(found, named, nouns)
    writers.write_blocks(kept, f"{path}/spans", blocks)
    spans = spark.read.parquet(f"{path}/spans")
    postings = entities.candidate_postings(spans, entities.best_name_score(names, word_scores))
    entities.with_instances(postings, instances, names).write.mode("overwrite").parquet(f"{path}/postings")
    return {t: spark.read.parquet(f"{path}/{t}").count() for t in ("spans", "postings")}


def stress(session: Session, phrases: Iterable[str], n: int = 1000, k: int = 5) -> dict[str, float]:
    """Asks n queries, the phrases again and again, as one plan; how many were answered, and in how many seconds.

    A phrase that comes again is a query of its own: the session's numbers are not reused.
    """
    asked = list(islice(cycle(phrases), n))
    began = time.perf_counter()
    rows = session.spark.createDataFrame([(i, i, p) for i, p in enumerate(asked)], "sent_uid long, chunk_idx long, sentence string")
    q = vocabulary.with_default(tokens.token_table(rows), session.importance, "word", "score", 0.0)
    heads = session.importance.select(F.col("word").alias("head_word"), F.col("score").alias("head_score"))
    q = q.join(heads, "head_word", "left").withColumn("head_score", F.coalesce("head_score", F.lit(0.0)))
    words = q.select(F.col("sent_uid").alias("q"), F.col("pos").alias("q_pos"), "word", "score", "head_word", "head_score")
    from textloom.operators import search

    found = search.find_similar_sentences(words, session.similar(words), session.tokens, k=k)
    answered, results = found.agg(F.countDistinct("q"), F.count("*")).first()
    return {"queries": len(asked), "answered": answered, "results": results, "seconds": round(time.perf_counter() - began, 3)}


def correct_many(session: Session, words: Iterable[str], dictionary: DataFrame, n: int = 50_000) -> dict[str, float]:
    """Corrects the case of n words, those given again and again; how many changed, and in how many seconds."""
    from textloom.operators import render

    asked = list(islice(cycle(words), n))
    began = time.perf_counter()
    rows = session.spark.createDataFrame(list(enumerate(asked)), "q long, word string").withColumn("pos", F.lit(0))
    scored = rows.join(session.importance.select("word", "score"), "word", "left")
    changed = render.did_you_mean(scored, dictionary, "q").filter(F.size("changes") > 0).count()
    return {"words": len(asked), "changed": changed, "seconds": round(time.perf_counter() - began, 3)}


def noisy_words(word_scores: DataFrame) -> DataFrame:
    """Words that searches leave out."""
    return word_scores.filter(importance.is_noisy(F.col("score"))).select("word")
