"""A search session: registered query texts, asking, statistics, suggestions, and the request dispatcher.

Corpus tables are DataFrames; registering adds a small DataFrame of query sentences.  Answers are lazy DataFrames or, by
``handle``, JSON strings of the few ranked results of one request.  A lock guards the registered texts, so threads may
share a session; plans run outside of it.
"""

from __future__ import annotations

import json
import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import depgraph, importance, render, search, tokens, vocabulary

#: numbers of registered sentences begin here
FIRST_QUERY = 0x80000000


_WORD = re.compile(r"\S+")


class Session:
    """A corpus that can be asked.

    origins, if given, tells where a sentence comes from: sent_uid, table_name, column_name, index_col, column_uid,
    row_uid, row_idx, country, offset_beg, offset_end; any of them may be missing.  vectors (word, vec) make similar words
    by cosine; without them, words are similar that are equal but for capitals.  countries are the names that tag texts.
    """

    def __init__(
        self, spark: SparkSession, corpus_tokens: DataFrame, corpus_sentences: DataFrame, importance: DataFrame,
        origins: DataFrame | None = None, vectors: DataFrame | None = None, countries: list[str] | None = None,
    ):
        self.spark, self.tokens, self.sentences, self.importance = spark, corpus_tokens, corpus_sentences, importance
        self.origins, self.vectors, self.countries = origins, vectors, countries or []
        self._exact = search.exact_similar(corpus_tokens.select("word").distinct())
        self.texts: dict[str, list[int]] = {}  # answered from here when a text comes again
        self.registered: dict[int, str] = {}
        self.offsets: dict[int, tuple[int, int]] = {}  # of a sentence in its text
        self.tags: dict[int, list[str]] = {}  # countries of a sentence's text
        self._lock = threading.Lock()

    def similar(self, query_words: DataFrame) -> DataFrame:
        """Similar words of the words of a query and of their heads."""
        if self.vectors is None:
            return self._exact
        heads = query_words.select(F.col("head_word").alias("word"), F.col("head_score").alias("score"))
        return search.vector_similar(query_words.select("word", "score").unionByName(heads).filter("word is not null"), self.vectors)

    def preprocess(self, text: str, dictionary: DataFrame) -> DataFrame:
        """Corrected spelling of a text (original, corrected, changes)."""
        words = self.spark.createDataFrame([(0, i, w) for i, w in enumerate(text.split())] or [(0, 0, "")], "q int, pos int, word string")
        words = words.join(self.importance.select("word", "score"), "word", "left")
        return render.did_you_mean(words, dictionary, "q").drop("q")

    def register(self, text: str | None) -> list[int]:
        """Numbers of the sentences of a text; the same text gets the same numbers."""
        if not text or not text.strip():
            return []
        with self._lock:
            if text not in self.texts:
                first, at, own = FIRST_QUERY + len(self.registered), 0, []
                for s in (s for line in text.split("\n") for s in re.split(r"(?<=[.!?]) +", line) if s.strip()):
                    at = text.index(s, at)
                    uid = first + len(own)
                    own.append(uid)
                    self.registered[uid] = s
                    self.offsets[uid] = (at, at + len(s))
                    at += len(s)
                tags = sorted(c for c in self.countries if c in text)
                self.tags |= dict.fromkeys(own, tags)
                self.texts[text] = own
            return self.texts[text]

    def _query_words(self, uids: list[int]) -> DataFrame:
        rows = [(u, self.registered[u]) for u in uids if u in self.registered]  # unknown numbers are left out
        s = self.spark.createDataFrame(rows, "sent_uid long, sentence string").withColumn("chunk_idx", F.col("sent_uid"))
        q = vocabulary.with_default(tokens.token_table(s), self.importance, "word", "score", 0.0)
        heads = self.importance.select(F.col("word").alias("head_word"), F.col("score").alias("head_score"))
        q = q.join(heads, "head_word", "left").withColumn("head_score", F.coalesce("head_score", F.lit(0.0)))
        return q.select(F.col("sent_uid").alias("q"), F.col("pos").alias("q_pos"), "word", "score", "head_word", "head_score")

    def _corpus(self, tables: list[str] | None) -> DataFrame:
        """The tokens that may be found: of the named tables alone, if there are names."""
        if not tables or self.origins is None:
            return self.tokens
        return self.tokens.join(self.origins.filter(F.col("table_name").isin(*tables)).select("sent_uid"), "sent_uid", "left_semi")

    def ask(self, uids: list[int], k: int = 5, tables: list[str] | None = None) -> DataFrame:
        """(q, sent_uid, score, rank, is_highly_met, sentence), one row per bag of words: the k best, then de-duplicated."""
        words = self._query_words(uids)
        return self._asked(words, self.similar(words), k, tables)

    def _asked(self, words: DataFrame, similar: DataFrame, k: int, tables: list[str] | None) -> DataFrame:
        found = search.find_similar_sentences(words, similar, self._corpus(tables), k=k)
        texts = found.join(self.sentences.select("sent_uid", "sentence"), "sent_uid").withColumn("bag", X.bag_key(X.words(F.col("sentence"))))
        from pyspark.sql import Window

        first = F.row_number().over(Window.partitionBy("q", "bag").orderBy("rank"))
        one = texts.withColumn("n", first).filter("n = 1").drop("n", "bag")
        return render.is_highly_met(one, words)

    def query_info(self, uids: list[int]) -> list[dict]:
        """Words, their importances as cutoffs, and place in its text of every registered sentence."""
        rows = self._query_words(uids).orderBy("q", "q_pos").collect()  # the words of one request
        out = []
        for u in dict.fromkeys(u for u in uids if u in self.registered):
            own = [r for r in rows if r["q"] == u]
            out.append({"input_uid": u, "input_offset": list(self.offsets[u]), "words": [r["word"] for r in own], "cutoffs": [r["score"] for r in own], "countries": self.tags[u]})
        return out

    def answer(self, uids: list[int], k: int = 5, max_clip_len: int = 200, tables: list[str] | None = None) -> list[dict]:
        """A document per query sentence: arrays, one item a result, and what is known of the query."""
        from textloom.workspace import materialise

        words = self._query_words(uids)
        similar = self.similar(words)
        found = materialise(self._asked(words, similar, k, tables), "results")
        matches = search.match_list(found, words, similar, self.tokens).collect()  # at most k sentences a query
        rows = found
        if self.origins is not None:
            rows = rows.join(self.origins.join(F.broadcast(found.select("sent_uid").distinct()), "sent_uid", "left_semi"), "sent_uid", "left")
        rows = [r.asDict() for r in rows.orderBy("q", "rank").collect()]
        out = []
        for info in self.query_info(uids):
            q = info["input_uid"]
            mine = [r for r in rows if r["q"] == q]
            doc: dict[str, list] = {name: [] for name in _ARRAYS}
            q_spans = [m.span() for m in _WORD.finditer(self.registered[q])]
            for r in mine:
                spans = [m.span() for m in _WORD.finditer(r["sentence"])]
                own = sorted((m for m in matches if m["q"] == q and m["sent_uid"] == r["sent_uid"]), key=lambda m: (-m["score"], m["pos"]))
                base = r.get("offset_beg") or 0
                clip = render.clip([(m["score"], *spans[m["pos"]]) for m in own], [b for b, _ in spans], [e for _, e in spans], max_clip_len)
                values = {
                    "score": r["score"], "is_highly_meet": r["is_highly_met"], "result_sent_uid": r["sent_uid"], "sentence": r["sentence"],
                    "result_sent_country": r.get("country"), "result_table_name": r.get("table_name"), "result_column_name": r.get("column_name"),
                    "result_index_col_name": r.get("index_col"), "result_column_uid": r.get("column_uid"), "result_row_uid": r.get("row_uid"),
                    "result_row_idx": r.get("row_idx"), "result_offset": [base, r.get("offset_end") or base + len(r["sentence"])],
                    "highlight_offset": [0, 0], "clip_offset": list(clip),
                    "score_with_offset": [[m["score"], *q_spans[m["q_pos"]], *spans[m["pos"]]] for m in own if m["score"]],
                }
                for name in _ARRAYS:
                    doc[name].append(values[name])
            out.append({**doc, "n_relevant_matches": len(mine), **info})
        return out

    def stats(self, uids: list[int], phrase_cutoff: float = 5.0, **how: object) -> dict:
        """Answers, with suggestions from the phrases of all matching sentences of each query."""
        words = self._query_words(uids)
        hits = search.word_matches(words, self.similar(words), self.tokens, None).select("q", "sent_uid").distinct()
        trees = depgraph.sentence_trees(vocabulary.with_default(self.tokens.join(hits.select("sent_uid").distinct(), "sent_uid", "left_semi"), self.importance, "word", "score", 0.0))
        phrases = depgraph.segment(trees, phrase_cutoff, longest=100)
        per = []
        for u in dict.fromkeys(u for u in uids if u in self.registered):
            ideas = words.filter((F.col("q") == u) & (F.col("score") >= importance.NOISY_BELOW)).select("word").distinct()
            own = phrases.join(hits.filter(F.col("q") == u), "sent_uid", "left_semi")
            per.append({"sent_uid": u, "query_suggestions": self._suggestions(depgraph.suggest(own, ideas))})
        return {"results": self.answer(uids, **how), "query_suggestions_per_sent": per}

    @staticmethod
    def _suggestions(found: DataFrame) -> list[dict]:
        by: dict[str, list] = {}
        for r in found.orderBy("idea", "rank").collect():  # at most 21 an idea
            by.setdefault(r["idea"], []).append(r["suggestion"])
        return [{"idea": k, "suggestions": v} for k, v in by.items()]

    def suggest(self, ideas: list[str], phrase_rows: DataFrame) -> DataFrame:
        """(idea, suggestion, n, rank)."""
        return depgraph.suggest(phrase_rows, self.spark.createDataFrame([(w,) for w in ideas], "word string"))

    def compare(self, one: int, other: int) -> float | None:
        """Score of a registered sentence against another one, None if either is unknown."""
        if one not in self.registered or other not in self.registered:
            return None
        words = self._query_words([one])
        s = self.spark.createDataFrame([(other, other, self.registered[other])], "sent_uid long, chunk_idx long, sentence string")
        vocabulary_of_both = tokens.token_table(s).select("word").unionByName(words.select("word")).distinct()
        similar = search.exact_similar(vocabulary_of_both) if self.vectors is None else self.similar(words)
        got = search.find_similar_sentences(words, similar, tokens.token_table(s), k=1).first()
        return got["score"] if got else 0.0

    def handle(self, request: str) -> str:
        """JSON in, JSON out; what is no request, or asks for nothing that is known, gives null.

        {"register": text} or {"raw_text": text}; {"ask": text}, {"ask_sents": [numbers]}, {"ask_query": ...} or
        {"chain_query": ...}, which is the same; {"stats_query": text or numbers}; {"suggest": [words]} or
        {"query_suggestion": ...}; {"sent_compare": [number, number]}; {"sents": [numbers]}.  ask and stats take "tables",
        "n_cut", "max_clip_len" and "phrase_cutoff".
        """
        try:
            r = json.loads(request)
        except ValueError:
            return "null"
        if not isinstance(r, dict):
            return "null"

        def told(*names: str) -> object:
            return next((r[n] for n in names if n in r), None)

        def reply(x: object) -> str:
            return json.dumps(x, ensure_ascii=False)

        if isinstance(text := told("register", "raw_text"), str):
            return json.dumps({"sent_uids": self.register(text)})
        if isinstance(ideas := told("suggest", "query_suggestion"), list):
            words = [w for w in ideas if isinstance(w, str)]
            trees = depgraph.sentence_trees(vocabulary.with_default(self.tokens, self.importance, "word", "score", 0.0))
            phrases = depgraph.segment(trees, float(r.get("phrase_cutoff", 0.5)), longest=100)
            return reply({"query_suggestions": self._suggestions(self.suggest(words, phrases))}) if words else "null"
        if isinstance(pair := told("sent_compare"), list):
            score = self.compare(*pair) if len(pair) == 2 else None
            return "null" if score is None else reply({"score": score})
        if isinstance(numbers := told("sents"), list):
            rows = self.sentences.filter(F.col("sent_uid").isin([n for n in numbers if isinstance(n, int)])).select("sent_uid", "sentence").collect()
            known = {x["sent_uid"]: x["sentence"] for x in rows} | self.registered
            return reply({"sents": [{"sent_uid": n, "sentence": known[n]} for n in numbers if n in known]})
        asked = told("ask", "ask_sents", "ask_query", "chain_query", "stats_query")
        uids = self.register(asked) if isinstance(asked, str) else asked
        if not isinstance(uids, list) or not any(u in self.registered for u in uids):
            return "null"
        tables = r["tables"] if isinstance(r.get("tables"), list) else None
        how = {"k": int(r.get("n_cut", 5)), "max_clip_len": int(r.get("max_clip_len", 200)), "tables": tables}
        if "stats_query" in r:
            return reply(self.stats(uids, float(r.get("phrase_cutoff", 5.0)), **how))
        return reply({"results": self.answer(uids, **how)})


#: fixed values: names of the arrays of an answer
_ARRAYS = (
    "score", "result_sent_country", "result_table_name", "result_column_name", "result_index_col_name", "highlight_offset", "clip_offset",
    "score_with_offset", "result_sent_uid", "result_row_uid", "result_row_idx", "result_column_uid", "result_offset", "is_highly_meet", "sentence",
)
