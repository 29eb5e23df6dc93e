"""The queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import vectors as V
from textloom.ml import metric_tree, models, parser, weighting
from textloom.operators import depgraph, entities, importance, knowledge, nested, ranking, render, sampling, search, similarity, tokens, vocabulary
from textloom.sources import readers
from textloom.streaming import flows
from textloom.workspace import materialise, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------------------------------------------------------------
# shared pieces

#: common table expressions: white-space words, plain sentences, tokens
_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_SENTS = (
    r"list_filter(flatten(list_transform(string_split({}, chr(10)), lambda x: "
    r"string_split(regexp_replace(x, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)))), lambda y: regexp_matches(y, '\S'))"
)
_TOKENS = f"""
sents AS (
  SELECT doc_id AS chunk_idx, generate_subscripts(ss, 1) - 1 AS sent_idx, unnest(ss) AS sentence
  FROM (SELECT doc_id, {_SENTS.format("text")} AS ss FROM documents WHERE text IS NOT NULL)),
tokens AS (
  SELECT chunk_idx, chunk_idx * 1000000 + sent_idx AS sent_uid, sent_idx, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word, len(ws) AS n
  FROM (SELECT chunk_idx, sent_idx, {_WORDS.format("sentence")} AS ws FROM sents))"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return tokens.sentence_table(_docs(spark, d))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_table(_sentences(spark, d))


# ---------------------------------------------------------------------------------------------------------------------
# counts and dictionaries


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.word_counts(_docs(spark, d), "text")


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word HAVING count(*) >= 5")
def vocabulary_min5(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.word_counts(_docs(spark, d), "text", 5)


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 100")
def top_words(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(vocabulary.word_counts(_docs(spark, d), "text"), 100, "n", "word")


@query(f"SELECT word, sum(n)::BIGINT AS n FROM (SELECT source, word, count(*) AS n FROM (SELECT source, unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY ALL) GROUP BY word")
def merged_word_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    feeds = F.coalesce(F.col("source").startswith("rss."), F.lit(False))
    return vocabulary.merge_counts(vocabulary.word_counts(docs.filter(feeds), "text"), vocabulary.word_counts(docs.filter(~feeds), "text"))


@query(f"SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.document_frequency(_docs(spark, d), "doc_id", X.words(F.col("text")))


@query(f"""WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word)
SELECT word, n, round(n / sum(n) OVER (), 12) AS p FROM c""")
def unigram_share(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.unigram(vocabulary.word_counts(_docs(spark, d), "text")).withColumn("p", F.round("p", 12))


@query(f"""WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word),
u AS (SELECT word, n, n / sum(n) OVER () AS p FROM c)
SELECT word, n, round(least(1.0, (sqrt(p / 0.001) + 1) / (p / 0.001)), 9) AS keep, round(pow(n, 0.75), 6) AS noise FROM u""")
def subsampling_weights(spark: SparkSession, d: str) -> DataFrame:
    u = vocabulary.unigram(vocabulary.word_counts(_docs(spark, d), "text"))
    keep = F.least(F.lit(1.0), vocabulary.subsample_keep(F.col("p"), 0.001))
    return u.select("word", "n", F.round(keep, 9).alias("keep"), F.round(vocabulary.noise_weight(F.col("n")), 6).alias("noise"))


@query(f"""WITH w AS (SELECT DISTINCT lang, unnest({_WORDS.format('text')}) AS word FROM documents)
SELECT word FROM w WHERE lang = 'en' INTERSECT SELECT word FROM w WHERE lang = 'de'""")
def known_words(spark: SparkSession, d: str) -> DataFrame:
    known, _ = _split_vocabulary(spark, d)
    return known


@query(f"""WITH w AS (SELECT DISTINCT lang, unnest({_WORDS.format('text')}) AS word FROM documents)
SELECT word FROM w WHERE lang = 'de' EXCEPT SELECT word FROM w WHERE lang = 'en'""")
def unseen_words(spark: SparkSession, d: str) -> DataFrame:
    _, unseen = _split_vocabulary(spark, d)
    return unseen


def _split_vocabulary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, d)
    words = lambda lang: docs.filter(F.col("lang") == lang).select(F.explode(X.words(F.col("text"))).alias("word")).distinct()
    return vocabulary.known_and_unseen(words("de"), words("en"))


@query(f"""WITH w AS (SELECT DISTINCT lang, unnest({_WORDS.format('text')}) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents WHERE lang = 'fr') GROUP BY word)
SELECT word, n FROM c WHERE word NOT IN (SELECT word FROM w WHERE lang = 'en') ORDER BY n DESC, word""")
def new_word_report(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    counts = vocabulary.word_counts(docs.filter("lang = 'fr'"), "text")
    _, unseen = vocabulary.known_and_unseen(counts, vocabulary.word_counts(docs.filter("lang = 'en'"), "text"))
    return unseen.orderBy(F.col("n").desc(), "word")


@query(f"""WITH w AS (SELECT DISTINCT lang, unnest({_WORDS.format('text')}) AS word FROM documents WHERE lang IN ('en', 'de', 'fr', 'es'))
SELECT word FROM w GROUP BY word HAVING count(DISTINCT lang) = 4""")
def words_of_all_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).filter(F.col("lang").isin("en", "de", "fr", "es"))
    return vocabulary.intersect_all(docs.select("lang", F.explode(X.words(F.col("text"))).alias("word")), "word", "lang")


@query("SELECT doc_id, coalesce(c.full_name, '-UNKNOWN-') AS full_name, row_idx FROM documents d LEFT JOIN column_catalog c USING (col_uid)")
def column_of_document(spark: SparkSession, d: str) -> DataFrame:
    # the catalog is a fixed table of 11 rows
    return vocabulary.with_default(_docs(spark, d), F.broadcast(table(spark, d, "column_catalog")), "col_uid", "full_name", X.UNKNOWN).select("doc_id", "full_name", "row_idx")


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents)
SELECT doc_id, len(ws) AS n_words FROM w WHERE len(ws) > 2 AND len(ws) < 20""")
def short_documents(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(X.words(F.col("text")))
    return _docs(spark, d).select("doc_id", n.cast("long").alias("n_words")).filter("n_words > 2 AND n_words < 20")


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents),
v AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 5)
SELECT DISTINCT doc_id FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM w WHERE word NOT IN (SELECT word FROM v))""")
def all_words_known(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).filter("text IS NOT NULL")
    known = vocabulary.word_counts(docs, "text", 5)
    odd = docs.select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("word")).join(known, "word", "left_anti")
    return docs.select("doc_id").join(odd, "doc_id", "left_anti").distinct()


# ---------------------------------------------------------------------------------------------------------------------
# sentences, tokens, windows


@query(f"WITH {_TOKENS} SELECT chunk_idx, sent_idx, chunk_idx * 1000000 + sent_idx AS sent_uid, sentence FROM sents")
def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d)


@query(f"""WITH {_TOKENS}
SELECT sent_uid, pos, word, CASE WHEN pos = n - 1 THEN -1 ELSE pos + 1 END AS head_pos, lead(word) OVER (PARTITION BY sent_uid ORDER BY pos) AS head_word FROM tokens""")
def token_rows(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("sent_uid", F.col("pos").cast("long").alias("pos"), "word", F.col("head_pos").cast("long").alias("head_pos"), "head_word")


@query(f"WITH {_TOKENS} SELECT sent_uid, dense_rank() OVER (ORDER BY sent_uid) - 1 + 2147483648 AS sent_no FROM (SELECT DISTINCT sent_uid FROM tokens)")
def dense_sentence_numbers(spark: SparkSession, d: str) -> DataFrame:
    return tokens.dense_numbers(_sentences(spark, d), 1 << 31)  # every sentence has a word


@query(f"WITH {_TOKENS} SELECT chunk_idx, min(sent_uid) AS first_sent, max(sent_uid) + 1 AS end_sent, count(DISTINCT sent_uid) AS n_sents, count(*) AS n_tokens FROM tokens GROUP BY chunk_idx")
def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return t.groupBy("chunk_idx").agg(F.min("sent_uid").alias("first_sent"), (F.max("sent_uid") + 1).alias("end_sent"), F.countDistinct("sent_uid").alias("n_sents"), F.count("*").alias("n_tokens"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS flag
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r)
SELECT user_id, run::BIGINT AS run, event_type, min(event_id) AS "begin", max(event_id) + 1 AS "end" FROM g GROUP BY ALL""")
def equal_runs(spark: SparkSession, d: str) -> DataFrame:
    return tokens.consecutive_ranges(table(spark, d, "events"), "event_type", "event_id", "user_id")


@query(f"""WITH {_TOKENS}, g AS (SELECT sent_uid, pos, word || ' ' || lead(word) OVER (PARTITION BY sent_uid ORDER BY pos) AS gram FROM tokens)
SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram""")
def bigram_count(spark: SparkSession, d: str) -> DataFrame:
    grams = tokens.ngram_rows(_sentences(spark, d).select(X.words(F.col("sentence")).alias("ws")), "ws", 2)
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query(f"""WITH {_TOKENS} SELECT a.word, b.word AS context, count(*) AS n FROM tokens a JOIN tokens b
ON a.sent_uid = b.sent_uid AND a.pos <> b.pos AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 GROUP BY ALL""")
def context_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = tokens.contexts(_sentences(spark, d).select("sent_uid", X.words(F.col("sentence")).alias("ws")), 2)
    return pairs.groupBy("word", "context").agg(F.count("*").alias("n"))


@query(f"""WITH {_TOKENS} SELECT word, lower(word) AS low, length(word) AS n_chars, word[2:3] AS part, upper(word) AS up, list_aggregate(list_sort(string_split(word, '')), 'string_agg', '') AS bag
FROM (SELECT DISTINCT word FROM tokens WHERE regexp_full_match(word, '[A-Za-z]+'))""")
def word_functions(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("word")
    words = _tokens(spark, d).select("word").filter(w.rlike("^[A-Za-z]+$")).distinct()
    bag = F.array_join(F.array_sort(F.split(w, "")), "")
    return words.select("word", F.lower(w).alias("low"), F.length(w).cast("long").alias("n_chars"), X.code_points(w, 1, 3).alias("part"), F.upper(w).alias("up"), bag.alias("bag"))


@query("SELECT doc_id, substring(text, 9, 12) AS part, length(text) AS n FROM documents WHERE text IS NOT NULL")
def unicode_substring(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", X.code_points(F.col("text"), 8, 20).alias("part"), F.length("text").cast("long").alias("n"))


@query("""SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS stripped, len(string_split_regex(text, '[ \\t]')) AS n_parts, NOT regexp_matches(text, '\\S') AS blank
FROM documents WHERE text IS NOT NULL""")
def strip_and_split(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", X.strip(t).alias("stripped"), F.size(X.split_any(t)).cast("long").alias("n_parts"), X.is_blank(t).alias("blank"))


@query("""SELECT full_name, string_split(full_name, '.')[1] AS table_name, string_split(full_name, '.')[2] AS column_name, string_split(full_name, '.')[3] AS index_col, col_uid::VARCHAR AS row_id FROM column_catalog""")
def file_name_parts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "column_catalog")
    path = F.concat(F.lit("/dump/"), "full_name", F.lit("."), F.col("col_uid").cast("string"))
    return c.select("full_name", X.path_parts(path).alias("p")).select("full_name", "p.*")


@query(f"""WITH l AS (SELECT rec_id, item_label, list_filter({_WORDS.format('item_label')}, lambda w: regexp_matches(w, '^[A-Za-z]') AND w NOT IN ('and', 'the', 'of')) AS ws FROM wikidata_items WHERE item_label IS NOT NULL)
SELECT rec_id, array_to_string(list_transform(ws, lambda w: upper(w[1])), '') AS acronym FROM l""")
def acronyms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wikidata_items").filter("item_label IS NOT NULL").select("rec_id", X.acronym(X.words(F.col("item_label"))).alias("acronym"))


@query(f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word),
f AS (SELECT lower(word) AS low, max_by(word, (n, word)) AS form FROM w WHERE regexp_full_match(word, '[A-Za-z]+') GROUP BY ALL)
SELECT low, form FROM f WHERE low <> form""")
def case_forms(spark: SparkSession, d: str) -> DataFrame:
    w = vocabulary.word_counts(_docs(spark, d), "text").filter(F.col("word").rlike("^[A-Za-z]+$"))
    forms = w.groupBy(F.lower("word").alias("low")).agg(F.max_by("word", F.struct("n", "word")).alias("form"))
    return forms.filter("low <> form")


_COUNTRIES = ["Brarkloustiora", "Giskarflormar", "Parpremar", "Pruvoniia", "Thipurmland", "Varfoufiora"]
_COUNTRY_LIST = "[" + ", ".join(f"'{c}'" for c in _COUNTRIES) + "]"


@query(f"""SELECT doc_id, array_to_string(list_distinct_sorted, ',') AS tags FROM (
SELECT doc_id, list_sort(list_distinct(list_concat(list_filter({_COUNTRY_LIST}, lambda c: contains(text, c)), CASE WHEN contains(text, 'Water Board') THEN ['Water Land'] ELSE [] END))) AS list_distinct_sorted
FROM documents WHERE text IS NOT NULL) WHERE len(list_distinct_sorted) > 0""")
def country_tags(spark: SparkSession, d: str) -> DataFrame:
    tagged = entities.country_tags(_docs(spark, d).filter("text IS NOT NULL"), "text", _COUNTRIES, {"Water Board": "Water Land"})
    return tagged.filter(F.size("tags") > 0).select("doc_id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


# ---------------------------------------------------------------------------------------------------------------------
# importance, weights, search

_PAIRS = f"""
pairs AS (SELECT doc_id, {_WORDS.format("ss[1]")} AS s, {_WORDS.format("array_to_string(ss[2:], ' ')")} AS f
  FROM (SELECT doc_id, {_SENTS.format("text")} AS ss FROM documents WHERE text IS NOT NULL) WHERE len(ss) > 1),
sides AS (SELECT doc_id, unnest(list_distinct(s)) AS word, 1 AS a, 0 AS b FROM pairs UNION ALL SELECT doc_id, unnest(list_distinct(f)), 0, 1 FROM pairs),
per AS (SELECT doc_id, word, max(a) AS a, max(b) AS b FROM sides GROUP BY ALL),
cont AS (SELECT word, sum(a)::BIGINT AS summary, sum(b)::BIGINT AS "full", sum(a * b)::BIGINT AS common, (SELECT count(*) FROM pairs) AS n_case FROM per GROUP BY word),
imp AS (SELECT *, CASE WHEN summary < 5 OR "full" < 5 THEN 0.0 ELSE common::DOUBLE * n_case / (summary * "full") END AS ratio FROM cont),
scores AS (SELECT *, 0.9 * (1 - 1 / greatest(1.0, ratio + 0.001)) AS score FROM imp)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """First sentences against the rest of their documents."""
    ss = _docs(spark, d).select("doc_id", X.sentences(F.col("text")).alias("ss")).filter(F.size("ss") > 1)
    rest = F.array_join(F.slice("ss", 2, F.size("ss")), " ")
    return ss.select("doc_id", X.words(F.get("ss", F.lit(0))).alias("summary_words"), X.words(rest).alias("full_words"))


def _importance(spark: SparkSession, d: str) -> DataFrame:
    return materialise(importance.importance_table(_pairs(spark, d)), "importance")


@query(f'WITH {_PAIRS} SELECT word, summary, "full", common AS "both", n_case, round(ratio, 9) AS ratio, round(score, 9) AS score, CASE WHEN ratio < 0.1 OR common = 0 THEN 0.0 ELSE round(ln(ratio) * pow(common, 0.3), 9) END AS report FROM scores')
def word_importance(spark: SparkSession, d: str) -> DataFrame:
    c = importance.contingency(_pairs(spark, d)).withColumn("ratio", importance.ratio())
    report = importance.report_score(F.col("ratio"), F.col("both"))
    return c.select("word", "summary", "full", "both", "n_case", F.round("ratio", 9).alias("ratio"), F.round(importance.score(F.col("ratio")), 9).alias("score"), F.round(report, 9).alias("report"))


@query(f"WITH {_PAIRS} SELECT word, score < 0.6 AS noisy, score = 0 AS unknown FROM scores")
def noisy_words(spark: SparkSession, d: str) -> DataFrame:
    s = importance.importance_table(_pairs(spark, d))
    return s.select("word", importance.is_noisy(F.col("score")).alias("noisy"), (F.col("score") == 0).alias("unknown"))


@query(f"""WITH tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)
SELECT doc_id, word, tf, round(tf * ln((SELECT count(*) FROM documents WHERE text IS NOT NULL)::DOUBLE / df), 6) AS tfidf FROM tf JOIN df USING (word)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, word) <= 5""")
def tfidf_top(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).filter("text IS NOT NULL")
    w = weighting.tfidf(docs.select("doc_id", X.words(F.col("text")).alias("words")), "doc_id", "words")
    return ranking.top_per_table(w.withColumn("tfidf", F.round("tfidf", 6)), "doc_id", 5, "tfidf", "word").select("doc_id", "word", "tf", "tfidf")


_SEARCH = f"""
q AS (SELECT sent_uid AS q, pos AS q_pos, word, score, lead(word) OVER (PARTITION BY sent_uid ORDER BY pos) AS head_word
  FROM (SELECT t.*, coalesce(s.score, 0.0) AS score FROM tokens t LEFT JOIN scores s USING (word)) WHERE chunk_idx IN (SELECT doc_id FROM documents WHERE source = 'query.log')),
qh AS (SELECT q.*, coalesce(s.score, 0.0) AS head_score FROM q LEFT JOIN scores s ON q.head_word = s.word),
voc AS (SELECT DISTINCT word, lower(word) AS low FROM tokens),
sim AS (SELECT a.word, b.word AS sim_word, CASE WHEN a.word = b.word THEN 1.0 ELSE 0.9 END AS similarity FROM voc a JOIN voc b USING (low)),
posts AS (SELECT sent_uid, word, lead(word) OVER (PARTITION BY sent_uid ORDER BY pos) AS head_word FROM tokens),
hits AS (SELECT qh.q, qh.q_pos, p.sent_uid, max(qh.score * s.similarity * (1 + qh.head_score * coalesce(h.similarity, 0.0))) AS score
  FROM qh JOIN sim s ON qh.word = s.word JOIN posts p ON p.word = s.sim_word LEFT JOIN sim h ON h.word = qh.head_word AND h.sim_word = p.head_word
  WHERE qh.score >= 0.6 GROUP BY ALL)"""


def _query_words(spark: SparkSession, d: str, t: DataFrame, imp: DataFrame) -> DataFrame:
    """Words of all sentences of the asked documents with their importances and heads."""
    asked = _docs(spark, d).filter("source = 'query.log'").select(F.col("doc_id").alias("chunk_idx"))
    q = t.join(asked, "chunk_idx", "left_semi")
    q = vocabulary.with_default(q, imp, "word", "score", 0.0)
    heads = imp.select(F.col("word").alias("head_word"), F.col("score").alias("head_score"))
    q = q.join(heads, "head_word", "left").withColumn("head_score", F.coalesce("head_score", F.lit(0.0)))
    return q.select(F.col("sent_uid").alias("q"), F.col("pos").alias("q_pos"), "word", "score", "head_word", "head_score")


def _asked_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the asked documents, picked before their texts are cut."""
    docs = _docs(spark, d)
    asked = docs.filter("source = 'query.log'").select("doc_id").distinct()
    return tokens.token_table(tokens.sentence_table(docs.join(F.broadcast(asked), "doc_id", "left_semi")))


def _word_lists(spark: SparkSession, d: str) -> DataFrame:
    """(sent_uid, ws) of all sentences.  Documents of the same number, or of none, share their sentences' numbers: the words of
    such sentences stand in one list, parted by a null."""
    docs = _docs(spark, d)
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id")
    lists = lambda rows: tokens.sentence_table(rows).select("sent_uid", X.words(F.col("sentence")).alias("ws"))
    found = [r[0] for r in again.limit(1).collect()]
    if not found:
        return lists(docs)
    mark = F.broadcast(again.withColumnRenamed("doc_id", "again"))
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    one = F.flatten(F.collect_list(F.concat("ws", F.array(F.lit(None).cast("string")))))
    merged = lists(docs.join(mark, same, "left_semi")).groupBy("sent_uid").agg(one.alias("ws"))
    return lists(docs.join(mark, same, "left_anti")).unionByName(merged)


def _similar_to(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """Words of the sentences (sent_uid, ws) that equal words or heads of queries but for capitals; others match no query."""
    asked = words.select(F.explode(F.array("word", "head_word")).alias("word")).filter("word is not null")
    low = F.broadcast(asked.select(F.lower("word").alias("low")).distinct())
    met = sentences.select(F.explode("ws").alias("word")).filter("word is not null").withColumn("low", F.lower("word")).join(low, "low", "left_semi")
    return materialise(search.exact_similar(met.select("word").distinct()), "similar")


def _search(spark: SparkSession, d: str, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The words of queries, what is similar to them, and the k best sentences of every query."""
    words = materialise(_query_words(spark, d, _asked_tokens(spark, d), _importance(spark, d)), "query-words")
    sentences = _word_lists(spark, d)
    similar = _similar_to(sentences, words)
    return words, similar, search.find_in_sentences(words, similar, sentences, k)


@query(f"""WITH {_TOKENS}, {_PAIRS}, {_SEARCH}, total AS (SELECT q, sent_uid, round(sum(score), 6) AS score FROM hits GROUP BY ALL HAVING round(sum(score), 6) > 0)
SELECT q, sent_uid, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, sent_uid) AS rank FROM total QUALIFY rank <= 5""")
def similar_sentences(spark: SparkSession, d: str) -> DataFrame:
    _, _, found = _search(spark, d)
    return found.select("q", "sent_uid", "score", F.col("rank").cast("long").alias("rank"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the best sentences, with their texts, for every asked sentence."""
    texts = _sentences(spark, d).select("sent_uid", "sentence")
    return similar_sentences(spark, d).join(texts, "sent_uid")


_DICTIONARY = """
names AS (SELECT DISTINCT CAST(substring(item_id, 2) AS BIGINT) AS entity_uid, list_filter(regexp_split_to_array(item_label, '\\s+'), lambda w: w <> '') AS ws
  FROM wikidata_items WHERE item_label IS NOT NULL AND regexp_full_match(item_id, 'Q[0-9]+'))"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "wikidata_items").filter(F.col("item_label").isNotNull() & F.col("item_id").rlike("^Q[0-9]+$"))
    return items.select(F.substring("item_id", 2, 20).cast("long").alias("entity_uid"), X.words(F.col("item_label")).alias("ws")).distinct()


def _short_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of items as texts use them: the label, its last word, and its words before "of"."""
    n = _names(spark, d).filter(F.size("ws") > 0)
    before = F.slice("ws", 1, F.greatest(F.array_position("ws", "of") - 1, F.lit(0)).cast("int"))
    forms = F.array(F.col("ws"), F.slice("ws", -1, 1), before)
    return n.select("entity_uid", F.explode(forms).alias("ws")).filter(F.size("ws") > 0).distinct()


@query()
def annotated_entities(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary names in all sentences, with all candidates.  Sequential left-to-right rule: tested against a brute force."""
    s = _sentences(spark, d).select("sent_uid", X.words(F.col("sentence")).alias("ws"))
    names = entities.distinct_names(_short_names(spark, d))
    written = names.select("name_id", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ",").alias("candidates"))  # once a name, not once a mark
    return entities.name_marks(s, names).join(written, "name_id").select("sent_uid", "token_pos", "token_len", "candidates")


@query()
def sentences_with_entities(spark: SparkSession, d: str) -> DataFrame:
    """The whole search with entities: asked sentences against sentences that have all their entities, then similar words."""
    imp = _importance(spark, d)
    names = entities.distinct_names(_short_names(spark, d))
    asked = _asked_tokens(spark, d)
    words = materialise(_query_words(spark, d, asked, imp), "query-words")
    lists = asked.groupBy("sent_uid").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("ps")).select("sent_uid", F.transform("ps", lambda p: p.word).alias("ws"))
    wanted = materialise(entities.name_marks(lists, names).select(F.col("sent_uid").alias("q"), "name_id"), "query-names")
    sentences = _word_lists(spark, d)
    pairs = entities.name_pairs(wanted, names, imp)
    return search.find_in_sentences(words, _similar_to(sentences, words), sentences, names=names, query_names=wanted, pairs=pairs).select("q", "sent_uid", "score", "rank")


@query(f"""WITH {_DICTIONARY}, a AS (SELECT entity_uid, ws, array_to_string(list_transform(list_filter(ws, lambda w: regexp_matches(w, '^[A-Za-z]') AND w NOT IN ('and', 'the', 'of')), lambda w: upper(w[1])), '') AS acr FROM names)
SELECT entity_uid, max(CASE WHEN EXISTS (SELECT 1 FROM a b WHERE b.entity_uid = a.entity_uid AND len(b.ws) > 1 AND len(a.ws) = 1 AND a.ws[1] = b.acr) THEN 1 ELSE 0 END) = 1 OR bool_or(entity_uid % 7 = 0) AS named FROM a GROUP BY entity_uid""")
def named_entities(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    listed = names.filter("entity_uid % 7 = 0").select("entity_uid")  # stands for a list of names
    return entities.named_entities(names, listed)


@query("""WITH e AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(p31, '\\s+'), lambda x: x <> '')[2:]) AS class_id, item_label IS NOT NULL AND regexp_matches(item_label, '^[A-Z]') AS named FROM wikidata_items),
v AS (SELECT class_id, sum(CASE WHEN named THEN 1 ELSE 0 END)::BIGINT AS yes, sum(CASE WHEN named THEN 0 ELSE 1 END)::BIGINT AS no FROM e GROUP BY class_id)
SELECT class_id, yes, no, yes * 5 > no AS vote FROM v""")
def class_vote(spark: SparkSession, d: str) -> DataFrame:
    e = _instances(spark, d).withColumn("named", F.coalesce(F.col("item_label").rlike("^[A-Z]"), F.lit(False)))
    return entities.class_vote(e, "class_id", "named")


def _instances(spark: SparkSession, d: str) -> DataFrame:
    vs = X.words(F.col("p31"))
    return table(spark, d, "wikidata_items").select("item_id", "item_label", F.explode(F.slice(vs, 2, F.greatest(F.size(vs) - 1, F.lit(0)))).alias("class_id"))


@query("""WITH e AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(p31, '\\s+'), lambda x: x <> '')[2:]) AS class_id FROM wikidata_items)
SELECT class_id, count(*) AS n, min(item_id) AS first_item FROM e GROUP BY class_id""")
def instances_by_class(spark: SparkSession, d: str) -> DataFrame:
    return _instances(spark, d).select("item_id", "class_id").distinct().groupBy("class_id").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


# ---------------------------------------------------------------------------------------------------------------------
# rank cuts, de-duplication

_ASK = "(SELECT input_uid, result_sent_uid, result_column_uid, result_row_uid, max(score) AS score FROM ask_results WHERE input_uid IS NOT NULL AND result_sent_uid IS NOT NULL AND isfinite(score) AND score > 0 GROUP BY ALL)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "ask_results").filter("input_uid IS NOT NULL AND result_sent_uid IS NOT NULL AND score > 0 AND NOT isnan(score) AND score < double('Infinity')")
    return a.groupBy("input_uid", "result_sent_uid", "result_column_uid", "result_row_uid").agg(F.max("score").alias("score"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, max(o_totalprice) OVER (PARTITION BY o_custkey) AS best FROM orders)
SELECT o_custkey, o_orderkey, rank FROM r WHERE rank <= 5 AND o_totalprice > 0.5 * best""")
def half_of_best_cut(spark: SparkSession, d: str) -> DataFrame:
    return ranking.half_cut(table(spark, d, "orders"), "o_custkey", 5, "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH a AS (SELECT input_uid, result_row_uid, max(score) AS score FROM {_ASK} WHERE result_row_uid IS NOT NULL GROUP BY ALL),
b AS (SELECT *, result_row_uid % 50 AS chunk FROM a),
u AS (SELECT input_uid, chunk, max(score) AS score FROM b GROUP BY ALL),
f AS (SELECT *, max(score) OVER (PARTITION BY input_uid) AS best, row_number() OVER (PARTITION BY input_uid ORDER BY score DESC, chunk) AS k FROM u)
SELECT input_uid, chunk, score FROM f WHERE k <= 3 AND score >= 0.5 * best""")
def unique_chunk_cut(spark: SparkSession, d: str) -> DataFrame:
    a = _asked(spark, d).filter("result_row_uid IS NOT NULL").withColumn("chunk", F.col("result_row_uid") % 50)
    u = a.groupBy("input_uid", "chunk").agg(F.max("score").alias("score"))
    return ranking.unique_chunk_cut(u, "input_uid", "chunk", 3, "score").select("input_uid", "chunk", "score")


@query(f"SELECT result_column_uid, input_uid, result_sent_uid, row_number() OVER (PARTITION BY result_column_uid ORDER BY score DESC, input_uid, result_sent_uid, result_row_uid) AS rank FROM {_ASK} QUALIFY rank <= 20")
def top_per_column(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("result_column_uid").orderBy(F.col("score").desc(), "input_uid", "result_sent_uid", F.col("result_row_uid").asc_nulls_last())
    return _asked(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 20").select("result_column_uid", "input_uid", "result_sent_uid", "rank")


@query("""WITH b AS (SELECT l_returnflag, l_linestatus, l_suppkey, max(l_extendedprice) AS s FROM lineitem GROUP BY ALL),
p AS (SELECT l_returnflag, l_suppkey, sum(s) AS row_score FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY row_score DESC, l_suppkey) AS rank, max(row_score) OVER (PARTITION BY l_returnflag) AS top FROM p)
SELECT l_returnflag, l_suppkey, round(row_score, 4) AS row_score, rank FROM r WHERE rank <= 10 AND row_score > 0.5 * top""")
def row_score_cut(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.row_cut(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_suppkey", 10, "l_extendedprice")
    return r.select("l_returnflag", "l_suppkey", F.round("row_score", 4).alias("row_score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH s AS (SELECT row_uid, array_to_string(list_sort({_WORDS.format('row_str')}), chr(1)) AS bag FROM ygp_rows WHERE row_str IS NOT NULL)
SELECT min(row_uid) AS row_uid, count(*) AS n FROM s GROUP BY bag""")
def bag_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ygp_rows").filter("row_str IS NOT NULL").select("row_uid", X.bag_key(X.words(F.col("row_str"))).alias("bag"))
    # the key can be long: groups meet by its digest
    return rows.groupBy(F.sha2("bag", 256).alias("bag")).agg(F.min("row_uid").alias("row_uid"), F.count("*").alias("n")).select("row_uid", "n")


@query(f"SELECT input_uid, result_sent_uid, max(score) AS score, count(*) AS n FROM {_ASK} GROUP BY ALL")
def best_score_per_pair(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).groupBy("input_uid", "result_sent_uid").agg(F.max("score").alias("score"), F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT result_sent_uid, count(DISTINCT input_uid) AS n_queries, round(sum(score), 6) AS total FROM {_ASK} WHERE result_column_uid IN (0, 1) GROUP BY ALL)
SELECT result_sent_uid, n_queries, total FROM a WHERE n_queries >= 3""")
def sentences_of_many_queries(spark: SparkSession, d: str) -> DataFrame:
    a = _asked(spark, d).filter("result_column_uid IN (0, 1)")
    return a.groupBy("result_sent_uid").agg(F.countDistinct("input_uid").alias("n_queries"), F.round(F.sum("score"), 6).alias("total")).filter("n_queries >= 3")


@query("""SELECT reportid, max(rec_id) AS rec_id FROM reach_reports WHERE reportid IS NOT NULL
AND (reportid, loaded_at) IN (SELECT (reportid, max(loaded_at)) FROM reach_reports GROUP BY reportid) GROUP BY reportid""")
def newest_reports(spark: SparkSession, d: str) -> DataFrame:
    return ranking.newest(table(spark, d, "reach_reports").filter("reportid IS NOT NULL"), "reportid", "loaded_at", "rec_id").select("reportid", "rec_id")


@query("""SELECT l_returnflag, l_suppkey, round(sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) - w, 4) AS lo, round(sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_suppkey), 4) AS hi
FROM (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)""")
def cumulative_cells(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    c = ranking.cumulative(w, "w", "l_suppkey", "l_returnflag")
    return c.select("l_returnflag", "l_suppkey", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("SELECT l_suppkey, l_extendedprice FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS n FROM lineitem) WHERE n = 2")
def second_largest(spark: SparkSession, d: str) -> DataFrame:
    return similarity.second_largest(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice")


# ---------------------------------------------------------------------------------------------------------------------
# vectors


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS l2, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS l1,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS sig FROM embeddings""")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    e = table(spark, d, "embeddings")
    sig = V.sigmoid(F.element_at(v, 1).cast("double"))
    return e.select("vec_id", F.round(V.l2_norm(v), 6).alias("l2"), F.round(V.l1_norm(v), 6).alias("l1"), F.round(V.vector_sum(v), 6).alias("total"), F.round(sig, 6).alias("sig"))


_DBL = "list_transform({}, lambda x: x::DOUBLE)"


@query(f"""WITH e AS (SELECT vec_id, {_DBL.format('embedding')} AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(q.v, e.v) AS sim FROM q JOIN e ON q.vec_id <> e.vec_id)
SELECT query, id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def nearest_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The vectors whose id is divisible by 20 against all rows."""
    e = table(spark, d, "embeddings")
    n = similarity.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    return n.select("query", "id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH e AS (SELECT vec_id, {_DBL.format('embedding')} AS v FROM embeddings)
SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 6) AS sim FROM e q JOIN e ON q.vec_id % 20 = 0 WHERE list_cosine_similarity(q.v, e.v) >= 0.3""")
def similarity_table(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return similarity.similar_table(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 0.3).withColumn("sim", F.round("sim", 6))


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL)
SELECT label, max(n) AS n, array_to_string(list(printf('%.4f', round(m, 4) + 0.0) ORDER BY i), ',') AS centroid FROM m GROUP BY label""")
def class_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = similarity.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", "n", F.array_join(F.transform("centroid", lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0)), ",").alias("centroid"))


@query(f"""WITH e AS (SELECT vec_id, label, {_DBL.format('embedding')} AS v FROM embeddings),
p AS (SELECT a.vec_id, list_transform(list_zip(a.v, b.v), lambda z: z[1] + z[2]) AS s, list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])) AS t, a.v AS av, b.v AS bv FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(s), 6) AS sum_part, round(list_sum(t), 6) AS diff_part, len(s) + len(t) AS n, round(t[len(t)], 6) AS last_diff, round(list_inner_product(av, bv), 6) AS dot, round(list_distance(av, bv) * list_distance(av, bv), 5) AS dist2 FROM p""")
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    p = e.join(b, "vec_id").select("vec_id", "embedding", "other", V.pair_features(F.col("embedding"), F.col("other")).alias("f"), V.pair_features_last(F.col("embedding"), F.col("other")).alias("g"))
    half = (F.size("f") / 2).cast("int")
    return p.select(
        "vec_id",
        F.round(V.vector_sum(F.slice("f", 1, half)), 6).alias("sum_part"),
        F.round(V.vector_sum(F.slice("f", half + 1, half)), 6).alias("diff_part"),
        F.size("f").cast("long").alias("n"),
        F.round(F.element_at("g", -1), 6).alias("last_diff"),
        F.round(V.dot(F.col("embedding"), F.col("other")), 6).alias("dot"),
        F.round(V.squared_distance(F.col("embedding"), F.col("other")), 5).alias("dist2"),
    )


# ---------------------------------------------------------------------------------------------------------------------
# JSON, dumps, ETL


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type")
def json_property_sum(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@query("""WITH l AS (SELECT line_no, trim(raw_line) AS r FROM wikidata_dump), j AS (SELECT line_no, substring(r, 1, length(r) - 1) AS t FROM l WHERE r LIKE '%,'),
v AS (SELECT line_no, t FROM j WHERE json_valid(t) AND starts_with(t, '{')),
x AS (SELECT line_no, t->>'$.id' AS id, t->>'$.type' AS type, CASE WHEN json_type(t, '$.labels.en') = 'OBJECT' THEN t->>'$.labels.en.value' ELSE t->>'$.labels.en' END AS label FROM v)
SELECT line_no, id, type, label FROM x WHERE label IS NOT NULL""")
def items_with_label(spark: SparkSession, d: str) -> DataFrame:
    trimmed = table(spark, d, "wikidata_dump").select("line_no", F.rtrim("raw_line").alias("value"))
    lines = trimmed.filter(F.col("value").endswith(",")).select("line_no", F.expr("substring(value, 1, length(value) - 1)").alias("t"))
    v = lines.withColumn("v", F.try_parse_json("t")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    g = lambda p: F.try_variant_get("v", p, "string")
    label = F.coalesce(g("$.labels.en.value"), g("$.labels.en"))
    return v.select("line_no", g("$.id").alias("id"), g("$.type").alias("type"), label.alias("label")).filter("label IS NOT NULL")


_DUMP = """
l AS (SELECT line_no, regexp_replace(raw_line, '^[\\s,\\[\\]]+|[\\s,\\[\\]]+$', '', 'g') AS t FROM wikidata_dump),
j AS (SELECT line_no, t::JSON AS j FROM l WHERE starts_with(t, '{') AND ends_with(t, '}') AND json_valid(t)),
n AS (SELECT line_no, j, CASE WHEN json_type(j, '$.labels.en') = 'OBJECT' THEN j->>'$.labels.en.value' ELSE j->>'$.labels.en' END AS label FROM j)"""


@query(f"""WITH {_DUMP} SELECT line_no, j->>'$.id' AS id, j->>'$.type' AS type, label,
array_to_string(list_concat(['P31'], list_filter(coalesce(json_extract_string(j, '$.claims.P31[*].mainsnak.datavalue.value.id'), []), lambda x: x IS NOT NULL)), ' ') AS p31,
array_to_string(list_concat(['P279'], list_filter(coalesce(json_extract_string(j, '$.claims.P279[*].mainsnak.datavalue.value.id'), []), lambda x: x IS NOT NULL)), ' ') AS p279 FROM n WHERE label IS NOT NULL""")
def dump_items(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.items(table(spark, d, "wikidata_dump"))


@query(f"""WITH {_DUMP} SELECT line_no, j->>'$.id' AS id, alias FROM (SELECT line_no, j, unnest(CASE WHEN json_type(j, '$.aliases.en') = 'ARRAY' THEN json_extract_string(j, '$.aliases.en[*].value')
WHEN json_type(j, '$.aliases.en') = 'OBJECT' THEN [j->>'$.aliases.en.value'] ELSE [] END) AS alias FROM n WHERE label IS NOT NULL) WHERE alias IS NOT NULL""")
def dump_aliases(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.aliases(table(spark, d, "wikidata_dump"))


@query(f"""WITH {_DUMP}, k AS (SELECT line_no, j, unnest(json_keys(j, '$.claims')) AS property FROM j WHERE json_type(j, '$.claims') = 'OBJECT')
SELECT line_no, j->>'$.id' AS id, property, json_extract_string(j, '$.claims.' || property || '[0].mainsnak.datavalue.value.id') AS value FROM k WHERE value IS NOT NULL""")
def first_claims(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.first_claims(table(spark, d, "wikidata_dump"))


@query("""WITH e AS (SELECT item_id AS entity, unnest(list_filter(regexp_split_to_array(p31, '\\s+'), lambda x: x <> '')[2:]) AS class_id, coalesce(regexp_matches(item_label, '^[A-Z]'), false) AS named FROM wikidata_items),
v AS (SELECT class_id, sum(CASE WHEN named THEN 1 ELSE 0 END) * 5 > sum(CASE WHEN named THEN 0 ELSE 1 END) AS vote FROM e GROUP BY class_id),
a AS (SELECT DISTINCT item_id AS entity FROM wikidata_items)
SELECT a.entity, CASE WHEN bool_or(vote) THEN 'True' WHEN bool_or(NOT vote) THEN 'False' ELSE 'Unknown' END AS flag FROM a LEFT JOIN e USING (entity) LEFT JOIN v USING (class_id) GROUP BY a.entity""")
def entity_flags(spark: SparkSession, d: str) -> DataFrame:
    vs = X.words(F.col("p31"))
    e = table(spark, d, "wikidata_items").select(
        F.col("item_id").alias("entity"),
        F.explode_outer(F.slice(vs, 2, F.greatest(F.size(vs) - 1, F.lit(0)))).alias("class_id"),
        F.coalesce(F.col("item_label").rlike("^[A-Z]"), F.lit(False)).alias("named"),
    )
    return knowledge.entity_flags(e, "named")


@query("SELECT rec_id, 'content' AS column_name, regexp_replace(content, '\\r\\n|[\\r\\n]', ' ', 'g') AS text FROM reach_reports WHERE length(content) > 5 UNION ALL SELECT rec_id, 'abstract', regexp_replace(abstract, '\\r\\n|[\\r\\n]', ' ', 'g') FROM reach_reports WHERE length(abstract) > 5")
def stacked_columns(spark: SparkSession, d: str) -> DataFrame:
    return readers.long_form(table(spark, d, "reach_reports"), "rec_id", ["content", "abstract"], 5).select("rec_id", "column_name", "text")


@query("SELECT rec_id, p AS n_par, t AS text FROM (SELECT rec_id, len(regexp_extract_all(enregsummary, '(?is)<p>(.*?)</p>', 1)) AS p, array_to_string(regexp_extract_all(enregsummary, '(?is)<p>(.*?)</p>', 1), '|') AS t FROM regulation) WHERE p > 0")
def markup_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "regulation").select("rec_id", readers.paragraphs(F.col("enregsummary")).alias("ps")).filter(F.size("ps") > 0)
    return r.select("rec_id", F.size("ps").cast("long").alias("n_par"), F.array_join("ps", "|").alias("text"))


@query("SELECT y.row_uid, c.full_name, y.row_idx, coalesce(y.country, 'Unknown') AS country FROM ygp_rows y JOIN column_catalog c USING (col_uid)")
def rows_with_columns(spark: SparkSession, d: str) -> DataFrame:
    y, c = table(spark, d, "ygp_rows"), table(spark, d, "column_catalog")
    return y.join(F.broadcast(c), "col_uid").select("row_uid", "full_name", "row_idx", F.coalesce("country", F.lit("Unknown")).alias("country"))  # 11 rows


@query("""SELECT a.input_uid, a.result_sent_uid, c.table_name, coalesce(a.result_sent_country, 'Unknown') AS country, length(y.row_str) AS n_chars
FROM (SELECT input_uid, result_sent_uid, result_row_uid, max(result_sent_country) AS result_sent_country FROM ask_results WHERE score > 0 AND isfinite(score) GROUP BY ALL) a
JOIN ygp_rows y ON a.result_row_uid = y.row_uid LEFT JOIN column_catalog c USING (col_uid)""")
def results_with_rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "ask_results").filter("score > 0 AND NOT isnan(score) AND score < double('Infinity')")
    a = a.groupBy("input_uid", "result_sent_uid", "result_row_uid").agg(F.max("result_sent_country").alias("c"))
    y = table(spark, d, "ygp_rows").select(F.col("row_uid").alias("result_row_uid"), "col_uid", F.length("row_str").cast("long").alias("n_chars"))
    c = F.broadcast(table(spark, d, "column_catalog").select("col_uid", "table_name"))  # 11 rows
    return a.join(y, "result_row_uid").join(c, "col_uid", "left").select("input_uid", "result_sent_uid", "table_name", F.coalesce("c", F.lit("Unknown")).alias("country"), "n_chars")


# ---------------------------------------------------------------------------------------------------------------------
# dependency trees, suggestions, rendering


@query(f"""WITH {_TOKENS}, {_PAIRS}, t AS (SELECT sent_uid, pos, coalesce(s.score, 0.0) AS w FROM tokens LEFT JOIN scores s USING (word))
SELECT sent_uid, pos, round(sum(w) OVER (PARTITION BY sent_uid ORDER BY pos), 6) AS subtree FROM t""")
def subtree_sums(spark: SparkSession, d: str) -> DataFrame:
    trees = _trees(spark, d)
    return depgraph.fragilities(trees, with_fragility=False).select("sent_uid", F.col("pos").cast("long").alias("pos"), F.round("subtree", 6).alias("subtree"))


def _trees(spark: SparkSession, d: str) -> DataFrame:
    t = vocabulary.with_default(_tokens(spark, d), _importance(spark, d), "word", "score", 0.0)
    return depgraph.sentence_trees(t)


@query()
def phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of all sentences by fragility; iterative, tested against literal cases."""
    p = depgraph.segment(_trees(spark, d), 5.0)
    return p.select("sent_uid", "phrase_no", F.array_join("ws", " ").alias("phrase"), F.round("score", 6).alias("score"))


@query()
def phrase_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Phrases around the words of asked sentences that are not noisy."""
    imp = _importance(spark, d)
    t = _tokens(spark, d)
    ideas = _query_words(spark, d, t, imp).filter(F.col("score") >= importance.NOISY_BELOW).select("word").distinct()
    return depgraph.suggest(depgraph.segment(_trees(spark, d), 0.5, longest=100), ideas)


@query(f"""WITH {_TOKENS}, {_PAIRS}, {_SEARCH}, total AS (SELECT q, sent_uid, round(sum(score), 6) AS score FROM hits GROUP BY ALL HAVING round(sum(score), 6) > 0),
r AS (SELECT q, sent_uid, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, sent_uid) AS rank FROM total QUALIFY rank <= 5),
need AS (SELECT q, sum(score) AS total FROM qh GROUP BY q)
SELECT r.q, count(*) AS n, string_agg(sent_uid::VARCHAR, ',' ORDER BY rank) AS sents, sum(CASE WHEN r.score > need.total THEN 1 ELSE 0 END)::BIGINT AS n_high FROM r JOIN need USING (q) GROUP BY r.q""")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    words, _, found = _search(spark, d)
    high = render.is_highly_met(found, words)
    per = high.groupBy("q").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "sent_uid"))).alias("s"), F.sum(F.col("is_highly_met").cast("long")).alias("n_high"))
    return per.select("q", "n", F.array_join(F.transform("s", lambda x: x.sent_uid.cast("string")), ",").alias("sents"), "n_high")


@query(f"""WITH {_TOKENS}, {_PAIRS}, {_SEARCH}, total AS (SELECT q, sent_uid, round(sum(score), 6) AS score FROM hits GROUP BY ALL HAVING round(sum(score), 6) > 0),
r AS (SELECT q, sent_uid FROM total QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, sent_uid) <= 5),
places AS (SELECT sent_uid, pos, word, lead(word) OVER (PARTITION BY sent_uid ORDER BY pos) AS head_word FROM tokens),
m AS (SELECT qh.q, qh.q_pos, p.sent_uid, p.pos, round(qh.score * s.similarity * (1 + qh.head_score * coalesce(h.similarity, 0.0)), 6) AS score
  FROM r JOIN qh USING (q) JOIN sim s ON qh.word = s.word JOIN places p ON p.word = s.sim_word AND p.sent_uid = r.sent_uid
  LEFT JOIN sim h ON h.word = qh.head_word AND h.sim_word = p.head_word WHERE qh.score >= 0.6)
SELECT q, sent_uid, q_pos, pos, score FROM m QUALIFY row_number() OVER (PARTITION BY q, sent_uid, q_pos ORDER BY score DESC, pos) = 1""")
def result_matches(spark: SparkSession, d: str) -> DataFrame:
    """Where every word of an asked sentence meets each of its results."""
    words, similar, found = _search(spark, d)
    found = materialise(found, "found")
    results = F.broadcast(found.select("sent_uid").distinct())  # at most five a query
    t = tokens.token_table(_sentences(spark, d).join(results, "sent_uid", "left_semi"))
    return search.match_list(found, words, similar, t).select("q", "sent_uid", F.col("q_pos").cast("long").alias("q_pos"), F.col("pos").cast("long").alias("pos"), "score")


@query(f"""WITH {_TOKENS}, {_PAIRS}, {_SEARCH}
SELECT q, string_agg(word, ' ' ORDER BY q_pos) AS words, string_agg(CASE WHEN score >= 0.6 THEN '1' ELSE '0' END, '' ORDER BY q_pos) AS kept, round(sum(score), 6) AS cutoff FROM q GROUP BY q""")
def query_info(spark: SparkSession, d: str) -> DataFrame:
    """Words of every asked sentence, which of them count, and the sum of their importances."""
    words = _query_words(spark, d, _tokens(spark, d), _importance(spark, d))
    per = words.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("q_pos", "word", (F.col("score") >= 0.6).cast("int").cast("string").alias("k")))).alias("ws"), F.round(F.sum("score"), 6).alias("cutoff"))
    return per.select("q", F.array_join(F.transform("ws", lambda x: x.word), " ").alias("words"), F.array_join(F.transform("ws", lambda x: x.k), "").alias("kept"), "cutoff")


@query("""WITH v AS (SELECT word, min(list_transform(wvec, lambda x: x::DOUBLE)) AS v, max(n_seen) AS n FROM word_vectors
  WHERE word IS NOT NULL AND len(wvec) = 100 AND len(list_filter(wvec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(wvec, lambda x: x <> 0)) > 0 GROUP BY word),
u AS (SELECT word, n, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))::DOUBLE[100] AS v FROM v),
s AS (SELECT word, 0.9 * (1 - 1 / greatest(1.0, ln(n) + 0.001)) AS score, v FROM u WHERE n > 0),
p AS (SELECT a.word, b.word AS sim_word, a.score, array_inner_product(a.v, b.v) AS c FROM s a JOIN u b ON TRUE WHERE a.score >= 0.6)
SELECT word, sim_word, round(c, 4) AS similarity FROM p WHERE round(c, 9) >= round(0.7 * score, 9)""")
def similar_words(spark: SparkSession, d: str) -> DataFrame:
    """For each word whose importance, here by how often it was seen, is not noisy: all words within its threshold."""
    numbers = F.filter("wvec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = table(spark, d, "word_vectors").filter((F.size("wvec") == 100) & (F.size(numbers) == 100) & F.exists("wvec", lambda x: x != 0))
    v = v.select("word", F.col("wvec").cast("array<double>").alias("vec"), "n_seen")
    stated = v.filter("word is not null").groupBy("word").agg(F.max("n_seen").alias("n")).filter("n > 0")
    stated = stated.select("word", importance.score(F.log(F.col("n"))).alias("score"))
    return search.vector_similar(stated, v).withColumn("similarity", F.round("similarity", 4))


# ---------------------------------------------------------------------------------------------------------------------
# learned weights, latent spaces, trees

_LABELLED = """
p AS (SELECT rec_id, CASE WHEN rec_id % 2 = 0 THEN 1 ELSE -1 END AS label, list_distinct(list_filter(regexp_split_to_array(lower(abstract), '\\s+'), lambda w: w <> '')) AS a,
  list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS b FROM reach_reports WHERE abstract IS NOT NULL AND content IS NOT NULL),
s AS (SELECT rec_id, label, unnest(a) AS word, 1 AS x, 0 AS y FROM p UNION ALL SELECT rec_id, label, unnest(b), 0, 1 FROM p),
m AS (SELECT rec_id, label, word, max(x) * max(y) AS shared FROM s GROUP BY ALL),
c AS (SELECT word, sum(CASE WHEN label = 1 AND shared = 1 THEN 1 ELSE 0 END)::DOUBLE AS p1, sum(CASE WHEN label = 1 AND shared = 0 THEN 1 ELSE 0 END)::DOUBLE AS p0,
  sum(CASE WHEN label = -1 AND shared = 1 THEN 1 ELSE 0 END)::DOUBLE AS n1, sum(CASE WHEN label = -1 AND shared = 0 THEN 1 ELSE 0 END)::DOUBLE AS n0 FROM m GROUP BY word),
r AS (SELECT word, (p1 + 0.05) / (p1 + p0 + 0.1) AS p, (n1 + 0.05) / (n1 + n0 + 0.1) AS q FROM c)"""


@query(f"WITH {_LABELLED} SELECT word, round(p * ln((p + 1e-7) / (q + 1e-7)) + (1 - p) * ln((1 - p + 1e-7) / (1 - q + 1e-7)), 9) AS weight FROM r")
def discriminative_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of words of report pairs (abstract, content); labels stand for judged pairs."""
    r = table(spark, d, "reach_reports").filter("abstract IS NOT NULL AND content IS NOT NULL")
    label = F.when(F.col("rec_id") % 2 == 0, 1).otherwise(-1).alias("label")
    p = r.select(label, X.words(F.lower("abstract")).alias("words1"), X.words(F.lower("content")).alias("words2"))
    return weighting.kld_weights(p).withColumn("weight", F.round("weight", 9))


@query(f"""WITH tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format('lower(text)')}) AS word FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
df AS (SELECT word, ln((SELECT count(*) FROM documents WHERE text IS NOT NULL)::DOUBLE / count(*)) AS idf FROM tf GROUP BY word),
w AS (SELECT doc_id, word, tf * idf AS w FROM tf JOIN df USING (word)), m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
u AS (SELECT doc_id, word, w / norm AS u FROM w JOIN m USING (doc_id) WHERE norm > 0),
s AS (SELECT a.doc_id AS query, b.doc_id, round(sum(a.u * b.u), 6) AS sim FROM u a JOIN u b USING (word) WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL)
SELECT query, doc_id, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose doc_id is divisible by 20 as queries against all documents."""
    docs = _docs(spark, d).filter("text IS NOT NULL")
    lists = docs.select("doc_id", X.words(F.lower("text")).alias("words"))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"))
    if again.limit(1).collect():  # texts of the same number are one document
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        merged = lists.join(F.broadcast(again), same, "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("words")).alias("words"))
        lists = lists.join(F.broadcast(again), same, "left_anti").unionByName(merged)
    found = weighting.similar_by_words(lists, lists.filter("doc_id % 20 = 0"), "doc_id", "words", docs.count(), 5)
    return found.select("query", "doc_id", "sim", F.col("rank").cast("long").alias("rank"))


@query()
def sampled_events(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 100 events: the sample is the feature."""
    return sampling.random_rows(table(spark, d, "events"), "event_id", 100).select("event_id", "event_type")


@query()
def noise_draws(spark: SparkSession, d: str) -> DataFrame:
    """A word per cell, drawn with probability proportional to its count^0.75."""
    counts = vocabulary.word_counts(_docs(spark, d), "text", 20).withColumn("w", vocabulary.noise_weight(F.col("n")))
    return sampling.weighted_draws(counts, "word", "w", table(spark, d, "ygp_rows").select("row_uid"), "row_uid")


@query()
def latent_documents(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings in their 8 strongest directions."""
    latent, _, _ = models.latent_space(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return latent.select("vec_id", F.transform("latent", lambda x: F.round(x, 4)).alias("latent"))


@query()
def principal_plane(spark: SparkSession, d: str) -> DataFrame:
    p = models.principal_components(table(spark, d, "embeddings"), "vec_id", "embedding", 2)
    return p.select("vec_id", F.transform("pc", lambda x: F.round(x, 4)).alias("pc"))


@query()
def document_topics(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).filter("text IS NOT NULL").select("doc_id", X.words(F.lower("text")).alias("words"))
    return models.hashed_topics(docs, "doc_id", "words")


@query()
def word_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of vectors by k-means."""
    numbers = F.filter("wvec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = table(spark, d, "word_vectors").filter((F.size("wvec") == 100) & (F.size(numbers) == 100))
    return models.word_classes(v, "voca_idx", "wvec", 20)


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_distance(a.v, b.v), 6) AS distance, list_distance(a.v, b.v) AS d FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query, id, distance FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(d, 9), id) <= 5""")
def nearest_by_tree(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rows by vantage-point trees, of every vector whose vec_id is divisible by 20."""
    e = table(spark, d, "embeddings")
    return metric_tree.nearest_by_tree(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("query", "id", F.round("distance", 6).alias("distance"))


@query()
def svm_labels(spark: SparkSession, d: str) -> DataFrame:
    """Linear classifier of embeddings by whether their label is below 5, applied to all rows."""
    e = table(spark, d, "embeddings").withColumn("y", F.when(F.col("label") < 5, 1).otherwise(-1))
    model = models.train_svm(e, "y", "embedding")
    return e.select("vec_id", "y", (models.svm_score(model, F.col("embedding")) > 0).alias("positive"))


@query(f"""WITH {_TOKENS} SELECT sent_uid, any_value(n) - 1 AS n_merges,
  string_agg(replace(replace(word, '(', '⟨'), ')', '⟩'), ' ' ORDER BY pos) AS leaves FROM tokens GROUP BY sent_uid""")
def parse_trees(spark: SparkSession, d: str) -> DataFrame:
    """Greedy trees of all sentences: a tree of n words has n - 1 merges and its words in order.  Both are read off the trees."""
    s = _sentences(spark, d).select("sent_uid", X.words(F.col("sentence")).alias("ws"))
    trees = parser.parse_sentences(s, None, parser.Merger.random(8, 3))
    merges = F.length("tree") - F.length(F.replace(F.col("tree"), F.lit(")"), F.lit("")))
    leaves = F.array_join(F.array_remove(F.split(F.regexp_replace("tree", "[()]", " "), "\\s+"), ""), " ")
    return trees.select("sent_uid", merges.cast("long").alias("n_merges"), leaves.alias("leaves"))


@query()
def sentence_parses(spark: SparkSession, d: str) -> DataFrame:
    """The greedy trees themselves with their scores, under fixed weights; tested against a tree worked out by hand."""
    s = _sentences(spark, d).select("sent_uid", X.words(F.col("sentence")).alias("ws"))
    return parser.parse_sentences(s, None, parser.Merger.random(8, 3)).select("sent_uid", "tree", F.round("score", 6).alias("score"))


_KNOWN = f"""
c AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('row_str')}) AS word FROM ygp_rows) GROUP BY word),
known AS (SELECT word, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS vec_id FROM c) JOIN embeddings USING (vec_id))"""


def _known_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The known vocabulary: the most frequent words of cells, as many as embeddings has vectors, in order."""
    vectors = (table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1
    counts = ranking.top_n(vocabulary.word_counts(table(spark, d, "ygp_rows"), "row_str"), vectors, "n", "word")
    ranks = counts.withColumn("vec_id", (F.row_number().over(Window.orderBy(F.col("n").desc(), "word")) - 1).cast("long"))  # a row per vector
    return ranks.join(table(spark, d, "embeddings"), "vec_id").select("word", F.col("embedding").alias("vec"))


@query(f"""WITH {_KNOWN},
t AS (SELECT row_uid, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM (SELECT row_uid, {_WORDS.format('row_str')} AS ws FROM ygp_rows WHERE row_str IS NOT NULL)),
p AS (SELECT a.row_uid, a.word, b.word AS context FROM t a JOIN t b ON a.row_uid = b.row_uid AND a.pos <> b.pos AND b.pos BETWEEN a.pos - 5 AND a.pos + 5),
s AS (SELECT row_uid, ln(1 / (1 + exp(-list_cosine_similarity(x.vec, y.vec)))) AS s FROM p JOIN known x USING (word) JOIN known y ON y.word = p.context)
SELECT row_uid, count(*) AS n, round(sum(s), 6) AS score FROM s GROUP BY row_uid""")
def context_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well the words of a cell fit their contexts, within five words."""
    cells = table(spark, d, "ygp_rows").filter("row_str IS NOT NULL").select(F.col("row_uid").alias("sent_uid"), X.words(F.col("row_str")).alias("ws"))
    pairs = tokens.contexts(cells, 5)
    s = similarity.context_scores(pairs, _known_vectors(spark, d), "sent_uid")
    return s.select(F.col("sent_uid").alias("row_uid"), "n", F.round("score", 6).alias("score"))


@query()
def context_derived_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of words outside of a known vocabulary, from the vectors of their contexts in cells."""
    known = _known_vectors(spark, d)
    cells = table(spark, d, "ygp_rows").filter("row_str IS NOT NULL").select(F.col("row_uid").alias("sent_uid"), X.words(F.col("row_str")).alias("ws"))
    pairs = tokens.contexts(cells, 10)
    unseen = pairs.join(known, "word", "left_anti")
    v = similarity.context_vectors(unseen, known)
    return v.select("word", "n", F.round(F.get("centroid", F.lit(0)), 5).alias("first"))


# ---------------------------------------------------------------------------------------------------------------------
# streams (the same plans run on a stream; these run on what is there)


@query("SELECT date_trunc('day', ts) AS beg, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def day_windows(spark: SparkSession, d: str) -> DataFrame:
    return flows.window_counts(table(spark, d, "events"), "ts", "event_type", "value", "1 day")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS beg, count(*) AS n FROM g GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return flows.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours")


# ---------------------------------------------------------------------------------------------------------------------
# 7: deeply nested semi-structured records


_NODES = r"""
WITH l AS (SELECT line_no, regexp_replace(raw_line, '^[\s,\[\]]+|[\s,\[\]]+$', '', 'g') AS t FROM wikidata_dump),
j AS (SELECT line_no, t::JSON AS j FROM l WHERE starts_with(t, '{') AND ends_with(t, '}') AND json_valid(t)),
n AS (SELECT line_no, t.type, regexp_replace(regexp_replace(replace(substring(t.fullkey, 3), '"', ''), '\.', '/', 'g'), '\[(\d+)\]', '/\1', 'g') AS p FROM j, json_tree(j.j) t),
k AS (SELECT line_no, p AS node_path, CASE
  WHEN regexp_full_match(p, 'labels/[^/]+') AND type IN ('OBJECT', 'VARCHAR') THEN 'label'
  WHEN regexp_full_match(p, 'aliases/[^/]+(/\d+)?') AND type = 'OBJECT' THEN 'alias'
  WHEN regexp_full_match(p, 'claims/P\d+/\d+') AND type = 'OBJECT' THEN 'claim'
  WHEN regexp_full_match(p, 'claims/P\d+/\d+/qualifiers/(P\d+/)?\d+') AND type = 'OBJECT' THEN 'qualifier'
  WHEN regexp_full_match(p, 'claims/P\d+/\d+/references/\d+') AND type = 'OBJECT' THEN 'reference'
  WHEN regexp_full_match(p, 'claims/P\d+/\d+/references/\d+/snaks/(P\d+/)?\d+') AND type = 'OBJECT' THEN 'refsnak' END AS kind FROM n)
"""


@query(_NODES + "SELECT line_no, kind, node_path FROM k WHERE kind IS NOT NULL")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes(table(spark, d, "wikidata_dump")).select("line_no", "kind", "node_path")


@query(_NODES + "SELECT line_no, kind, node_path, array_to_string(string_split(node_path, '/')[:3], '/') AS claim_path FROM k WHERE kind = 'refsnak'")
def p7_refsnaks_of_claims(spark: SparkSession, d: str) -> DataFrame:
    """Reference snaks with the claim that contains them, linked by intervals over two levels."""
    labelled = nested.nodes(table(spark, d, "wikidata_dump"), kinds=("claim", "refsnak"))
    return nested.linked(labelled, "claim", "refsnak", "claim").select("line_no", F.lit("refsnak").alias("kind"), "node_path", "claim_path")
