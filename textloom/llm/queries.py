"""The queries pN_... of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import distinct, encoding, frequency, mixing, neighbours, packing, quality, sentences, tokens, topn
from textloom.operators import similarity
from textloom.workspace import materialise, new_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 2: top N items within every group


def _top_results(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, d, "ask_results"), "input_uid", "result_sent_uid", "score", n=5)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _top_results(spark, d).select("input_uid", "result_sent_uid")


@query
def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _top_results(spark, d).select("input_uid", "result_sent_uid", "score", F.col("rank").cast("long").alias("rank"))


_BEST = """
WITH best AS (
  SELECT input_uid, result_sent_uid, max(score) AS score FROM ask_results
  WHERE input_uid IS NOT NULL AND result_sent_uid IS NOT NULL AND isfinite(score) AND score > 0
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY input_uid ORDER BY score DESC, result_sent_uid) AS rank FROM best)
"""
SQL["p2_found"] = _BEST + "SELECT input_uid, result_sent_uid FROM ranked WHERE rank <= 5"
SQL["p2_ranked"] = _BEST + "SELECT input_uid, result_sent_uid, score, rank FROM ranked WHERE rank <= 5"

# 3: how distinctive a term is per record


def _records(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "ygp_rows").select(F.lit("row_str").alias("src_field"), F.col("row_uid").alias("rec_key"), F.col("row_str").alias("text"))
    sums = table(spark, d, "regulation").select(F.lit("enregsummary").alias("src_field"), F.col("rec_id").alias("rec_key"), F.col("enregsummary").alias("text"))
    return cells.unionByName(sums)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return distinct.distinctive_terms(_records(spark, d), top=3, min_df=3, by="tf_idf").select("src_field", "rec_key", "term")


@query
def p3_residual(spark: SparkSession, d: str) -> DataFrame:
    found = distinct.distinctive_terms(_records(spark, d), top=3, min_df=3, by="residual")
    return found.select("src_field", "rec_key", "term", "tf", "df", "cf")


_TERMS = """
WITH records AS (
  SELECT 'row_str' AS src_field, row_uid AS rec_key, row_str AS text FROM ygp_rows WHERE row_str IS NOT NULL
  UNION ALL SELECT 'enregsummary', rec_id, enregsummary FROM regulation WHERE enregsummary IS NOT NULL),
sizes AS (SELECT src_field, count(*) AS n FROM records GROUP BY ALL),
tf AS (
  SELECT src_field, rec_key, lower(t) AS term, count(*) AS tf
  FROM (SELECT src_field, rec_key, unnest(regexp_extract_all(text, '\\p{L}+')) AS t FROM records) GROUP BY ALL),
stats AS (
  SELECT src_field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY ALL HAVING count(*) >= 3),
scored AS (
  SELECT src_field, rec_key, term, tf, df, cf, round(tf * ln(n::DOUBLE / df), 6) AS tf_idf,
    round(tf * (ln(n::DOUBLE / df) + ln(1 - exp(-cf::DOUBLE / n))), 6) AS residual
  FROM tf JOIN stats USING (src_field, term) JOIN sizes USING (src_field))
"""
SQL["p3_found"] = _TERMS + """SELECT src_field, rec_key, term FROM scored
QUALIFY row_number() OVER (PARTITION BY src_field, rec_key ORDER BY tf_idf DESC, term) <= 3"""
SQL["p3_residual"] = _TERMS + """SELECT src_field, rec_key, term, tf, df, cf FROM scored
QUALIFY row_number() OVER (PARTITION BY src_field, rec_key ORDER BY residual DESC, term) <= 3"""

# 6: frequency of every distinct value or term

#: arrivals up to this day make the first load, the others come as a change set
FIRST_LOAD_UNTIL = "2018-07-01"


def _term_records(spark: SparkSession, d: str) -> DataFrame:
    """(field, terms, loaded_at) of wikidata_items.p31, without the property's name, and of ygp_rows.row_str."""
    values = frequency.white_space_terms(F.col("p31"))
    p31 = table(spark, d, "wikidata_items").select(F.lit("p31").alias("field"), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))).alias("terms"), "loaded_at")
    cells = table(spark, d, "ygp_rows").select(F.lit("row_str").alias("field"), frequency.white_space_terms(F.col("row_str")).alias("terms"), "loaded_at")
    return p31.unionByName(cells)


def _counts(spark: SparkSession, d: str) -> frequency.TermCounts:
    records = _term_records(spark, d).withColumn("sign", F.lit(1))
    late = F.coalesce(F.col("loaded_at") >= F.lit(FIRST_LOAD_UNTIL).cast("timestamp"), F.lit(False))
    store = frequency.TermCounts(spark, new_dir(spark, "counts"))
    store.apply(records.filter(~late).drop("loaded_at"))
    return store.apply(records.filter(late).drop("loaded_at"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).marked().filter(F.col("mark").isNotNull()).select(F.col("field").alias("src_field"), "term", "mark")


@query
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).marked().select(F.col("field").alias("src_field"), "term", "occurrences", "records", "mark")


_COUNTS = """
WITH cells AS (
  SELECT 'p31' AS src_field, rec_id AS k, list_filter(regexp_split_to_array(p31, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')[2:] AS terms FROM wikidata_items
  UNION ALL SELECT 'row_str', row_uid, list_filter(regexp_split_to_array(row_str, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') FROM ygp_rows),
sizes AS (SELECT src_field, count(*) AS n FROM cells GROUP BY ALL),
tf AS (SELECT src_field, k, term, count(*) AS tf FROM (SELECT src_field, k, unnest(terms) AS term FROM cells) GROUP BY ALL),
counts AS (SELECT src_field, term, sum(tf)::BIGINT AS occurrences, count(*) AS records FROM tf GROUP BY ALL),
marked AS (
  SELECT src_field, term, occurrences, records,
    CASE WHEN occurrences < 3 THEN 'rare' WHEN records > 0.05 * n THEN 'common' END AS mark
  FROM counts JOIN sizes USING (src_field))
"""
SQL["p6_found"] = _COUNTS + "SELECT src_field, term, mark FROM marked WHERE mark IS NOT NULL"
SQL["p6_counts"] = _COUNTS + "SELECT src_field, term, occurrences, records, mark FROM marked"



def _cell_terms(df: DataFrame, text: str, sign: int | None = None) -> DataFrame:
    terms = df.select(F.lit("row_str").alias("field"), frequency.white_space_terms(F.col(text)).alias("terms"), *([] if sign is not None else ["sign"]))
    return terms.withColumn("sign", F.lit(sign)) if sign is not None else terms


@query
def p6_changed(spark: SparkSession, d: str) -> DataFrame:
    """The counts after a second dump: late cells added, cells without a country deleted, texts in lower case and trimmed."""
    cells = table(spark, d, "ygp_rows").select("row_uid", "row_str", "country", "loaded_at")
    old = cells.filter(F.col("loaded_at") < F.lit(FIRST_LOAD_UNTIL).cast("timestamp"))
    new = cells.filter(F.col("country").isNotNull()).select("row_uid", F.lower(F.trim("row_str")).alias("row_str"))
    store = frequency.TermCounts(spark, new_dir(spark, "counts")).apply(_cell_terms(old, "row_str", 1))
    store = frequency.TermCounts(spark, store.path).apply(_cell_terms(frequency.changes(old, new, "row_uid", "row_str"), "text"))
    return store.marked().select("term", "occurrences", "records", "mark")


SQL["p6_changed"] = """
WITH cells AS (
  SELECT row_uid AS k, list_filter(regexp_split_to_array(lower(trim(row_str, ' ')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS terms
  FROM ygp_rows WHERE country IS NOT NULL),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM cells) GROUP BY ALL)
SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS records,
  CASE WHEN sum(tf) < 3 THEN 'rare' WHEN count(*) > 0.05 * (SELECT count(*) FROM cells) THEN 'common' END AS mark
FROM tf GROUP BY term"""

# 8: filling fixed-capacity containers; 9: mixing sources


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", tokens.token_count(F.col("text")).alias("n_tokens"))
    return materialise(docs, "sizes")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    capacities = {r[0]: r[1] for r in table(spark, d, "containers").select("container_kind", "capacity_tokens").collect()}  # 4 rows, fixed
    return packing.pack(_sizes(spark, d), capacities, "doc_id", "n_tokens")


@query
def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query
def p8_filled(spark: SparkSession, d: str) -> DataFrame:
    return packing.filled(_packed(spark, d), table(spark, d, "containers"))


def _in_characters(spark: SparkSession, d: str) -> DataFrame:
    return materialise(table(spark, d, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n_tokens")), "sizes")


@query
def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Packing by characters, of which SQL knows the sizes: what is placed, containers that hold too much or have gaps, and
    documents that are split although they fit."""
    kinds = table(spark, d, "containers").select("container_kind", (4 * F.col("capacity_tokens")).alias("room"))
    packed = materialise(packing.pack(_in_characters(spark, d), {r[0]: r[1] for r in kinds.collect()}, "doc_id", "n_tokens"), "packed")  # 4 rows, fixed
    per_box = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("begin") + F.col("n_tokens")).alias("end"))
    boxes = per_box.join(F.broadcast(kinds), "container_kind").groupBy("container_kind").agg(
        F.sum((F.col("n") > F.col("room")).cast("long")).alias("overfull"), F.sum((F.col("n") != F.col("end")).cast("long")).alias("gaps")
    )
    per_doc = packed.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    docs = per_doc.join(F.broadcast(kinds), "container_kind").groupBy("container_kind").agg(
        F.count("*").alias("documents"), F.sum("n").alias("characters"), F.sum((F.col("pieces") != F.ceil(F.col("n") / F.col("room"))).cast("long")).alias("split")
    )
    return docs.join(boxes, "container_kind")


SQL["p8_invariants"] = """SELECT container_kind, count(*) AS documents, sum(length(text))::BIGINT AS characters, 0 AS split, 0 AS overfull, 0 AS gaps
FROM containers, documents WHERE length(text) > 0 GROUP BY container_kind"""


@query
def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Mixing by characters: what each source has and should give, whether it gives that to within its longest document,
    in how many passes, and whether each document, drawn or not, comes once for every whole pass and at most once more,
    each time with another of the numbers from 0. One row per mix and source, however many documents there are."""
    sizes, targets = _in_characters(spark, d), table(spark, d, "mix_targets")
    given = mixing.shares(sizes, targets)
    rows = materialise(mixing.mix(sizes, targets), "mixed")
    longest = sizes.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    known = sizes.filter("source IS NOT NULL AND n_tokens > 0")
    plan = mixing.mix_plan(known, targets)
    passes = F.col("taken") / F.col("available")
    due = known.join(F.broadcast(plan.filter("taken > 0")), "source").select("mix_name", "source", "doc_id", F.floor(passes).alias("least"), F.ceil(passes).alias("most"))
    copies = due.unionByName(rows.select("mix_name", "source", "doc_id", "copy_no"), allowMissingColumns=True).groupBy("mix_name", "source", "doc_id").agg(
        F.max("least").alias("least"), F.max("most").alias("most"), F.count("copy_no").alias("n"), F.count_distinct("copy_no").alias("numbers"), F.max("copy_no").alias("last")
    )
    in_turn = (F.col("n") == F.col("numbers")) & (F.col("n") == F.coalesce("last", F.lit(-1)) + 1)
    even = F.coalesce(F.col("n").between(F.col("least"), F.col("most")), F.lit(False))  # what isn't due has no bounds
    whole = copies.groupBy("mix_name", "source").agg(F.min(in_turn & even).alias("even"))
    all_ = given.join(plan.select("mix_name", "source", "taken"), ["mix_name", "source"]).join(longest, "source", "left").join(whole, ["mix_name", "source"], "left")
    near = F.abs(F.col("tokens") - F.col("taken")) <= F.coalesce("longest", F.lit(0))
    return all_.select("mix_name", "source", "available", F.round("taken", 3).alias("taken"), near.alias("reached"), F.coalesce("even", F.lit(True)).alias("even"), (F.col("passes") <= F.col("max_repeats")).alias("within"))


SQL["p9_invariants"] = """WITH have AS (SELECT source, sum(length(text))::BIGINT AS available FROM documents WHERE source IS NOT NULL AND length(text) > 0 GROUP BY source),
t AS (SELECT mix_name, source, target_share, max_repeats, coalesce(available, 0) AS available FROM mix_targets LEFT JOIN have USING (source) WHERE target_share > 0),
m AS (SELECT *, sum(available) OVER (PARTITION BY mix_name) AS whole FROM t)
SELECT mix_name, source, available, round(least(target_share * whole, (available * max_repeats)::DOUBLE), 3) AS taken, TRUE AS reached, TRUE AS even, TRUE AS within FROM m"""


@query
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_sizes(spark, d), table(spark, d, "mix_targets"))

# 5: sentence boundaries


def _long_texts(spark: SparkSession, d: str) -> DataFrame:
    reports, rules = table(spark, d, "reach_reports"), table(spark, d, "regulation")
    unknown = F.lit(None).cast("string")  # the field of the English texts holds other languages too
    parts = [(reports, "content", F.col("lang")), (reports, "abstract", F.col("lang")), (rules, "enmainrequire", unknown)]
    rows = [t.select(F.lit(c).alias("src_field"), "rec_id", F.col(c).alias("text"), lang.alias("lang")) for t, c, lang in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_long_texts(spark, d))


@query
def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_long_texts(spark, d), with_text=True)

# 10: text quality


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents")).filter("not_prose").select("doc_id")


@query
def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents"))



@query
def p10_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts that SQL can form too."""
    return quality.counts(table(spark, d, "documents")).select("doc_id", "n_chars", "n_visible", "n_words", "n_lines")


_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SQL["p10_counts"] = f"""SELECT doc_id, length(text) AS n_chars, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS n_visible,
len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> '')) AS n_words, length(text) - length(replace(text, chr(10), '')) AS n_lines
FROM documents WHERE text IS NOT NULL"""

# 4: garbled text from wrong character encoding


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ygp_rows").select("row_uid", "lang", F.col("row_str").alias("text"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(_cells(spark, d)).select("row_uid")


@query
def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(_cells(spark, d)).select("row_uid", "chain", "restored")

# 1: most similar vectors for every vector


#: far neighbours take longer lists and a wider start than the close pairs of p1_found
FAR = {"width": 56, "sample": 22, "probes": 9, "waves": 4, "stop_share": 0.01}


def _graph(spark: SparkSession, d: str, **how: float) -> neighbours.Graph:
    return neighbours.nn_descent(table(spark, d, "word_vectors"), "voca_idx", "wvec", dim=100, k=10, **how)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours.similar_pairs(_graph(spark, d), table(spark, d, "word_vectors"), "voca_idx", "wvec", k=10, least=0.80)
    return pairs.select(F.col("a").alias("voca_idx_a"), F.col("b").alias("voca_idx_b"))


#: all pairs, for comparison on small tables
SQL["p1_found"] = """
WITH v AS (SELECT voca_idx, list_transform(wvec, lambda x: x::DOUBLE) AS v FROM word_vectors WHERE len(wvec) = 100 AND len(list_filter(wvec, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT voca_idx, v, sqrt(list_inner_product(v, v)) AS n FROM v),
w AS (SELECT voca_idx, list_transform(v, lambda x: x / n)::DOUBLE[100] AS v FROM u WHERE n > 0),
p AS (SELECT a.voca_idx AS a, b.voca_idx AS b, array_inner_product(a.v, b.v) AS c FROM w a JOIN w b ON a.voca_idx <> b.voca_idx),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM p WHERE c >= 0.7)
SELECT DISTINCT least(a, b) AS voca_idx_a, greatest(a, b) AS voca_idx_b FROM r WHERE k <= 10 AND c >= 0.8"""


@query
def p1_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose voca_idx is divisible by 20 among all rows, exactly, by blocked products."""
    numbers = F.filter("wvec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = table(spark, d, "word_vectors").filter((F.size("wvec") == 100) & (F.size(numbers) == 100) & F.exists("wvec", lambda x: x != 0))
    v = v.select("voca_idx", F.col("wvec").cast("array<double>").alias("v"))
    found = similarity.nearest(v.filter("voca_idx % 20 = 0"), v, "voca_idx", "v", 10)
    return found.select(F.col("query").alias("voca_idx"), F.col("id").alias("similar_voca_idx"), F.round("sim", 6).alias("cosine"))


SQL["p1_exact"] = """
WITH v AS (SELECT voca_idx, list_transform(wvec, lambda x: x::DOUBLE) AS v FROM word_vectors WHERE len(wvec) = 100 AND len(list_filter(wvec, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT voca_idx, v, sqrt(list_inner_product(v, v)) AS n FROM v),
w AS (SELECT voca_idx, list_transform(v, lambda x: x / n)::DOUBLE[100] AS v FROM u WHERE n > 0),
p AS (SELECT a.voca_idx, b.voca_idx AS similar_voca_idx, array_inner_product(a.v, b.v) AS c FROM w a JOIN w b ON a.voca_idx <> b.voca_idx WHERE a.voca_idx % 20 = 0)
SELECT voca_idx, similar_voca_idx, round(c, 6) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY voca_idx ORDER BY round(c, 9) DESC, similar_voca_idx) <= 10"""


@query
def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d, **FAR)
    e = neighbours.rows_of_copies(g, g.edges(), 10)
    return e.select(F.col("src").alias("voca_idx"), F.col("dst").alias("similar_voca_idx"), F.round(F.col("sim").cast("double"), 2).alias("cosine"))


@query
def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose voca_idx is divisible by 20 as a query against all rows, by greedy search on the graph."""
    g = _graph(spark, d, **FAR)
    asked = g.nodes.filter(F.col("id") % 20 == 0)
    if g.nodes is not g.packed:  # a representative is asked for all of its copies
        asked = g.nodes.join(g.packed.filter(F.col("id") % 20 == 0).select("copy").distinct(), "copy", "left_semi")
    found = neighbours.greedy_search(g, asked.select(F.col("id").alias("query"), "vec"), k=11).filter(F.col("query") != F.col("id"))
    found = neighbours.rows_of_copies(g, found.select(F.col("query").alias("src"), F.col("id").alias("dst"), "sim"), 10).filter(F.col("src") % 20 == 0)
    return found.select(F.col("src").alias("voca_idx"), F.col("dst").alias("similar_voca_idx"), F.round(F.col("sim").cast("double"), 2).alias("cosine"))
