"""Dictionary entities: annotation, ambiguity, acronyms, instance-of expansion, named-entity votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import workspace
from textloom.functions import text as T

_LEAF = 0  # key of a trie node under which the identifiers of names that end there are kept


def build_trie(names: list[tuple[object, list[object]]]) -> dict:
    """Trie over word lists; every identifier of a name is kept at its end."""
    root: dict = {}
    for uid, ws in names:
        node = root
        for w in ws:
            node = node.setdefault((1, w), {})
        node.setdefault(_LEAF, []).append(uid)
    return root


def annotate_words(ws: list[object], trie: dict) -> list[tuple[int, int, list[object]]]:
    """(begin, length, candidates) of the names in a sentence, left to right.

    A prefix is extended while some name has it.  When the next word fits none, names of exactly that length are given;
    if there are none, the scan goes on one word later.  It never falls back to a shorter name, and never reads beyond
    the sentence.
    """
    out, at, n = [], 0, len(ws)
    while at < n:
        node, k = trie, at
        while k < n and (1, ws[k]) in node:
            node = node[(1, ws[k])]
            k += 1
        uids = node.get(_LEAF) if k > at else None
        if uids:
            out.append((at, k - at, sorted(set(uids))))
            at = k
        else:
            at += 1
    return out


class Words:
    """The words of a batch of sentences (a list array) one after the other: sentence and end of sentence of each."""

    def __init__(self, ws: pa.ListArray) -> None:
        size = ws.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        self.n = len(ws)
        self.begin = ends - size
        self.sentence = np.repeat(np.arange(len(ws)), size)
        self.end = ends[self.sentence]
        encoded = ws.flatten().dictionary_encode()
        self._index = encoded.indices.fill_null(len(encoded.dictionary)).to_numpy(zero_copy_only=False)
        self._distinct = encoded.dictionary.to_pylist()

    def codes(self, code: dict[str, int]) -> np.ndarray:
        """The code of every word, -1 for one that has none."""
        index, own = self.terms(code)
        return own[index]


    def terms(self, code: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every word among the batch's distinct words, and the codes of those, -1 for one that has none."""
        return self._index, np.array([*(code.get(w, -1) for w in self._distinct), -1], np.int64)


class FlatTrie:
    """The trie of a table of distinct names (name_id, ws) in sorted arrays: some ten bytes a node, so that a dictionary of a
    million names fits into every task.

    The node after the i-th key is i + 1; a key is a node and the code of the next word.
    """

    def __init__(self, names: pa.Table) -> None:
        ws = names["ws"].combine_chunks()
        ws = pa.concat_arrays(ws.chunks) if isinstance(ws, pa.ChunkedArray) else ws
        size = ws.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        words = ws.flatten().dictionary_encode()
        self.code = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        node, keys, n, depth = np.zeros(len(size), np.int64), [], 0, 0
        while len(on := np.flatnonzero(size > depth)):
            key, inverse = np.unique(node[on] << 32 | code[first[on] + depth], return_inverse=True)
            node[on] = n + 1 + inverse
            keys.append(key)
            n, depth = n + len(key), depth + 1
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.name = np.full(n + 1, -1, np.int64)
        self.name[node] = names["name_id"].to_numpy()
        self.name[0] = -1
        self.root = np.zeros(len(self.code) + 1, np.int64)  # the last place is that of unknown words
        if keys:
            self.root[keys[0]] = np.arange(len(keys[0])) + 1

    def reach(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, name) for each word at which the longest prefix of names is a name; begin counts the batch's words."""
        code = words.codes(self.code)
        node = self.root[code]
        begin = np.flatnonzero(node)
        node, length = node[begin], np.ones(len(begin), np.int64)
        on = np.arange(len(begin))
        while len(on):
            at = begin[on] + length[on]
            inside = at < words.end[begin[on]]
            on, at = on[inside], at[inside]
            known = code[at] >= 0
            on, at = on[known], at[known]
            key = node[on] << 32 | code[at]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            on = on[hit]
            node[on] = i[hit] + 1
            length[on] += 1
        name = self.name[node]
        return begin[name >= 0], length[name >= 0], name[name >= 0]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, name) by the rule of ``annotate_words``."""
        begin, length, name = self.reach(words)
        keep, at = np.zeros(len(begin), bool), 0
        for i, (b, n) in enumerate(zip(begin.tolist(), length.tolist(), strict=True)):
            if b >= at:
                keep[i], at = True, b + n
        return begin[keep], length[keep], name[keep]


def distinct_names(names: DataFrame) -> DataFrame:
    """(name_id, ws, candidates): each name once, with all its entities; written, as a number holds for one run alone."""
    per = names.filter(F.size("ws") > 0).groupBy("ws").agg(F.array_sort(F.collect_set("entity_uid")).alias("candidates"))
    return workspace.materialise(per.select(F.monotonically_increasing_id().alias("name_id"), "ws", "candidates"), "names")


def name_marks(sentences: DataFrame, distinct: DataFrame, part_names: int = 1_000_000) -> DataFrame:
    """(sent_uid, token_pos, token_len, name_id) of ``distinct_names`` in sentences (sent_uid, ws).

    A dictionary of at most ``part_names`` names goes to the tasks whole.  Of a larger one each part, by a hash of the first
    word, is sent in turn and reads the sentences once; then the left-to-right rule is applied to the marks of a sentence.
    """
    parts = max(1, -(-distinct.count() // part_names))

    def scan(part: int) -> DataFrame:
        own = distinct if parts == 1 else distinct.filter(F.pmod(F.xxhash64(F.col("ws")[0]), F.lit(parts)) == part)
        trie = FlatTrie(own.select("name_id", "ws").toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = Words(batch.column("ws"))
                begin, length, name = trie.find(words) if parts == 1 else trie.reach(words)
                sent = words.sentence[begin]
                columns = [batch.column("row").take(pa.array(sent)), batch.column("sent_uid").take(pa.array(sent))]
                columns += [pa.array((begin - words.begin[sent]).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(name)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "sent_uid", "token_pos", "token_len", "name_id"])

        return rows.mapInArrow(run, "row long, sent_uid long, token_pos int, token_len int, name_id long")

    if parts == 1:
        rows = sentences.select(F.lit(0).cast("long").alias("row"), F.col("sent_uid").cast("long").alias("sent_uid"), "ws")
        return scan(0).drop("row")
    # the rule holds within a row: numbers of sentences need not be distinct
    rows = sentences.select(F.xxhash64("sent_uid", "ws").alias("row"), F.col("sent_uid").cast("long").alias("sent_uid"), "ws")
    marks = scan(0)
    for i in range(1, parts):
        marks = marks.unionByName(scan(i))
    per = marks.groupBy("row", "sent_uid").agg(F.array_sort(F.collect_list(F.struct("token_pos", "token_len", "name_id"))).alias("ms"))
    empty = F.array().cast("array<struct<token_pos:int,token_len:int,name_id:bigint>>")
    kept = F.aggregate(
        "ms",
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda s, m: F.when(m.token_pos >= s["at"], F.struct((m.token_pos + m.token_len).alias("at"), F.concat(s["out"], F.array(m)).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    return per.select("sent_uid", F.explode(kept).alias("m")).select("sent_uid", "m.token_pos", "m.token_len", "m.name_id")


def annotate(sentences: DataFrame, names: DataFrame, part_names: int = 1_000_000) -> DataFrame:
    """(sent_uid, token_pos, token_len, candidates) of dictionary names in sentences (sent_uid, ws).

    names: entity_uid long, ws array<string>.  Marks and names meet at the end, so that the many candidates of a name are
    not handed about with its marks.
    """
    distinct = distinct_names(names)
    marks = name_marks(sentences, distinct, part_names)
    return marks.join(distinct.select("name_id", "candidates"), "name_id").select("sent_uid", "token_pos", "token_len", "candidates")


def annotate_by_join(sentences: DataFrame, names: DataFrame) -> DataFrame:
    """The same annotation by joins with all prefixes of names, for dictionaries of any size.

    A sentence's words meet the prefixes by equi-joins; the longest run of prefixes at each start decides, and a fold over
    the starts of one sentence applies the left-to-right rule.
    """
    longest = names.agg(F.max(F.size("ws"))).first()[0] or 0
    if longest == 0:
        return sentences.sparkSession.createDataFrame([], "sent_uid long, token_pos int, token_len int, candidates array<long>")
    named = names.filter(F.size("ws") > 0).select("entity_uid", "ws")
    sizes = F.sequence(F.lit(1), F.size("ws"))
    prefixes = named.select(F.explode(F.transform(sizes, lambda n: T.pack_words(F.slice("ws", 1, n)))).alias("p")).distinct()
    ends = named.select(T.pack_words(F.col("ws")).alias("p"), "entity_uid").groupBy("p").agg(F.array_sort(F.collect_set("entity_uid")).alias("candidates"))
    starts = sentences.select("sent_uid", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - 1)).alias("pos")).filter(F.size("ws") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("ws") - F.col("pos"))), lambda n: F.struct(n.alias("n"), T.pack_words(F.slice("ws", F.col("pos") + 1, n)).alias("p")))
    tried = starts.select("sent_uid", "pos", F.explode(runs).alias("r")).select("sent_uid", "pos", "r.n", "r.p")
    reach = tried.join(prefixes, "p").groupBy("sent_uid", "pos").agg(F.max(F.struct("n", "p")).alias("m"))
    marks = reach.select("sent_uid", "pos", "m.n", "m.p").join(ends, "p").select("sent_uid", "pos", "n", "candidates")
    per = marks.groupBy("sent_uid").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "candidates"))).alias("ms"))
    empty = F.array().cast("array<struct<pos:int,n:int,candidates:array<bigint>>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    fold = F.aggregate(
        F.transform("ms", lambda m: F.struct(m.pos.cast("int").alias("pos"), m.n.cast("int").alias("n"), m.candidates.alias("candidates"))),
        start,
        lambda s, m: F.when(m.pos >= s["at"], F.struct((m.pos + m.n).alias("at"), F.concat(s["out"], F.array(m)).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    found = per.select("sent_uid", F.explode(fold).alias("m"))
    return found.select("sent_uid", F.col("m.pos").alias("token_pos"), F.col("m.n").alias("token_len"), "m.candidates")


def same_entity(a: Column, b: Column) -> Column:
    """Ambiguous entities are equal if they share a candidate; not transitive, so never a key."""
    return F.arrays_overlap(a, b)


def contains_all(entities: Column, tags: Column) -> Column:
    """Whether every wanted entity (array of candidate arrays) overlaps some tag of the sentence."""
    return F.forall(entities, lambda e: F.exists(tags, lambda t: F.arrays_overlap(e, t)))


def candidate_postings(annotated: DataFrame, scores: DataFrame) -> DataFrame:
    """(entity_uid, sent_uid, token_pos, score): candidates with the score of their best name (entity_uid, score)."""
    each = annotated.select("sent_uid", "token_pos", F.explode("candidates").alias("entity_uid"))
    return each.join(scores, "entity_uid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def best_name_score(names: DataFrame, importance: DataFrame) -> DataFrame:
    """(entity_uid, score): per entity the largest sum of word importances of a name."""
    each = names.select("entity_uid", T.pack_words(F.col("ws")).alias("name"), F.explode("ws").alias("word"))
    per = each.join(importance.select("word", "score"), "word", "left").groupBy("entity_uid", "name").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("s"))
    return per.groupBy("entity_uid").agg(F.max("s").alias("score"))


def name_pairs(wanted: DataFrame, distinct: DataFrame, importance: DataFrame) -> DataFrame:
    """(name_id, other, score): for each wanted name all names that share an entity with it, with 1 and the best name score of
    the best entity shared.  distinct: name_id, ws, candidates."""
    each = distinct.select("name_id", F.explode("ws").alias("word")).join(importance.select("word", "score"), "word", "left")
    sums = each.groupBy("name_id").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("s"))
    of = distinct.select("name_id", F.explode("candidates").alias("entity_uid"))
    scored = of.join(sums, "name_id").groupBy("entity_uid").agg((F.max("s") + 1).alias("score"))
    own = of.join(F.broadcast(wanted.select("name_id").distinct()), "name_id", "left_semi")
    meets = own.join(scored, "entity_uid").join(of.select("entity_uid", F.col("name_id").alias("other")), "entity_uid")
    return meets.groupBy("name_id", "other").agg(F.max("score").alias("score"))


def with_instances(postings: DataFrame, instance_of: DataFrame, names: DataFrame) -> DataFrame:
    """Postings and those of the classes of their entities, as far as the class has a name."""
    named = names.select("entity_uid").distinct()
    classes = postings.join(instance_of.select("entity_uid", "class_uid"), "entity_uid").drop("entity_uid").withColumnRenamed("class_uid", "entity_uid")
    return postings.unionByName(classes.join(named, "entity_uid", "left_semi").select(postings.columns)).distinct()


def keep_true_entities(annotated: DataFrame, named: DataFrame, nouns: DataFrame) -> DataFrame:
    """Spans that stay entities: of several words those candidates that are named entities; one word if it is a noun.

    named: entity_uid.  nouns: sent_uid, token_pos of noun tokens.
    """
    several = annotated.filter("token_len > 1").select("sent_uid", "token_pos", "token_len", F.explode("candidates").alias("entity_uid"))
    several = several.join(named.select("entity_uid").distinct(), "entity_uid", "left_semi")
    several = several.groupBy("sent_uid", "token_pos", "token_len").agg(F.array_sort(F.collect_set("entity_uid")).alias("candidates"))
    single = annotated.filter("token_len = 1").join(nouns.select("sent_uid", "token_pos"), ["sent_uid", "token_pos"], "left_semi")
    return several.unionByName(single.select(several.columns))


def is_acronym(names: Column) -> Column:
    """Whether a one-word name is the acronym of a name of the same entity (array of word arrays)."""
    return F.exists(names, lambda a: (F.size(a) == 1) & F.exists(names, lambda b: (F.size(b) > 1) & (T.acronym(b) == F.element_at(a, 1))))


def named_entities(names: DataFrame, listed: DataFrame) -> DataFrame:
    """(entity_uid, named): in the list, or called by an acronym."""
    per = names.groupBy("entity_uid").agg(F.collect_set("ws").alias("names"))
    known = listed.select("entity_uid", F.lit(True).alias("is_listed")).distinct()
    return per.join(known, "entity_uid", "left").select("entity_uid", (F.coalesce("is_listed", F.lit(False)) | is_acronym(F.col("names"))).alias("named"))


def class_vote(df: DataFrame, key: str, flag: str, weight: int = 5) -> DataFrame:
    """(key, yes, no, vote): a class counts as named if its yes votes, times the weight, exceed its no votes."""
    yes = F.sum(F.when(F.col(flag), 1).otherwise(0))
    n = F.count("*")
    return df.groupBy(key).agg(yes.alias("yes"), (n - yes).alias("no"), (yes * weight > n - yes).alias("vote"))


def all_tagged(df: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, named): no token of the entity has the empty tag O."""
    return df.groupBy(key).agg(F.every(F.col(tag) != "O").alias("named"))


def span_heads(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per span (sent_uid, token_pos, token_len) the first token whose head lies outside of it, else its first token."""
    t = tokens.select("sent_uid", F.col("pos").alias("p"), "head_pos")
    inside = (F.col("p") >= F.col("token_pos")) & (F.col("p") < F.col("token_pos") + F.col("token_len"))
    out = (F.col("head_pos") < F.col("token_pos")) | (F.col("head_pos") >= F.col("token_pos") + F.col("token_len"))
    rows = spans.join(t, "sent_uid").filter(inside)
    return rows.groupBy("sent_uid", "token_pos", "token_len").agg(F.coalesce(F.min(F.when(out, F.col("p"))), F.first("token_pos")).alias("head_token"), F.array_sort(F.collect_set(F.when(out, F.col("head_pos")))).alias("outside_heads"))


def country_tags(df: DataFrame, text: str, names: list[str], also: dict[str, str] | None = None) -> DataFrame:
    """tags: names found as case-sensitive substrings, in order of names, with the further names that some imply.

    The list of names is a fixed small one and becomes part of the expression.
    """
    hits = [F.when(F.contains(F.col(text), F.lit(n)), F.lit(n)) for n in sorted(names)]
    more = [F.when(F.contains(F.col(text), F.lit(a)), F.lit(b)) for a, b in sorted((also or {}).items())]
    return df.withColumn("tags", F.array_distinct(F.array_compact(F.array(*hits, *more))))
