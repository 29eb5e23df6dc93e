"""Readers: text, dumps, parser output, dictionaries, paragraphs and links, trees.  All give lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as X

PARSED = (
    "struct<query_str:string, sentences:array<struct<index:bigint, tokens:array<struct<index:bigint, word:string, originalText:string, pos:string, "
    "before:string, after:string, characterOffsetBegin:bigint, characterOffsetEnd:bigint>>, basicDependencies:array<struct<dep:string, "
    "dependent:bigint, dependentGloss:string, governor:bigint, governorGloss:string>>>>>"
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): a row per line."""
    return spark.read.text(path)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(value, path): a row per file."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def separated_documents(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(value): documents between separator lines; the splits of a file need no shuffle."""
    return spark.read.option("lineSep", separator).text(path).filter(~X.is_blank(F.col("value")))


def jdbc_column(spark: SparkSession, url: str, table: str, column: str, index: str, **options: str) -> DataFrame:
    """(idx, text) of a database column, without blank values; an equality filter on idx is pushed to the database."""
    query = f"(SELECT {column} AS text, {index} AS idx FROM {table}) AS t"
    return spark.read.format("jdbc").options(url=url, dbtable=query, **options).load().filter(~X.is_blank(F.col("text")))


def long_form(df: DataFrame, key: str, columns: list[str], shortest: int = 5) -> DataFrame:
    """(key, column_name, text): text columns stacked, line breaks to blanks, texts longer than ``shortest``."""
    text = F.regexp_replace("text", "\\r\\n|[\\r\\n]", " ")
    rows = df.select(key, *columns).unpivot(key, columns, "column_name", "text")
    return rows.filter(F.col("text").isNotNull()).withColumn("text", text).filter(F.length("text") > shortest)


def json_list_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """(json): lines of a JSON list that end with a comma, without it."""
    return df.filter(F.col(column).endswith(",")).select(F.expr(f"substring({column}, 1, length({column}) - 1)").alias("json"))


def parsed_documents(df: DataFrame, column: str = "value") -> DataFrame:
    """The given columns and ``doc``; broken documents and those without sentences are skipped."""
    return df.withColumn("doc", F.from_json(F.col(column), PARSED)).filter(F.size("doc.sentences") > 0)


def parsed_tokens(docs: DataFrame, chunk: str) -> DataFrame:
    """Token rows of parsed documents; positions from 0, the head of a root is -1."""
    s = docs.select(F.col(chunk).alias("chunk_idx"), F.posexplode("doc.sentences").alias("sent_idx", "s"))
    deps = F.map_from_entries(F.transform("s.basicDependencies", lambda d: F.struct(d.dependent, d)))
    t = s.select("chunk_idx", "sent_idx", deps.alias("deps"), F.col("s.tokens").alias("ts"), F.posexplode("s.tokens").alias("word_ord", "t"))
    d = F.col("deps")[F.col("t.index")]
    gov = d.governor
    head = F.when(gov > 0, F.get("ts", (gov - 1).cast("int")).word)
    return t.select(
        "chunk_idx",
        "sent_idx",
        (F.col("t.index") - 1).cast("int").alias("pos"),
        F.col("t.word").alias("word"),
        F.col("t.originalText").alias("original"),
        F.col("t.pos").alias("pos_tag"),
        F.coalesce(gov - 1, F.lit(-1)).cast("int").alias("head_pos"),
        head.alias("head_word"),
        d.dep.alias("arc_label"),
        F.col("t.characterOffsetBegin").alias("beg"),
        F.col("t.characterOffsetEnd").alias("end"),
    )


def batch_token(line: Column) -> Column:
    """A token of the batch parser's text: [Text=w CharacterOffsetBegin=b CharacterOffsetEnd=e PartOfSpeech=p]."""
    g = lambda k: F.regexp_extract(line, "^\\[Text=(.*) CharacterOffsetBegin=([0-9]+) CharacterOffsetEnd=([0-9]+) PartOfSpeech=(.*)\\]$", k)
    return F.when(line.startswith("[Text="), F.struct(g(1).alias("word"), g(2).cast("int").alias("beg"), g(3).cast("int").alias("end"), g(4).alias("pos_tag")))


def batch_edge(line: Column) -> Column:
    """An edge of the batch parser's text, rel(a-i, b-j): the words and their positions from 0, -1 for the root."""
    g = lambda k: F.regexp_extract(line, "^([^(\\[]+)\\((.*)-([0-9]+)'*, (.*)-([0-9]+)'*\\)$", k)
    s = F.struct(g(1).alias("rel"), g(2).alias("first"), (g(3).cast("int") - 1).alias("first_pos"), g(4).alias("second"), (g(5).cast("int") - 1).alias("second_pos"))
    return F.when(line.rlike("^[^(\\[]+\\(.*-[0-9]+'*, .*-[0-9]+'*\\)$"), s)


def batch_sentences(df: DataFrame, document: str, order: str, line: str) -> DataFrame:
    """Lines of batch parser text with the number of their sentence in the document."""
    w = Window.partitionBy(document).orderBy(order)
    n = F.sum(F.col(line).rlike("^Sentence #[0-9]+").cast("int")).over(w)
    return df.withColumn("sent_no", n).withColumn("token", batch_token(F.col(line))).withColumn("edge", batch_edge(F.col(line)))


def entity_names(df: DataFrame, column: str = "value") -> DataFrame:
    """(entity, ws) of lines 'id <tab> name'; other numbers of fields are refused by being left out."""
    f = F.split(column, "\t")
    return df.filter(F.size(f) == 2).select(f[0].alias("entity"), X.words(f[1]).alias("ws"))


def properties(df: DataFrame, column: str = "value", name: str = "P31") -> DataFrame:
    """(entity, value) of lines 'entity <tab> P31 v1 v2 ...' of one property."""
    f = F.split(column, "\t")
    vs = X.words(f[1])
    return df.filter(F.element_at(vs, 1) == name).select(f[0].alias("entity"), F.explode(F.slice(vs, 2, F.greatest(F.size(vs) - 1, F.lit(0)))).alias("value"))


def vectors(df: DataFrame, column: str = "value") -> DataFrame:
    """(word, vec) of lines 'word x1 x2 ...'."""
    f = X.words(F.col(column))
    return df.filter(F.size(f) > 1).select(f[0].alias("word"), F.transform(F.slice(f, 2, F.size(f) - 1), lambda x: x.cast("float")).alias("vec"))


def xml_items(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A row per element of a tag, of files of any size."""
    return spark.read.format("xml").option("rowTag", tag).load(path)


def paragraphs(text: Column) -> Column:
    """Contents of <P>...</P>."""
    return F.regexp_extract_all(text, F.lit("(?is)<p>(.*?)</p>"), F.lit(1))


def links(html: Column, containing: str = "") -> Column:
    """Targets of <a href=...> that contain a string."""
    found = F.regexp_extract_all(html, F.lit("(?i)<a[^>]*href=\"([^\"]*)\""), F.lit(1))
    return F.filter(found, lambda x: F.contains(x, F.lit(containing)))


def description_text(xml: Column) -> Column:
    """Text of a description, without its tables, formulas and tags."""
    out = F.regexp_replace(xml, "(?is)<(table|math|maths|chemistry)\\b.*?</\\1>", " ")
    return X.strip(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), "\\s+", " "))


def paraphrase_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(label, sent1, sent2) of a table with header; quality 0 becomes -1."""
    t = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    c = t.columns
    return t.select(F.when(F.col(c[0]) == "0", -1).otherwise(F.col(c[0]).cast("int")).alias("label"), F.col(c[3]).alias("sent1"), F.col(c[4]).alias("sent2"))


def changed_files(df: DataFrame, content: str, digest: str) -> DataFrame:
    """Rows whose content does not have the listed MD5."""
    return df.filter(F.md5(F.col(content).cast("binary")) != F.col(digest))


def parse_remote(df: DataFrame, text: str, parser, limit: int = 99_000) -> DataFrame:
    """Adds ``value``: what a parser callable gives for each text, control characters stripped and cut to its limit.

    The parser is any function from a list of texts to a list of JSON strings; it is called per batch on the executors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(value=parser(list(pdf["clean"])))

    clean = df.withColumn("clean", F.substring(F.regexp_replace(text, "[\\x00-\\x1F]", " "), 1, limit))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema.fields)
    return clean.mapInPandas(run, f"{schema}, value string").drop("clean")


def http_parser(address: str, timeout: float = 60.0) -> Callable[[list[str]], list[str | None]]:
    """A parser for ``parse_remote`` that posts each text to a server and gives the body of its answer, None if it fails."""

    def parse(texts: list[str]) -> list[str | None]:
        from urllib.error import URLError
        from urllib.request import Request, urlopen

        out: list[str | None] = []
        for text in texts:
            try:
                with urlopen(Request(address, (text or "").encode(), {"Content-Type": "text/plain; charset=utf-8"}), timeout=timeout) as answer:
                    out.append(answer.read().decode())
            except (URLError, TimeoutError, UnicodeDecodeError):
                out.append(None)
        return out

    return parse


def latest_version(names: DataFrame, column: str) -> DataFrame:
    """The name of highest (major, minor), compared as numbers, per base name."""
    v = names.withColumn("v", X.version(F.col(column))).filter("v.base <> ''")
    best = v.groupBy("v.base").agg(F.max(F.struct("v.major", "v.minor", F.col(column).alias("name"))).alias("b"))
    return best.select("base", "b.major", "b.minor", "b.name")


def files_named(spark: SparkSession, path: str, table: str, row: int) -> DataFrame:
    """(value, path): lines of the feed files of a table and row, whatever their folder; other files are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", X.feed_path_parts(F.col("path")).alias("p"))
    paths = [r.path for r in files.filter((F.col("p.table_name") == table) & (F.col("p.row_id") == row)).select("path").collect()]  # file names
    empty = spark.createDataFrame([], "value string, path string")
    return spark.read.text(paths).withColumn("path", F.input_file_name()) if paths else empty


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, column_name, data_type) of the session's tables."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def valid_request(request: dict, kind: str = "cells") -> bool:
    """Whether a request has the keys that its kind needs."""
    need = {"sent_uids", "max_clip_len"} | ({"Countries"} if kind == "cells" else set())
    return need <= request.keys()


def confined(df: DataFrame, full_name: str, wanted: list[str]) -> DataFrame:
    """Rows whose column's full name contains one of the wanted strings; all rows if none is given."""
    if not wanted:
        return df
    hit = F.lit(False)
    for w in wanted:
        hit = hit | F.contains(F.col(full_name), F.lit(w))
    return df.filter(hit)
