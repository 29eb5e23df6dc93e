"""Knowledge-base dumps: items, aliases, properties, classes and named-entity flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import entities


def records(lines: DataFrame, key: str = "line_no", line: str = "raw_line") -> DataFrame:
    """(line_no, v): the objects on the lines of a JSON list as variants; broken lines are left out.

    Variants keep fields whose shape differs between records, where a fixed struct would null the whole record.
    """
    text = F.regexp_replace(line, "^[\\s,\\[\\]\\uFEFF]+|[\\s,\\[\\]]+$", "")
    rows = lines.select(key, F.when(text.startswith("{") & text.endswith("}"), F.try_parse_json(text)).alias("v"))
    return rows.filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def text_of(v: str, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def english_label() -> Column:
    """The English label, whether it is an object or a plain string."""
    return F.coalesce(text_of("v", "$.labels.en.value"), F.when(~F.coalesce(text_of("v", "$.labels.en"), F.lit("")).startswith("{"), text_of("v", "$.labels.en")))


def property_values(name: str) -> Column:
    """Item identifiers of the statements of a property, in order; empty if it has none."""
    arr = F.try_variant_get("v", f"$.claims.{name}", "array<variant>")
    ids = F.transform(arr, lambda c: F.try_variant_get(c, "$.mainsnak.datavalue.value.id", "string"))
    return F.coalesce(F.array_compact(ids), F.array().cast("array<string>"))


def items(lines: DataFrame, key: str = "line_no", line: str = "raw_line") -> DataFrame:
    """(line_no, id, type, p31, p279, label): items with an English label; properties as 'P31 Q1 Q2'."""
    r = records(lines, key, line).withColumn("label", english_label()).filter(F.col("label").isNotNull())
    joined = lambda p: F.array_join(F.concat(F.array(F.lit(p)), property_values(p)), " ").alias(p.lower())
    return r.select(key, text_of("v", "$.id").alias("id"), text_of("v", "$.type").alias("type"), joined("P31"), joined("P279"), "label")


def aliases(lines: DataFrame, key: str = "line_no", line: str = "raw_line", language: str = "en") -> DataFrame:
    """(line_no, id, alias): the aliases of items with an English label in a language."""
    r = records(lines, key, line).filter(english_label().isNotNull())
    many = F.try_variant_get("v", f"$.aliases.{language}", "array<variant>")
    one = F.try_variant_get("v", f"$.aliases.{language}.value", "string")
    values = F.coalesce(F.transform(many, lambda a: F.try_variant_get(a, "$.value", "string")), F.array_compact(F.array(one)))
    return r.select(key, text_of("v", "$.id").alias("id"), F.explode(F.array_compact(values)).alias("alias"))


def first_claims(lines: DataFrame, key: str = "line_no", line: str = "raw_line") -> DataFrame:
    """(line_no, id, property, value): the first statement of every property."""
    r = records(lines, key, line)
    claims = F.try_variant_get("v", "$.claims", "map<string,variant>")
    each = r.select(key, text_of("v", "$.id").alias("id"), F.explode(claims).alias("property", "cs"))
    return each.select(key, "id", "property", F.try_variant_get("cs", "$[0].mainsnak.datavalue.value.id", "string").alias("value")).filter("value IS NOT NULL")


def tagged_names(lines: Column, mark: str = "WORDMARK") -> Column:
    """Tagger output 'word/TAG word/TAG' of one item: (name, tags) with words joined by blanks, tags by underscores."""
    pairs = F.filter(F.split(F.regexp_replace(lines, mark, " "), "\\s+"), lambda w: w.contains("/"))
    word = F.array_join(F.transform(pairs, lambda p: F.regexp_extract(p, "^(.*)/[^/]*$", 1)), " ")
    return F.struct(word.alias("name"), F.array_join(F.transform(pairs, lambda p: F.regexp_extract(p, "/([^/]*)$", 1)), "_").alias("tags"))


def entity_flags(instances: DataFrame, named: str, weight: int = 5) -> DataFrame:
    """(entity, flag): the vote of its class, or Unknown for entities whose classes have no vote; any named class is enough.

    instances: entity, class_id (null for none), and the flag of the entity itself.
    """
    votes = entities.class_vote(instances.filter(F.col("class_id").isNotNull()), "class_id", named, weight).select("class_id", "vote")
    joined = instances.select("entity", "class_id").join(votes, "class_id", "left")
    flag = F.when(F.bool_or("vote"), "True").when(F.bool_or(~F.col("vote")), "False").otherwise("Unknown")
    return joined.groupBy("entity").agg(flag.alias("flag"))
