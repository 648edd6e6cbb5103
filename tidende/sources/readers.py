"""Readers. Each gives a DataFrame with an explicit schema; file names come from the engine's own metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidende import schemas
from tidende.functions import dates, text


@dataclass(frozen=True)
class Paths:
    """Where the corpora are; given by the caller, or one a line in this order, as ``read_paths`` takes them."""

    root: str = ""
    news: str = ""
    entities: str = ""
    external: str = ""
    wikipedia: str = ""
    annotated: str = ""
    processed_news: str = ""
    disambiguated: str = ""


def read_paths(lines: list[str]) -> Paths:
    """The eight folders of a configuration's lines, blanks off; missing ones are empty."""
    return Paths(*[x.strip() for x in lines[:8]])


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """``abbr``: one a line, blanks off, repeats and empty lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("abbr")).where(F.col("abbr") != "").distinct()


def _file_name():
    return F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """One article a text file; day and id from its name."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    named = raw.select(_file_name().alias("doc_id"), F.col("value").alias("text"))
    return named.select("doc_id", "text", dates.date_of_name(F.col("doc_id")).alias("pub_date"), dates.ext_id_of_name(F.col("doc_id")).alias("ext_id"))


def read_news_xml(spark: SparkSession, path: str, row_tag: str = "article", done: DataFrame | None = None) -> DataFrame:
    """Articles of XML files: headline and paragraphs, each closed by a dot; those without a body, or done before, are left out."""
    schema = "hl1 string, p array<string>"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).select(F.regexp_replace(_file_name(), r"\.xml$", ".txt").alias("doc_id"), "hl1", "p")
    if done is not None:
        rows = rows.join(done.select("doc_id").distinct(), "doc_id", "left_anti")
    return news_text(rows)


def news_text(rows: DataFrame) -> DataFrame:
    """``doc_id, title, text`` from headline ``hl1`` and paragraphs ``p``."""
    kept = F.filter("p", lambda x: F.length(x) > 1)
    body = F.array_join(F.transform(kept, text.format_paragraph), " ")
    return rows.withColumn("body", body).where(F.coalesce(F.col("body"), F.lit("")) != "").select("doc_id", F.col("hl1").alias("title"), F.concat_ws(" ", "hl1", "body").alias("text"))


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """``title, text`` of each page of a dump."""
    schema = "title string, revision struct<text:string>"
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).select("title", F.col("revision.text").alias("text"))


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, pos, mention`` of recogniser files, one mention a line, in the order of the file."""
    raw = spark.read.text(path, wholetext=True).select(_file_name().alias("doc_id"), "value")
    return parse_mentions(raw)


def parse_mentions(raw: DataFrame) -> DataFrame:
    lines = raw.select("doc_id", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    return lines.select("doc_id", "pos", text.unescape_danish(text.mention_of_line(F.col("line"))).alias("mention"))


def mention_set(mentions: DataFrame) -> DataFrame:
    return mentions.select("mention").where(F.col("mention") != "").distinct()


def parse_disambiguations(lines: DataFrame) -> DataFrame:
    """``doc_id, pos, mention, kb, entity`` of lines ``mention, [u'kb.entity']``; ``None`` becomes null, a corrupt line gives no row."""
    value = text.mention_of_line(F.regexp_extract("line", r", (\[.*)$", 1))
    parsed = lines.select("doc_id", "pos", F.regexp_extract("line", r"^(.*?), \[", 1).alias("mention"), value.alias("v")).where((F.col("mention") != "") & (F.col("v") != ""))
    kb = F.when(F.col("v").rlike(r"^[wl]\."), F.substring("v", 1, 1))
    return parsed.select("doc_id", "pos", "mention", kb.alias("kb"), F.when(kb.isNotNull(), F.expr("substring(v, 3)")).alias("entity"))


def wiki_or_undecided(disambiguations: DataFrame) -> DataFrame:
    """Without those of other knowledge bases."""
    return disambiguations.where((F.col("kb") == "w") | F.col("entity").isNull())


def undecided(disambiguations: DataFrame) -> DataFrame:
    return disambiguations.where(F.col("entity").isNull())


def parse_gold(lines: DataFrame) -> DataFrame:
    """``doc_id, line_no, pos, mention, entity`` of inline marks ``[*[mention|entity]*]``."""
    marks = F.regexp_extract_all("line", F.lit(r"\[\*\[(.*?)\]\*\]"), 1)
    found = lines.select("doc_id", "line_no", F.posexplode(marks).alias("pos", "m"))
    entity = F.regexp_replace(F.element_at(F.split("m", r"\|"), -1), r"(/da|/)$", "")
    return found.select("doc_id", "line_no", "pos", F.get(F.split("m", r"\|"), F.lit(0)).alias("mention"), F.when(entity != "None", entity).alias("entity"))


def read_categories(spark: SparkSession, url: str | None = None, table: str = "categorylinks", path: str | None = None, **options: str) -> DataFrame:
    """``cl_to, cl_sortkey``, by JDBC with the caller's options or from parquet."""
    if path:
        return spark.read.schema(schemas.CATEGORY_LINK).parquet(path)
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(F.decode(F.col("cl_to"), "utf-8").alias("cl_to"), F.decode(F.col("cl_sortkey"), "utf-8").alias("cl_sortkey"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """``term, freq`` of a word list: the first token of each line, and its number where there is one."""
    raw = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.get("t", F.lit(0)) != "")
    return raw.select(F.get("t", F.lit(0)).alias("term"), F.get("t", F.lit(1)).try_cast("bigint").alias("freq"))


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(text.format_chars_off(F.col("value")).alias("name")).where(F.col("name") != "").distinct()


def parse_communities(lines: DataFrame, floor: float = 0.001) -> DataFrame:
    """``cluster_id, term, weight`` of lines of tab-separated ``term,weight``; no weight is twice the floor, none is below it."""
    parts = lines.select("cluster_id", F.explode(F.split("line", "\t")).alias("x")).where(F.col("x").contains(","))
    weight = F.regexp_extract("x", r",([^,]*)$", 1).cast("double")
    return parts.select("cluster_id", F.regexp_extract("x", r"^(.*),", 1).alias("term"), F.greatest(F.when(weight == 0, 2 * floor).otherwise(weight), F.lit(floor)).alias("weight"))


def parse_conll(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """``sentence_id, tok`` and the columns of each token, of blank-line separated blocks ``sentence_id, block``."""
    rows = blocks.select("sentence_id", F.posexplode(F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")).alias("tok", "line"))
    parts = F.split("line", "\t")
    return rows.select("sentence_id", "tok", *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_conll(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    raw = spark.read.option("lineSep", "\n\n").text(path)
    return parse_conll(raw.select(F.xxhash64(_file_name(), "value").alias("sentence_id"), F.col("value").alias("block")), columns)


def feature_map(feats):
    """``attr=value|…`` as a map."""
    return F.str_to_map(feats, F.lit(r"\|"), F.lit("="))


def read_json_documents(spark: SparkSession, path: str, id_field: str, fields: list[str]) -> DataFrame:
    """``doc_id, field, text`` of JSON lines; a list of texts is joined by line breaks."""
    raw = spark.read.text(path).select(F.col("value").alias("v"))
    keys = F.array(*[F.struct(F.lit(f).alias("field"), F.get_json_object("v", f"$.{f}").alias("j")) for f in fields])
    rows = raw.select(F.get_json_object("v", f"$.{id_field}").alias("doc_id"), F.explode(keys).alias("x")).select("doc_id", "x.field", "x.j")
    listed = F.from_json("j", "array<string>")
    return rows.where(F.col("j").isNotNull()).select("doc_id", "field", F.when(F.col("j").startswith("["), F.array_join(listed, "\n")).otherwise(F.col("j")).alias("text"))


def metro_cluster_ids(lines: DataFrame) -> DataFrame:
    """``cluster_id`` of the station lines of a map."""
    return lines.where(F.col("line").startswith("clusternr:")).select(F.replace(F.trim(F.regexp_extract("line", r"^clusternr:(.*)$", 1)), F.lit("*"), F.lit("")).alias("cluster_id"))


def read_line_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``tokens`` of each line of each file, split at white space."""
    return spark.read.text(path).select(_file_name().alias("file"), F.filter(F.split(F.lower("value"), r"\s+"), lambda x: x != "").alias("tokens"))


def not_done(inputs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only inputs without an output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")
