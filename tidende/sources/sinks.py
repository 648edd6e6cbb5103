"""Writers. Canonical outputs are parquet tables; text renderings are DataFrames of lines that any text sink can write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidende.functions import text


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A dictionary as one parquet table; with the number of its rows and a fingerprint beside it."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """``rows, stamp``: changes when the content does, whatever the order."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("stamp"))


def disambiguation_lines(d: DataFrame) -> DataFrame:
    value = F.when(F.col("entity").isNull(), F.lit("None")).otherwise(F.concat_ws(".", "kb", "entity"))
    return d.select("doc_id", "pos", F.concat(F.col("mention"), F.lit(", [u'"), value, F.lit("']")).alias("line"))


def snap_edges(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, tab separated."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return both.select("src", "dst", F.concat_ws("\t", "src", "dst").alias("line"))


def node_labels(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """``id, label, line`` of the nodes that have an edge; ``terms`` is ``id, label``."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return terms.join(nodes, "id", "left_semi").select("id", "label", F.concat_ws("\t", F.col("id").cast("string"), "label").alias("line"))


def ranked_lines(ranked: DataFrame) -> DataFrame:
    return ranked.select("doc_id", F.concat(F.col("rank"), F.lit("\t["), F.array_join("lemmas", ", "), F.lit("]")).alias("line"))


def top_terms(weights: DataFrame, k: int = 10) -> DataFrame:
    """The strongest terms of each basis vector."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def metro_map_lines(stations: DataFrame) -> DataFrame:
    """``station_date, cluster_id, lines`` of each station: number of lines, id, up to three sentences, date, entities.

    ``stations`` has ``cluster_id, station_date, multi, sentences array<string>, entities array<string>``.
    """
    mark = F.when(F.col("multi"), F.lit("*")).otherwise(F.lit(""))
    numbered = F.transform(F.slice("sentences", 1, 3), lambda s, i: F.concat((i + 1).cast("string"), F.lit(": "), s))
    names = F.transform("entities", lambda e: F.regexp_replace(e, r"^\*[wr]\.?", ""))
    date = F.array(F.date_format("station_date", "yyyy"), F.date_format("station_date", "MM"), F.date_format("station_date", "dd"))
    head = F.array(F.size(numbered).cast("string"), F.concat(F.lit("clusternr: "), F.col("cluster_id").cast("string"), mark))
    return stations.select("station_date", "cluster_id", F.concat(head, numbered, date, F.array(F.size(names).cast("string")), names).alias("lines"))


def metro_map_text(stations: DataFrame) -> DataFrame:
    """``line_no, line``: the whole map as lines, the number of stations first, then the stations by day; a map is a few stations of each day."""
    lines = metro_map_lines(stations).withColumn("k", F.row_number().over(Window.orderBy("station_date", "cluster_id")))
    head = lines.agg(F.count("*").alias("n")).select(F.lit(0).alias("k"), F.lit(0).alias("i"), F.col("n").cast("string").alias("line"))
    rows = head.unionByName(lines.select("k", F.posexplode("lines").alias("i", "line")))
    return rows.select((F.row_number().over(Window.orderBy("k", "i")) - 1).alias("line_no"), "line")


def conll09_lines(tokens: DataFrame) -> DataFrame:
    """Tokens of the older format in the columns of the newer one, blank ones as underscores."""
    feat = F.concat(F.lit("pos="), F.replace("pos", F.lit("="), F.lit("_")))
    blank = F.lit("_")
    columns = ["index", "form", "lemma", "lemma", "cpos", "cpos", feat, feat, "head", "head", "label", "label", blank]
    return tokens.select("sentence_id", "tok", F.concat_ws("\t", *columns).alias("line"))


def tagged_tokens(tokens: DataFrame) -> DataFrame:
    """``form_POS`` of a sentence on one line."""
    parts = F.array_sort(F.collect_list(F.struct("tok", F.concat_ws("_", "form", "pos").alias("t"))))
    return tokens.groupBy("sentence_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("line"))


def parsed_documents(sentences: DataFrame) -> DataFrame:
    """``doc_id, field, parsed``: sentences back by document and field, in order, as JSON."""
    listed = F.array_sort(F.collect_list(F.struct("sent_no", "sentence")))
    return sentences.groupBy("doc_id", "field").agg(F.to_json(F.transform(listed, lambda x: x["sentence"])).alias("parsed"))


def tag_dictionary(lexicon: DataFrame) -> DataFrame:
    """``token, tags, line``: an XML entry for each form with its tags in order."""
    tags = F.array_join(F.array_sort(F.collect_set("tag")), " ")
    grouped = lexicon.groupBy(text.xml_token(F.col("form")).alias("token")).agg(tags.alias("tags"))
    return grouped.withColumn("line", F.format_string('<entry tags="%s"><token>%s</token></entry>', "tags", "token"))
