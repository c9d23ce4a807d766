"""Readers of documents and ontologies in files, and writers of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A document for each file: doc_id (its path), text, filename, file_size. Compressed files are opened by their ending."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"), F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("file_size"))


def json_documents(spark: SparkSession, path: str, many: bool = False, broken: str = "fail") -> DataFrame:
    """Documents of JSON lines (or, with many, files with an array `documents`): doc_id, title, text, metadata (JSON). Broken lines raise when they are read, or, with broken="drop", are left out."""
    body = "doc_id: string, title: string, content: string, metadata: struct<source: string, category: string, year: int>"
    reader = spark.read.option("mode", {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[broken])
    if many:
        rows = reader.option("multiLine", True).schema(f"documents array<struct<{body}>>").json(path).select(F.explode("documents").alias("d")).select("d.*")
    else:
        rows = reader.schema(T.StructType.fromDDL(body)).json(path)
    return rows.select("doc_id", "title", F.col("content").alias("text"), F.to_json("metadata").alias("metadata"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Article XML, one in each file: title, abstract, authors, keywords, text (paragraphs of the body, joined by lines)."""
    name = "struct<surname: string, `given-names`: string>"
    meta = (
        "`title-group`: struct<`article-title`: string>, abstract: struct<p: array<string>>, "
        f"`contrib-group`: struct<contrib: array<struct<name: {name}>>>, `kwd-group`: struct<kwd: array<string>>"
    )
    schema = f"front struct<`article-meta`: struct<{meta}>>, body struct<p: array<string>, sec: array<struct<p: array<string>>>>"
    rows = spark.read.format("xml").option("rowTag", "article").schema(schema).load(path)
    m = F.col("front")["article-meta"]
    lines = lambda x: F.array_join(x, "\n")
    none = F.array().cast("array<string>")
    authors = F.transform(m["contrib-group"]["contrib"], lambda c: F.concat_ws(" ", c["name"]["given-names"], c["name"]["surname"]))
    body = F.concat(F.coalesce(F.col("body.p"), none), F.coalesce(F.flatten(F.transform(F.col("body.sec"), lambda s: F.coalesce(s["p"], none))), none))
    return rows.select(
        F.col("_metadata.file_path").alias("doc_id"), m["title-group"]["article-title"].alias("title"), lines(F.coalesce(m["abstract"]["p"], none)).alias("abstract"), F.coalesce(authors, none).alias("authors"),
        F.coalesce(m["kwd-group"]["kwd"], none).alias("keywords"), lines(body).alias("text"),
    )


_REF = "struct<`_rdf:resource`: string>"
_TEXT = "array<struct<_VALUE: string, `_xml:lang`: string>>"


def _ontology(spark: SparkSession, path: str, tag: str, fields: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(f"`_rdf:about` string, {fields}").load(path)


def owl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(concepts, relations) of the classes in an OWL file in RDF/XML: id, label, synonyms; src, type (is_a), dst."""
    rows = _ontology(spark, path, "owl:Class", f"`rdfs:label` array<string>, `rdfs:subClassOf` array<{_REF}>").where(F.col("`_rdf:about`").isNotNull())
    labels = F.col("`rdfs:label`")
    concepts = rows.select(F.col("`_rdf:about`").alias("id"), F.coalesce(F.get(labels, F.lit(0)), F.regexp_extract("`_rdf:about`", r"[^/#]+$", 0)).alias("label"), F.coalesce(F.slice(labels, F.lit(2), F.greatest(F.size(labels), F.lit(1))), F.array().cast("array<string>")).alias("synonyms"))
    up = rows.select(F.col("`_rdf:about`").alias("src"), F.lit("is_a").alias("type"), F.explode(F.transform("`rdfs:subClassOf`", lambda r: r["_rdf:resource"])).alias("dst")).where("dst is not null")
    return concepts, up


def skos(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(concepts, relations) of a SKOS file in RDF/XML: preferred and other labels; broader as is_a, narrower as its inverse, related as related_to."""
    rows = _ontology(spark, path, "skos:Concept", f"`skos:prefLabel` array<string>, `skos:altLabel` array<string>, `skos:broader` array<{_REF}>, `skos:narrower` array<{_REF}>, `skos:related` array<{_REF}>")
    about = F.col("`_rdf:about`")
    concepts = rows.select(about.alias("id"), F.get("`skos:prefLabel`", F.lit(0)).alias("label"), F.coalesce("`skos:altLabel`", F.array().cast("array<string>")).alias("synonyms"))
    to = lambda c, kind: rows.select(about.alias("src"), F.lit(kind).alias("type"), F.explode(F.transform(F.col(f"`skos:{c}`"), lambda r: r["_rdf:resource"])).alias("dst"))
    narrower = to("narrower", "is_a").select(F.col("dst").alias("src"), "type", F.col("src").alias("dst"))
    return concepts, to("broader", "is_a").union(narrower).union(to("related", "related_to")).distinct()


def snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes a table as Parquet to a new place and reads it back."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, title, text of raw pages: scripts, styles and comments go, tags become spaces. HTML isn't well-formed XML, hence patterns."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    unescaped = bare
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        unescaped = F.replace(unescaped, F.lit(name), F.lit(char))
    return pages.select("page_id", F.trim(F.regexp_replace(title, r"\s+", " ")).alias("title"), F.trim(F.regexp_replace(unescaped, r"\s+", " ")).alias("text"))
