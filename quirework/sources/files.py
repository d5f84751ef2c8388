"""Readers and writers of the document and log formats."""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quirework.functions.text import page_id_from_path

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "height")])
ISSUE = T.StructType([T.StructField("code", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("message", T.StringType())])
NODE = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("bbox", BOX),
    T.StructField("reading_order_index", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("normalized_text", T.StringType()),
    T.StructField("issues", T.ArrayType(ISSUE)),
])
PAGE = T.StructType([
    T.StructField("page_id", T.StringType()),
    T.StructField("page_geometry", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])),
    T.StructField("nodes", T.ArrayType(NODE)),
    T.StructField("reading_order", T.ArrayType(T.StringType())),
    T.StructField("parse_issues", T.ArrayType(ISSUE)),
])
DOCUMENT = T.StructType([T.StructField("document_manifest", T.StructType([T.StructField("book_id", T.StringType()), T.StructField("page_count", T.IntegerType())])), T.StructField("pages", T.ArrayType(PAGE))])
EVENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("code", T.StringType()), T.StructField("at_monotonic", T.DoubleType()), T.StructField("details", T.MapType(T.StringType(), T.StringType()))])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a document file, with its path."""
    return spark.read.option("multiLine", True).schema(DOCUMENT).json(path).withColumn("path", F.col("_metadata.file_path"))


def document_nodes(documents: DataFrame) -> DataFrame:
    """The node table of documents: doc, page_id, page_w, page_h, node_id, ord, content_type, confidence, text, x, y, w, h."""
    pages = documents.select(F.col("document_manifest.book_id").alias("doc"), F.explode("pages").alias("p"))
    return pages.select("doc", "p.page_id", F.col("p.page_geometry.width").cast("double").alias("page_w"), F.col("p.page_geometry.height").cast("double").alias("page_h"), F.explode("p.nodes").alias("n")).select(
        "doc", "page_id", F.when(F.col("page_w") > 0, F.col("page_w")).otherwise(1.0).alias("page_w"), F.when(F.col("page_h") > 0, F.col("page_h")).otherwise(1.0).alias("page_h"), "n.node_id", F.col("n.reading_order_index").alias("ord"),
        "n.content_type", "n.confidence", F.col("n.normalized_text").alias("text"), F.col("n.bbox.x").alias("x"), F.col("n.bbox.y").alias("y"), F.col("n.bbox.width").alias("w"), F.col("n.bbox.height").alias("h"),
    )


def reading_order(documents: DataFrame) -> DataFrame:
    """(doc, page_id, position, node_id) as the pages list it."""
    pages = documents.select(F.col("document_manifest.book_id").alias("doc"), F.explode("pages").alias("p"))
    return pages.select("doc", "p.page_id", F.posexplode("p.reading_order").alias("position", "node_id"))


def event_lines(rows: DataFrame, line: str, schema: T.StructType | str = EVENT) -> DataFrame:
    """Rows with the fields of the JSON object in their line; malformed lines and values that are no object are left out, objects that lack fields are kept."""
    bad = "__malformed"
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    read = F.from_json(line, T.StructType([*wanted.fields, T.StructField(bad, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    found = rows.where(F.col(line).rlike(r"^\s*\{")).withColumn("__e", read).where(f"__e is not null and __e.{bad} is null")
    return found.select(*[c for c in rows.columns if c not in wanted.fieldNames()], *[f"__e.{n}" for n in wanted.fieldNames()])


def read_event_log(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """Rows of a JSON-lines log; lines that are no object are left out."""
    return event_lines(spark.read.text(path), "value", schema).drop("value")


def list_pages(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, page_id, bytes, modified) of files whose names hold a page number, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    return files.select("path", page_id_from_path("path").alias("page_id"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).where("page_id is not null")


def audit_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def framed_lines(chunks: DataFrame, keys: list[str], order: str, data: str, longest: int = 512) -> DataFrame:
    """(keys, line_no, line) of records cut at line ends from text that arrived in pieces; longer records are left out whole.

    Pieces of a key are joined in order; an unfinished tail is no record.
    """
    whole = chunks.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, data))), lambda c: c[data]), "").alias("__t"))
    cut = whole.select(*keys, F.posexplode(F.split("__t", "\n")).alias("line_no", "line"), F.size(F.split("__t", "\n")).alias("__n"))
    return cut.where("line_no < __n - 1").select(*keys, "line_no", F.regexp_replace("line", "\r$", "").alias("line")).where((F.char_length("line") <= longest) & (F.col("line") != ""))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, shape_no, points, valid): polygons of annotation files; valid polygons have three points and do not cross themselves."""
    from quirework.operators.polygons import simple_polygon

    point = T.ArrayType(T.ArrayType(T.DoubleType()))
    schema = T.StructType([T.StructField("shapes", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("points", point)])))])
    shapes = spark.read.option("multiLine", True).schema(schema).json(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode("shapes").alias("shape_no", "s"))
    return shapes.select("path", "s.label", "shape_no", "s.points", simple_polygon("s.points").alias("valid"))


def write_once(df: DataFrame, folder: str, text: str) -> str:
    """Write df under the digest of `text`; content that is there already is never overwritten.  Returns the path.

    The files are written beside their place and moved there in one step, so a reader
    sees all of them or none, and of two writers the first wins.
    """
    path = f"{folder}/{hashlib.sha256(text.encode()).hexdigest()[:32]}"
    gateway = df.sparkSession.sparkContext._gateway
    hadoop, conf = gateway.jvm.org.apache.hadoop.fs, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        draft = hadoop.Path(f"{path}.{uuid.uuid4().hex}.draft")
        df.write.parquet(draft.toString())
        try:  # fails if the target is there by now
            hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(target), gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError:
            fs.delete(draft, True)
            if not fs.exists(target):
                raise
    return path


def write_package(tables: dict[str, DataFrame], folder: str, by: str = "book_id") -> None:
    """The tables of a package, each partitioned by book; only the books that the tables hold are replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{folder}/{name}")


def write_events(df: DataFrame, folder: str) -> None:
    """Events as JSON lines."""
    df.write.mode("append").json(folder)
