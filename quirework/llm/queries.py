"""Queries of the text operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirework.llm import languages, leaks, mixing, runs, scan_repair, sql, visual_text
from quirework.operators import nested
from quirework.session import table

PADDLE = "paddleocr_split_ocr_reconciliation_summary_p102"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a session that look the same but differ in characters."""
    return visual_text.look_alike_pairs(table(spark, folder, PADDLE), "candidate_id", "combined_recognized_text", "scan_session_id")


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate with the class of texts of its session that look like its own."""
    return visual_text.look_classes(table(spark, folder, PADDLE), "candidate_id", "combined_recognized_text", "scan_session_id")


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate's text in one consistent form."""
    return visual_text.consistent_text(table(spark, folder, PADDLE), "candidate_id", "combined_recognized_text")


def _noise(spark: SparkSession, folder: str) -> scan_repair.ScanNoise:
    rows, reports = table(spark, folder, PADDLE), table(spark, folder, "ocr_quality_report_p008")
    nodes = nested.low_confidence_table(reports).join(reports.select("report_id", "scan_session_id").distinct(), "report_id")
    whole_id = F.when(F.col("node_id").startswith("p"), F.col("node_id")).otherwise(F.concat_ws("-", "page_id", "node_id"))
    low = nodes.groupBy(F.col("scan_session_id"), whole_id.alias("source_text_node_id")).agg(F.min("confidence").alias("confidence"))
    hints = rows.select("candidate_id", "scan_session_id", "source_text_node_id").join(low, ["scan_session_id", "source_text_node_id"]).select("candidate_id", "confidence")
    return scan_repair.ScanNoise(rows, "candidate_id", "combined_recognized_text", "page_id", hints)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of scan noise in each candidate's text."""
    return _noise(spark, folder).kinds()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate's text as continuous, repaired text."""
    return _noise(spark, folder).repaired()


def _label_runs(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "scanner_video_v3a2_temporal_labels")
    return runs.collapse_runs(labels, "recording_id", "frame_index", runs.plain_label("label"), F.lower("page_spread"), F.col("captured_at"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of two or more distinct frames."""
    return _label_runs(spark, folder).where("events > 1").select(
        F.col("sequence").alias("recording_id"), F.col("first_position").cast("int").alias("start_frame"), F.col("last_position").cast("int").alias("end_frame")
    )


def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs with count and duration."""
    return _label_runs(spark, folder).select(
        F.col("sequence").alias("recording_id"), "label", F.col("context").alias("page_spread"), F.col("first_position").cast("int").alias("start_frame"),
        F.col("last_position").cast("int").alias("end_frame"), F.col("events").alias("frames"), "duration_s",
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least twelve consecutive words of an evaluation item."""
    return leaks.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """How far each evaluation item leaked."""
    items = table(spark, folder, "eval_items")
    return leaks.leak_report(leaks.leaked_passages(table(spark, folder, "documents"), items), items)


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn documents with their uses."""
    return _mixture(spark, folder).documents()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the drawn mix reaches."""
    return _mixture(spark, folder).shares_reached()


def p7_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each target source has its share and no document is used more often than allowed."""
    return _mixture(spark, folder).kept_promises()


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    samples, documents = table(spark, folder, "lang_samples"), table(spark, folder, "documents")
    return languages.segment_languages(documents, languages.corpus_models(samples, documents), label="lang")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages with a whole sentence in a document that its label does not name."""
    return languages.unnamed_languages(_segments(spark, folder))


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's main language with confidence, and all its languages."""
    return languages.document_languages(_segments(spark, folder))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each sentence with its language and confidence."""
    return _segments(spark, folder).drop("named")


QUERIES = {q.__name__: q for q in (p2_found, p2_classes, p2_canonical, p3_found, p3_repaired, p5_found, p5_runs, p6_found, p6_report, p7_mix, p7_shares, p7_audit, p8_found, p8_documents, p8_segments)}
SQL = sql.SQL
