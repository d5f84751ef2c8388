"""Relational, text and vector queries over orders, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quirework.functions import formulas as M, text as X, values as V
from quirework.operators import compare, delivery, documents, sequences, statistics
from quirework.session import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _source() -> Column:
    return F.coalesce(F.lower(F.trim("source")), F.lit("none"))


def doc_quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-01, AGG-06, SRT-04: documents by source with length statistics, noise counts and a weighted score, worst first."""
    d = _docs(spark, folder).select(_source().alias("source"), "n_chars", X.symbol_noise("text").alias("noise"), X.table_like("text").alias("tables"), (F.col("n_chars") < 100).alias("short"))
    out = d.groupBy("source").agg(
        F.count("*").alias("documents"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.count_if("noise").alias("noisy"), F.count_if("tables").alias("table_like"), F.count_if("short").alias("short")
    )
    return out.withColumn("score", F.expr("noisy + 3 * table_like + 2 * short")).orderBy(F.desc("score"), "source")


def doc_issue_scores(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-06, SRT-05: issues of each document by weight; every code counts, only weights above 0 enter score and count."""
    d = _docs(spark, folder).select("doc_id", F.array_compact(F.array(
        F.when(F.col("n_chars") < 100, F.lit("SHORT")), F.when(X.choices_missing("text"), F.lit("CHOICE_OMISSION")), F.when(X.number_prefix("text"), F.lit("NUMBER_PREFIX")), F.when(F.col("lang").isNull(), F.lit("NO_LABEL")),
    )).alias("codes"))
    weights = spark.createDataFrame([("SHORT", 2), ("CHOICE_OMISSION", 3), ("NUMBER_PREFIX", 1), ("NO_LABEL", 0)], "code string, weight int")
    issues = d.select("doc_id", F.explode("codes").alias("code")).join(F.broadcast(weights), "code")  # four fixed rows
    return issues.groupBy("doc_id").agg(F.sum("weight").alias("score"), F.count_if(F.col("weight") > 0).alias("issue_count"), F.count("*").alias("codes"))


def doc_source_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """JN-04: document counts by source with target shares, 0 where there is no target."""
    counts = _docs(spark, folder).groupBy(_source().alias("source")).agg(F.count("*").alias("n"))
    return compare.with_defaults(counts, table(spark, folder, "mix_targets"), ["source"], {"target_share": 0.0, "max_repeats": 0})


def doc_support(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-16, AGG-20: documents by source, split by approval of their source."""
    approved = table(spark, folder, "mix_targets").select(F.col("source").alias("s"))
    d = _docs(spark, folder).select(_source().alias("source")).join(approved, F.col("source") == F.col("s"), "left")
    return d.groupBy("source").agg(F.count_if(F.col("s").isNotNull()).alias("approved"), F.count_if(F.col("s").isNull()).alias("pending"))


def doc_math_scores(spark: SparkSession, folder: str) -> DataFrame:
    """STR-04, AGG-15: lines of documents scored as mathematics, by document."""
    lines = _docs(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    s = lines.withColumn("score", X.math_score("line")).withColumn("kind", X.math_kind("line"))
    return s.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("score") >= 3).alias("candidates"), F.max("score").alias("best"), F.count_if(F.col("kind") == "display_or_expression").alias("display"))


def doc_token_classes(spark: SparkSession, folder: str) -> DataFrame:
    """STR-05: tokens of documents by class."""
    t = _docs(spark, folder).select(F.explode(F.split("text", r"[ \t\n\r]+")).alias("token")).where("token <> ''")
    return t.groupBy(X.token_class("token").alias("class")).agg(F.count("*").alias("n"))


def doc_choices(spark: SparkSession, folder: str) -> DataFrame:
    """STR-08, FLT-12: choice options of documents."""
    d = _docs(spark, folder).where(F.col("text").rlike(X.CHOICE_MARK))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.col("t").rlike(X.CHOICE_MARK))
    return lines.select("doc_id", "line", F.explode(X.choice_options("t")).alias("o")).select("doc_id", "line", "o.label", "o.text")


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """STR-09: non-blank lines of documents, counted and measured."""
    lines = _docs(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where("trim(t) <> ''")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.char_length("t")).alias("longest"), F.max("line").alias("last_line"))


def doc_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """STR-01, HSH-01: digest of each text without blanks and case."""
    return _docs(spark, folder).select("doc_id", V.text_key(F.lower(F.regexp_replace("text", r"[ \t\n\r]+", ""))).alias("bare_key"))


def doc_page_labels(spark: SparkSession, folder: str) -> DataFrame:
    """STR-10, STR-11, SRC-04: page labels of documents, and whether the next page of the book follows."""
    d = _docs(spark, folder).where("page_no is not null and book_id is not null").select("book_id", F.col("page_no").cast("string").alias("label"), "page_no").distinct()
    n = sequences.neighbours(d, ["book_id"], ["page_no"], "label")
    return n.select("book_id", "page_no", X.page_label("label").alias("label"), X.consecutive("label", "next_item").alias("follows"), X.page_id_from_path(F.concat(F.lit("scans/p"), "label", F.lit(".png"))).alias("page_id"))


def doc_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """HSH-01: texts that occur more than once, with their first document."""
    d = documents.content_keys(_docs(spark, folder).select("doc_id", "text"), "text").where("copies > 1")
    return d.groupBy("content_key").agg(F.min("doc_id").alias("first_doc"), F.max("copies").alias("copies"))


def doc_viewport(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-12: each document's second window of twenty tokens."""
    cells = F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")), " ")
    v = _docs(spark, folder).select("doc_id", X.squeezed("text").alias("t"), cells.alias("cells")).withColumn("v", sequences.viewport(F.col("cells"), F.lit(20), 20))
    return v.select("doc_id", "v.offset", F.concat_ws(" ", "v.cells").alias("shown"), "v.total", "v.has_previous", "v.has_next")


def doc_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """MAP-02: each document against the first one of its book with its text: kept as that one, or to be made if it is the first."""
    d = _docs(spark, folder).select("doc_id", F.coalesce("book_id", F.lit("")).alias("key"), "text", "ingested_at")
    first = d.where("text is not null").groupBy("key", "text").agg(F.min(F.struct("ingested_at", "doc_id")).alias("m")).select("key", "text", F.col("m.doc_id").alias("asset"))
    out = documents.reused(d, first, "key", "text", "asset")
    own = F.col("asset").isNull() | (F.col("asset") == F.col("doc_id"))
    return out.select("doc_id", F.when(~own, F.col("asset")).alias("asset"), F.when(own, "synthesize").otherwise("keep").alias("action"))


# Rules for this project's own corpus: (name, pattern, replacement), each on what the ones before it left.
SPELLING_RULES = [("braille line", "점자 +줄", "점자줄"), ("reading place", "읽기 +위치", "읽기위치"), ("low contrast", "low-contrast", "low contrast"), ("line place", "점자줄 +위", "점자줄위")]


def doc_terms(spark: SparkSession, folder: str) -> DataFrame:
    """STR-03: texts corrected by ordered rules; which rules applied, how often in all, and the length after."""
    r = _docs(spark, folder).select("doc_id", X.rewritten("text", SPELLING_RULES).alias("r"))
    return r.select("doc_id", F.concat_ws("|", "r.applied.rule").alias("rules"), F.aggregate("r.applied.count", F.lit(0), lambda s, c: s + c).alias("times"), F.char_length("r.text").alias("chars"))


def doc_read_aloud(spark: SparkSession, folder: str) -> DataFrame:
    """STR-14: each different line with signs and single letters read as words."""
    lines = _docs(spark, folder).select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''").distinct()
    return lines.select("line", X.read_aloud("line").alias("spoken"))


def _formula_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line): lines with a relation between two sides, in no script of words and without the end of a sentence; a point inside a number and a factorial are neither."""
    lines = _docs(spark, folder).select(F.explode(F.split("text", "\n")).alias("line"))
    related = F.col("line").rlike(r"\S\s*(?:[=<>≥≤≠≈≡]|\\(?:geq?|leq?|neq?|approx|equiv)(?![A-Za-z]))\s*\S")
    prose = F.col("line").rlike(r"[가-힣ぁ-ん一-鿿?]|(?<![0-9])\.|\.(?![0-9])|(?<![0-9A-Za-z)\]}])!|[A-Za-z]{2}!")
    return lines.where(related & ~prose)


def doc_formulas(spark: SparkSession, folder: str) -> DataFrame:
    """STR-19, STR-20, GRD-08: formula lines of documents parsed; how many have each status and fault."""
    lines = _formula_lines(spark, folder)
    f = lines.groupBy("line").agg(F.count("*").alias("n")).select("n", M.formula_tree_udf("line").alias("f"), F.concat_ws(",", F.transform(X.formula_problems("line"), lambda p: F.concat_ws(":", p["code"], p["severity"]))).alias("fault"))
    return f.groupBy(F.col("f.status").alias("status"), "fault").agg(F.count("*").alias("formulas"), F.sum("n").alias("lines"))


def doc_formula_readings(spark: SparkSession, folder: str) -> DataFrame:
    """STR-15, STR-16, STR-18: speech and number of braille cells of each different formula line."""
    lines = _formula_lines(spark, folder).distinct()
    b = lines.select("line", M.formula_speech_udf("line").alias("speech"), M.formula_braille_udf("line").alias("b"))
    return b.select("line", "speech", F.size("b.cells").alias("cells"), "b.error")


def doc_word_braille(spark: SparkSession, folder: str) -> DataFrame:
    """STR-17, WIN-12: braille of each Hangul word of the corpus and the windows of twelve cells it fills."""
    words = _docs(spark, folder).select(F.explode(F.split("text", r"[ \n]+")).alias("w")).where(F.col("w").rlike("^[가-힣]+$")).groupBy("w").agg(F.count("*").alias("n"))
    b = words.select("w", "n", M.hangul_braille_udf("w")["cells"].alias("masks"), X.hangul_parts(F.substring("w", 1, 1))["initial"].alias("initial"))
    shown = F.transform("masks", lambda c: c.cast("string"))
    return b.select("w", "n", "initial", F.concat_ws(",", shown).alias("cells"), F.size(sequences.chunks(shown, 12)).alias("windows"))


def doc_particles(spark: SparkSession, folder: str) -> DataFrame:
    """STR-15: Hangul words with the particle they ask for."""
    words = _docs(spark, folder).select(F.explode(F.split("text", r"[ \n]+")).alias("w")).where(F.col("w").rlike("^[가-힣]+$")).distinct()
    return words.select("w", X.with_particle("w", "은", "는").alias("topic"))


def doc_language_modes(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-16: each book's most frequent label, of equals the one of the first document."""
    return statistics.consensus(_docs(spark, folder).where("book_id is not null"), ["book_id"], "lang", "doc_id")


def doc_append(spark: SparkSession, folder: str) -> DataFrame:
    """SET-05: a book's pages with new pages after them, in order."""
    d = _docs(spark, folder).select("book_id", "page_no", "doc_id").where("book_id is not null")
    both = compare.appended(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0"), "page_no")
    return sequences.reindexed(both, ["book_id"], ["source_rank", "page_no", "doc_id"]).select("book_id", "doc_id", F.col("place").cast("int").alias("place"))


def item_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """STR-02: similarity of each evaluation item with the next one of its suite."""
    n = sequences.neighbours(table(spark, folder, "eval_items"), ["suite"], ["item_id"], "text").where("next_item is not null")
    return compare.similarity(n, "text", "next_item").select("item_id", F.round("ratio", 6).alias("ratio"))


def item_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """JN-18: word alignment of each item with the language's first item."""
    words = table(spark, folder, "eval_items").select("item_id", "lang", F.posexplode(F.split("text", " ")).alias("i", "w"))
    first = words.groupBy(F.col("lang").alias("l")).agg(F.min("item_id").alias("f"))
    ref = words.join(first, F.expr("lang = l and item_id = f")).select("l", "i", "w")
    items = table(spark, folder, "eval_items").select("item_id", F.col("lang").alias("l"))
    return compare.aligned_ratio(words.select("item_id", "i", "w"), ref.join(items, "l").select("item_id", "i", "w"), ["item_id"], "i", "w")


def order_semi(spark: SparkSession, folder: str) -> DataFrame:
    """JN-05, JN-11: customers of a segment with an order above 200,000."""
    big = table(spark, folder, "orders").where("o_totalprice > 200000")
    return table(spark, folder, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def order_anti(spark: SparkSession, folder: str) -> DataFrame:
    """JN-13, JN-19: customers without orders."""
    return table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def order_references(spark: SparkSession, folder: str) -> DataFrame:
    """JN-15, AGG-13: dangling and duplicate references of line items."""
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    keys = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    dup = keys.agg(F.sum(F.col("n") - 1).alias("duplicate_lines"), F.sum("n").alias("line_rows"))
    dangling = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("dangling"))
    unused = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("without_lines"))
    return dup.join(dangling).join(unused)  # three single rows


def order_sets(spark: SparkSession, folder: str) -> DataFrame:
    """SET-01..04, SET-06: key sets of customers that order in two years."""
    o = table(spark, folder, "orders")
    year = lambda y: o.where(F.year("o_orderdate") == y).select("o_custkey")
    return compare.key_sets(year(1995), year(1996), ["o_custkey"])


def order_status(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-17: status of each order from its lines."""
    return delivery.status_rollup(table(spark, folder, "lineitem"), ["l_orderkey"], "l_linestatus", [], "F", "open").groupBy("status").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"))


def order_gapless(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-19: orders whose line numbers have no gap."""
    return delivery.gapless(table(spark, folder, "lineitem"), ["l_orderkey"], "l_linenumber").groupBy("complete").agg(F.count("*").alias("orders"))


def order_nested_max(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-09: the largest quantity of each part, summed by supplier."""
    return delivery.sum_of_max(table(spark, folder, "lineitem"), ["l_suppkey"], "l_partkey", "l_quantity")


def order_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-11: spread of prices by flag and status."""
    out = statistics.spread_summary(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 10000.0)
    return out.select("l_returnflag", "l_linestatus", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("p10", 4).alias("p10"), F.round("low_share", 6).alias("low_share"))


def order_wins(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-12: which of discount and tax is larger, with a dead band."""
    return compare.policy_wins(table(spark, folder, "lineitem"), "l_discount", "l_tax")


def order_regressions(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-10, AGG-30: the three worst line items by severity."""
    li = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), (F.col("l_returnflag") == "R").alias("gate"), "l_discount", "l_tax")
    return compare.regressions(li, "line_id", "gate", {"l_discount": 0.09, "l_tax": 0.07}).select("line_id", "severity")


def order_zip(spark: SparkSession, folder: str) -> DataFrame:
    """JN-17: returned and accepted lines of an order side by side."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return compare.zipped(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")


def order_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """JN-16: lines against the first line of their order."""
    li = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity"))
    return compare.anchored(li, ["l_orderkey"], F.col("l_linenumber") == 1, ["quantity"])


def order_type_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-26: return flags of an order's shipped and open lines."""
    li = table(spark, folder, "lineitem")
    return compare.type_deltas(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), ["l_suppkey"], "l_returnflag")


def order_pricing(spark: SparkSession, folder: str) -> DataFrame:
    """Pricing summary over all line items: sums, means and counts by flag and status."""
    li = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n")
    )


def order_nations(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by region and nation of customer and supplier in one nation: a five-table join."""
    j = table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(table(spark, folder, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    j = j.join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def vector_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """NUM-03, JN-12: nearest other vector of all rows for each twentieth vector, by the signs of all elements."""
    e = table(spark, folder, "embeddings").select("vec_id", F.size("embedding").alias("n"), V.sign_words("embedding").alias("h"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("n").alias("qn"), F.col("h").alias("qh"))
    # Every query meets every row, block by block; each block keeps its nearest before the shuffle.
    d = q.crossJoin(e).where("q_id <> vec_id and qn = n").withColumn("d", V.words_distance("qh", "h")).where("d is not null")
    return d.groupBy("q_id").agg(F.min(F.struct("d", "vec_id")).alias("m")).select("q_id", F.col("m.vec_id").alias("vec_id"), F.col("m.d").alias("bits"))


def vector_matches(spark: SparkSession, folder: str) -> DataFrame:
    """NUM-04: error, correlation and product of each query vector with the next vectors of its label."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    n = sequences.neighbours(e, ["label"], ["vec_id"], "embedding").where("next_item is not null")
    return n.select("vec_id", F.round(V.mean_abs_error("embedding", "next_item"), 5).alias("mae"), F.round(V.correlation("embedding", "next_item"), 5).alias("ncc"), F.round(V.dot("embedding", "next_item"), 4).alias("dot"))


def vector_cells(spark: SparkSession, folder: str) -> DataFrame:
    """NUM-06, ARR-03: cells packed from the places of a vector's first positive elements."""
    dots = F.filter(F.transform(F.slice("embedding", 1, 6), lambda v, k: F.when(v > 0, k + 1)), lambda x: x.isNotNull())
    return table(spark, folder, "embeddings").select("vec_id", V.cell_mask(dots).alias("cell"), F.array_join(F.array_distinct(F.transform(F.slice("embedding", 1, 6), lambda v: F.when(v > 0, "1").otherwise("0"))), "").alias("kinds"))


_NOISE = r"(regexp_matches(coalesce(text, ''), '[A-Za-z가-힣]') AND length(regexp_replace(coalesce(text, ''), '[^@#=<>+\-^_\[\](){}\\|0-9]', '', 'g')) >= 4)"
_TOKENS = r"list_filter(regexp_split_to_array(replace(coalesce(text, ''), '@', ' @ '), '\s+'), lambda t: t <> '')"
_TABLE = f"(len({_TOKENS}) >= 6 AND len(list_filter({_TOKENS}, lambda t: regexp_matches(t, '[0-9]') OR t IN ('@', 'O', 'X'))) >= 0.55 * len({_TOKENS}))"
_SRC = "coalesce(lower(trim(source)), 'none')"
_MARKS = "len(list_distinct(regexp_extract_all(text, '[①②③④⑤]')))"
_SIGNS = r"length(regexp_replace(t, '[^=+*/^<>≤≥≠≈±√∑∫∞π-]', '', 'g'))"
_SCORE = rf"""CASE WHEN len(regexp_extract_all(t, '[①②③④⑤]|\([1-5]\)|\b[1-5][.)]')) >= 2 AND {_SIGNS} <= 1 THEN 0 ELSE
  CASE WHEN regexp_matches(t, '[A-Za-z0-9)\]}}]\s*[=<>]|[≤≥≠≈]') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)\b[fgh]\s*\(|\b(?:sin|cos|tan|log|ln)\b') THEN 3 ELSE 0 END
  + CASE WHEN regexp_matches(t, '(?:[0-9]+|[A-Za-z])\s*/\s*(?:[0-9]+|[A-Za-z])') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '[A-Za-z0-9]\s*[\^_]\s*[A-Za-z0-9]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '[√∑∫∞π]') THEN 3 ELSE 0 END
  + CASE WHEN {_SIGNS} >= 2 AND {_SIGNS} >= 0.08 * length(t) THEN 2 ELSE 0 END + CASE WHEN length(t) <= 45 AND {_SIGNS} >= 1 AND length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) >= 2 THEN 2 ELSE 0 END END"""

def _rules_sql() -> str:
    text, hits = "coalesce(text, '')", []
    for name, pattern, replacement in SPELLING_RULES:
        hits.append(f"{{'rule': '{name}', 'n': len(regexp_extract_all({text}, '{pattern}'))}}")
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return f"""SELECT doc_id, array_to_string(list_transform(h, lambda x: x.rule), '|') AS rules, CAST(coalesce(list_sum(list_transform(h, lambda x: x.n)), 0) AS INTEGER) AS times, chars
FROM (SELECT doc_id, list_filter([{', '.join(hits)}], lambda x: x.n > 0) AS h, CASE WHEN text IS NOT NULL THEN CAST(length({text}) AS INTEGER) END AS chars FROM documents)"""


SQL = {
    "doc_terms": _rules_sql(),
    "doc_quality_report": f"""WITH d AS (SELECT {_SRC} AS source, n_chars, {_NOISE} AS noise, {_TABLE} AS tables, n_chars < 100 AS short FROM documents)
SELECT *, noisy + 3 * table_like + 2 * short AS score FROM (SELECT source, count(*) AS documents, round(avg(n_chars), 4) AS mean_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars, count(*) FILTER (noise) AS noisy, count(*) FILTER (tables) AS table_like, count(*) FILTER (short) AS short FROM d GROUP BY 1)""",
    "doc_issue_scores": rf"""WITH i AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 100 THEN 'SHORT' END, CASE WHEN {_MARKS} BETWEEN 2 AND 4 THEN 'CHOICE_OMISSION' END, CASE WHEN regexp_matches(ltrim(text), '^[0-9]+\s') THEN 'NUMBER_PREFIX' END, CASE WHEN lang IS NULL THEN 'NO_LABEL' END], lambda c: c IS NOT NULL)) AS code FROM documents),
w AS (SELECT *, CASE code WHEN 'SHORT' THEN 2 WHEN 'CHOICE_OMISSION' THEN 3 WHEN 'NUMBER_PREFIX' THEN 1 ELSE 0 END AS weight FROM i)
SELECT doc_id, CAST(sum(weight) AS BIGINT) AS score, count(*) FILTER (weight > 0) AS issue_count, count(*) AS codes FROM w GROUP BY 1""",
    "doc_source_defaults": f"SELECT source, n, coalesce(target_share, 0.0) AS target_share, coalesce(max_repeats, 0) AS max_repeats FROM (SELECT {_SRC} AS source, count(*) AS n FROM documents GROUP BY 1) LEFT JOIN mix_targets USING (source)",
    "doc_support": f"SELECT d.source, count(m.source) AS approved, count(*) FILTER (m.source IS NULL) AS pending FROM (SELECT {_SRC} AS source FROM documents) d LEFT JOIN mix_targets m USING (source) GROUP BY 1",
    "doc_math_scores": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t FROM l WHERE trim(line) <> ''), s AS (SELECT doc_id, t, {_SCORE} AS score FROM t)
SELECT doc_id, count(*) AS lines, count(*) FILTER (score >= 3) AS candidates, max(score) AS best, count(*) FILTER (score >= 3 AND length(t) <= 60) AS display FROM s GROUP BY 1""",
    "doc_token_classes": r"""SELECT CASE WHEN regexp_matches(t, '[가-힣]') THEN 'TEXT' WHEN regexp_matches(t, '[A-Za-z0-9=+*/^_<>≤≥≠≈±√∑∫∞π-]') THEN 'MATH' ELSE 'OTHER' END AS class, count(*) AS n
FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS t FROM documents) WHERE t <> '' GROUP BY 1""",
    "doc_choices": r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT doc_id, CAST(line AS INTEGER) AS line, left(o, 1) AS label, trim(substr(o, 2)) AS text FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '[①②③④⑤][^①②③④⑤]*')) AS o FROM l)""",
    "doc_lines": "SELECT doc_id, count(*) AS lines, CAST(max(length(t)) AS INTEGER) AS longest, CAST(max(line) AS INTEGER) AS last_line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE trim(t) <> '' GROUP BY 1",
    "doc_normalised": r"SELECT doc_id, left(sha256(lower(regexp_replace(text, '[ \t\n\r]+', '', 'g'))), 16) AS bare_key FROM documents",
    "doc_page_labels": "SELECT book_id, page_no, CASE WHEN page_no BETWEEN 1 AND 9999 THEN CAST(page_no AS VARCHAR) END AS label, coalesce(lead(page_no) OVER (PARTITION BY book_id ORDER BY page_no) = page_no + 1, false) AS follows, 'p' || CASE WHEN page_no < 1000 THEN lpad(CAST(page_no AS VARCHAR), 3, '0') ELSE CAST(page_no AS VARCHAR) END AS page_id FROM (SELECT DISTINCT book_id, page_no FROM documents WHERE page_no IS NOT NULL AND book_id IS NOT NULL)",
    "doc_duplicates": "SELECT left(sha256(text), 16) AS content_key, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "doc_viewport": r"""WITH t AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' ') AS c FROM documents), o AS (SELECT *, CAST(greatest(0, least(20, ((len(c) - 1) // 20) * 20)) AS INTEGER) AS o FROM t)
SELECT doc_id, o AS "offset", array_to_string(c[o + 1 : o + 20], ' ') AS shown, CAST(len(c) AS INTEGER) AS total, o > 0 AS has_previous, o + 20 < len(c) AS has_next FROM o""",
    "doc_reuse": """WITH f AS (SELECT doc_id, text, first_value(doc_id) OVER (PARTITION BY coalesce(book_id, ''), text ORDER BY ingested_at NULLS FIRST, doc_id) AS a FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL AND a <> doc_id THEN a END AS asset, CASE WHEN text IS NOT NULL AND a <> doc_id THEN 'keep' ELSE 'synthesize' END AS action FROM f""",
    "doc_particles": r"SELECT DISTINCT w, w || CASE WHEN (unicode(right(w, 1)) - 44032) % 28 <> 0 THEN '은' ELSE '는' END AS topic FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM documents) WHERE regexp_matches(w, '^[가-힣]+$')",
    "doc_language_modes": "SELECT book_id, lang, c AS votes, CAST(n AS BIGINT) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY book_id) AS n, row_number() OVER (PARTITION BY book_id ORDER BY c DESC, f) AS k FROM (SELECT book_id, lang, count(*) AS c, min(doc_id) AS f FROM documents WHERE book_id IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2)) WHERE k = 1",
    "doc_append": "SELECT book_id, doc_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, page_no NULLS FIRST, doc_id) - 1 AS INTEGER) AS place FROM documents WHERE book_id IS NOT NULL",
    "order_semi": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY 1",
    "order_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "order_references": "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_lines, CAST(sum(n) AS BIGINT) AS line_rows, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS dangling, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS without_lines FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "order_sets": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996),
n AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS "both", (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either)
SELECT *, only_left = 0 AND only_right = 0 AS equal, "both" = 0 AS disjoint FROM n""",
    "order_status": "SELECT status, count(*) AS orders, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' ELSE 'open' END AS status, count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1",
    "order_gapless": "SELECT complete, count(*) AS orders FROM (SELECT min(l_linenumber) = 1 AND count(DISTINCT l_linenumber) = max(l_linenumber) AS complete FROM lineitem GROUP BY l_orderkey) GROUP BY 1",
    "order_nested_max": "SELECT l_suppkey, sum(m) AS total FROM (SELECT l_suppkey, l_partkey, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "order_percentiles": "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(avg(CASE WHEN l_extendedprice < 10000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS low_share FROM lineitem GROUP BY 1, 2",
    "order_wins": "SELECT *, CASE WHEN wins_a >= 5 AND wins_a > wins_b THEN 'l_discount' WHEN wins_b >= 5 AND wins_b > wins_a THEN 'l_tax' ELSE 'none' END AS choice FROM (SELECT count(*) FILTER (l_discount - l_tax > 0.002::DOUBLE) AS wins_a, count(*) FILTER (l_discount - l_tax < -0.002::DOUBLE) AS wins_b, count(*) FILTER (abs(l_discount - l_tax) <= 0.002::DOUBLE) AS ties FROM lineitem)",
    "order_regressions": "SELECT l_orderkey * 10 + l_linenumber AS line_id, round(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END + greatest(l_discount, 0) + greatest(l_tax, 0), 6) AS severity FROM lineitem WHERE l_returnflag = 'R' OR l_discount > 0.09::DOUBLE OR l_tax > 0.07::DOUBLE ORDER BY severity DESC, line_id LIMIT 3",
    "order_zip": """WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS position FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS position FROM lineitem WHERE l_returnflag = 'A')
SELECT l_orderkey, CAST(position AS INTEGER) AS position, r.l_partkey AS "left", a.l_partkey AS "right", r.l_partkey IS NOT DISTINCT FROM a.l_partkey AS same FROM r FULL JOIN a USING (l_orderkey, position)""",
    "order_anchor": "WITH q AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) SELECT q.*, q.quantity - a.quantity AS d_quantity FROM q JOIN q a ON q.l_orderkey = a.l_orderkey AND a.l_linenumber = 1 WHERE q.l_linenumber <> 1",
    "order_type_deltas": "SELECT l_suppkey, l_returnflag, count(*) FILTER (l_linestatus = 'F') AS baseline, count(*) FILTER (l_linestatus = 'O') AS candidate, count(*) FILTER (l_linestatus = 'O') - count(*) FILTER (l_linestatus = 'F') AS delta FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_linestatus = 'O') <> count(*) FILTER (l_linestatus = 'F')",
    "order_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2",
    "order_nations": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "vector_hashes": """SELECT q_id, vec_id, CAST(d AS INTEGER) AS bits FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS k FROM (
  SELECT q.vec_id AS q_id, e.vec_id, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda k: CASE WHEN coalesce(q.embedding[k] > 0, false) <> coalesce(e.embedding[k] > 0, false) THEN 1 ELSE 0 END)) AS d
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id AND len(q.embedding) = len(e.embedding) WHERE q.vec_id % 20 = 0 AND len(q.embedding) > 0)) WHERE k = 1""",
    "vector_matches": """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id), lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings),
s AS (SELECT *, len(a) AS n, list_sum(a) AS sa, list_sum(b) AS sb, list_inner_product(a, b) AS ab, list_inner_product(a, a) AS aa, list_inner_product(b, b) AS bb FROM n WHERE b IS NOT NULL)
SELECT vec_id, round(list_sum(list_transform(range(1, n + 1), lambda k: abs(a[k] - b[k]))) / n, 5) AS mae, round((ab - sa * sb / n) / sqrt((aa - sa * sa / n) * (bb - sb * sb / n)), 5) AS ncc, round(ab, 4) AS dot FROM s""",
    "vector_cells": "SELECT vec_id, CAST(list_sum(list_transform(range(1, 7), lambda k: CASE WHEN embedding[k] > 0 THEN 1 << CAST(k - 1 AS INTEGER) ELSE 0 END)) AS INTEGER) AS cell, CASE WHEN embedding[1] > 0 THEN '1' ELSE '0' END || CASE WHEN len(list_distinct(list_transform(embedding[1:6], lambda x: x > 0))) = 1 THEN '' WHEN embedding[1] > 0 THEN '0' ELSE '1' END AS kinds FROM embeddings",
}

QUERIES = {
    q.__name__: q
    for q in (
        doc_quality_report, doc_issue_scores, doc_source_defaults, doc_support, doc_math_scores, doc_token_classes, doc_choices, doc_lines, doc_normalised, doc_page_labels, doc_duplicates, doc_viewport, doc_reuse, doc_terms, doc_read_aloud, doc_formulas, doc_formula_readings, doc_word_braille, doc_particles,
        doc_language_modes, doc_append, item_similarity, item_alignment, order_semi, order_anti, order_references, order_sets, order_status, order_gapless, order_nested_max, order_percentiles, order_wins, order_regressions,
        order_zip, order_anchor, order_type_deltas, order_pricing, order_nations, vector_hashes, vector_matches, vector_cells,
    )
}
