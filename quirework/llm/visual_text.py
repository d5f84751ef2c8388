"""Visually identical text with different characters: one consistent form.

Text is exploded to positioned code points.  A broadcast table gives each one its
decomposition and the letter it looks like; combining marks are ordered by class
within their cluster, clusters are recomposed through a second broadcast table,
and the strings are rebuilt.  Both tables follow from Unicode's properties by
rule, so their size is bounded by the character set, not by the data.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quirework.session import cut_lineage

# Letters and signs of other blocks that look like the letters and signs in the second row.
LOOKALIKES = [
    ("АВЕКМНОРСТУХЅІЈԚԜ", "ABEKMHOPCTYXSIJQW"),  # Cyrillic capitals
    ("аеорсухѕіјԛԝһ", "aeopcyxsijqwh"),  # Cyrillic small letters
    ("ӀҮԌѴ", "IYGV"),  # further Cyrillic capitals
    ("ԁӏүѵ", "dlyv"),  # further Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("οϲϳανρυιγ", "ocjavpuiy"),  # Greek small letters
    ("ՕՏՍ", "OSU"),  # Armenian capitals
    ("ոսօհ", "nuoh"),  # Armenian small letters
    ("ɑɡıɩ", "agii"),  # Latin small letters of other alphabets
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRSTVWYZ"),  # Cherokee
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),  # Lisu
    ("‐‑−﹣", "----"),  # hyphens and minus
    ("‧⋅・•∙", "·····"),  # middle dots
    ("∶∼ʼ′", ":~’’"),  # ratio, tilde operator, apostrophes
]
#: Compatibility forms that look like their plain characters; circled, super- and subscript forms do not.  Ligatures and Roman numerals look like their Latin letters.
LIKE_PLAIN = ("<wide>", "<narrow>", "<noBreak>", "<font>")
SOFT_HYPHEN = "\u00ad"
#: Characters that are their own consistent form (a test holds this against the tables), as the inside of a Java class.
_OWN = r"\x20-\x7e\n\x{ac00}-\x{d7a3}\x{2460}-\x{2473}\u00b2\u00b7\u2014\u2019\u00ab\u00bb\u00ac\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_STABLE = f"^[{_OWN}]*\\z"


@lru_cache(1)
def _lookalike() -> dict[str, str]:
    return {a: b for left, right in LOOKALIKES for a, b in zip(left, right)}


@lru_cache(200_000)
def parts_of(ch: str) -> tuple[str, ...]:
    """The characters that stand for ch before marks are ordered; none for an invisible one."""
    category = unicodedata.category(ch)
    if category == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or ch == "\u034f":
        return ()
    if category == "Zs":
        return (" ",)
    if category in ("Zl", "Zp") or ch == "\u0085":
        return ("\n",)
    if 0xAC00 <= ord(ch) <= 0xD7A3:  # syllables are composed from their letters instead
        return (ch,)
    rule = unicodedata.decomposition(ch)
    if not rule:
        return (_lookalike().get(ch, ch),)
    steps = rule.split()
    if steps[0].startswith("<"):
        drawn = [chr(int(x, 16)) for x in steps[1:]]
        letters = steps[0] == "<compat>" and all(c.isascii() and c.isalpha() for c in drawn) and (category == "Nl" or category.startswith("L") and len(drawn) > 1)
        if steps[0] not in LIKE_PLAIN and not letters:
            return (_lookalike().get(ch, ch),)
        steps = steps[1:]
    return tuple(p for s in steps for p in parts_of(chr(int(s, 16))))


def mark_class(ch: str) -> int:
    """Canonical combining class; vowel and final Hangul letters, which also join the character before, have 1000 and 1001."""
    if 0x1160 <= ord(ch) <= 0x11A7:
        return 1000
    if 0x11A8 <= ord(ch) <= 0x11FF:
        return 1001
    return unicodedata.combining(ch)


def _assigned() -> list[str]:
    return [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]


@lru_cache(1)
def character_rows() -> list[tuple[str, list[tuple[str, int]]]]:
    """(character, [(part, class)]) for every character that is not a lone starter standing for itself; some 20,000."""
    rows = []
    for ch in _assigned():
        if 0xAC00 <= ord(ch) <= 0xD7A3:
            continue
        parts = [(p, mark_class(p)) for p in parts_of(ch)]
        if parts != [(ch, 0)]:
            rows.append((ch, parts))
    return rows


@lru_cache(1)
def composite_rows() -> list[tuple[str, str]]:
    """(ordered decomposition, composed character) for every cluster that composes to one character; some 1,000."""
    rows = {}
    for ch in _assigned():
        if 0xAC00 <= ord(ch) <= 0xD7A3:
            continue
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch and all(parts_of(p) == (p,) for p in parts) and all(map(mark_class, parts[1:])):
            rows[parts] = ch
    return sorted(rows.items())


@lru_cache(1)
def _piece() -> str:
    """Pattern of a text's pieces: runs of characters that stay as they are, and single clusters.

    What follows a character in its cluster are marks and invisible characters.
    """
    spans: list[list[int]] = []
    for ch in _assigned():
        if not 0xAC00 <= ord(ch) <= 0xD7A3 and (parts_of(ch) == () or mark_class(parts_of(ch)[0])):
            if spans and spans[-1][1] == ord(ch) - 1:
                spans[-1][1] += 1
            else:
                spans.append([ord(ch), ord(ch)])
    following = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)
    return f"[{_OWN}]+(?![{following}])|(?s:.)[{following}]*"


def canonical(text: str | None) -> str | None:
    """The consistent form of one text; the operator's rule for a single value, used for tests and by callers that hold text in Python."""
    if text is None:
        return None
    clusters: list[list[str]] = []
    for ch in _line_end_hyphens(text):
        for p in parts_of(ch):
            if mark_class(p) and clusters:
                clusters[-1].append(p)
            else:
                clusters.append([p])
    return "".join(_compose("".join(sorted(c, key=mark_class))) for c in clusters)


def _line_end_hyphens(text: str) -> str:
    """A soft hyphen shows at the end of a line only, where it is a hyphen."""
    return text.replace(f"{SOFT_HYPHEN}\n", "-\n") if SOFT_HYPHEN in text else text


@lru_cache(1)
def _composites() -> dict[str, str]:
    return dict(composite_rows())


def _compose(cluster: str) -> str:
    if len(cluster) == 1:
        return cluster
    found = _composites().get(cluster)
    if found:
        return found
    first, second = ord(cluster[0]), ord(cluster[1])
    if 0x1100 <= first <= 0x1112 and 0x1161 <= second <= 0x1175:
        base = 0xAC00 + ((first - 0x1100) * 21 + second - 0x1161) * 28
        if len(cluster) > 2 and 0x11A8 <= ord(cluster[2]) <= 0x11C2:
            return chr(base + ord(cluster[2]) - 0x11A7) + cluster[3:]
        return chr(base) + cluster[2:]
    if 0xAC00 <= first <= 0xD7A3 and (first - 0xAC00) % 28 == 0 and 0x11A8 <= second <= 0x11C2:
        return chr(first + second - 0x11A7) + cluster[2:]
    return cluster


def character_table(spark: SparkSession) -> DataFrame:
    """Decomposition and look-alike mapping: __ch, __parts array<struct<p, cls>>."""
    return spark.createDataFrame(character_rows(), "__ch string, __parts array<struct<p: string, cls: int>>")


def composite_table(spark: SparkSession) -> DataFrame:
    """Composition mapping: __cluster, __composed."""
    return spark.createDataFrame(composite_rows(), "__cluster string, __composed string")


def _hangul(cluster: Column) -> Column:
    """Compose a cluster of Hangul letters by arithmetic; any other cluster stays."""
    a, b, c = (F.ascii(F.substring(cluster, k, 1)) for k in (1, 2, 3))
    letters = a.between(0x1100, 0x1112) & b.between(0x1161, 0x1175)
    syllable = a.between(0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & b.between(0x11A8, 0x11C2)
    base = ((a - 0x1100) * 21 + b - 0x1161) * 28 + 0xAC00
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
    rest = lambda k: F.substr(cluster, F.lit(k))
    return (
        F.when(letters & c.between(0x11A8, 0x11C2), F.concat(char(base + c - 0x11A7), rest(4)))
        .when(letters, F.concat(char(base), rest(3)))
        .when(syllable, F.concat(char(a + b - 0x11A7), rest(3)))
        .otherwise(cluster)
    )


def consistent_text(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, canonical_text) for every row: equal for texts that look the same, different for others.

    Full-width and half-width forms become plain, every blank a space, invisible
    characters vanish (a soft hyphen at a line end is a hyphen), look-alike letters
    of other scripts become Latin ones, combining marks are ordered and composed.
    Case, circled digits, superscripts, the number of blanks and line ends stay.
    Defined results: null gives null, empty gives empty, a text of invisible
    characters gives empty; texts may have any length; row ids must be unique.

    Texts of stable characters only are their own result.  The others are placed by
    row id once and cut into clusters and runs of stable characters.  Exploding to
    code points, both joins and both rebuilds then stay within their partition:
    characters are never shuffled.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col(row_id).alias("__id"), F.col(text).alias("__t"))
    stable = F.coalesce(F.col("__t").rlike(_STABLE), F.lit(True))
    plain = slim.where(stable).select(F.col("__id").alias(row_id), F.col("__t").alias("canonical_text"))
    work = slim.where(~stable).repartition("__id")
    shown = F.regexp_replace("__t", f"{SOFT_HYPHEN}\n", "-\n")
    pieces = work.select("__id", F.posexplode(F.regexp_extract_all(shown, F.lit(_piece()), F.lit(0))).alias("__no", "__piece"))
    points = pieces.select("__id", "__no", F.posexplode(F.when(F.col("__piece").rlike(_STABLE), F.array("__piece")).otherwise(F.split("__piece", ""))).alias("__pos", "__c"))
    mapped = points.join(F.broadcast(character_table(spark)), F.col("__c") == F.col("__ch"), "left")
    own = F.array(F.struct(F.col("__c").alias("p"), F.lit(0).alias("cls")))
    # An invisible character keeps an empty part, so that a text of nothing else still has a row.
    parts = F.when(F.size("__parts") == 0, F.array(F.struct(F.lit("").alias("p"), F.lit(0).alias("cls")))).otherwise(F.coalesce("__parts", own))
    single = mapped.select("__id", "__no", "__pos", F.posexplode(parts).alias("__sub", "__part")).select("__id", "__no", "__pos", "__sub", "__part.p", "__part.cls")
    clusters = single.groupBy("__id", "__no").agg(F.sort_array(F.collect_list(F.struct("cls", "__pos", "__sub", "p"))).alias("__m"))
    joined = clusters.select("__id", "__no", F.when(F.size("__m") == 1, F.col("__m")[0]["p"]).otherwise(F.concat_ws("", F.col("__m.p"))).alias("__s"))
    composed = joined.join(F.broadcast(composite_table(spark)), F.col("__s") == F.col("__cluster"), "left")
    short = F.char_length("__s").between(2, 8) & ~F.col("__s").rlike(_STABLE)
    done = composed.select("__id", "__no", F.coalesce("__composed", F.when(short, _hangul(F.col("__s"))).otherwise(F.col("__s"))).alias("__s"))
    rebuilt = done.groupBy("__id").agg(F.concat_ws("", F.sort_array(F.collect_list(F.struct("__no", "__s")))["__s"]).alias("canonical_text"))
    return plain.unionByName(rebuilt.select(F.col("__id").alias(row_id), "canonical_text"))


def _looks(rows: DataFrame, row_id: str, text: str, within: str) -> DataFrame:
    """(__id, __look, __spelling): digests of each row's look within its group and of its spelling; rows with a null text or group have none.

    Written once: the texts are brought to their form a single time however often the keys are read.
    """
    canon = consistent_text(rows, row_id, text).withColumnRenamed(row_id, "__cid")
    return cut_lineage(
        rows.where(F.col(within).isNotNull() & F.col(text).isNotNull())
        .select(F.col(row_id).alias("__id"), F.col(within).alias("__g"), F.sha2(text, 256).alias("__spelling"))
        .join(canon, F.col("__id") == F.col("__cid"))
        .select("__id", F.sha2(F.to_json(F.struct("__g", "canonical_text")), 256).alias("__look"), "__spelling")
    )


def look_classes(rows: DataFrame, row_id: str, text: str, within: str) -> DataFrame:
    """(row_id, class_id, spelling_id, spellings) of every row with a text and a group.

    Rows of one `within` group whose texts look the same share a class, named by its
    smallest row id; rows with the same character sequence share a spelling_id, the
    smallest row id with it; spellings counts the class's spellings.  One row a row,
    however many rows look alike.
    """
    keyed = _looks(rows, row_id, text, within)
    spellings = keyed.groupBy("__look", "__spelling").agg(F.min("__id").alias("spelling_id"))
    classes = spellings.groupBy("__look").agg(F.min("spelling_id").alias("class_id"), F.count("*").alias("spellings"))
    return keyed.join(spellings, ["__look", "__spelling"]).join(classes, "__look").select(F.col("__id").alias(row_id), "class_id", "spelling_id", "spellings")


def look_alike_pairs(rows: DataFrame, row_id: str, text: str, within: str) -> DataFrame:
    """(row_id_a, row_id_b), a < b: rows of one `within` group whose texts look the same but differ in characters.

    Distinct spellings are paired first, then rows are looked up for each spelling,
    so identical copies are never compared with one another.  Rows with a null text
    or a null group are in no pair.  The result holds every pair, so it grows with the
    square of a look's copies; look_classes says the same in one row a row.
    """
    keyed = _looks(rows, row_id, text, within)
    spellings = keyed.groupBy("__look", "__spelling").agg(F.count("*").alias("__n"))
    several = spellings.groupBy("__look").agg(F.count("*").alias("__v")).where("__v > 1").select(F.col("__look").alias("__k"))
    mine = keyed.join(several, F.col("__look") == F.col("__k"), "left_semi")
    kinds = mine.select("__look", "__spelling").distinct()
    a = kinds.toDF("__look", "__sa")
    b = kinds.toDF("__look", "__sb")
    pairs = a.join(b, "__look").where("__sa < __sb")
    left = mine.select(F.col("__look"), F.col("__spelling").alias("__sa"), F.col("__id").alias("__ia"))
    right = mine.select(F.col("__look"), F.col("__spelling").alias("__sb"), F.col("__id").alias("__ib"))
    both = pairs.join(left, ["__look", "__sa"]).join(right, ["__look", "__sb"])
    return both.select(F.least("__ia", "__ib").alias(f"{row_id}_a"), F.greatest("__ia", "__ib").alias(f"{row_id}_b"))
