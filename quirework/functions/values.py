"""Column functions over numbers, boxes, arrays, hashes and times."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def box_from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct<x, y, width, height> of two corners, rounded to 3 digits; null if a corner is null."""
    known = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    return F.when(known, F.struct(F.round(x0, 3).alias("x"), F.round(y0, 3).alias("y"), F.round(x1 - x0, 3).alias("width"), F.round(y1 - y0, 3).alias("height")))


def scaled_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """A box as shares of its page, rounded to 6 digits; zeros on a page without size."""
    ok = (page_w > 0) & (page_h > 0)
    part = lambda v, size, name: F.when(ok, F.round(F.try_divide(v, size), 6)).otherwise(0.0).alias(name)
    return F.struct(part(x, page_w, "x"), part(y, page_h, "y"), part(w, page_w, "width"), part(h, page_h, "height"))


def crop_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, pad: float) -> Column:
    """struct<left, top, right, bottom>: the box with padding, cut at the page; null if nothing is left."""
    left, top = F.greatest(F.floor(x - pad), F.lit(0)), F.greatest(F.floor(y - pad), F.lit(0))
    right, bottom = F.least(F.ceil(x + w + pad), F.floor(page_w)), F.least(F.ceil(y + h + pad), F.floor(page_h))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def exact_mean(value: Column | str, digits: int = 6) -> Column:
    """Mean to so many digits whatever the order of the rows: summed as integers of 10^-(digits + 3), halves away from zero."""
    units = F.round(_c(value) * 10.0 ** (digits + 3)).cast("long")
    return F.round(F.sum(units) / F.nullif(F.count(_c(value)) * F.lit(1000.0), F.lit(0.0))) / 10.0**digits


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share; 0 if none."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def overlap_area(a: str, b: str) -> Column:
    """Area that two boxes share; a and b are prefixes of columns x, y, w, h."""
    f = lambda p, n: F.col(f"{p}{n}")
    return span_overlap(f(a, "x"), f(a, "x") + f(a, "w"), f(b, "x"), f(b, "x") + f(b, "w")) * span_overlap(f(a, "y"), f(a, "y") + f(a, "h"), f(b, "y"), f(b, "y") + f(b, "h"))


def centre_inside(a: str, b: str) -> Column:
    """The centre of box a lies in box b."""
    f = lambda p, n: F.col(f"{p}{n}")
    return (f(a, "x") + f(a, "w") / 2).between(f(b, "x"), f(b, "x") + f(b, "w")) & (f(a, "y") + f(a, "h") / 2).between(f(b, "y"), f(b, "y") + f(b, "h"))


def sign_words(vector: Column | str) -> Column:
    """The signs of all elements of a vector in 64-bit words: bit k of word w is set if element 64 w + k is positive."""
    v = _c(vector)
    bit = lambda x, k: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.transform(F.slice(v, w * 64 + 1, F.lit(64)), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int")), word))


def words_distance(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two arrays of 64-bit words; null if they differ in length."""
    d = F.aggregate(F.zip_with(_c(a), _c(b), hamming), F.lit(0), lambda s, n: s + n)
    return F.when(F.size(_c(a)) == F.size(_c(b)), d)


def hex_hash(text: Column | str) -> Column:
    """The bits of a hash of up to 16 hexadecimal digits as a (signed) bigint; null for other text."""
    t = F.lpad(F.lower(_c(text)), 16, "0")
    half = lambda k: F.conv(F.substring(t, k, 8), 16, 10).cast("long")
    return F.when(_c(text).rlike("^[0-9a-fA-F]{1,16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two bigint hashes."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def mean_abs_error(a: Column | str, b: Column | str, scale: float = 1.0) -> Column:
    """Mean absolute difference of two arrays over scale; null if they are empty or differ in length."""
    d = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(_c(a)) == F.size(_c(b))) & (F.size(_c(a)) > 0), d / F.size(_c(a)) / scale)


def dot(a: Column | str, b: Column | str) -> Column:
    """Scalar product of two arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Normalised cross-correlation of two arrays of one length; null for constant or empty ones."""
    n = F.size(_c(a))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    cov = dot(a, b) - total(_c(a)) * total(_c(b)) / n
    va, vb = dot(a, a) - total(_c(a)) * total(_c(a)) / n, dot(b, b) - total(_c(b)) * total(_c(b)) / n
    return F.when((n == F.size(_c(b))) & (n > 0) & (va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb))


def cell_mask(dots: Column | str) -> Column:
    """Raised dots 1..8 packed in an integer, dot 1 lowest; repeated dots count once."""
    return F.aggregate(F.array_distinct(_c(dots)), F.lit(0), lambda a, d: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), (d - 1).cast("int"))))


def wav_millis(data_bytes: Column, rate: Column, channels: Column) -> Column:
    """Duration of 16-bit audio in milliseconds."""
    return F.round(data_bytes / (2 * channels) / rate * 1000).cast("long")


def cadence_step(fps: Column | str, millis: Column | str) -> Column:
    """Frames between two samples, at least 1; halves round to even."""
    return F.greatest(F.bround(_c(fps) * _c(millis) / 1000).cast("int"), F.lit(1))


def text_key(text: Column | str, digits: int = 16) -> Column:
    """The first hexadecimal digits of a text's SHA-256."""
    return F.substring(F.sha2(_c(text), 256), 1, digits)


def joined_digest(*parts: Column | str, digits: int = 64) -> Column:
    """SHA-256 over parts joined by NUL; null if a part is null."""
    return F.substring(F.sha2(F.concat(*[x for p in parts for x in (F.char(F.lit(0)), _c(p).cast("string"))][1:]), 256), 1, digits)


def page_key(session: Column | str, sequence: Column | str, side: Column | str) -> Column:
    """pg-, 12 digits of the session's digest, the eight-digit sequence and the side."""
    return F.concat_ws("-", F.lit("pg"), text_key(session, 12), F.lpad(_c(sequence).cast("string"), 8, "0"), _c(side))


@F.pandas_udf(T.StringType())
def canonical_digest_udf(documents: pd.Series) -> pd.Series:
    """SHA-256 of JSON text in canonical form: keys sorted, no blanks, ASCII-escaped; null for text that is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            return None
        return None if text is None else hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()

    return documents.map(one, na_action=None)


def age_class(seen: Column, now: Column, stale_s: float = 45, offline_s: float = 120) -> Column:
    """online, stale or offline by the seconds since something was seen; null counts as offline."""
    age = (F.unix_micros(now) - F.unix_micros(seen)) / 1e6
    return F.when(seen.isNull() | (age > offline_s), "offline").when(age > stale_s, "stale").otherwise("online")


def retry_delay(attempts: Column | str, initial: float, longest: float, server_after: Column | None = None) -> Column:
    """Seconds until the next try: doubling from initial up to longest, not before what the server asks for."""
    wait = F.least(F.lit(longest), F.lit(initial) * F.pow(F.lit(2.0), F.greatest(_c(attempts) - 1, F.lit(0))))
    return F.greatest(wait, server_after) if server_after is not None else wait


def jittered(base: Column | str, jitter: float, u: Column | str) -> Column:
    """base spread by +-jitter with u in 0..1."""
    return _c(base) * (1 + (2 * _c(u) - 1) * jitter)


def first_failing(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that does not hold (a null does not), or null."""
    out = None
    for name, ok in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def image_status(width: Column, height: Column, mode: Column, blur: Column, least: int = 1800, better: int = 2800, aspect: tuple[float, float] = (0.68, 0.82), sharp: float = 25.0) -> Column:
    """REJECTED without size, LOW_QUALITY below the least long edge, PASS_WITH_CORRECTION with any remark, else PASS."""
    edge = F.greatest(width, height)
    remark = (edge < better) | ~F.try_divide(width, height).between(*aspect) | ~mode.isin("RGB", "RGBA", "L") | F.coalesce(blur < sharp, F.lit(False))
    return F.when((width <= 0) | (height <= 0), "REJECTED").when(edge < least, "LOW_QUALITY").when(remark, "PASS_WITH_CORRECTION").otherwise("PASS")


def region_domain(label: Column, w_share: Column, h_share: Column) -> Column:
    """struct<domain, content_type> of a layout region; a table that is tall or large is a boxed problem."""
    raw = F.lower(F.trim(label))
    pair = lambda d, c: F.struct(F.lit(d).alias("domain"), F.lit(c).alias("content_type"))
    return (
        F.when((raw == "table") & ((h_share >= 0.12) | (w_share * h_share >= 0.08)), pair("PROBLEM_BOX_CANDIDATE", "UNKNOWN"))
        .when(raw == "table", pair("TABLE_CANDIDATE", "TABLE"))
        .when(raw.isin("image", "figure", "chart", "graph"), pair("GRAPH_OR_DIAGRAM_CANDIDATE", "UNSUPPORTED_VISUAL"))
        .when(raw.isin("figure_title", "table_title"), pair("VISUAL_OR_PROBLEM_CAPTION_CANDIDATE", "UNKNOWN"))
        .when(raw.isin("formula", "equation"), pair("DISPLAY_FORMULA_CANDIDATE", "MATH"))
        .when(raw.isin("text", "paragraph_title", "title", "header", "footer", "number"), pair("TEXT_LAYOUT_CANDIDATE", "UNKNOWN"))
        .otherwise(pair("UNKNOWN_STRUCTURE_CANDIDATE", "UNKNOWN"))
    )


def side_faults(side: Column, x: Column, y: Column, w: Column, h: Column, area_share: Column, frame_w: float, frame_h: float, luminance_range: Column | None = None, margin: int = 2) -> Column:
    """array<string>: why a page side cannot stand for a fixed layout; empty if nothing speaks against it.

    Fixed values: shares of the frame 0.20 to 0.44 in area, 0.28 in width, 0.70 in
    height; a range of brightness of 35.  A side without a box is not found.
    """
    touches = F.when(side == "left", x <= margin).otherwise(x + w - 1 >= frame_w - 1 - margin) | (y + h - 1 >= frame_h - 1 - margin)
    rest = F.array_compact(F.array(
        F.when(touches, "OUT_OF_FRAME"), F.when(h / frame_h < 0.70, "PARTIAL_VERTICAL_EXTENT"), F.when(w / frame_w < 0.28, "NARROW_PAGE_EXTENT"), F.when(~area_share.between(0.20, 0.44), "PAGE_AREA_OUTLIER"),
        F.when(luminance_range > 35.0, "UNEVEN_ILLUMINATION") if luminance_range is not None else F.lit(None).cast("string"),
    ))
    return F.when(x.isNull() | y.isNull() | w.isNull() | h.isNull(), F.array(F.lit("PAGE_NOT_FOUND"))).otherwise(rest)
