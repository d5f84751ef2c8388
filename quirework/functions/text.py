"""Column functions over text: predicates, scores, splitting, labels.  All stay in the JVM unless the name says udf."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns and weights of the mathematical-text score.
RELATION = r"[A-Za-z0-9)\]}]\s*[=<>]|[≤≥≠≈]"
FUNCTION = r"(?i)\b[fgh]\s*\(|\b(?:sin|cos|tan|log|ln)\b"
FRACTION = r"(?:[0-9]+|[A-Za-z])\s*/\s*(?:[0-9]+|[A-Za-z])"
POWER = r"[A-Za-z0-9]\s*[\^_]\s*[A-Za-z0-9]"
ROOT_OR_SUM = r"[√∑∫∞π]"
MATH_SIGN = r"[=+*/^<>≤≥≠≈±√∑∫∞π-]"
OPTION_MARK = r"[①②③④⑤]|\([1-5]\)|\b[1-5][.)]"
NOISE_SIGN = r"[@#=<>+\-^_\[\](){}\\|0-9]"
CHOICE_MARK = "[①②③④⑤]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeezed(text: Column | str) -> Column:
    """Text with single blanks and none at its ends."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def bare(text: Column | str) -> Column:
    """Text in small letters without any white space; the form in which strings are compared."""
    return F.lower(F.regexp_replace(_c(text), r"\s+", ""))


def math_score(text: Column | str) -> Column:
    """Weighted evidence that a line is mathematics: relation 4, function 3, fraction 3, power 2, root 3, dense signs 2, short symbolic line 2; an answer list scores 0."""
    t = squeezed(text)
    signs, length = F.regexp_count(t, F.lit(MATH_SIGN)), F.char_length(t)
    hit = lambda pattern, weight: F.when(t.rlike(pattern), weight).otherwise(0)
    score = hit(RELATION, 4) + hit(FUNCTION, 3) + hit(FRACTION, 3) + hit(POWER, 2) + hit(ROOT_OR_SUM, 3)
    score += F.when((signs >= 2) & (signs >= 0.08 * length), 2).otherwise(0)
    score += F.when((length <= 45) & (signs >= 1) & (F.regexp_count(t, F.lit("[A-Za-z0-9]")) >= 2), 2).otherwise(0)
    return F.when((F.regexp_count(t, F.lit(OPTION_MARK)) >= 2) & (signs <= 1), 0).otherwise(score)


def math_kind(text: Column | str, threshold: int = 3) -> Column:
    """'display_or_expression' for a short candidate, 'inline_or_mixed' for other lines, null for null."""
    return F.when((math_score(text) >= threshold) & (F.char_length(squeezed(text)) <= 60), "display_or_expression").when(_c(text).isNotNull(), "inline_or_mixed")


def token_class(token: Column | str) -> Column:
    """TEXT with Hangul, MATH with signs, Latin letters or digits, OTHER otherwise."""
    t = _c(token)
    return F.when(t.rlike("[가-힣]"), "TEXT").when(t.rlike(r"[A-Za-z0-9=+*/^_<>≤≥≠≈±√∑∫∞π-]"), "MATH").otherwise("OTHER")


def symbol_noise(text: Column | str) -> Column:
    """Letters together with at least four signs or digits."""
    t = F.coalesce(_c(text), F.lit(""))
    return t.rlike(r"[A-Za-z가-힣]") & (F.regexp_count(t, F.lit(NOISE_SIGN)) >= 4)


def table_like(text: Column | str) -> Column:
    """At least six tokens of which 55 % are numbers or cell marks (@, O, X)."""
    tokens = F.filter(F.split(F.regexp_replace(F.coalesce(_c(text), F.lit("")), "@", " @ "), r"\s+"), lambda x: x != "")
    cells = F.size(F.filter(tokens, lambda x: x.rlike("[0-9]") | x.isin("@", "O", "X")))
    return (F.size(tokens) >= 6) & (cells >= 0.55 * F.size(tokens))


def choice_count(text: Column | str) -> Column:
    """Number of different choice marks."""
    return F.size(F.array_distinct(F.regexp_extract_all(_c(text), F.lit(f"({CHOICE_MARK})"), 1)))


def choices_missing(text: Column | str) -> Column:
    """More than one but fewer than five choice marks: a choice was probably lost."""
    return choice_count(text).between(2, 4)


def number_prefix(text: Column | str) -> Column:
    """A bare number before the text: perhaps a problem number that was drawn into it."""
    return F.ltrim(_c(text)).rlike(r"^[0-9]+\s")


def choice_options(text: Column | str) -> Column:
    """array<struct<label, text>> of the choices ①-⑤."""
    t, labels = _c(text), r"([①②③④⑤])\s*([^①②③④⑤]*)"
    return F.zip_with(F.regexp_extract_all(t, F.lit(labels), 1), F.regexp_extract_all(t, F.lit(labels), 2), lambda a, b: F.struct(a.alias("label"), F.trim(b).alias("text")))


def labelled_items(text: Column | str, marks: str) -> Column:
    """array<struct<label, text>> of items that begin with a mark matched by `marks` (a pattern without groups)."""
    t = _c(text)
    labels = F.regexp_extract_all(t, F.lit(f"({marks})"), 1)
    bodies = F.slice(F.split(t, marks), 2, F.greatest(F.size(labels), F.lit(1)))
    return F.zip_with(labels, bodies, lambda a, b: F.struct(a.alias("label"), F.trim(b).alias("text")))


def without_delimiters(text: Column | str) -> Column:
    """A formula without its $ or $$ marks."""
    t = F.trim(_c(text))
    return F.when(t.rlike(r"(?s)^\$\$.*\$\$$") & (F.char_length(t) >= 4), F.trim(F.regexp_replace(t, r"(?s)^\$\$(.*)\$\$$", "$1"))).when(
        t.rlike(r"(?s)^\$.*\$$") & (F.char_length(t) >= 2), F.trim(F.regexp_replace(t, r"(?s)^\$(.*)\$$", "$1"))
    ).otherwise(t)


def inline_math_spans(text: Column | str) -> Column:
    """array<struct<text, is_math>>: a text cut at $...$ and $$...$$; empty pieces are left out."""
    pattern = r"(?s)\$\$(.+?)\$\$|\$(.+?)\$"
    t = _c(text)
    plain = F.split(t, pattern)
    formulas = F.transform(F.regexp_extract_all(t, F.lit(r"(?s)(\$\$.+?\$\$|\$.+?\$)"), 1), lambda m: without_delimiters(m))
    both = F.zip_with(plain, formulas, lambda a, b: F.array(F.struct(a.alias("text"), F.lit(False).alias("is_math")), F.struct(b.alias("text"), F.lit(True).alias("is_math"))))
    return F.filter(F.flatten(both), lambda s: s["text"].isNotNull() & (s["text"] != ""))


def page_label(text: Column | str) -> Column:
    """A page number of 1 to 4 ASCII digits without leading zeros, 1..9999, as text; anything else is null."""
    digits = F.when(F.trim(_c(text)).rlike("^[0-9]{1,4}$"), F.regexp_replace(F.trim(_c(text)), "^0+", ""))
    return F.when(digits != "", digits)


def page_id_from_path(path: Column | str) -> Column:
    """'p' and three digits out of a file name with p1..p9999, else null."""
    n = F.regexp_extract(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"p([0-9]{1,4})", 1)
    return F.when(n != "", F.concat(F.lit("p"), F.when(F.char_length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)))


def page_key_parts(page_id: Column | str) -> Column:
    """struct<sequence, side> of a page key that ends with an eight-digit sequence and L or R; null for other keys."""
    p = _c(page_id)
    return F.when(p.rlike("-[0-9]{8}-[LR]$"), F.struct(F.regexp_extract(p, "-([0-9]{8})-[LR]$", 1).cast("int").alias("sequence"), F.regexp_extract(p, "-([LR])$", 1).alias("side")))


def consecutive(left: Column | str, right: Column | str) -> Column:
    """Both are page labels and differ by one; false if either is none."""
    a, b = page_label(left).cast("int"), page_label(right).cast("int")
    return F.coalesce(F.abs(a - b) == 1, F.lit(False))


def safe_int(value: Column | str) -> Column:
    """An integer out of text, null where it is none."""
    return F.when(F.trim(_c(value)).rlike("^[+-]?[0-9]{1,18}$"), F.trim(_c(value)).try_cast("long"))


# How signs, Greek letters, their names in LaTeX and Latin letters are read in Korean.
SIGN_READINGS = {"≤": " 작거나 같다 ", "≥": " 크거나 같다 ", "≠": " 같지 않다 ", "≈": " 거의 같다 ", "≡": " 항등적으로 같다 "}
COMMAND_READINGS = {"le": " 작거나 같다 ", "leq": " 작거나 같다 ", "ge": " 크거나 같다 ", "geq": " 크거나 같다 ", "ne": " 같지 않다 ", "neq": " 같지 않다 ", "infty": "무한대"}
GREEK_READINGS = {
    "alpha": ("α", "알파"), "beta": ("β", "베타"), "gamma": ("γ", "감마"), "Gamma": ("Γ", "감마"), "delta": ("δ", "델타"), "Delta": ("Δ", "델타"), "epsilon": ("ε", "엡실론"), "zeta": ("ζ", "제타"),
    "eta": ("η", "에타"), "theta": ("θ", "세타"), "Theta": ("Θ", "세타"), "iota": ("ι", "요타"), "kappa": ("κ", "카파"), "lambda": ("λ", "람다"), "Lambda": ("Λ", "람다"), "mu": ("μ", "뮤"), "nu": ("ν", "뉴"),
    "xi": ("ξ", "크시"), "pi": ("π", "파이"), "Pi": ("Π", "파이"), "rho": ("ρ", "로"), "sigma": ("σ", "시그마"), "Sigma": ("Σ", "시그마"), "tau": ("τ", "타우"), "phi": ("φ", "파이"), "Phi": ("Φ", "파이"),
    "chi": ("χ", "카이"), "psi": ("ψ", "프사이"), "Psi": ("Ψ", "프사이"), "omega": ("ω", "오메가"), "Omega": ("Ω", "오메가"),
}
LETTER_READINGS = {
    "a": "에이", "b": "비", "c": "씨", "d": "디", "e": "이", "f": "에프", "g": "지", "h": "에이치", "i": "아이", "j": "제이", "k": "케이", "l": "엘", "m": "엠",
    "n": "엔", "o": "오", "p": "피", "q": "큐", "r": "알", "s": "에스", "t": "티", "u": "유", "v": "브이", "w": "더블유", "x": "엑스", "y": "와이", "z": "제트",
}


def rewritten(text: Column | str, rules: list[tuple[str, str, str]]) -> Column:
    """struct<text, applied array<struct<rule, count>>>: ordered rules, each on the text the ones before it left."""
    t, counts = _c(text), []
    for name, pattern, replacement in rules:
        counts.append(F.struct(F.lit(name).alias("rule"), F.regexp_count(t, F.lit(pattern)).alias("count")))
        t = F.regexp_replace(t, pattern, replacement)
    return F.struct(t.alias("text"), F.filter(F.array(*counts), lambda c: c["count"] > 0).alias("applied"))


def _spread(text: Column, before: str, after: str, end: str = "") -> Column:
    """Products of two to four letters between the given surroundings, with blanks between the letters."""
    for n in (2, 3, 4):
        text = F.regexp_replace(text, before + "([A-Za-z])" * n + after, " ".join(f"${k + 1}" for k in range(n)) + end)
    return text


def read_aloud(text: Column | str) -> Column:
    """Text with signs, Greek letters, axes and single letters as words, for speech; blanks squeezed.

    Bars around a formula are read as its absolute value, products of letters between
    signs or digits letter by letter.  The text is cut once, and each piece is looked up.
    """
    t = _spread(_c(text), r"\| *", r" *\|", "의 절댓값")
    t = F.regexp_replace(t, r"\| *([0-9A-Za-z\p{IsGreek}^()*/+ -]{1,40}?) *\|", "$1의 절댓값")
    t = _spread(t, r"(?<=[0-9=+*/^(-])", r"(?=[0-9=+*/),^-]|$)")
    commands = COMMAND_READINGS | {name: reading for name, (_, reading) in GREEK_READINGS.items()}
    signs = SIGN_READINGS | {sign: reading for sign, reading in GREEK_READINGS.values()} | {"∞": "무한대"}
    words = {f"\\{name}": reading for name, reading in commands.items()} | signs | {c: r for x, r in LETTER_READINGS.items() for c in (x, x.upper())}
    one = "".join(signs)
    piece = rf"(?s)(\\(?:{'|'.join(commands)})\b|[{one}]|(?<![A-Za-z])[xXyY]\s*축|(?<![A-Za-z])[A-Za-z](?![A-Za-z])|[A-Za-z]+|[^\\A-Za-z{one}]+|.)"
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    read = lambda p: F.when(p.rlike(r"^[xX]\s*축$"), "엑스축").when(p.rlike(r"^[yY]\s*축$"), "와이축").otherwise(F.coalesce(F.try_element_at(known, p), p))
    return squeezed(F.array_join(F.transform(F.regexp_extract_all(t, F.lit(piece), 1), read), ""))


def formula_problems(latex: Column | str, longest: int = 300) -> Column:
    """array<struct<code, severity>>: all faults of a recognised formula; EMPTY stands alone."""
    t = F.coalesce(_c(latex), F.lit(""))
    fault = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    rest = F.array(
        F.when(t.rlike("[가-힣一-鿿]"), fault("UNEXPECTED_SCRIPT", "error")), F.when(t.rlike(r"(?s)(.{3,20}?)\1{4,}"), fault("REPETITION", "error")), F.when(F.char_length(t) > longest, fault("TOO_LONG", "warning"))
    )
    return F.when(F.trim(t) == "", F.array(fault("EMPTY", "warning"))).otherwise(F.array_compact(rest))


def hangul_parts(syllable: Column | str) -> Column:
    """struct<initial, vowel, final> numbers of a Hangul syllable; null for other characters."""
    code = F.ascii(_c(syllable)) - 0xAC00
    return F.when(code.between(0, 11171), F.struct((code / 588).cast("int").alias("initial"), ((code % 588) / 28).cast("int").alias("vowel"), (code % 28).alias("final")))


def with_particle(word: Column | str, after_final: str, after_vowel: str) -> Column:
    """A word with the particle that its last syllable asks for; digits and Latin letters by their Korean reading."""
    w = _c(word)
    last = F.substring(w, -1, 1)
    code = F.ascii(last) - 0xAC00
    closed = F.when(code.between(0, 11171), code % 28 != 0).otherwise(last.isin(list("013678lmnrLMNR")))
    return F.concat(w, F.when(closed, after_final).otherwise(after_vowel))


def joined_with_gaps(gap: Column | str, height: Column | str, ratio: float = 0.45) -> Column:
    """The blank that belongs before a token: one if its gap to the token before exceeds ratio times the median height."""
    return F.when(_c(gap) > ratio * _c(height), " ").otherwise("")
