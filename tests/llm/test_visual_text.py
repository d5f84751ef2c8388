import unicodedata

from quirework.llm import visual_text as v


def spark_canonical(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return {r[0]: r[1] for r in v.consistent_text(df, "i", "t").collect()}


def test_matches_single_value_rule(spark):
    texts = [
        None, "", "​⁠", "plain text\n둘째 줄", "Ｐａｇｅ　１２", "ȩ́ and ̧́e", "́ lone", "한각나", "각나", "Ѕtер 5∶ ѕum", "x² ≠ x2 ①", "sp­\noken sp­oken", "a b c　d",
        "q̣̇", "한글 ｶﾞ", "Å Å Å", "ё ё", "𝟏𝐀", "אַּ", "̈́", "word‍ " * 2000, "ᄀ", "ᅡᆨ", "ﬁ ligature Ⅳ ½", "👩‍👧 ️",
        "abc\u2028", "end\u0085", "\u09c7\u09be", "x\u09cb\u09bc", "a\u0301\u09c7\u0300", "가\u0301 각\u11a8", "\u0301\u200b\u0327", "a" * 30_000 + "\u0301", "a\u200b" * 5000, "e\n\u0301", "x\ud55c\u1161",
    ]
    got = spark_canonical(spark, texts)
    assert got == {i: v.canonical(t) for i, t in enumerate(texts)}
    assert got[0] is None and got[1] == "" and got[2] == ""
    assert got[4] == "Page 12" and got[9] == "Step 5: sum" and got[10] == "x² ≠ x2 ①"
    assert got[11] == "sp-\noken spoken" and got[15] == "Å Å Å"


def test_every_character(spark):
    chars = [chr(c) for c in range(0x20, 0x3100) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")] + [chr(c) for c in range(0xF900, 0xFFF0) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    texts = [f"x{c}y" for c in chars]
    got = spark_canonical(spark, texts)
    assert all(got[i] == v.canonical(t) for i, t in enumerate(texts))
    marked = [f"{c}\u0301\u0327" for c in chars[::3]]
    got = spark_canonical(spark, marked)
    assert all(got[i] == v.canonical(t) for i, t in enumerate(marked))


def test_stable_characters_are_their_own_form():
    import re

    pattern = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]}", v._OWN) + "]")
    stable = [chr(c) for c in range(0x11000) if not 0xD800 <= c <= 0xDFFF and pattern.match(chr(c))]
    assert len(stable) > 11_000
    assert all(v.canonical(c) == c for c in stable)


def test_idempotent():
    for t in ("Ｅｉｎｈｅｉｔ １", "а́", "한"):
        assert v.canonical(v.canonical(t)) == v.canonical(t)


def test_pairs(spark):
    rows = [(1, "s", "a b"), (2, "s", "а b"), (3, "s", "a b"), (4, "t", "а b"), (5, "s", "A b"), (6, None, "a b"), (7, "s", None), (8, "s", "a b"), (9, "s", "a  b"), (10, "u", "x²"), (11, "u", "x2")]
    df = spark.createDataFrame(rows, "id long, g string, t string").selectExpr("*", "'clash' as canonical_text", "1 as __v")
    got = {tuple(r) for r in v.look_alike_pairs(df, "id", "t", "g").collect()}
    assert got == {(1, 2), (2, 3), (1, 8), (3, 8), (2, 8)}


def test_hot_group_of_copies(spark):
    rows = [(i, "s", "same text") for i in range(3000)] + [(5000, "s", "ѕame text")]
    got = v.look_alike_pairs(spark.createDataFrame(rows, "id long, g string, t string"), "id", "t", "g")
    assert got.count() == 3000


def test_empty(spark):
    df = spark.createDataFrame([], "id long, g string, t string")
    assert v.look_alike_pairs(df, "id", "t", "g").count() == 0 and v.consistent_text(df, "id", "t").count() == 0


def test_letters_agree_with_the_public_list_of_confusables(spark):
    """Each letter and its look-alike have the same skeleton by Unicode's rules."""
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    pairs = [(a, b) for left, right in v.LOOKALIKES for a, b in zip(left, right, strict=True) if a.isalpha() and b.isalpha()]
    # The list draws the small palochka as i and has no Cyrillic Q.
    assert {(a, b) for a, b in pairs if checker.getSkeleton(a) != checker.getSkeleton(b)} == {("ӏ", "l"), ("Ԛ", "Q")}


def test_more_look_alikes():
    same = {"ıdea": "idea", "ﬁle": "file", "ﬃ": "ffi", "αβ": "aβ", "νρυ": "vpu", "ոսօ": "nuo", "ԁӏ": "dl", "ɑɡ": "ag", "ⅰⅼⅿ": "ilm", "Ⅻ": "XII", "ᎪᏴ": "AB", "ꓮꓐ": "AB"}
    for a, b in same.items():
        assert v.canonical(a) == v.canonical(b), a
    for a, b in {"①": "1", "x²": "x2", "A": "a", "ſ": "s", "β": "b", "ß": "B", "½": "1/2"}.items():
        assert v.canonical(a) != v.canonical(b), a


def test_classes(spark):
    rows = [(1, "s", "Step"), (2, "s", "Ѕtep"), (3, "s", "Ѕtep"), (4, "t", "Step"), (5, "s", "step"), (6, None, "Step"), (7, "s", None), (8, "s", ""), (9, "s", "​")]
    df = spark.createDataFrame(rows, "i long, g string, t string").selectExpr("*", "'x' as class_id", "1 as __n")
    got = {r["i"]: (r["class_id"], r["spelling_id"], r["spellings"]) for r in v.look_classes(df, "i", "t", "g").collect()}
    assert got == {1: (1, 1, 2), 2: (1, 2, 2), 3: (1, 2, 2), 4: (4, 4, 1), 5: (5, 5, 1), 8: (8, 8, 2), 9: (8, 9, 2)}
    hot = spark.createDataFrame([(k, "s", "Step" if k % 2 else "Ѕtep") for k in range(2000)], "i long, g string, t string")
    assert v.look_classes(hot, "i", "t", "g").count() == 2000
