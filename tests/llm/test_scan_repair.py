import pytest

from quirework.llm import scan_repair as S

BODY = ["The operator checks the focus lamp and then corrects the lens cover.", "We can read the spoken formula aloud because the preview frame stays stable.", "여백이 안정되어 있으므로 책 이음선을 소리 내어 읽을 수 있다.", "단위원과 화면은 모두 확인되어야 한다. (low-contrast, step-by-step)"]
SCHEMA = "cid long, t string, page string"


def corpus():
    rows = [(k, f"{BODY[k % 4]}\n{BODY[(k + 1) % 4]} {k}", "p007") for k in range(60)]
    rows += [(100 + k, f"Unit {k} · Sums and Series ({k}~9)", "p007") for k in range(3)]
    rows += [(110, "1 ① 2 173 3 ③ 4 ①", "p007")]
    return rows


CASES = [
    (200, "Unit 2 Sums and Series 7\nThe operator checks the focus lamp and then corrects the lens cover.", {"header"}),
    (201, "The operator checks the fo-\ncus lamp and then corrects the lens cover.\n— 7 —", {"hyphen", "page_number"}),
    (202, "The 0perator checks the focus larnp and then corrects the lens cover.", {"misread"}),
    (203, "여백이 안정되어 있으므로 책 이응선을 소리 내어 읽을 수 있다.", {"misread"}),
    (204, "화면은 모두 확인되어야 한다. (low-contrast, step-\nby-step) 8", set()),
    (205, "The operator checks the fo¬\nSUMS AND SERIES\ncus lamp and then corrects the lens covcr.", {"header", "hyphen", "misread"}),
    (206, "(7)\nThe operator checks = 7 the focus lamp.\n= 7\n834", set()),
    (207, "Sums and Series", set()),
    (208, "«Sums and Series» The operator checks the focus\nlamp and then corrects the lens cover.", set()),
    (209, None, set()),
    (210, "", set()),
    (211, "7\n" + "The operator checks the focus lamp. " * 3000, {"page_number"}),
    (212, "The opеrator checks the focus lamp.", set()),  # a look-alike letter is no misreading
    (214, "The operator checks the facus lamp and then coerects the lens cover.", {"misread"}),
    (215, "The aperatar checks the focus lanp and then corrects the lens cover.", {"misread"}),
    (213, "We can read the spo-\nkcn formula aloud because the preview frame stays stable.", {"hyphen", "misread"}),
]


@pytest.fixture(scope="module")
def noise(spark):
    rows = corpus() + [(i, t, "p007") for i, t, _ in CASES]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as id", "1 as w", "'y' as canonical_text")
    return S.ScanNoise(df, "cid", "t", "page")


def test_kinds(noise):
    got = {}
    for r in noise.kinds().collect():
        got.setdefault(r["cid"], []).append(r["noise"])
    assert all(len(v) == len(set(v)) for v in got.values())
    for i, _, want in CASES:
        assert set(got.get(i, [])) == want, i
    assert not {i for i in got if i < 200}


def test_repaired(noise):
    got = {r["cid"]: r["repaired_text"] for r in noise.repaired().collect()}
    clean = BODY[0]
    assert got[200] == got[201] == got[202] == got[205] == got[214] == got[215] == clean
    assert got[203] == BODY[2] and got[213] == BODY[1]
    assert got[204] == "화면은 모두 확인되어야 한다. (low-contrast, step-by-step) 8"
    assert got[210] == "" and 209 not in got and len(got) == len(corpus()) + len(CASES) - 1


def test_distance():
    assert S.shape_distance("lamp", "larnp") == pytest.approx(0.4) and S.shape_distance("이음선", "이응선") == pytest.approx(0.4)
    assert S.shape_distance("에서", "위에서") > 0.9 and S.shape_distance("a", "a") == 0
    assert set(S.delete_keys("larnp")) & set(S.delete_keys("lamp"))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    n = S.ScanNoise(df, "cid", "t", "page")
    assert n.kinds().count() == 0 and n.repaired().count() == 0


def test_keys_reach_two_edits():
    assert set(S.delete_keys("aperatar", 2)) & set(S.delete_keys("operator", 2)) and not set(S.delete_keys("aperatar")) & set(S.delete_keys("operator"))


def test_ties_go_to_the_first_word(spark):
    """Two repairs of equal distance and frequency: the alphabetically first."""
    pairs = spark.createDataFrame([("w", 0.4, 100, "b"), ("w", 0.4, 100, "a"), ("w", 0.4, 90, "0"), ("w", 0.8, 900, "A")], "w string, distance double, nc long, c string")
    assert pairs.groupBy("w").agg(S.best_repair().alias("c")).first()["c"] == "a"


def test_unlisted_confusions(spark):
    """Words of the small corpus with one sign exchanged, lost or added at random, but for the listed pairs: at least nine of ten found, and few others touched."""
    import random

    rng = random.Random(11)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/paddleocr_split_ocr_reconciliation_summary_p102.parquet").select("combined_recognized_text").where("combined_recognized_text is not null").collect()]
    counts = {}
    for t in texts:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    rows, planted = [], set()
    for k, t in enumerate(texts):
        words = t.split(" ")
        at = [n for n, w in enumerate(words) if 0 < n < len(words) - 1 and w.isascii() and w.isalpha() and w.islower() and len(w) >= 5 and counts[w] >= 20]
        if at and k % 4 == 0:
            n = rng.choice(at)
            w = words[n]
            p = rng.randrange(1, len(w) - 1)
            sign = rng.choice([c for c in "abdefghjkmpqrstvwxyz" if c != w[p] and c not in S.shape_pairs().get(w[p], ())])
            words[n] = rng.choice([w[:p] + sign + w[p + 1 :], w[:p] + w[p + 1 :], w[:p] + sign + w[p:]])
            if words[n] not in counts:
                planted.add(k)
        rows.append((k, " ".join(words), "p1"))
    plain = {r[0] for r in S.ScanNoise(spark.createDataFrame([(k, t, "p1") for k, t in enumerate(texts)], SCHEMA), "cid", "t", "page").kinds().where("noise = 'misread'").collect()}
    got = {r[0] for r in S.ScanNoise(spark.createDataFrame(rows, SCHEMA), "cid", "t", "page").kinds().where("noise = 'misread'").collect()}
    clean = planted - plain
    recall, wrong = len(got & clean) / len(clean), len(got - planted - plain)
    assert recall >= 0.9 and wrong <= 0.05 * len(clean)
