import unicodedata

import numpy as np
import pytest

from quirework.llm import languages as L

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/lang_samples.parquet").orderBy("sample_id").select("lang", "text").collect()]


@pytest.fixture(scope="module")
def models(samples):
    return L.train(samples)


def test_held_out_accuracy(samples):
    by = {}
    for l, t in samples:
        by.setdefault(l, []).append(t)
    train = [(l, t) for l, ts in by.items() for k, t in enumerate(ts) if k % 4]
    test = [(l, t) for l, ts in by.items() for k, t in enumerate(ts) if k % 4 == 0]
    m = L.train(train)
    scores, _ = L.score_texts(m, [t for _, t in test])
    assert np.mean([m.languages[k] == l for k, (l, _) in zip(scores.argmin(1), test)]) >= 0.95


def test_probabilities_sum_to_one(models):
    """Over the whole alphabet, the end sign and one unseen sign, after a known and an unknown beginning."""
    grams = len(models.keys[0])
    for begin in ("", "d", "qx", "th"):
        alphabet = set()
        for word in ("der", "the", "한국어", "año", "être"):
            alphabet |= set(word)
        # Word bits are the sum over their signs, so the last sign's probability is a difference of two sums.
        c = [chr(x) for x in range(1, 0x200)] + [chr(x) for x in range(0x3040, 0x3060)] + [chr(x) for x in range(0xAC00, 0xAC40)]
        codes, lengths = L._word_codes([begin + x for x in c])
        del codes, lengths
        p = _last(models, begin, c)
        assert p.sum(0).max() <= 1.0 + 1e-3 + len(c) * models.uniform * 1.0
        assert (p > 0).all()
    assert grams > 500


def _last(models, begin, c):
    """P(sign | begin) for each sign: from scores of begin + sign without its end, by scoring both with a sign that nothing follows."""
    whole = L.score_words(models, [begin + x for x in c])
    ends = np.zeros_like(whole)
    for k, x in enumerate(c):
        ends[k] = _end_bits(models, begin + x)
    head = _head_bits(models, begin)
    return np.exp2(-(whole - ends - head))


def _signs(models, word):
    """Bits of each sign of a framed word, by the definition, one by one."""
    framed = chr(2) + word + chr(3)
    out = []
    for i in range(1, len(framed)):
        p = np.full(len(models.languages), models.uniform, np.float64) * models.start
        for n in range(models.order):
            if i - n < 0:
                break
            gram = framed[i - n : i + 1]
            if n:
                k = L._keys([gram[:-1]])[0]
                at = np.searchsorted(models.keys[n - 1], k)
                if at == len(models.keys[n - 1]) or models.keys[n - 1][at] != k:
                    break
                p = p * models.back[n - 1][at]
            k = L._keys([gram])[0]
            at = np.searchsorted(models.keys[n], k)
            if at < len(models.keys[n]) and models.keys[n][at] == k:
                p = p + models.gain[n][at]
        out.append(-np.log2(np.maximum(p, 1e-12)))
    return out


def _end_bits(models, word):
    return _signs(models, word)[-1]


def _head_bits(models, word):
    return sum(_signs(models, word)[:-1]) if word else np.zeros(len(models.languages))


def test_vectorised_scores_match_the_definition(models):
    words = ["a", "straße", "the", "qué", "한국어를", "漢字かな", "zzzzzz", "l’équation"]
    got = L.score_words(models, words)
    assert np.allclose(got, [sum(_signs(models, w)) for w in words], rtol=1e-4)


def test_sentences():
    cut = lambda t: [t[a:b].strip() for a, b in L.sentences(t)]
    assert cut("One. Two 3.5 is\nmore! “Three?” four\n\nFive。六！七") == ["One.", "Two 3.5 is\nmore!", "“Three?”", "four", "Five。", "六！", "七"]
    assert cut("") == cut(" \n\n ") == []
    assert cut("Así es.点検用紙。(Ja.)가나다. a.b stays") == ["Así es.", "点検用紙。", "(Ja.)", "가나다.", "a.b stays"]
    assert cut(L.plain_text("呢？Il y a.")) == ["呢?", "il y a."]


def test_named():
    assert L.named_languages("en-US") == L.named_languages(" ENG ") == L.named_languages("English") == ["en"]
    assert L.named_languages("de; français") == ["de", "fr"]
    assert L.named_languages(None) == L.named_languages(" ") == L.named_languages("und") == L.named_languages("unknown") == []


def rows_of(spark, models, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as segment", "true as whole")
    return L.segment_languages(df, models, label="lang")


def test_documents(spark, models):
    ko, en, es = "제목 상자는 7번째 시도에서 복구되었고 미리보기 화면은 보내졌다.", "The left page contains 349 entries, while the number line contains only 7.", "Se compara la tabla con el cursor en la edición impresa."
    docs = [
        (1, f"{ko} {en}", "ko"), (2, f"{en}\n\n{es}", None), (3, "S_9 = 7·75/6\nf(4) = 24.\n1 ① 2 ③ 3 ②.", "und"), (4, None, "en"), (5, "", "en"), (6, en.upper(), "Korean"), (7, unicodedata.normalize("NFD", ko), "en"),
        (8, "The left page contains ...", "ko"), (9, (ko + " ") * 3000, "kor"), (10, "​", None), (11, en, "English"), (11, en, "English"),
    ]
    seg = rows_of(spark, models, docs)
    got = {tuple(r) for r in L.unnamed_languages(seg).collect()}
    assert got == {(1, "en"), (2, "en"), (2, "es"), (6, "en"), (7, "ko")}
    main = {r["doc_id"]: r for r in L.document_languages(seg).collect()}
    assert main[9]["lang"] == "ko" and main[9]["confidence"] > 0.99 and main[2]["languages"] == ["en", "es"] and 3 not in main


def test_a_fragment_brings_no_language(spark, models):
    en = "The left page contains 349 entries, while the number line contains only 7. "
    seg = rows_of(spark, models, [(1, en * 3 + "\n\nde Skanolgar.", "en")])
    assert L.unnamed_languages(seg).count() == 0


def test_unknown_script_is_rejected(spark, models):
    seg = rows_of(spark, models, [(1, "Это предложение написано по русски и здесь неизвестно.", None)]).collect()
    assert [r["lang"] for r in seg] == [None]


def test_empty(spark, models):
    assert L.unnamed_languages(rows_of(spark, models, [])).count() == 0


FOREIGN = """Il gatto dorme sul divano mentre la bambina legge un libro.
La scuola si trova vicino alla piazza principale della città.
Non so perché il treno sia arrivato con due ore di ritardo.
El gat dorm al sofà mentre la nena llegeix un llibre.
Demà anirem al mercat per comprar pa i fruita.
L'escola es troba a prop de la plaça principal de la ciutat.
Aquesta pàgina conté una taula amb tots els resultats de l'exercici.
De kat slaapt op de bank terwijl het meisje een boek leest.
Morgen gaan we naar de markt om brood en fruit te kopen.
Katten sover på soffan medan flickan läser en bok.
Kot śpi na kanapie, a dziewczynka czyta książkę.
Jutro pójdziemy na targ, żeby kupić chleb i owoce.
Kedi kanepede uyurken kız kitap okuyor.
Kissa nukkuu sohvalla, kun tyttö lukee kirjaa.
Pisica doarme pe canapea în timp ce fetița citește o carte.
Con mèo ngủ trên ghế trong khi cô bé đọc sách."""


def test_languages_without_a_model_are_rejected(spark, models):
    """At least eight of ten sentences of Latin-script languages that have no model."""
    seg = rows_of(spark, models, [(k, t, None) for k, t in enumerate(FOREIGN.splitlines())]).collect()
    assert np.mean([r["lang"] is None for r in seg]) >= 0.8


def test_confidence_is_calibrated(samples):
    """Over held-out pieces of two to eight words, the mean confidence is near the share that is right."""
    by = {}
    for l, t in samples:
        by.setdefault(l, []).append(t)
    m = L.train([(l, t) for l, ts in by.items() for k, t in enumerate(ts) if k % 4])
    pieces = [(l, " ".join(w[a : a + n])) for l, ts in by.items() for k, t in enumerate(ts) if k % 4 == 0 for w in [t.split()] for n in (2, 4, 8) for a in range(0, max(1, len(w) - n + 1), n)]
    bits, signs = L.score_texts(m, [t for _, t in pieces])
    p, right = L.posterior(bits, m.temperature), np.array([m.languages.index(l) for l, _ in pieces])
    some = signs > 0
    assert abs(p.max(1)[some].mean() - (p.argmax(1) == right)[some].mean()) < 0.05


def test_a_bounded_fit_keeps_every_language(spark, samples):
    drawn = L.verified_sentences(spark.createDataFrame(samples, "lang string, text string"), max_rows=120)
    assert len({l for l, _ in drawn}) == 8 and len(drawn) <= 120
    assert L.verified_sentences(spark.createDataFrame([("xx", "ein Wort"), (None, "y"), ("yy", None)], "lang string, text string")) == [("xx", "ein Wort")]


@pytest.fixture(scope="module")
def adapted(spark, samples):
    return L.corpus_models(spark.createDataFrame(samples, "lang string, text string"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_corpus_models(spark, samples, models, adapted):
    scores, _ = L.score_texts(adapted, [t for _, t in samples])
    assert np.mean([adapted.languages[k] == l for k, (l, _) in zip(scores.argmin(1), samples)]) == 1.0
    assert len(adapted.keys[3]) > len(models.keys[3])
    df = spark.createDataFrame(samples, "lang string, text string")
    empty = L.corpus_models(df, spark.createDataFrame([], "doc_id long, text string"))
    assert np.allclose(L.score_words(empty, ["the", "der"]), L.score_words(models, ["the", "der"]))


def test_short_sentences_have_a_language(spark, adapted):
    """Length does not decide: a sentence of eight letters of known words is accepted."""
    got = rows_of(spark, adapted, [(1, "This is it.", None), (2, "x = 3.", None)]).orderBy("doc_id").collect()
    assert [r["lang"] for r in got] == ["en", None]


def test_foreign_sentences_are_rejected_by_corpus_models(spark, adapted):
    seg = rows_of(spark, adapted, [(k, t, None) for k, t in enumerate(FOREIGN.splitlines())]).collect()
    assert np.mean([r["lang"] is None for r in seg]) >= 0.8


def test_mixed_documents_with_known_segments(spark, samples, adapted):
    """Documents put together from sentences of two languages: nearly every segment has its language."""
    by = {}
    for l, t in samples:
        by.setdefault(l, []).append(t)
    docs, truth = [], []
    for k in range(64):
        a, b = [sorted(by)[(k + d) % 8] for d in (0, 1 + k % 7)]
        parts = [(a, by[a][k % 40]), (b, by[b][(k + 7) % 40]), (a, by[a][(k + 13) % 40])]
        docs.append((k, "\n\n".join(t for _, t in parts), None))
        truth.append([l for l, _ in parts])
    got = {}
    for r in rows_of(spark, adapted, docs).orderBy("doc_id", "segment").collect():
        got.setdefault(r["doc_id"], []).append((r["begin"], r["lang"]))
    right = sum({l for _, l in got[k]} - {None} == set(want) for k, want in enumerate(truth))
    assert right >= 61


def test_every_document_counts(spark, models):
    """Words of a language found in 12 of 4,500 documents are all learnt, and none of 4,488 sentences of one language is left out."""
    en, de = "The left page contains 349 entries, while the number line contains only 7 {}.", "Die linke Seite enthält mehrere Einträge, während die Zeile nur eine Zahl und das Wort {} enthält."
    made = lambda k: "".join("bdfgklmnpr"[int(x)] + "ö" for x in f"{k:04d}")
    docs = spark.createDataFrame([(k, de.format(made(k)) if k % 375 == 0 else en.format("entries")) for k in range(4500)], "doc_id long, text string").repartition(5)
    words = {(r["lang"], r["word"]): r["n"] for r in L.clear_words(docs, models).collect()}
    assert words["en", "contains"] == 2 * 4488 and words["de", "zeile"] == 12
    assert all(words["de", made(k)] == 1 for k in range(0, 4500, 375))
