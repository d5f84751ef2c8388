import random

import numpy as np

from quirework.llm import leaks
from quirework.llm.words import plain_words


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' as sig", "1 as passage")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["passages"] for r in leaks.leaked_passages(d, i, **options).collect()}


def brute(docs, items, n=12):
    grams = lambda t: {tuple(w[k : k + n]) for w in [plain_words(t)] for k in range(len(w) - n + 1)}
    d, i = {k: grams(t) for k, t in docs}, {k: grams(t) for k, t in items}
    return {(a, b): len(x & y) for a, x in d.items() for b, y in i.items() if x & y}


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [(k, " ".join(words(rng.choice([5, 11, 12, 13, 40, 90]), k))) for k in range(30)]
    items += [(100, items[5][1]), (101, None), (102, "")]
    docs = []
    for k in range(200):
        body = words(rng.choice([3, 12, 100, 400]), 1000 + k)
        src = items[rng.randrange(30)][1].split()
        take = rng.choice([5, 11, 12, 13, 30])
        at = rng.randrange(max(1, len(src) - take))
        cut = rng.randrange(len(body) + 1)
        docs.append((k, " ".join(body[:cut] + src[at : at + take] + body[cut:])))
    docs += [(500, docs[0][1]), (501, None), (502, "")]
    want = brute(docs, items)
    assert want and found(spark, docs, items) == want


def test_forms_do_not_matter(spark):
    item = "Später, bemalt Ｗiquilo jedes 44 Stück blau und nahe Ferasta bleiben genau 893"
    plain = item.replace("Ｗ", "W")
    import unicodedata

    docs = [(1, plain.upper()), (2, unicodedata.normalize("NFD", plain)), (3, plain.replace(" ", " \n​- ")), (4, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in plain)), (5, " ".join(plain.split()[:11]))]
    assert set(found(spark, docs, [(9, item)])) == {(k, 9) for k in (1, 2, 3, 4)}


def test_repeats_and_long_texts(spark):
    item = " ".join(words(30, 1))
    same = "ha " * 40
    docs = [(1, "x " * 50_000 + item + " y" * 50_000), (2, same), (3, "ha " * 11)]
    assert set(found(spark, docs, [(7, item), (8, same)])) == {(1, 7), (2, 8)}


def test_hot_item(spark):
    item = " ".join(words(20, 2))
    docs = [(k, f"{k} {item}" if k % 3 == 0 else f"clean text {k}") for k in range(1500)]
    assert len(found(spark, docs, [(1, item)])) == 500


def test_empty(spark):
    assert found(spark, [], [(1, "a " * 20)]) == {} and found(spark, [(1, "a " * 20)], []) == {}


def test_classes_follow_from_the_threshold():
    classes = leaks.size_classes(8, 1e-5)
    assert [u for u, _, _ in classes] == [8, 10, 12, 14, 16]
    for u, j, bands in classes:
        assert j == 8 / (u + 8) and (1 - j) ** bands <= 1e-5 < (1 - j) ** (bands - 1)


def test_every_run_lies_in_one_piece():
    for n in (11, 12, 13, 20, 27, 28, 29, 100):
        p = leaks.Pieces([words(3, 1), words(n, 2), []], 12)
        spans = [(w, w + k) for o, w, k in zip(p.owner, p.word, p.words) if o == 1]
        assert all(any(a <= k and k + 12 <= b for a, b in spans) for k in range(n - 11)) and set(p.owner) <= {1}
        assert all(8 <= s <= 16 for s in p.size[:1])


def test_minima_estimate_similarity():
    """Two pieces that share 8 of 24 shingles agree in about a third of the bands."""
    rng = random.Random(6)
    agree = []
    for k in range(200):
        a, b = words(20, rng.randrange(10**9)), words(20, rng.randrange(10**9))
        b[:12] = a[8:]
        pa, pb = leaks.Pieces([a], 12), leaks.Pieces([b], 12)
        agree += [pa.minima(r)[0] == pb.minima(r)[0] for r in range(29)]
    assert abs(np.mean(agree) - 1 / 3) < 0.03


def test_recall_of_shortest_leaks(spark):
    """Twelve words of a long item in a long document, at every alignment: all found."""
    item = words(60, 1)
    docs = [(k, " ".join(words(20 + k % 9, k) + item[k % 49 : k % 49 + 12] + words(25, 7000 + k))) for k in range(1500)]
    assert len(found(spark, docs, [(1, " ".join(item))])) == 1500
