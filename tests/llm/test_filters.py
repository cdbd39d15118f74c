"""Languages, toxicity and decontamination."""

import math
import random
import zlib

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from docloom.llm import decontam, langid, toxicity
from docloom.llm.common import fold, hash_word_bytes, hashed_texts, words_of

TONGUES = {"aa": ["ka", "ko", "ku", "ki"], "bb": ["sel", "sil", "sol"], "cc": ["çé", "èr", "ño"]}


@pytest.fixture(scope="module")
def tongues(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        lang = r.choice(sorted(TONGUES))
        rows.append((i, prose(r, r.randint(3, 60), TONGUES[lang]), lang if r.random() < 0.9 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_languages_of_held_out_rows(tongues):
    got = langid.documents_languages(tongues).join(tongues.select("doc_id", "truth"), "doc_id")
    assert got.where("held_out").count() > 50
    assert got.where("lang_pred <> truth").count() == 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_ignores_what_it_may_not_see(tongues):
    mixed = tongues.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "wrong").otherwise(F.col("lang")))
    a, b = (sorted(langid.documents_languages(t).collect()) for t in (tongues, mixed))
    assert a == b


def test_languages_of_odd_rows(odd, odd_rows, none):
    got = langid.documents_languages(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[0] == by[1] == by[2] == ("und", 0.0) and by[8][0] == "en"
    assert langid.documents_languages(none).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("text is null or trim(text) = ''").count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.documents_languages(unlabelled).collect()} == {"und"}


def naive_counters(text):
    """The counters of a text's n-grams that begin with a letter and hold no two spaces, in whole numbers."""
    whole = "".join(c.lower() if c.isalpha() else " " for c in f" {text or ''} ")
    for n in (1, 2, 3):
        for i in range(len(whole) - n + 1):
            gram = whole[i : i + n]
            if gram[0] == " " or "  " in gram:
                continue
            g = 0
            for c in gram:
                g = (g * 0x01000193 + ord(c)) % 2**32
            h = (g + n) * 0x9E3779B1 % 2**32
            yield ((h ^ h >> 15) * 0x85EBCA77 % 2**32) >> 17


def test_languages_against_plain_bayes(spark):
    r = random.Random(12)
    tongue = lambda lang, n: prose(r, n, TONGUES[lang])
    rows = [(i, f"{tongue(x, 9)}, {i}! {tongue(y, r.randint(0, 3))}".title(), x if i % 7 else None) for i in range(120) for x, y in [r.choices(sorted(TONGUES), k=2)]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12, 7.", None), (903, "ka", None), (903, "ka", None), (None, "sel", None), (904, "q", None)]
    learned = [(t, x) for k, t, x in rows if x and t is not None and zlib.crc32(str(k).encode()) % 4 != 2]
    counts = {x: [0.5] * langid.BUCKETS for x in sorted(TONGUES)}
    for t, x in learned:
        for b in naive_counters(t):
            counts[x][b] += 1
    want = []
    for k, t, _ in rows:
        grams = list(naive_counters(t))
        logs = {x: math.log(sum(y == x for _, y in learned) / len(learned)) + sum(math.log(c[b] / sum(c)) for b in set(grams) for _ in range(grams.count(b))) for x, c in counts.items()}
        best = max(logs, key=lambda x: (logs[x], -ord(x[0])))
        want.append((str(k), best if grams else "und", 1 / sum(math.exp(v - logs[best]) for v in logs.values()) if grams else 0.0))
    got = sorted((str(x["doc_id"]), x["lang_pred"], x["score"]) for x in langid.documents_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=1e-4)


def test_a_dirty_column_of_languages(spark):
    r = random.Random(4)
    rows = [(i, prose(r, 20, TONGUES[x]), x) for i in range(60) for x in sorted(TONGUES)[:2]] + [(1000 + i, prose(r, 5), f"junk{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="more than 2 languages"):
        model = langid.fit(df, "text", "lang", "doc_id", most_languages=2)
    assert model.languages == ["aa", "bb"] and model.log_probs.shape == (2, langid.BUCKETS + 1)


def test_long_texts_are_scored_in_overlapping_pieces(monkeypatch):
    text = prose(random.Random(1), 3000)
    whole = [g for _, _, n, p in langid.segments([text]) for g in langid.gram_buckets(p, n)]
    model = langid.LanguageModel(["a", "b"], np.random.default_rng(0).normal(-9, 1e-3, (2, langid.BUCKETS + 1)).astype(np.float32), np.zeros(2))
    want = model.score([text, "short", None])
    for chunk in (1000, 997, len(text) + 1, len(text) + 2, len(text)):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        pieces = [langid.gram_buckets(p, n) for _, _, n, p in langid.segments([text])]
        for n in range(3):
            assert sorted(b for g in pieces if len(g) > n for b in g[n].tolist() if b >= 0) == sorted(b for b in whole[n].tolist() if b >= 0)
        got = model.score([text, "short", None])
        assert got[0] == want[0] and np.allclose(got[1], want[1], atol=1e-3)


BAD = ["vilan", "grobo", "nasty"]


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        words = prose(r, r.randint(20, 80)).split()
        y = i % 4 == 0
        if y:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice([r.choice(BAD), "zuk" + prose(r, 1)]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(y)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_rows(toxic):
    docs, labels = toxic
    got = toxicity.documents_toxicity(docs, labels).join(labels, "doc_id")
    assert got.where("held_out").count() > 100
    assert got.where("predicted <> toxic").count() == 0
    assert got.where("predicted <> cast(score >= 0.7 as int) or score < 0 or score > 1").count() == 0


def test_folding_finds_disguised_words(toxic):
    model = toxicity.fit_documents(*toxic)
    calm = "ba be bi bo da de di do fa fe fi fo ga ge gi go " * 2
    for word in ("VILAN", "v1l4n", "vіlаn", "vílàn", "ｖｉｌａｎ", "vilan,"):
        assert model.score(f"{calm} {word} and {word} and {word}") > 0.7
    assert model.score(calm) < 0.5


def test_copies_count_once_on_both_sides(spark):
    r = random.Random(5)
    fixed = [(prose(r, 30) + " you grobulon " + prose(r, 30), 1) for _ in range(100)]
    clean = [(prose(r, 60), 0) for _ in range(100)]
    angry, calm = (prose(r, 60).split() for _ in range(2))
    copies = [(" ".join(["zukzuk", *angry, prose(r, 1)]), 1) for _ in range(40)] + [(" ".join(["grobulon", *calm, prose(r, 1)]), 0) for _ in range(40)]
    rows = [(i, *x) for i, x in enumerate(fixed + clean + copies)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.fit(frame, frame)
    assert any(" grobulon ".startswith(p) for p in model.weights)
    assert not any(" zukzuk ".startswith(p) for p in model.weights)
    assert not any(f" {w} ".startswith(p) for p in model.weights for w in angry)


def test_exceptions_and_length():
    model = toxicity.ToxicityModel({" trash ": 5.0, " scu": 4.0}, ("trash can",), 2.0, -3.0)
    assert model.strength("the trash can") == 0 and model.strength("a trash, can") == 0 and model.strength("the trash cans") > 0
    assert model.strength("scum " + "word " * 1000) < model.strength("scum word")
    assert model.strength(None) == model.strength("") == 0


def naive_strength(model, text):
    """Pattern by pattern and phrase by phrase, with the text's folded words in a list."""
    words = fold(text or "").split()
    phrases = [fold(e).split() for e in model.exceptions]
    total = 0.0
    for i, w in enumerate(words):
        if any(words[j : j + len(e)] == e for e in phrases for j in range(max(0, i - len(e) + 1), i + 1)):
            continue
        total += sum(x for p, x in model.weights.items() if (w == p.strip() if p.endswith(" ") else w.startswith(p.strip())))
    return total / np.log2(2 + len(words))


def test_strength_against_a_naive_matcher(monkeypatch):
    r = random.Random(6)
    model = toxicity.ToxicityModel({" ba ": 2.0, " gogo": 1.5, " ti ": 0.5, " fefe ": 3.0}, ("ba ti", "go ba", "ti gogo re", "fefe fefe"))
    texts = [" ".join(r.choice(["ba", "go", "ti", "gogo", "gogori", "fefe", "re", "B4,", "1"]) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, ""]
    want = [naive_strength(model, t) for t in texts]
    assert np.allclose([model.strength(t) for t in texts], want) and sum(want) > 0
    for chunk in (1, 7, 50):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.allclose([model.strength(t) for t in texts], want)


def test_long_texts_are_matched_whole_and_in_linear_time():
    import time

    model = toxicity.ToxicityModel({" trash ": 5.0}, ("trash can",))
    for lead in range(toxicity.CHUNK - 8, toxicity.CHUNK + 2):
        assert model.strength("x" * lead + " trash can") == 0 and model.strength("x" * lead + " trash cans") > 0
    began = time.perf_counter()
    assert model.strength("trash can " * 100_000 + "trash") > 0
    assert time.perf_counter() - began < 5


def test_phrases_that_excuse_are_learned(spark):
    r = random.Random(7)
    rows = []
    for i in range(600):
        words = prose(r, 40).split()
        toxic = i % 3 == 0
        if toxic or i % 3 == 1:
            words[20:20] = ["trashy", prose(r, 1)] if toxic else ["trashy", "bucket"] if i % 2 else ["old", "trashy"]
        if not toxic and i % 25 == 2:
            words[5:5] = ["trashy", "bucket"]
        rows.append((i, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.fit(frame, frame)
    assert set(model.exceptions) == {"trashy bucket", "old trashy"}
    wrong = [i for i, t, y in rows if (model.score(t) >= 0.7) != y]
    assert not wrong


def test_left_out_patterns_are_told(toxic):
    docs, labels = toxic
    with pytest.warns(UserWarning, match="more than 2 patterns"):
        model = toxicity.fit(docs, labels, max_patterns=2)
    assert 0 < len(model.weights) <= 2


def test_toxicity_of_odd_rows(spark, odd, odd_rows, none, toxic):
    labels = spark.createDataFrame([(5, None, 1), (5, 1, 0), (None, 1, 1), (7, 1, None), (100, 1, 0), (101, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.documents_toxicity(odd, labels).count() == len(odd_rows)
    nothing = labels.limit(0)
    assert {r["score"] for r in toxicity.documents_toxicity(odd, nothing).collect()} == {0.0}
    assert toxicity.documents_toxicity(none, labels).count() == 0
    kept = toxicity.drop_toxic(odd, nothing)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)


def test_fold():
    assert fold("Ünïçødé 1D10T-Ѕсum") == "unicøde idiot scum"


# --- decontamination ---------------------------------------------------------------------------------


def brute(docs, items):
    out = []
    import hashlib

    for k, t in docs:
        w = words_of(t)
        hit, found = set(), set()
        for item, it in items:
            v = words_of(it)
            n = min(13, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == v[i : i + n]:
                        hit.update(range(a, a + n))
                        if item is not None:
                            found.add(str(item))
        out.append((str(k), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def rows_of(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


@pytest.fixture(scope="module")
def leaks():
    r = random.Random(8)
    items = [(i, prose(r, r.choice([1, 3, 12, 13, 14, 30]), ["ba", "be", "bo"])) for i in range(40)] + [(3, prose(r, 20)), (None, prose(r, 20)), (77, None), (78, ""), (79, "…"), (5, prose(r, 2))]
    docs = []
    for i in range(80):
        words = prose(r, r.randint(0, 60), ["ba", "be", "bo", "du"]).split()
        for _ in range(r.randint(0, 2)):
            part = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(part) - 13))
            words[len(words) // 2 : len(words) // 2] = [x.upper() if r.random() < 0.5 else x for x in part[a : a + r.choice([12, 13, 25])]]
        docs.append((i if i % 9 else None, ", ".join(words)))
    docs += [(200, None), (201, ""), docs[3], docs[3], (202, (items[5][1] + " ") * 300)]
    return docs, items


@pytest.mark.parametrize(("bits", "places"), [(1 << 28, 2000), (64, 3)])  # the second: nearly all alarms are false
def test_overlaps_against_brute_force(spark, leaks, bits, places, monkeypatch):
    docs, items = leaks
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    monkeypatch.setattr(decontam, "PLACES", places)
    assert rows_of(decontam.documents_overlaps(d, b)) == brute(docs, items)


def test_overlaps_of_odd_rows(spark, odd, odd_rows, none):
    items = spark.createDataFrame([(1, odd_rows[5][1]), (2, "é" * 500), (3, None)], "item_id long, text string")
    plain = [(k, t) for k, t, *_ in odd_rows if not t or len(t) < 10_000]
    small = odd.where("text is null or length(text) < 10000")
    assert rows_of(decontam.documents_overlaps(small, items)) == brute(plain, [(1, odd_rows[5][1]), (2, "é" * 500)])
    assert decontam.documents_overlaps(none, items).count() == 0
    assert decontam.documents_overlaps(odd, items.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    with pytest.raises(ValueError, match="already columns"):
        decontam.find_overlaps(odd, items)
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and 5 not in {r["doc_id"] for r in kept.where("text <> 'another text'").collect()}


def test_a_leak_in_a_long_document_goes(spark):
    r = random.Random(12)
    item, near, long_ = prose(r, 30).split(), prose(r, 5000).split(), prose(r, 5000).split()
    rows = [(1, " ".join([*long_[:2500], *item[5:18], *long_[2500:]])), (2, " ".join([*near[:2500], *item[5:17], *near[2500:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert not decontam.documents_overlaps(docs, items).where("contaminated").count()
    assert [x["doc_id"] for x in decontam.drop_contaminated(docs, items).collect()] == [2]


def test_words_in_pieces(monkeypatch):
    from docloom.llm import common

    text = prose(random.Random(0), 2000)
    want = hash_word_bytes(text.encode())[0].tolist()
    monkeypatch.setattr(common, "CHUNK", 500)
    got = [h.tolist() for _, _, h, _, _ in hashed_texts([text])]
    assert got == [want]
