"""Problems 6, 8, 9 and 10 against libraries, brute force and exact round trips."""

import os
import random
import re

import numpy as np
import pytest

from spindrift.llm import bpe, encoding, leakage, repetition

HAVE = os.path.exists(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
DOCS = "doc_id long, text string, ids string, score int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], DOCS)


# problem 6

GOOD = ["Les élèves préfèrent l'été à la mer.", "Größe und Übung für Straßen", "“Quoted” – and … ‘more’ £5 ½ 20°C", "São João não é pão"]


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r"])
def test_utf8_shown_in_a_page_is_restored(page):
    for good in GOOD:
        raw = good.encode("utf-8")
        try:
            bad = raw.decode(page)
        except UnicodeDecodeError:
            bad = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in raw)
        assert encoding.repair(bad) == (good, True, False), (page, bad)


def test_cyrillic_is_restored():
    text = "Старый музей хранит книгу после дождя, а река защищает мост."
    for page in ("cp1252", "latin-1", "cp1251"):
        bad = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in text.encode("utf-8"))
        assert encoding.repair(bad) == (text, True, False), page
    assert encoding.repair(text.encode("cp1251").decode("latin-1"))[0] == text
    assert encoding.repair(text.encode("koi8_r").decode("cp1251"))[0] == text


def test_doubled_error():
    bad = "café – naïve".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(bad) == ("café – naïve", True, False)


def test_part_of_a_text():
    assert encoding.repair("crème brûlÃ©e, NÃO") == ("crème brûlée, NÃO", True, False)


@pytest.mark.parametrize("text", [*GOOD, "PROIBIDA A REPRODUÇÃO SEM AUTORIZAÇÃO. NÃO!", "ÂNGULO, Île, Ångholm, Æbelvik, Øskta, Ðela, BOÎTE", "Объём ещё не ясен: «СССР» № 5", "ВПЕРЁД! ТРЁХ", "plain", "", None, "two daggers † † and ?", "¿questions? ¡sí!", "Ελληνικά και λόγος", "日本の港 🚢"])
def test_rightly_decoded_text_stays(text):
    assert encoding.repair(text) == (text, False, False)


def test_lost_text_is_flagged():
    assert encoding.repair("na�ve") == ("na�ve", True, True)


def test_found_passages(spark):
    rows = [("a", 0, "cafÃ©", "b"), ("a", 0, "cafÃ©", "b"), ("a", 1, None, "b"), ("a", 2, "", None), ("b", 0, "x" * 200_000 + " Ã©", "b")]
    df = spark.createDataFrame(rows, "doc_id string, pos int, text string, garbled string")
    assert {(r["doc_id"], r["pos"]) for r in encoding.found(df).collect()} == {("a", 0), ("b", 0)}
    assert encoding.found(df.limit(0)).count() == 0


# problem 8

TEXTS = ["", None, " ", "Hello  world!\n\n\tx 12345", "<|endoftext|> is text", "naïve café 日本の港 🚢👩‍🔧 ﬁ", "a" * 5000 + "zq" * 300, "it's we'll I'D", "﻿ "]


@pytest.mark.skipif(not HAVE, reason="the tokenizer's files are not here")
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs(spark, TEXTS)).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert all(r["same"] for r in bpe.roundtrip(docs(spark, TEXTS)).collect())
    assert bpe.encode(docs(spark, TEXTS).limit(0)).count() == 0


@pytest.mark.skipif(not HAVE, reason="the tokenizer's files are not here")
def test_random_bytes_round_trip():
    rng = random.Random(1)
    e = bpe.BytePairEncoder.load()
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x4E00, 0x4F00)])) for _ in range(rng.randrange(40)))
        assert e.decode(e.encode(text)) == text


def test_merges_of_a_small_vocabulary():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258}
    e = bpe.BytePairEncoder(ranks)
    assert e.merge(b"ababa") == [257, 97]
    assert e.merge(b"bab") == [98, 256]


# problem 9

ITEM = "the old ferry leaves the northern harbour every morning while two patient pilots watch the grey tide and count small boats"


def brute(text, item):
    w, q = leakage.words(text), leakage.words(item)
    for o in range(-len(q) + 1, len(w)):
        m = [0 <= o + k < len(w) and w[o + k] == q[k] for k in range(len(q))]
        for i in range(len(m)):
            for j in range(i + leakage.MIN_WORDS, len(m) + 1):
                part = m[i:j]
                if part[0] and part[-1] and 6 * part.count(False) <= len(part) and all(a or b for a, b in zip(part, part[1:])):
                    return True
    return False


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    q = ITEM.split()
    texts = [None, "", ITEM.upper().replace(" ", " -- "), "x " + " ".join(q[3:18]) + " y", " ".join(q[:14]), " ".join(q[::-1])]
    for _ in range(150):
        a = rng.randrange(len(q) - 5)
        part = q[a : a + rng.randrange(8, 22)]
        for _ in range(rng.randrange(5)):
            part[rng.randrange(len(part))] = rng.choice(["zeal", *q])
        texts.append("before it " + " ".join(part) + " and after")
    bench = spark.createDataFrame([(7, ITEM, 0), (7, ITEM, 0), (8, "too short", 0), (9, None, 0)], "item_id long, text string, doc_id int")
    want = {(i, 7) for i, t in enumerate(texts) if t and brute(t, ITEM)}
    assert 20 < len(want) < len(texts)
    df = docs(spark, texts)
    assert {tuple(r) for r in leakage.found(df, bench).collect()} == want
    by = leakage.by_shuffle(df.select("doc_id", "text").filter("length(text) > 0"), bench.select("item_id", "text").filter("length(text) > 0").distinct())
    assert {(r["doc_id"], r["item_id"]) for r in by.filter(f"n_words >= {leakage.MIN_WORDS}").collect()} == want
    assert {tuple(r) for r in by.collect()} == {tuple(r) for r in leakage.leaks(df, bench).collect()}
    assert leakage.found(df, bench.limit(0)).count() == 0
    assert leakage.found(df.limit(0), bench).count() == 0


def test_common_seeds_lose_nothing(spark):
    head = "which of the following statements about the ferry is right"
    bench = spark.createDataFrame([(i, f"{head} one{i} two{i} three{i} four{i} five{i} six{i} seven{i}") for i in range(8)], "item_id long, text string")
    text = f"{head} one3 x three3 four3 y six3 seven3"  # only common seeds are whole
    assert [tuple(r) for r in leakage.found(docs(spark, [text]), bench).collect()] == [(0, 3)]


@pytest.mark.parametrize("runs", [(4, 4, 4, 3), (3, 4, 4, 4), (4, 4, 4, 4), (4, 4, 4, 4, 4)])
def test_stretches_without_a_run_of_five_are_found(spark, runs):
    size = sum(runs) + len(runs) - 1  # 18, 18, 19 and 24 words, of which 3 or 4 are replaced
    item = " ".join(f"q{k}" for k in range(size))
    at = set(np.cumsum([n + 1 for n in runs[:-1]]) - 1)
    text = "before it " + " ".join(f"zeal{k}" if k in at else f"q{k}" for k in range(size)) + " and after"
    assert brute(text, item)
    bench = spark.createDataFrame([(3, item)], "item_id long, text string")
    df = docs(spark, [text])
    assert [(r["doc_id"], r["item_id"], r["n_words"]) for r in leakage.leaks(df, bench).collect()] == [(0, 3, size)]
    assert [(r["doc_id"], r["item_id"], r["n_words"]) for r in leakage.by_shuffle(df.select("doc_id", "text"), bench).collect()] == [(0, 3, size)]


def test_smith_waterman():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 2, 8, 3, 4, 5])
    assert leakage.smith_waterman(a, a) == 5
    assert leakage.smith_waterman(a, b) == 3
    assert leakage.smith_waterman(a, np.array([], int)) == 0


# problem 10


def share(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    seen, rep = set(), [False] * len(w)
    for i in range(len(w) - 3):
        g = tuple(w[i : i + 4])
        if g in seen:
            rep[i : i + 4] = [True] * 4
        seen.add(g)
    return len(w), sum(rep) / len(w) if w else 0.0


def test_repetition_equals_the_rule(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice("tide ferry bread harbour old new slow warm lamp stone".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 12))) + "."
    texts = [None, "", "   ", "a b c d " * 4, "a b c d " * 5, "word " * 3000]
    for _ in range(300):
        pool = [line() for _ in range(rng.randrange(1, 12))]
        texts.append(rng.choice(["\n", " "]).join(rng.choice(pool) for _ in range(rng.randrange(1, 15))))
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in repetition.repetition(df).collect()}
    want = set()
    for i, t in enumerate(texts):
        n, s = share(t)
        assert got[i]["n_words"] == n
        assert got[i]["repeated_share"] == pytest.approx(s)
        if n >= 20 and s >= 0.4:
            want.add(i)
    assert {r["doc_id"] for r in repetition.found(df).collect()} == want
    assert repetition.found(df.limit(0)).count() == 0


def test_no_case_is_cleared_by_a_sure_field(spark, monkeypatch):
    emit = np.zeros((repetition.FEATURES, 2))
    emit[0, repetition.CONTENT] = 20.0  # sure that all is content, whatever the text
    monkeypatch.setattr(repetition, "fit_field", lambda texts: repetition.ChainField(emit))
    head = " ".join(f"h{k}" for k in range(20))
    long = " ".join(f"{head} {' '.join(f'w{i}x{k}' for k in range(28))}." for i in range(60))  # 59 of 60 sentences repeat 20 of 48 words
    fresh = " ".join(f"n{k}" + "." * (k % 9 == 0) for k in range(300))
    n, s = share(long)
    assert n == 2880 and 0.4 <= s < 0.42
    assert [r["doc_id"] for r in repetition.found(docs(spark, [fresh, long])).collect()] == [1]


def test_field_learns_and_decodes():
    rng = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(60):
        y = (rng.random(12) < 0.3).astype(int)
        x = np.zeros((12, repetition.FEATURES))
        x[:, 0], x[:, 1] = 1, np.where(y, 0.9, 0.05)
        xs.append(x)
        ys.append(y)
    field = repetition.ChainField().fit(xs, ys)
    assert np.mean([np.mean(field.viterbi(x) == y) for x, y in zip(xs, ys)]) > 0.97
    p, _, z = field.marginals(xs[0])
    assert np.allclose(p.sum(1), 1) and np.isfinite(z)


def test_edited_copies_are_leaks_by_their_alignment(spark):
    q = ITEM.split()
    inserted, left_out = [*q[:10], "very", *q[10:]], [*q[:8], *q[9:]]
    texts = [" ".join(inserted), " ".join(left_out), ITEM, "no leak at all in this text about other things and places of the day"]
    df = docs(spark, [f"Before it all. {t} And after." for t in texts])
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    want = {(0, len(q) - 2), (1, len(q) - 1 - 2), (2, len(q))}
    for got in (leakage.leaks(df, bench), leakage.by_shuffle(df.select("doc_id", "text"), bench)):
        assert {(r["doc_id"], r["score"]) for r in got.collect()} == want
    whole = {r["doc_id"]: r["n_words"] for r in leakage.leaks(df, bench).collect()}
    assert whole[2] == len(q) and max(whole[0], whole[1]) < leakage.MIN_WORDS
    assert [r["doc_id"] for r in leakage.found(df, bench).collect()] == [2]


def test_retention_follows_the_labels(spark):
    again = "Buy the best lamp here today and save now. "
    df = docs(spark, [again * 30, " ".join(f"Line {k} tells of place{k} and of thing{k} beside it." for k in range(30)), None])
    got = {r["doc_id"]: r for r in repetition.repetition(df).collect()}
    assert not got[0]["retained"] and got[1]["retained"] and got[2]["retained"]
    assert [r["doc_id"] for r in repetition.found(df).collect()] == [0]


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    f = repetition.ChainField(rng.normal(size=(repetition.FEATURES, 2)), rng.normal(size=(2, 2)))
    x = rng.normal(size=(6, repetition.FEATURES))
    e = x @ f.emit
    value = lambda y: sum(e[t, k] for t, k in enumerate(y)) + sum(f.move[a, b] for a, b in zip(y, y[1:]))
    best = max(([(n >> t) & 1 for t in range(6)] for n in range(64)), key=value)
    assert f.viterbi(x).tolist() == best
