"""The chances of words that training has not seen: by hand, and gibberish against real text."""

import random
import zlib

import numpy as np
import pytest

from quarryline.llm import lm

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def spelling(spark):
    words = [("tion",), ("ation",), ("é",), ("a",), ("the",), ("then",), ("there",)]
    return lm.spelling(spark.createDataFrame([*words, (lm.END,)], "word string").repartition(3))


def test_bytes_after_any_others_add_up_to_one(spelling):
    r = np.random.default_rng(1)
    for one, two in [(lm.STOP, lm.STOP), (110, lm.STOP), (110, 111), *r.integers(0, 257, (20, 2))]:
        assert abs(spelling.chance(np.arange(257), np.full(257, one), np.full(257, two)).sum() - 1) < 1e-9


def test_chance_of_a_word_by_hand(spelling):
    for word in (b"a", b"tion", "né".encode(), b"zzz"):
        p, one, two = 1.0, lm.STOP, lm.STOP
        for x in [*word[::-1], lm.STOP]:
            p *= spelling.chance(np.array([x]), np.array([one]), np.array([two]))[0]
            one, two = x, one
        unseen = np.full(lm.CLASSES, 40.0)
        want = np.log10((1 - lm.LISTED) * p / spelling.mass[lm.suffix_class(word)] + lm.LISTED / 40)
        assert abs(spelling.logs([word, b"x"], unseen)[0] - want) < 1e-9
    assert len(spelling.logs([], np.ones(lm.CLASSES))) == 0
    assert abs(spelling.mass.sum() + spelling.chance(np.array([lm.STOP]), np.array([lm.STOP]), np.array([lm.STOP]))[0] - 1) < 1e-9


def test_gibberish_ranks_below_real_text(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    ids = [i for i in range(10**7, 10**7 + 200) if zlib.crc32(str(i).encode()) % 7 == 2][:12]
    noise = spark.createDataFrame([(i, " ".join(word() for _ in range(80))) for i in ids], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = [x for x in lm.lm_scores(docs.unionByName(noise)).collect() if x.held_out]
    gibberish = [x.score / x.n_tokens for x in got if x.doc_id in ids]
    real = sorted(x.score / x.n_tokens for x in got if x.doc_id not in ids)
    assert len(gibberish) == 12 and max(gibberish) < real[len(real) // 20], (max(gibberish), real[:5])
    known = [x for x in got if x.n_known == x.n_tokens]
    assert np.mean([x.score / x.n_tokens for x in known]) > np.mean([x.base_score / x.n_tokens for x in known])
