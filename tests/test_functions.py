"""Functions against goldens and Python models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlake.functions import arrays, signal
from tokenlake.functions import text as tx


def values(df):
    return [tuple(r) for r in df.collect()]


def test_normalized_transcript():
    assert tx.normalized_transcript("أَهْلاً، إلى مدرسة!") == "اهلا الي مدرسه"
    assert tx.normalized_transcript("don't  stop|now") == "dont stop now"
    assert tx.normalized_transcript("آـب") == "اب"
    assert tx.normalized_transcript("") == ""


def test_speakable():
    assert tx.speakable("شنو؟ هنا،") == "شنو? هنا,"
    assert tx.speakable("a‏b  c") == "a b c"
    assert tx.speakable("é ـx") == "é x"
    assert tx.speakable("“q” ‘r’ – —") == "\"q\" 'r' - -"
    assert tx.speakable("بّ") == "ب" and tx.speakable("بّ", strip_marks=False) == "بّ"


def test_reject_reason_order(spark):
    rows = [(None, 60), ("  ", 60), ("hello", 60), ("كلمة 5", 60), ("كلمة ab", 60), ("كلمة", 49), ("كلمة", 101), ("كلمة", 50)]
    df = spark.createDataFrame(rows, "text string, n int").select("text", "n", tx.mapped_text("text").alias("m"))
    got = [r[0] for r in values(df.select(tx.reject_reason(F.col("text"), F.col("m"), F.col("n"), 100, reject_latin=True)))]
    assert got == ["null_text", "empty_text", "no_arabic_letters", "contains_digits", "latin_run", "too_short", "too_long", None]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edit_errors_equal_a_dynamic_program(spark):
    rng = random.Random(3)
    words = ["a", "bé", "c", "ده", "e", "ff"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(120)]
    got = values(spark.createDataFrame(rows, "r string, h string").select("r", "h", tx.word_errors(F.col("r"), F.col("h")), tx.char_errors(F.col("r"), F.col("h"))))
    for r, h, w, c in got:
        assert w == distance(r.split(), h.split()) and c == distance(r, h)


@pytest.mark.parametrize("raw, want", [("[1, 2]", [1, 2]), ("1,2 3", [1, 2, 3]), ("x", None), ("", None), ("[]", []), ("[1,", None), (None, None)])
def test_parsed_tokens(spark, raw, want):
    assert values(spark.createDataFrame([(raw,)], "r string").select(tx.parsed_tokens(F.col("r")))) == [(want,)]


def test_frames_and_buckets(spark):
    df = spark.createDataFrame([(16000,), (21920,), (8000,), (10,), (100,)], "n long")
    assert [r[0] for r in values(df.select(arrays.expected_frames(F.col("n"))))] == [50, 68, 25, 1, 1]
    df = spark.createDataFrame([(1.9,), (2.0,), (11.9,), (float("nan"),)], "d double")
    assert [r[0] for r in values(df.select(arrays.duration_bucket(F.col("d"))))] == [0, 1, 5, 5]


def test_array_functions(spark):
    one = spark.range(1)
    ids = F.array(*[F.lit(x) for x in (105, 3, 101, 9, 102)])
    assert values(one.select(arrays.generated_codes(ids, 100, 9, 10)))[0][0] == [5, 1]
    assert values(one.select(arrays.assemble(F.array(F.lit(1)), F.array(F.lit(0), F.lit(7)), 100, 8, 9)))[0][0] == [1, 8, 100, 107, 9]
    assert values(one.select(arrays.fsq_digits(F.lit(65535), [8, 8, 8, 8, 16])))[0][0] == [7, 7, 7, 7, 15]
    assert len(values(one.select(arrays.pad_to_hop(F.array_repeat(F.lit(1.0), 321))))[0][0]) == 640
    assert len(values(one.select(arrays.pad_to_hop(F.array_repeat(F.lit(1.0), 320))))[0][0]) == 320
    assert values(one.select(arrays.peak_normalised(F.array(F.lit(2.0), F.lit(-4.0)))))[0][0] == [0.5, -1.0]
    back = values(one.select(arrays.int16_roundtrip(F.array(F.lit(0.5), F.lit(-1.0), F.lit(2.0)))))[0][0]
    assert np.allclose(back, [0.5, -1, 1], atol=1e-4)


def test_si_sdr(spark):
    rng = np.random.default_rng(0)
    x, n = rng.standard_normal(200), rng.standard_normal(200)
    rows = [(x.tolist(), (x + 0.1 * n).tolist()), (x.tolist(), (3 * x).tolist()), (x.tolist(), (3 * (x + 0.1 * n)).tolist()), ([0.0] * 5, [1.0] * 5)]
    got = [r[0] for r in values(spark.createDataFrame(rows, "r array<double>, e array<double>").select(arrays.si_sdr(F.col("r"), F.col("e"))))]
    assert 15 < got[0] < 25 and got[1] >= 99 and abs(got[0] - got[2]) < 1e-9 and got[3] is None


def test_resample_and_mel():
    t = np.arange(24000) / 24000
    tone = 0.3 * np.sin(2 * np.pi * 220 * t)
    down = signal.resampled(tone, 24000, 16000)
    assert len(down) == 16000
    want = 0.3 * np.sin(2 * np.pi * 220 * np.arange(16000) / 16000)
    assert np.abs(down[200:-200] - want[200:-200]).max() < 1e-3
    assert (signal.resampled(want, 16000, 16000) == want).all()
    rng = np.random.default_rng(0)
    noise = rng.standard_normal(16000)
    d = [signal.mel_distance(want, want + s * noise) for s in (0.0, 0.01, 0.1)]
    assert d[0] == 0 and d[0] < d[1] < d[2]
    with pytest.raises(ValueError):
        signal.mel_distance([], [1.0])
    with pytest.raises(ValueError):
        signal.resampled(np.zeros((2, 2)), 24000, 16000)
