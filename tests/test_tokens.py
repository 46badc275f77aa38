"""Byte and code-point tokenizers (NumPy over Arrow buffers) against Python's
own UTF-8 handling on random strings from every Unicode plane."""

import random

from lexiscope.functions import text as X
from lexiscope.functions import tokens as TK


def _random_text(rnd):
    ranges = [(0x20, 0x7E), (0xA0, 0x7FF), (0x800, 0xD7FF), (0xE000, 0xFFFD), (0x10000, 0x10FFFF)]
    out = []
    for _ in range(rnd.randint(0, 40)):
        a, b = rnd.choice(ranges)
        out.append(chr(rnd.randint(a, b)))
        if rnd.random() < 0.2:
            out.append(rnd.choice(" \t\n　\x85\xa0"))
    return "".join(out)


def test_tokenizers_match_python(spark):
    rnd = random.Random(4)
    texts = [_random_text(rnd) for _ in range(400)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    rows = df.select("t", TK.byte_tokens("t").alias("b"), TK.char_tokens("t").alias("c"),
                     TK.byte_tokens("t", special=False).alias("rb"),
                     TK.char_tokens("t", special=False).alias("rc"),
                     X.count_words("t").alias("w"), X.clean_text("t").alias("cl"),
                     TK.byte_decode(TK.byte_tokens("t")).alias("bd"),
                     TK.char_decode(TK.char_tokens("t")).alias("cd")).collect()
    for r in rows:
        t = r.t
        if t is None:
            assert r.b is None and r.c is None
            continue
        assert r.rb == list(t.encode("utf-8"))
        assert r.b == [x + 3 for x in t.encode("utf-8")] + [1]
        assert r.rc == [ord(ch) for ch in t]
        assert r.c == [0xE000] + [ord(ch) for ch in t] + [0xE001]
        assert r.w == len(t.split())
        assert r.cl == " ".join(t.split())
        assert r.bd == t
        # the character model's special code points are dropped when decoding
        assert r.cd == "".join(ch for ch in t if ord(ch) not in TK.CHAR_SPECIALS)
