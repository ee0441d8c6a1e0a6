"""Keys and CNPJs against plain Python, on more rows than a function that redoes its work for each digit gets through."""

import random
import time

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def check_digit(digits):
    dv = 11 - sum(d * (2 + (len(digits) - 1 - i) % 8) for i, d in enumerate(digits)) % 11
    return 0 if dv >= 10 else dv


def cnpj_valid(s):
    d = list(map(int, s))
    return len(d) == 14 and len(set(d)) > 1 and check_digit(d[:12]) == d[12] and check_digit(d[:13]) == d[13]


def key_valid(s):
    return len(s) == 44 and check_digit(list(map(int, s[:43]))) == int(s[43])


def made_key(rng, good):
    d = [rng.randrange(10) for _ in range(43)]
    return "".join(map(str, [*d, (check_digit(d) + (not good)) % 10]))


def repaired(s):
    canonical = lambda d: f"{d[:2]}.{d[2:5]}.{d[5:8]}/{d[8:12]}-{d[12:]}"
    if cnpj_valid(s) or len(s) != 14:
        return canonical(s) if len(s) == 14 else ""
    changes = (s[:i] + str(r) + s[i + 1 :] for i in range(14) for r in range(10))
    return next((canonical(x) for x in changes if cnpj_valid(x)), "")


def key_in_text(s):
    return next((x[p : p + 44] for x in (*s.split("\n"), s.replace("\n", "")) for p in range(len(x) - 43) if key_valid(x[p : p + 44])), "")


def results(spark, texts, f, limit):
    """What f makes of the texts, in one task and within the limit of seconds; some texts go before, so that code is compiled."""
    texts = [*texts[:50], *texts]
    df = lambda n: spark.createDataFrame(list(enumerate(texts[:n])), "i long, s string").coalesce(1)
    df(50).select(f(F.col("s")).alias("x")).collect()
    began = time.perf_counter()
    got = [r["x"] for r in df(len(texts)).select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]
    assert time.perf_counter() - began < limit
    return list(zip(texts, got, strict=True))


def test_cnpj_repair_of_many(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("0123456789") for _ in range(rng.choice([14, 14, 14, 13]))) for _ in range(6000)] + [c * 14 for c in "0123456789"] + ["1" * 13 + "0", "0" * 12 + "91"]
    for text, got in results(spark, texts, S.repaired_cnpj, 15):
        assert got == repaired(text)


def test_key_from_text_of_many(spark):
    rng = random.Random(3)
    texts = []
    for i in range(20000):
        key = made_key(rng, i % 3 > 0)
        cut = rng.randrange(44)
        texts.append([f"77{key}12\n3", key, f"{key[:cut]}\n{key[cut:]}", key[:-1], f"{made_key(rng, False)}\n\n{key}9"][i % 5])
    for text, got in results(spark, texts, S.key_from_text, 15):
        assert got == key_in_text(text)


def test_key_from_qr_of_many(spark):
    rng = random.Random(4)
    texts = []
    for i in range(30000):
        key = made_key(rng, i % 3 > 0)
        texts.append([f"https://x.gov.br/?a=b&P={key}%7C2", f"https://x.gov.br/?p=12&q={key}", key, f"x {key[:9]} {key[9:]}"][i % 4])
    for text, got in results(spark, texts, S.key_from_qr, 13):
        key = "".join(c for c in text.replace("%7C2", "").replace("p=12", "") if c.isdigit())
        assert got == (key if key_valid(key) else "")
