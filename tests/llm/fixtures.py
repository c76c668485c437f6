"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns with clashing names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, n int, cluster string"


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (1, 3, 4, 5, 6, 30, 60, 200)]
    found = [None, "", "   \n\t ", *base, *base[3:6], base[6].upper(), base[7] + " tail", base[7].replace(" ", "\n", 20)]
    found += [" ".join(base[7].split()[:-k]) for k in (5, 30, 60)]
    found += ["été à la plage ñandú ß Ω 日本語 😀 \x00\x01", words(rng, 20_000), "x" * 5000, "!!! ... ???", "a\u00a0b\u2003c\x85d\x1ce", "▁ mark ▁▁ x", "don't we've I'LL, end."]
    return found


def documents(spark, rows=None):
    rows = list(enumerate(texts())) + [(3, texts()[3]), (None, texts()[8]), (None, None)] if rows is None else rows
    return spark.createDataFrame([(i, t, None if t is None else "en", "s", None, "own", None, 7, "c") for i, t in rows], DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
