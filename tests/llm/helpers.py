"""Small tables with nulls, empty and long texts, repeated rows and extra columns."""

import random

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, size STRING, h INT, score STRING"


def rows(n=60, seed=3):
    rnd = random.Random(seed)
    word = {"en": ["the", "thing", "and", "other", "with", "hand"], "de": ["der", "nicht", "über", "schön", "groß", "und"]}
    out = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        text = " ".join(rnd.choice(word[lang]) + rnd.choice(["", "", "a", "b", "c", "ing"]) for _ in range(rnd.randrange(1, 120)))
        out.append((i, text, lang, rnd.choice(["a", "b", "b", "b", None]), len(text), "x", 1, "s"))
    long = " ".join(rnd.choice(word["en"]) + str(rnd.randrange(50)) for _ in range(30_000))
    out += [(n, None, "en", "a", None, None, None, None), (n + 1, "", None, None, 0, "", 0, ""), (n + 2, " \t\n ", "en", "b", 4, "", 0, ""),
            (n + 3, long, "en", "b", len(long), "", 0, ""), (n + 4, out[5][1], "en", "b", out[5][4], "x", 1, "s"), out[7], out[7],
            (None, out[9][1], "en", "a", 5, "", 0, ""), (n + 5, "\x0b,;!\n\r\n", "en", "b", 4, "", 0, "")]
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
