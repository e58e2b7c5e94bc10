import random

import pytest

LANGS = {"en": "the of and to in is that with for was on are be by this from or an it as".split(), "de": "der die das und ist von zu mit den auf für im nicht eine als auch es an werden aus".split()}


def prose(rng, lang="en", n=60):
    syllables = {"en": ["th", "er", "ing", "on", "re", "st", "nd"], "de": ["ch", "ung", "ge", "ver", "sch", "en", "ü"]}[lang]
    return " ".join(rng.choice(LANGS[lang]) if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    out = []
    passage = prose(rng, n=55)
    for i in range(60):
        lang = rng.choice(["en", "de"])
        out.append((i, prose(rng, lang, rng.choice([5, 30, 60, 120])), lang, rng.choice(["a", "a", "b", "c", None]), 0))
    base = prose(rng, n=150).split()
    for i in range(60, 75):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(999))
        out.append((i, " ".join(w), "en", "a", 0))
    for i in range(75, 80):  # a passage in other contexts
        out.append((i, prose(rng, n=40) + " " + passage + "\n" + prose(rng, n=30), "en", "b", 0))
    out += [(80, out[3][1], "en", "c", 0), (81, None, "en", "a", 0), (82, "", None, "b", 0), (83, " \t\n ", "en", None, 0), (84, "same " * 100, "en", "a", 0), (None, "no id here at all", "en", "a", None)]
    out += [(85, prose(rng, n=6000), "en", "d", 0), out[10], out[10], (86, "one", "en", "a", 0), (87, "word with nbsp ÉCLAIR Ünder", "fr", "a", 0)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
