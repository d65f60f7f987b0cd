import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

SYLLABLES = "an be cor du el fi gra ho in ja ko lu mé no ôp qui ra sto tu ve".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))).capitalize() if rng.random() < 0.1 else "".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def made_documents(seed=7):
    """Plain texts, exact and near copies, shared passages, runs of one word, and degenerate texts."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(30, 160)) for _ in range(14)]
    passage, run = words(rng, 60), ["la"] * 40
    texts = [" ".join(b) for b in base]
    for k in range(30):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            b[rng.randrange(len(b))] = "".join(words(rng, 2))
        texts.append(" ".join(b))
    for k in range(8):
        a, b = words(rng, rng.randint(0, 30)), words(rng, rng.randint(0, 30))
        cut = passage[rng.randint(0, 20):rng.randint(35, 60)]
        texts.append(" ".join(a) + "\n" + " ".join(cut) + "\t" + " ".join(b))
    texts += [" ".join(words(rng, 5) + run[:k] + words(rng, 6)) for k in (13, 14, 30, 40)]
    texts += ["", None, " \n\t ", "one", "one two", "One Two", "x" * 120, "é" * 60, "é" * 70, "a b " * 9, "<|endoftext|> a", " ".join(["q"] * 30),
              " ".join(words(rng, 9000)), "A, b! ## ** \n\nA, b! ## **\n" * 9]
    texts += texts[-5:]
    rng.shuffle(texts)
    return list(enumerate(texts, start=3))


@pytest.fixture(scope="session")
def made():
    return made_documents()


@pytest.fixture(scope="session")
def docs(spark, made):
    """The documents with columns of the names that operators use themselves."""
    df = spark.createDataFrame([(d, t, "en" if d % 3 else None, f"s{d % 2}") for d, t in made], "doc_id long, text string, lang string, source string")
    clash = ("doc", "tag", "n", "keys", "cuts", "token", "n_words", "items", "kept", "route", "kind", "prefix", "member_key", "component", "first", "words", "site", "path")
    return df.withColumns({c: F.lit("clash") for c in clash}).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")

