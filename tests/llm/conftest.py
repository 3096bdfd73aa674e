import random

import pytest

WORDS = "the of and to in a is that for it as was on be ban can dog égal 漢字 x1 don't Zed it's re-do".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(",.!\n") if rng.random() < 0.1 else "") for _ in range(n))


def corpus():
    """Texts with copies, near copies, shared passages, repeated lines, and odd ones."""
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.choice([0, 1, 3, 8, 30, 90, 200]))) for k in range(60)]
    long = [t for _, t in rows if len(t.split()) > 80]
    passage = prose(rng, 70)
    for k in range(60, 75):
        rows.append((k, rng.choice(long)))
    for k in range(75, 90):
        words = rng.choice(long).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    for k in range(90, 100):
        rows.append((k, prose(rng, 20) + " " + passage + " " + prose(rng, 15)))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one line again\n" * 40), (104, "word " * 300), (105, "x" * 5000), (106, "😀" * 300), (107, passage), (108, None)]
    rows += [(109, "word " * 300), (110, "one line again\n" * 40)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus, with columns whose names the operators use themselves."""
    data = [(k, t, "en", f"s{k % 3}", len(t or ""), -1, "clash", True, [1], 5, 6, "ids") for k, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, doc string, hit_spans boolean, grams array<int>, _t int, _0 int, token_ids string"
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, and one id with repeated rows."""
    text = " ".join(f"w{k}" for k in range(80))
    return spark.createDataFrame([(None, text), (None, text), (7, text), (7, text), (9, text), (None, None)], "doc_id bigint, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
