import random

import pytest

from offerlens.llm.common import discard

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, keep_id string, row string, term string"
WORDS = "the of and a in to is wave stone river light paper green seven house small quick over under through market winter morning idle".split()


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", str(draw.randrange(300)), ","]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, nulls, empty, odd and very long texts, ties and repeated rows."""
    draw = random.Random(5)
    texts = ["\n".join(" ".join(sentence(draw, draw.randrange(4, 14)) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(1, 8))) for _ in range(60)]
    texts += [texts[0]] * 25 + [texts[1].upper(), texts[1].lower(), texts[2] + " "]
    texts += [t.replace("stone", "rock", 1) for t in texts[:10]]
    texts += [None, "", " ", "\n\n", "one", "one two", "ﬀ \x85 x y\x1c z  <|endoftext|> \t\r\n end  ", "ÄÖ É ß İ ŉ " * 9, "word" * 30000, " ".join(sentence(draw, 12) for _ in range(2500))]
    texts += ["same words here again and again please now ok then " * 6, "# * $ % & | < > " * 20, "A\nA\nA\nB b\n \nB b"]
    out = [(i, t, None if i % 7 == 0 else "en", (None if i % 11 == 3 else f"s{i % 4 if i % 3 else 0}"), i, 1, "k", "r", "t") for i, t in enumerate(texts)]
    out += [(None, texts[3], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (5, texts[5], "en", "s1", 5, 1, "k", "r", "t"), (5, texts[5], "en", "s1", 5, 1, "k", "r", "t")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session", autouse=True)
def staged_tables_go(spark):
    yield
    discard(spark)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
