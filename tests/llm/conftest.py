import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality string, language string, pieces string"


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts of two made-up languages, with near copies, repeated passages, and every odd case."""
    rng = random.Random(7)
    vocabulary = {"xx": ["".join(rng.choice("aeioulmnr") for _ in range(rng.randint(2, 7))) for _ in range(300)], "yy": ["".join(rng.choice("bcdfgkpstzü") for _ in range(rng.randint(2, 7))) for _ in range(300)]}
    out = []
    for i in range(60):
        lang = "xx" if i % 2 else "yy"
        out.append((sentence(rng, vocabulary[lang], rng.randint(25, 90)), lang))
    passage = sentence(rng, vocabulary["xx"], 40)
    for i in range(5):
        out.append((f"{sentence(rng, vocabulary['xx'], 10)}\n{passage}\n{sentence(rng, vocabulary['xx'], 12)}", "xx"))
    for i in (1, 4, 7):
        words = out[i][0].split()
        out.append((" ".join(words[:-1] + ["changed"]), out[i][1]))
        out.append((out[i][0], out[i][1]))
    out += [(None, "xx"), ("", "yy"), ("   \t ", None), ("12 34 !!", "xx"), ("one", "xx"), ("é" * 120, "yy"), ("aa " * 400, "xx"), ("x" * 3000, "yy"), ("日本語 " * 40, None)]
    out.append((" ".join(sentence(rng, vocabulary["yy"], 200) for _ in range(40)), "yy"))
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    """With repeated rows and with columns whose names operators might use themselves."""
    rows = [(i, t, lang, "s", len(t or ""), "q", "l", "p") for i, (t, lang) in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[3]], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
