"""A small corpus with the hard cases: nulls, empty and long texts, ties, copies, near copies, shared passages."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, row long, node string, tag string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def rows(seed=3, n=60):
    rng = random.Random(seed)
    passage, line = sentence(rng, 60), "This line of a licence is in very many documents of the corpus."
    texts = [sentence(rng, rng.randint(30, 120)) + ".\n" + sentence(rng, 25) for _ in range(n)]
    for k in range(0, n, 3):  # a third share a passage and a line
        texts[k] += "\n" + line + "\n" + passage
    base = texts[1]
    texts += [base] * 8
    for k in range(25):  # near copies, some near the threshold
        words = base.split(" ")
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] += rng.choice(["x", "yz"])
        texts.append(" ".join(words))
    texts += [None, "", "   ", "\n\n", "one", "two words", "One", "a b c d e", "A B c d e", "é ñ ß " * 10, "long " + sentence(rng, 20000), "w" * 5000, line, line[:-1], line.replace("very", "vary")]
    return [(i, t) for i, t in enumerate(texts)]


def table(spark, given=None):
    found = rows() if given is None else given
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "n", "t") for i, t in found], SCHEMA).repartition(3)


def written(spark, path, given=None):
    """The same read from files."""
    table(spark, given).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))
