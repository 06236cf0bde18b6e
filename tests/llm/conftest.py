import random

import pytest

from textveil.llm.common import words_of

WORDS = {
    "en": "the of and that with there shall water under house letter morning people".split(),
    "de": "der die und nicht über schön straße müssen haben werden zwischen größe".split(),
}


def prose(seed, n, lang="en"):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en", str(rng.randint(0, 99))]) for _ in range(n))


def shingle_set(text):
    w = words_of(text)
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(nodes, links):
    """Smallest node that each reaches."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case; ids are unique but for the last two rows."""
    base = prose(1, 60)
    words = base.split()
    near = " ".join([*words[:-1], "changed"])
    texts = [base, base, near, prose(2, 80, "de"), "", None, "one two", "   \n\t ", "!!! ???", prose(3, 4),
             base + "\n" + prose(4, 40), "é" * 300, "ab" * 200, prose(5, 3000),
             "<|endoftext|> it's we'll 'r  x\n\n y", "日本語 テキスト " * 20, base.upper(), "a b\x1cc",
             prose(6, 50) + " " + " ".join(words[10:35]) + " " + prose(7, 50)]
    found = [(i, t) for i, t in enumerate(texts)]
    return [*found, (None, "text without an id " + prose(8, 30)), (18, texts[18])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The same as a table with extra columns whose names operators use inside."""
    full = [(i, t, "en", t, 1, "x", None) for i, t in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, row string, node int, kept string, n_links int").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
