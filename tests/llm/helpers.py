"""Brute-force versions and awkward inputs for the training-data operators."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema=DOC_SCHEMA):
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """Nulls everywhere, empty and blank texts, odd characters, repeats, a long text."""
    rows = [
        (0, None, "en", "a", None), (1, "", None, None, 0), (2, "  \n\t ", "en", "a", 5), (3, "word", "en", "b", 4), (4, "word", "en", "b", 4),
        (5, "ÄÖ 😀 \x1c \x85 été日本", "fr", None, 9), (6, "alpha beta gamma delta " * 3000, "en", "a", 72000), (7, "!!! ??? ...", None, "a", 11),
        (8, "mit license " * 50, "en", "a", 600), (None, "no id here at all", "en", "a", 17), (10, "0 1 2", "en", "c", 5),
    ]
    return documents(spark, rows)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def jaccard_links(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    where = defaultdict(list)
    for k in sorted(sets):
        for s in sets[k]:
            where[s].append(k)
    shared = Counter((a, b) for l in where.values() for i, a in enumerate(l) for b in l[i + 1 :])
    return [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)], sets
