"""Plain versions of the training-data operators, to test against."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_duplicates(texts: dict, percent: int = 85):
    sets, index, common = {i: shingle_set(t) for i, t in texts.items()}, defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for ids in index.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[min(a, b), max(a, b)] += 1
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    return sets, roots(sets, links)


def repeat_words(w):
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})


def docs(spark, rows, extra=True):
    """(doc_id, text[, source]) rows as a documents table, with columns whose names clash with results'."""
    rows = [(*r, None)[:3] for r in rows]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({"kept": F.lit("mine"), "size": F.lit(-1), "rep": F.lit("r"), "component": F.lit(0), "key": F.lit("k"), "__n": F.lit(5), "target": F.lit("t"), "id": F.lit("i")})
        df = df.select("*", F.lit("shout").alias("Text"), F.lit(-5).alias("DOC_ID"))
    return df
