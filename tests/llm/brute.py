"""Plain counterparts of the operators, and texts that are awkward."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def texts(seed=3, n=60):
    """Random texts with copies, near copies, shared passages, nulls and odd characters."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "the", "\x1c", "a\xa0b", "日本", "x|y"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    out = [None, "", " \n\t", "one", "two words", "One", "four little words here", "a b c d e", passage]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(n):
        kind = i % 5
        if kind == 0:
            out.append(" ".join(base))
        elif kind == 1:
            near = list(base)
            for _ in range(rng.randrange(1, 8)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append("  ".join(near))
        elif kind == 2:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) + "\n" + passage)
        else:
            out.append("\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 9))))
    out.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    return out


def documents(spark, rows=None, id_type="bigint"):
    """A documents table with extra columns whose names the operators use themselves."""
    rows = [(i, t) for i, t in enumerate(texts())] if rows is None else rows
    data = [(i, t, "en" if i and i % 2 else None, "s", len(t or ""), "x", 7, True) for i, t in rows]
    return spark.createDataFrame(
        data, f"doc_id {id_type}, text string, lang string, source string, n_chars bigint, shard string, key int, kept boolean"
    )


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near(rows):
    """doc_id -> (number of shingles, component)."""
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def repeats(rows, length=13):
    """doc_id -> (words, removed, kept words)."""
    cut = {i: words(t) for i, t in rows}
    owner = {}
    for i in sorted(cut):
        for k in range(len(cut[i]) - length + 1):
            owner.setdefault(tuple(cut[i][k : k + length]), i)
    out = {}
    for i, w in cut.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if owner[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out
