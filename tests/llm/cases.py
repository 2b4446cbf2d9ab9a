"""Rows that every operator must stand, and brute-force versions."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, row string, position int, kept int, spans string, ids int, n long"
_LONG = " ".join(f"w{i % 977} q{i}" for i in range(20_000))
TEXTS = [
    (1, "The cat sat on the mat today."), (1, "The cat sat on the mat today."), (2, None), (3, ""), (None, "no id here"), (None, None), (4, " \n\t"),
    (5, _LONG), (6, "The cat  sat on the\nmat today."), (7, "x"), (8, "é日本 😀 mail a.b@c.org 4111 1111 1111 1111"), (9, _LONG + " end"),
]


def edge(spark):
    rows = [(i, t, None, f"s{n % 3}" if n % 4 else None, None, None, "a", None, 1, None, "b", 3, n) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_components(rows):
    """Component of each id, ids being unique."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists, common = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    for members in lists.values():
        for pair in combinations(members, 2):
            common[pair] += 1
    for (a, b), k in common.items():
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def keepers(rows):
    """Of equal texts the longest original, then the smallest id."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append((-len(t or ""), i))
    return {k: min(v)[1] for k, v in groups.items()}, {k: len(v) for k, v in groups.items()}
