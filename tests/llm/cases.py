"""Awkward tables and plain-Python rules that the tests of this folder share."""

from __future__ import annotations

import random
import re
import zlib

CLASH = (
    "score size shard slot node start mark kept recipe chunks signature key tree block epoch words local vocab payload record_type item law "
    "weight vector leaf target taken skey held_out predicted n_tokens __index__"
).split()
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def documents(spark, rows):
    """(doc_id, text[, source]) rows as documents with many further columns."""
    data = []
    for doc_id, text, *rest in rows:
        data.append((doc_id, text, "en", rest[0] if rest else "a", len(text or ""), *("x" for _ in CLASH)))
    return spark.createDataFrame(data, FIELDS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ta", "re", "no", "is", "Ga", "é", "x1")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def messy():
    """Nulls, blanks, odd characters, ties, repeated rows, copies, near copies and a very long text."""
    base = prose(1, 400)
    near = base.split()
    near[200] = "other"
    rows = [
        (5, base), (3, base), (3, base), (9, base.replace(" ", "\n\t ")), (7, " ".join(near)), (8, base.upper()),
        (None, base), (None, None), (None, None), (11, None), (10, ""), (12, " \t\n"), (13, "one two"), (14, "one  two"), (15, "one"),
        (16, "a b c d e"), (17, "  x\x00y"), (18, "\U0001f600 ́e 漢字"), (2, "LOUD!! " * 300), (1, prose(2, 30_000)),
        (20, prose(3, 60)), (21, prose(4, 60)), (21, prose(5, 60)),
    ]
    return [(*r, (None, "b", "a", "é")[i % 4]) for i, r in enumerate(rows)]


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def crc(doc_id, m):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def rows(df, *names):
    names = names or df.columns
    return sorted(([r[n] for n in names] for r in df.collect()), key=repr)


def roots(nodes, links):
    """The least node that each one reaches."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
