"""Divergence rules, Merkle manifests and hard negatives against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import cases
import numpy as np
import pytest

from ironlog.llm import divergence, hard_negatives, merkle

CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain_base(doc_id, text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {j for i, x in enumerate(windows) if many[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(w), len(covered)
    return [doc_id, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n]


def odd_texts():
    rng = random.Random(1)
    texts = ["a b c a b c", "x y z " * 40, "a\na\n a\n\n\n \na", "#|<>&%$* \t#", "one\x0btwo\x0cthree\r\nfour", "w " * 30_000, "é \U0001f600 \x00     z"]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 3, 4, 60, 300)]
    return [(100 + i, t) for i, t in enumerate(texts)]


def test_base_counts(spark):
    made = cases.messy() + odd_texts()
    got = divergence.quality_rules(cases.documents(spark, made))
    assert cases.rows(got, *CONTRACT) == sorted((plain_base(*r[:2]) for r in made), key=repr)
    assert all(r["kept"] is not None and not (r["kept"] and r["base_failed"]) for r in got.collect())


def corpus():
    """Prose in two languages, and junk that departs from it in characters or words."""
    rng = random.Random(3)
    common = {"en": ["the", "of", "and", "to"], "de": ["der", "und", "die", "von"]}
    docs, junk = [], set()
    for i in range(120):
        lang = ("en", "de")[i % 2]
        made = lambda: "".join(rng.choice(("ta", "re", "no", "is", "lu")) for _ in range(rng.randint(6, 8)))  # noqa: B023, E731
        words = [rng.choice(common[lang]) if rng.random() < 0.4 else made() for _ in range(rng.randint(80, 300))]
        if i % 12 == 5:
            words, junk = [w.upper() + "!!" for w in words], junk | {i}
        elif i % 12 == 8:
            words, junk = [made() + "$$" for _ in words], junk | {i}
        docs.append((i, " ".join(words), lang))
    return docs, junk


def plain_divergence(docs, i):
    """(classes, words) of document ``i``, from nothing but counters."""
    split = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]

    def kind(c):
        if c in " \t\n\x0b\x0c\r":
            return "space"
        if c.isalpha():
            return "upper" if c.isupper() else "lower"
        return "digit" if c.isdigit() else "symbol" if c in divergence.SYMBOLS else "punctuation" if c in divergence.PUNCTUATION else "other"

    def apart(p, q):
        js = 0.0
        for k in set(p) | set(q):
            x, y = p.get(k, 0), q.get(k, 0)
            js += sum(z / 2 * math.log2(2 * z / (x + y)) for z in (x, y) if z > 0)
        return js

    def shares(c):
        return {k: v / sum(c.values()) for k, v in c.items()}

    lang, text = docs[i][2], docs[i][1]
    same = [t for _, t, language in docs if language == lang]
    counts = [Counter(map(kind, t)) for t in same if not plain_base(0, t)[-1]]
    kinds = {k for c in counts for k in c}
    classes = shares(Counter({k: sorted(1000 * c[k] // sum(c.values()) for c in counts)[(len(counts) - 1) // 2] for k in kinds}))
    words = shares(Counter(w for t in same for w in split(t)))
    words = {w: s for w, s in words.items() if s >= divergence.COMMON_SHARE}
    of = Counter(w if w in words else None for w in split(text))
    words[None] = 1 - sum(words.values())
    return apart(shares(Counter(map(kind, text))), classes), apart(shares(of), words)


def test_divergence_finds_junk_and_leaves_prose(spark):
    docs, junk = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in divergence.quality_rules(df).collect()}
    assert {i for i, r in got.items() if not r["kept"]} == junk
    for i in (0, 1, 5, 8, 20, 33):
        classes, words = plain_divergence(docs, i)
        assert got[i]["classes_apart"] == pytest.approx(classes, abs=1e-8)
        assert got[i]["words_apart"] == pytest.approx(words, abs=1e-8)


def test_a_rare_language_has_no_word_reference(spark):
    docs, _ = corpus()
    rows = [*docs * 3, (900, "uno dos tres", "xx"), (901, " ".join(f"w{i}" for i in range(60)), None)]
    got = {r["doc_id"]: r for r in divergence.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900]["words_apart"] is None and got[901]["words_apart"] is None and got[901]["classes_apart"] > 0
    assert got[900]["base_failed"] and not got[901]["base_failed"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """doc_id -> (leaf, subroot, root, path) from (doc_id, text, lang, source, n_chars) rows; equal ids keep a list."""
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, over = [], []
            for a in range(0, len(nodes), 3):
                run = nodes[a : a + 3]
                for j in range(len(run)):
                    for i in groups[a + j]:
                        paths[i].append(run[:j] + run[j + 1 :])
                up.append(H(*run))
                over.append([i for g in groups[a : a + 3] for i in g])
            nodes, groups = up, over
        return nodes[0], paths

    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        by.setdefault(source, []).append((doc_id is not None, doc_id, H(*map(f, (doc_id, source, lang, n_chars, text)))))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in sources]
    root, tops = climb([t[0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for x, p in zip(sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2])), trees[k][1], strict=True):
            out.append([x[1], x[2], trees[k][0], root, H(*(h for level in p + tops[k] for h in level))])
    return sorted(out, key=repr)


def _fields(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


@pytest.mark.parametrize("climb", [6, 2, 1])
def test_merkle_proofs(spark, messy, monkeypatch, climb):
    monkeypatch.setattr(merkle, "CLIMB", climb)
    more = [(1000 + i, f"line {i}\nnext", ("big", "lone", "tri", "\U0001f600", "￿")[0 if i < 100 else 1 + i % 4]) for i in range(108)]
    docs = messy.unionByName(cases.documents(spark, more)).unionByName(cases.documents(spark, [(1, "x", "only"), (None, "y", "nothing")]))
    got = merkle.tamper_check(docs)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256"]
    assert cases.rows(got, *names) == plain_manifest(_fields(docs))
    text = {(r["doc_id"], r["leaf"]): r for r in got.collect()}
    for r in got.collect():
        assert r["verified"] == (r["folded_root"] == r["root"])
    cut = {i for i, t, *_ in _fields(docs) if i is not None and t and "\n" in t and cases.crc(i, 2) == 0}
    changed = {r["doc_id"] for r in text.values() if not r["verified"]}
    assert changed == cut and len(cut) > 20


def test_merkle_of_few_rows(spark, nothing):
    assert merkle.tamper_check(nothing).count() == 0
    for rows in ([(7, "a\nb")], [(7, "a"), (8, "b")], [(7, "a", "s"), (7, "a", "t")], [(3, "c", None)] * 4):
        docs = cases.documents(spark, rows)
        got = merkle.tamper_check(docs)
        assert cases.rows(got, "doc_id", "leaf", "subroot", "root", "proof_sha256") == plain_manifest(_fields(docs))


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 18), (64, 64, 64), (130, 65, 257), (3, 200, 5)])
@pytest.mark.parametrize("small", [1, 16])
def test_strassen_is_exact(shape, small):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = rng.integers(-(2**30), 2**30, (m, k)), rng.integers(-(2**25), 2**25, (k, n))
    assert (hard_negatives.strassen(a, b, small) == a @ b).all()


def plain_negatives(rows):
    live = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, label, v in live:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, other) for b, other, w in live if b != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            near = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [[a, p, i + 1, b, -s, -t] for i, (t, b, _) in enumerate(near[:5])]
    return sorted(out, key=repr)


def vectors(n, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0.2, 0.3, 12)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[5][1], i % 3) for i in range(40)]  # ties
    rows += [(2000, None, 1), (2100, rows[0][1], None), (2200, [float("nan")] * 12, 1), (2300, [float("inf")] + [0.0] * 11, 1), (2400, [None] * 12, 1), (None, rows[0][1], 1)]
    return [*rows, (2500, [0.0] * 12, 1), (2600, [], 2), (2700, rows[3][1] + [0.5], 0), (2800, [-1.0] * 12, 2)]


@pytest.mark.parametrize("tiles", [(1024, 4096), (2, 50)])
def test_hard_negatives(spark, monkeypatch, tiles):
    monkeypatch.setattr(hard_negatives, "ANCHORS", tiles[0])
    monkeypatch.setattr(hard_negatives, "CANDIDATES", tiles[1])
    rows = vectors(420)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, row string, anchor string")
    got = hard_negatives.mine(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert cases.rows(got) == plain_negatives(rows)
    assert len(plain_negatives(rows)) > 50


def test_hard_negatives_without_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], kind)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1)], kind)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(3, [1.0], 1), (5, [1.0], 1)], kind)).count() == 0
