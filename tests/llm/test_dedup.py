"""Exact and near duplicates against plain rules."""

import hashlib
import random
import re
from itertools import combinations

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from ironlog.llm import exact_dedup, minhash_forest
from ironlog.llm.components import components


def plain_exact(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_with_and_without_clashing_hashes(messy, bits):
    got = exact_dedup.exact_duplicates(messy, bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert cases.rows(got) == plain_exact(cases.messy())


def test_chunks_put_together_are_the_text(messy):
    text = exact_dedup.normalised(F.col("text"))
    found = messy.select(text.alias("t"), exact_dedup.chunks(text).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] for r in found)
    assert max(len(c) for r in found for c in r["c"]) <= exact_dedup.MOST
    assert any(len(r["c"]) > 50 for r in found)


def test_an_insertion_changes_few_chunks(spark):
    text = cases.prose(8, 8000)
    cut = lambda t: set(spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t"))).first()[0])
    one, two = cut(text), cut("Inserted. " + text)
    assert len(one - two) <= 0.3 * len(one)


def test_survivors_keep_all_columns_and_one_row_each(messy):
    got = exact_dedup.survivors(messy)
    assert got.columns == messy.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in cases.messy()})


def shingles(text):
    w = cases.words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_near(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if None not in (a, b) and a != b and x and y and 100 * len(x & y) >= 85 * len(x | y)]
    root = cases.roots({i for i, _ in sets if i is not None}, links)
    return sorted(([i, len(s), root.get(i), i is None or root[i] == i] for i, s in sets), key=repr)


def test_near_on_awkward_rows(messy):
    assert cases.rows(minhash_forest.near_duplicates(messy)) == plain_near(cases.messy())


def test_near_on_a_large_group_and_many_pairs(spark):
    rng = random.Random(5)
    made = []
    base = cases.prose(70, 150).split()
    for i in range(60):  # one large group whose members differ from each other
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(999)}"
        made.append((1000 + i, " ".join(w)))
    for i in range(60):  # pairs on both sides of the threshold
        w = cases.prose(500 + i, 120).split()
        made.append((2 * i, " ".join(w)))
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = "changed"
        made.append((2 * i + 1, " ".join(w)))
    got = cases.rows(minhash_forest.near_duplicates(cases.documents(spark, made)))
    assert got == plain_near(made)


def test_empty_tables(nothing):
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    assert minhash_forest.near_duplicates(nothing).count() == 0
    assert exact_dedup.survivors(nothing).columns == nothing.columns
    assert minhash_forest.survivors(nothing).count() == 0


def test_components_of_a_long_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 501 + i) for i in range(50)] + [(7, 7), (None, 3), (900, 899)]
    got = dict(cases.rows(components(spark.createDataFrame(edges, "x long, y long"), "x", "y")))
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(500, 551), 500), 899: 899, 900: 899}


@pytest.mark.parametrize("block", [7, 64])
def test_components_over_several_blocks(spark, block):
    rng = random.Random(block)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(90)]
    rng.shuffle(edges)
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "x long, y long").repartition(5), "x", "y", block).collect()]
    ends = {n for a, b in edges if a != b for n in (a, b)}
    root = cases.roots(ends, [e for e in edges if e[0] != e[1]])
    assert sorted(got) == sorted((n, root[n]) for n in ends)


def test_components_of_one_block_take_no_shuffled_round(spark, monkeypatch):
    monkeypatch.setattr("ironlog.llm.components._contract", lambda *_: pytest.fail("a round over one block"))
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)], "x string, y string")
    assert dict(cases.rows(components(edges, "x", "y"))) == {str(i): "0" for i in range(41)}


def _copies(n, most, seed):
    """Copies of one text that is not among them, each with one to ``most`` changed words."""
    rng = random.Random(seed)
    base = cases.prose(seed, 400).split()
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(1, most)):
            w[at] = f"w{i}x{at}"
        yield i, " ".join(w)


def _same_groups(got, made, percent):
    """Do (doc_id, component_id) pairs follow the plain rule?  The sets share so much that they are compared as a matrix."""
    sets = [shingles(t) for _, t in made]
    place = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        held[i, [place[x] for x in s]] = 1
    common = held @ held.T
    sizes = held.sum(axis=1)
    a, b = np.nonzero(np.triu(100 * common >= percent * (sizes[:, None] + sizes[None] - common), 1))
    root = cases.roots(range(len(made)), zip(a.tolist(), b.tolist(), strict=True))
    return got == {made[i][0]: made[root[i]][0] for i in range(len(made))}


@pytest.mark.parametrize(("n", "most"), [(300, 9), (1500, 9)])
def test_near_copies_of_an_absent_original(spark, n, most):
    made = list(_copies(n, most, 11))
    got = minhash_forest.near_duplicates(cases.documents(spark, made)).select("doc_id", "component_id").collect()
    assert _same_groups({r[0]: r[1] for r in got}, made, 85)


def test_survivors_at_80_percent(spark):
    made = []
    for i in range(40):
        w = cases.prose(900 + i, 400).split()
        made.append((2 * i, " ".join(w)))
        for at in range(20, 400, 53):  # eight places: 40 of 396 shingles, similarity 0.82
            w[at] = f"w{at}"
        made.append((2 * i + 1, " ".join(w)))
    kept = minhash_forest.survivors(cases.documents(spark, made), 80)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [2 * i for i in range(40)]
    assert all((1 - (p / 100) ** minhash_forest.STEP) ** minhash_forest._trees(p) < minhash_forest.MISS for p in (80, 85))
