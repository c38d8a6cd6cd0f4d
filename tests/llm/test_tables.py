"""Quality model, shards, mixtures, vectors and archives."""

import gzip
import math
import random
import zlib
from collections import defaultdict

import cases
import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ironlog.llm import common, mixture, quality, sharding, vector_dups, warc
from ironlog.llm.common import remainder


def graded(spark, n=240):
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        docs.append((i, cases.prose(i, 80) if good else cases.prose(i, 80).upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0, "x"))
    return cases.documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), labels


def test_quality_is_learned_and_held_out_rows_are_not_used(spark):
    docs, labels, rows = graded(spark)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    held = [(i, q) for i, q, *_ in rows if cases.crc(i, 3) == 1]
    assert sum(got[i]["predicted"] == q for i, q in held) >= 0.98 * len(held)
    assert all(got[i]["held_out"] == (cases.crc(i, 3) == 1) for i, *_ in rows)
    turned = labels.withColumn("quality", labels["quality"])
    wrong = turned.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality) AS quality")
    assert cases.rows(quality.classify(docs, wrong)) == cases.rows(quality.classify(docs, labels))


def test_quality_of_awkward_rows(spark, messy, nothing):
    _, labels, _ = graded(spark)
    got = quality.classify(messy, labels)
    assert got.count() == len(cases.messy())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.collect())
    assert quality.accepted(messy, labels).columns == messy.columns
    odd = spark.createDataFrame([(1, None), (None, 1), (99, 1), (5, 7)], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(messy, odd).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0


def test_pairs_of_features_are_found():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 2) in model.pairs
    assert (((model.score(x) >= 0.5) == y).mean()) > 0.95


def test_best_fit_decreasing():
    assert sharding.best_fit_decreasing(np.array([5, 7, 5, 3]), 10).tolist() == [1, 0, 1, 0]
    assert sharding.best_fit_decreasing(np.array([12, 4]), 10).tolist() == [0, 1]
    sizes = np.random.default_rng(3).integers(1, 1000, 500)
    loads = np.bincount(sharding.equal_bins(sizes, 16), sizes, 16)
    assert loads.max() - loads.min() <= 5


@pytest.mark.parametrize("lane", [20_000, 12])
def test_shards(spark, messy, monkeypatch, lane):
    monkeypatch.setattr(sharding, "LANE_ITEMS", lane)
    docs = messy.unionByName(cases.documents(spark, [(1000 + i, cases.prose(i, 20 + i % 50)) for i in range(150)] + [(5000 + i, "copy of a text") for i in range(90)]))
    got = sharding.byte_shards(docs, 4).collect()
    assert len(got) == docs.count()
    text = defaultdict(set)
    slots = defaultdict(list)
    loads = defaultdict(int)
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect() if r["doc_id"] is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    for r in got:
        text[r["text_crc32"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(4))


def test_shards_of_a_capacity(spark, monkeypatch, nothing):
    docs = cases.documents(spark, [(i, "x" * (i * 37 % 400)) for i in range(300)])
    for lane in (20_000, 100):
        monkeypatch.setattr(sharding, "LANE_ITEMS", lane)
        loads = defaultdict(int)
        for r in sharding.byte_shards(docs, capacity=2000).collect():
            loads[r["shard"]] += r["size"]
        assert sorted(loads) == list(range(len(loads)))
        assert max(loads.values()) <= 2000 and len(loads) <= 1.15 * sum(loads.values()) / 2000 + 3
    assert sharding.byte_shards(nothing).count() == 0


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        for seed in (0, 5, -7):
            got = mixture.permuted(np.arange(n), np.full(n, n), np.full(n, seed))
            assert sorted(got) == list(range(n))


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, 1.5 * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not above:
            return target | {s: unit * weight[s] for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize("settings", [{}, {"block": 7, "shard_blocks": 2}])
def test_mixture(spark, messy, settings):
    extra = [(100 + i, cases.prose(i, i % 90), ("a", "c", "d", None, "Z")[i % 5]) for i in range(200)]
    docs = messy.unionByName(cases.documents(spark, extra))
    got = mixture.mixture(docs, **settings).collect()
    source = defaultdict(list)
    for r in docs.collect():
        source[r["source"]].append(len(cases.words(r["text"])))
    target = plain_targets({s: sum(v) for s, v in source.items()})
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, len(cases.words(r["text"]))) for r in docs.collect())
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert {k: 0 for k in taken} == {(sum(v), round(target[s], 6)): 0 for s, v in source.items()}
    for (_, t), n in taken.items():
        assert abs(n - t) <= 0.51 * sum(round(x, 6) == t for x in target.values())
    key = lambda rows: sorted(map(repr, rows))
    assert key(got) == key(mixture.mixture(docs.repartition(5), **settings).collect())


def test_mixture_meets_every_slot_once(spark):
    docs = cases.documents(spark, [(i, cases.prose(i, i % 120), "abc"[i % 3]) for i in range(150)])
    spans = mixture.spans(docs, block=8, shard_blocks=4).where("words > 0").collect()
    blocks = defaultdict(int)
    shards = defaultdict(set)
    for r in spans:
        blocks[r["skey"], r["slot"]] += r["words"]
        shards[r["shard"]].add((r["skey"], r["slot"]))
    for key in {k for k, _ in blocks}:
        slots = sorted(s for k, s in blocks if k == key)
        assert slots == list(range(len(slots)))
    assert max(map(len, shards.values())) <= 5 and None not in shards


def test_draw_decides_the_shards_and_no_total(spark):
    docs = cases.documents(spark, [(i, cases.prose(i, i % 120), "abc"[i % 3]) for i in range(150)] + [(900, None, "a"), (901, "", None)])
    runs = {seed: {r["doc_id"]: r for r in mixture.mixture(docs, block=8, shard_blocks=4, seed=seed).collect()} for seed in (1, 2)}
    placed = {seed: {i: [(b["slot"], b["word"], b["words"]) for b in r["blocks"]] for i, r in rows.items()} for seed, rows in runs.items()}
    for seed, rows in runs.items():
        assert all(r["taken"] == sum(b["words"] for b in r["blocks"]) for r in rows.values())
        assert all(0 <= b["word"] and b["word"] + b["words"] <= r["size"] for r in rows.values() for b in r["blocks"])
        assert rows[900]["blocks"] == rows[901]["blocks"] == []
    assert {i: r["taken"] for i, r in runs[1].items()} == {i: r["taken"] for i, r in runs[2].items()}
    assert {i: sorted(p) for i, p in placed[1].items()} == {i: sorted(p) for i, p in placed[2].items()}
    shards = [{i: {(b["shard"], b["slot"]) for b in r["blocks"]} for i, r in rows.items()} for rows in runs.values()]
    assert shards[0] != shards[1]


def test_mixed_documents(messy, nothing):
    mixed = mixture.mixed(messy, block=16)
    assert mixed.columns == messy.columns
    rows = mixed.collect()
    texts = defaultdict(list)
    for i, t, *_ in cases.messy():
        texts[i].append(t or "")
    assert all(any(r["text"] in t for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)
    once = messy.dropDuplicates(["doc_id", "text"])
    assert sum(len(cases.words(r["text"])) for r in rows) == sum(r["taken"] for r in mixture.mixture(once, block=16).collect())
    assert mixture.mixed(nothing).count() == 0 and mixture.mixture(nothing).count() == 0


def plain_vectors(rows, threshold):
    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links, n = [], defaultdict(int)
    for a, (i, v, k) in enumerate(rows):
        for j, w, m in rows[:a]:
            if k is not None and k == m and None not in (i, j) and fine(v) and fine(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links.append((i, j))
                    n[i] += 1
                    n[j] += 1
    root = cases.roots({i for i, *_ in rows if i is not None}, links)
    return sorted(([i, n[i], root.get(i), i is None or root[i] == i] for i, *_ in rows), key=repr)


@pytest.mark.parametrize("leaf", [1024, 12])
def test_vectors(spark, monkeypatch, leaf):
    monkeypatch.setattr(vector_dups, "LEAF", leaf)
    rng = np.random.default_rng(2)
    rows = [(1, None, 0), (None, [1.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0)]
    rows += [(6, [1.0, 0.0], None), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2e30, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [], 0), (12, [3e-30, 0.0], 0)]
    centre = rng.standard_normal(16)
    for i in range(60):  # a dense group of vectors that all differ, and copies
        v = (centre + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist()
        rows += [(100 + i, v, 1)] + ([(300 + i, v, 1)] if i % 10 == 0 else [])
    rows += [(500 + i, rng.standard_normal(16).astype(np.float32).tolist(), 1) for i in range(150)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    assert cases.rows(vector_dups.near_duplicate_vectors(df)) == plain_vectors(rows, 0.93)
    assert vector_dups.near_duplicate_vectors(df.where("false")).count() == 0


PAGES = [(3, "a\r\nb", "x"), (1, None, "x"), (2, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\nhé\r\n\r\n"), (6, "u", "x"), (7, "u", "y" * 300_000)]


def pages(spark):
    return spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string")


def test_archives_match_sql(spark):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    result = duck.execute(warc.ORACLE)
    names = [c[0] for c in result.description]
    assert cases.rows(warc.archive_round_trip(pages(spark)), *names) == sorted(map(list, result.fetchall()), key=repr)


def test_archives_of_repeated_and_unnamed_pages(spark):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "u", "n")], "page_id long, url string, html string")
    got = cases.rows(warc.archive_round_trip(df), "page_id", "record_type", "refers_to")
    assert got == sorted([[1, "response", None], [1, "response", None], [None, "revisit", 1], [None, "response", None]], key=repr)
    assert warc.archive_round_trip(df.where("false")).count() == 0


def record(i, payload=b"body"):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:ironlog:page:{i}>\r\nWARC-Payload-Digest: sha1:{warc.payload_digest(payload)}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def test_damaged_archives_lose_only_damaged_records():
    parts = [record(i, b"payload %d" % i) for i in range(6)]
    bad = [parts[0], parts[1].replace(b"payload 1", b"payload X"), parts[2], parts[3][:-9], parts[4].replace(b"Content-Length: 9", b"Content-Length: z"), b"noise", parts[5], b"WARC/1.1\r\nhalf"]
    found = list(warc.salvage(b"".join(bad)))
    assert [f["warc-record-id"][18:-1] for _, _, fault, f, _ in found if fault is None] == ["0", "2", "5"]
    assert [fault for _, _, fault, *_ in found if fault] == ["digest differs", "no end mark", "header without end"]
    assert [a for a, *_ in found[1:]] == [b for _, b, *_ in found[:-1]] and found[-1][1] == sum(map(len, bad))
    members = [gzip.compress(p) for p in parts]
    members[2] = members[2][:20] + b"\xff\xff" + members[2][22:]
    members.insert(4, b"\x1f\x8b\x08 not a member")
    found = list(warc.salvage_members(b"".join(members) + gzip.compress(parts[0])[:-3]))
    # the last member lacks its end, but its record is there and its digest holds
    assert [f["warc-record-id"][18:-1] for _, _, fault, f, _ in found if fault is None] == ["0", "1", "3", "4", "5", "0"]
    assert sum(fault is not None for _, _, fault, *_ in found) == 3


def test_one_damaged_member_keeps_its_records_up_to_the_fault():
    rng = random.Random(7)
    payloads = [bytes(rng.choices(b"abcdefgh ", k=400)) for _ in range(200)]
    head = record(200, b"")
    packed = gzip.compress(b"".join(record(i, p) for i, p in enumerate(payloads)))
    at = len(packed) * 9 // 10
    broken = packed[:at] + bytes(b ^ 255 for b in packed[at : at + 8]) + packed[at + 8 :]
    found = list(warc.salvage_members(gzip.compress(head) + broken + gzip.compress(record(201))))
    good = [(int(f["warc-record-id"][18:-1]), payload) for _, _, fault, f, payload in found if fault is None]
    assert good[0] == (200, b"") and good[-1] == (201, b"body")
    assert 140 <= len(good) - 2 < 200 and good[1:-1] == [(i, payloads[i]) for i in range(len(good) - 2)]
    gaps = [(begin, end) for begin, end, fault, *_ in found if fault]
    assert len(gaps) == 1 and gaps[0][0] <= len(gzip.compress(head)) + at < gaps[0][1]


def test_a_changed_record_inside_a_damaged_member_is_a_gap():
    plain = b"".join(record(i, b"payload %d" % i) for i in range(5))
    packed = gzip.compress(plain)
    other = gzip.compress(plain.replace(b"payload 2", b"payload X"))
    found = list(warc.salvage_members(other[:-8] + packed[-8:] + gzip.compress(record(9))))
    assert [f["warc-record-id"][18:-1] if fault is None else fault for _, _, fault, f, _ in found][:5] == ["0", "1", "digest differs", "3", "4"]
    assert [f["warc-record-id"][18:-1] for _, _, fault, f, _ in found[5:] if fault is None] == ["9"] and len(found) == 7


def test_long_pages_have_archives_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LONG", 100)
    monkeypatch.setattr(warc, "MOST_BYTES", 3 * 4196)
    texts = ["x" * n for n in (0, 5, 100, 101, 5000, 9, 20000, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w"), pattern="part-*").collect()
    assert sorted((int(r["record_id"][18:-1]), bytes(r["payload"]).decode()) for r in found) == list(enumerate(texts))
    together = [{int(r["record_id"][18:-1]) for r in found if r["archive"] == name} for name in {r["archive"] for r in found}]
    assert sorted(map(sorted, together)) == [[0, 1, 2], [3], [4], [5, 7], [6]]


def test_gaps_are_rows(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1) + record(2)[:-8] + record(3))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(4)) + b"\x1f\x8b\x08x" + gzip.compress(record(5)))
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path))
    assert [r[0] for r in cases.rows(got.where("fault IS NULL"), "record_id")] == [f"<urn:ironlog:page:{i}>" for i in (1, 3, 4, 5)]
    assert got.where("fault IS NOT NULL").count() == 2
    assert {bytes(r["payload"]) for r in got.where("fault IS NULL").collect()} == {b"body"}


def test_remainder_is_that_of_the_text_of_the_id(spark):
    df = spark.createDataFrame([(i,) for i in [0, 1, 12345, -7, None]], "doc_id long")
    assert [r[0] for r in df.select(remainder(df["doc_id"], 10)).collect()] == [cases.crc(i, 10) for i in [0, 1, 12345, -7, None]]
    assert random.Random(1).random() < 1


def test_archives_with_damaged_first_bytes(spark, tmp_path):
    members = [gzip.compress(record(i)) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"\x00\x00\x00" + members[0][3:] + members[1] + members[2])
    (tmp_path / "b.warc.gz").write_bytes(b"junk" + members[3] + record(5) + members[0])
    got = warc.read_archives(spark, str(tmp_path))
    assert [r[0] for r in cases.rows(got.where("fault IS NULL"), "record_id")] == [f"<urn:ironlog:page:{i}>" for i in (0, 1, 2, 3, 5)]
    assert got.where("fault IS NOT NULL").count() == 2


def test_runs_are_cut_in_bounded_batches():
    text = " ".join(["word"] * 800)
    parts = [{"epoch": 0, "word": 0, "words": 800}, {"epoch": 1, "word": 799, "words": 1}]
    kind = pa.list_(pa.struct([("epoch", pa.int64()), ("word", pa.int64()), ("words", pa.int64())]))
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(1000), pa.int64()), pa.array([text] * 1000), pa.array([9] * 1000, pa.int32()), pa.array([parts] * 1000, kind)],
        ["doc_id", "text", "n_chars", "__parts"],
    )
    got = list(mixture._cut(iter([rows]), ["doc_id", "text", "n_chars"]))
    assert max(b.nbytes for b in got) < 1.2 * common.SLICE
    assert [r for b in got for r in b.to_pylist()] == [{"doc_id": i, "text": t, "n_chars": len(t)} for i in range(1000) for t in (text, "word")]
