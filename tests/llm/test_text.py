"""Tokenizer, language model and page text against plain rules."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import cases
import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ironlog.llm import bpe, common, ngram_lm
from ironlog.llm.elias_fano import Sequence, Trie, temporary
from ironlog.llm.html_text import extract_pages, main_text
from ironlog.llm.words import shingle_hashes, word_hashes

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(bpe.tokenizer_json(RANKS), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("a b=-é\n\t0'sth", max_size=80)))
def test_ids_are_those_of_the_rank_file(text):
    ids = CODEC.encode([text])[0].tolist()
    assert ids == PLAIN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()
    assert "".join(bpe.decode_stream(CODEC, ids)) == text


def test_newer_characters_are_cut_as_the_pattern_library_cuts_them():
    for point in (0x10EE7, 0x18DA7, 0x16EA7, 0x1C89, 0xA7CB):
        text = f"a{chr(point)}a 1{chr(point)}1  {chr(point)}."
        assert CODEC.encode([text])[0].tolist() == PLAIN.encode_ordinary(text)


def test_offsets_cover_split_characters():
    text = "ab 漢字 \U0001f600!"
    ids = CODEC.encode([text])[0].tolist()
    starts, ends = CODEC.offsets(ids)
    assert starts[0] == 0 and ends[-1] == len(text)
    for i, a, b in zip(ids, starts, ends, strict=True):
        assert CODEC.bytes_of[i] in text[a:b].encode()


def test_round_trip_and_tables(spark, messy, nothing):
    got = {tuple(r) for r in bpe.round_trip(messy, PATH, P.PATTERN).collect()}
    want = set()
    for doc_id, text, *_ in cases.messy():
        ids = PLAIN.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.add((doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert got == want
    encoded = bpe.encode_texts(messy, PATH, P.PATTERN)
    decoded = bpe.decode_ids(encoded, PATH, P.PATTERN)
    assert cases.rows(decoded, "doc_id", "text") == cases.rows(messy.na.fill("", ["text"]), "doc_id", "text")
    assert bpe.round_trip(nothing, PATH, P.PATTERN).count() == 0
    half = spark.createDataFrame([(1, CODEC.encode(["漢"])[0].tolist()[:1])], "doc_id long, ids array<int>")
    assert half.transform(bpe.decode_ids, PATH, P.PATTERN).first()["data"] in "漢".encode()


def test_word_and_shingle_hashes_follow_the_words():
    texts = ["Aa b", None, " ", "", "x" * 70_000 + " aA", "aa B c\nD e f", "b aa"]
    hashes, counts = word_hashes(pa.array(texts))
    spelled = [w for t in texts for w in cases.words(t)]
    assert counts.tolist() == [len(cases.words(t)) for t in texts]
    assert len({*zip(spelled, hashes.tolist(), strict=True)}) == len({*spelled}) == len({*hashes.tolist()})
    _, per = shingle_hashes(hashes, counts, 3)
    assert per.tolist() == [1, 0, 0, 0, 1, 3, 1]


def test_words_across_windows(monkeypatch):
    from ironlog.llm import words

    texts = [cases.prose(i, 40) for i in range(30)] + ["y" * 500, ""]
    want = words.word_hashes(pa.array(texts))
    monkeypatch.setattr(words, "WINDOW", 64)
    got = words.word_hashes(pa.array(texts))
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


@pytest.mark.parametrize(("n", "top"), [(1, 0), (7, 3), (500, 10**9), (500, 40), (64, 2**45)])
def test_sequences(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n))
    s = Sequence.of(values)
    assert (s.get(np.arange(n)) == values.astype(np.uint64)).all()
    asked = np.concatenate([values, values + 1, rng.integers(0, top + 2, 200), [0, 4 * top + 9]])
    assert (s.find(asked, np.zeros(len(asked), int), np.full(len(asked), n)) == np.searchsorted(values, asked)).all()
    assert s.words.nbytes < 16 * n + 600


def test_trie_in_a_mapped_file():
    rng = np.random.default_rng(1)
    contexts = np.unique(rng.integers(0, 10**6, 200))
    lists = [np.unique(rng.integers(0, 10**5, rng.integers(1, 30))) for _ in contexts]
    degrees, followers = np.array([len(x) for x in lists]), np.concatenate(lists)
    codes = rng.integers(1, 256, len(followers)).astype(np.uint8)
    known = {(c, w): k for c, w, k in zip(np.repeat(contexts, degrees), followers, codes, strict=True)}
    u = np.concatenate([np.repeat(contexts, degrees), rng.choice(contexts, 500), rng.integers(0, 10**6, 500)])
    w = np.concatenate([followers, rng.integers(0, 10**5, 1000)])
    with temporary() as file:
        trie = Trie.of(contexts, degrees, followers, codes).mapped(file)
        assert trie.look_up(u, w).tolist() == [known.get(x, 0) for x in zip(u, w, strict=True)]


def test_low_bits_are_packed_in_little_memory():
    n = 200_000
    values = np.cumsum(np.random.default_rng(3).integers(0, 1 << 18, n))
    tracemalloc.start()
    s = Sequence.of(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert s.shift >= 16
    assert (s.get(np.arange(n)) == values.astype(np.uint64)).all()
    assert peak < 60 * n  # spread out at once, the low bits took 16 bytes each


def test_a_worker_of_the_language_model_holds_one_block_at_a_time(messy):
    plan = ngram_lm.score_documents(messy)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert "collect_list" not in plan  # nor are a block's answers gathered in one row


def test_a_block_gets_only_the_probabilities_of_its_own_bigrams():
    def row(block, followers, times):
        one, n = np.array([5], np.int64), len(followers)
        packed = (ngram_lm._pack(x) for x in (np.array([1000]), np.array([n], np.int32)))
        return (
            0, block, n, 1, one.tobytes(), *packed, False, np.array(followers, np.uint32).tobytes(),
            ngram_lm._pack(np.array(times, np.int32)), ngram_lm._pack(np.full(n, 60, np.uint8)),
        )

    sent = [row(1, list(range(100)), list(range(1, 101))), row(2, [7, 300], [0, 0])]
    names = [x.split()[0] for x in ngram_lm._PAIRS.split(", ")]
    got = ngram_lm._answer((0,), pd.DataFrame(sent, columns=names)).set_index("block")
    codes = [ngram_lm._unpack(got["codes"][b], np.uint8, n) for b, n in ((1, 100), (2, 2))]
    books = [np.frombuffer(got["book"][b]) for b in (1, 2)]
    assert [len(x) for x in books] == [100, 2]
    assert books[0][codes[0]] == pytest.approx(np.arange(1, 101) / 1001)
    assert books[1][codes[1]] == pytest.approx([8 / 1001, 0])


@pytest.mark.parametrize("size", [2_000_000, 3_000])
def test_language_model(messy, monkeypatch, size):
    monkeypatch.setattr(ngram_lm, "BLOCK", size)
    monkeypatch.setattr(ngram_lm, "SHARD", size)
    learned = []
    plain_weights = ngram_lm.bigram_weights
    monkeypatch.setattr(ngram_lm, "bigram_weights", lambda n, s: learned.append(plain_weights(n, s)) or learned[0])
    got = sorted((tuple(r) for r in ngram_lm.score_documents(messy).collect()), key=repr)
    docs = [(i, [*cases.words(t), None]) for i, t, *_ in cases.messy()]
    c, pairs = Counter(), Counter()
    for i, t in docs:
        if cases.crc(i, 10):
            c.update(t)
            pairs.update(zip([None, *t], t))
    n = sum(c.values())
    base = lambda w: (c[w] + 0.1) / (n + 0.1 * (len(c) + 1))

    def model(u, w):
        a = learned[0][int(math.log2(c[u]))] if c[u] else 0
        return a * pairs[u, w] / (c[u] + 1) + (1 - a * c[u] / (c[u] + 1)) * base(w)

    want = sorted(
        ((i, not cases.crc(i, 10), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), sum(math.log10(model(*p)) for p in zip([None, *t], t))) for i, t in docs),
        key=repr,
    )
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5])
        assert w[6] - 0.03 * g[2] <= g[6] <= w[6] + 1e-6  # rounded to 8 bits, downwards
    # the model is normalised after every context
    for u in (None, "one", docs[0][1][0]):
        assert sum(model(u, w) for w in c) + base("never seen") == pytest.approx(1)


def test_language_model_without_rows(nothing, spark):
    assert ngram_lm.score_documents(nothing).count() == 0
    held = next(i for i in range(100) if not cases.crc(i, 10))
    only = ngram_lm.score_documents(cases.documents(spark, [(held, "a b")])).first()
    assert (only["n_tokens"], only["n_known"], only["train_tokens"]) == (3, 0, 0)
    assert only["score"] == pytest.approx(only["base_score"]) == pytest.approx(0.0)


LONG = "Enough words for a paragraph of the article, and then some more of them. " * 3
PAGES = [
    (1, "<nav><a href=x>Menu</a></nav><article><h1>T &amp; x</h1><p>A\n  b<p>c<script>var a='</p>'</script></article><footer>f</footer>", "T & x\nA b\nc"),
    (2, f"<div id=header><a>Home</a></div><div class='side-bar'>{LONG}</div><div id=content><h1>Title</h1><p>{LONG}</p><div class=ad>buy</div><p>Short.</p></div><div id='comments'>{LONG}</div>", f"Title\n{LONG.strip()}\nShort."),
    (3, f"<main><header><h1>H</h1><i>by me</i></header><p>{LONG}</p><form>mail<input></form></main><aside>{LONG}</aside>", f"H\n{LONG.strip()}"),
    (4, "<nav><a>only</a><a>links</a></nav>", ""),
    (5, "", ""),
    (6, None, ""),
    (7, f"<p>{LONG}</p><p>1 &lt; 2</p>", f"{LONG.strip()}\n1 < 2"),
    (8, f"<article><p>{LONG}<b>unclosed<p>cut off in a t", f"{LONG.strip()} unclosed\ncut off in a t".replace(" unclosed", "unclosed" if LONG.endswith("</") else " unclosed")),
    (9, "<article>" + "<p>x" * 20_000 + "</article>", "\n".join(["x"] * 20_000)),
    (10, "<" * 50_000 + "<a \"" * 20_000, None),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, "u", h, "x", "y") for i, h, _ in PAGES], "page_id long, url string, html string, text string, n_chars string")
    got = {r["page_id"]: r for r in extract_pages(df).collect()}
    for i, _, text in PAGES:
        assert text is None or got[i]["text"] == text, i
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert extract_pages(df.where("false")).count() == 0


def test_text_lines_decide_without_named_parts():
    links = "".join(f"<p><a href=/{i}>link {i} with words</a></p>" for i in range(30))
    paragraphs = "".join(f"<p>{random.Random(i).random()} {LONG}</p>" for i in range(5))
    text = main_text(f"<body>{links}{paragraphs}{links}</body>")
    assert text.count("\n") == 4 and "link" not in text


def _paragraphs(n, seed):
    return [f"{LONG}{seed} {i}" for i in range(n)]


def _html(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def test_all_articles_of_a_page_count_and_a_teaser_does_not():
    one, two, body = _paragraphs(4, 1), _paragraphs(2, 2), _paragraphs(6, 3)
    assert main_text(f"<body><article>{_html(one)}</article><div>x</div><article>{_html(two)}</article></body>") == "\n".join(one + two)
    text = main_text(f"<body><div>{_html(body)}</div><article class=card><p>A short teaser.</p></article></body>")
    assert all(x in text for x in body)


def test_class_names_do_not_remove_most_of_the_text():
    lines = _paragraphs(5, 4)
    for name in ("content has-sidebar", "with-comments"):
        assert main_text(f"<body><div class='{name}'>{_html(lines)}</div></body>") == "\n".join(lines)
    for name in ("body share-enabled", "social-history"):
        assert main_text(f"<body><article><h1>Title</h1><div class='{name}'>{_html(lines)}</div></article></body>") == "\n".join(["Title", *lines])
    small = main_text(f"<body><article>{_html(lines)}</article><div class=comments>{_html(_paragraphs(20, 5))}</div></body>")
    assert small == "\n".join(lines)


def test_a_short_text_without_named_parts_is_kept():
    assert main_text("<body><nav><a href=/>Home</a></nav><div><p>A short note.</p></div></body>") == "A short note."


def test_line_blocks_decide_where_articles_hold_little():
    links = "".join(f"<p><a href=/{i}>link {i}</a></p>" for i in range(9))
    lines = _paragraphs(5, 6)
    assert main_text(f"<body><article>{links}<p>Tip.</p></article><div>{_html(lines)}</div></body>") == "\n".join(lines)


def test_encoder_takes_few_pieces_and_one_vocabulary_at_a_time():
    codec = bpe.Codec(bpe.tokenizer_json(RANKS), P.PATTERN)
    text = " ".join(f"{i:x}q{i}" for i in range(3 * bpe.PIECES))
    asked, inner = [], codec.tokenizer

    class Counted:
        def encode_batch_fast(self, names, **settings):
            asked.append(len(names))
            return inner.encode_batch_fast(names, **settings)

    codec.tokenizer = Counted()
    (ids,) = codec.encode([text])
    assert codec.decode(ids.tolist()) == text.encode()
    assert len(asked) > 3 and max(asked) <= bpe.PIECES
    assert codec.whole is None


def test_slices_are_bounded_and_whole():
    texts = ["x" * 2000] * 3000 + ["y" * (3 * common.SLICE), None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = list(common.slices(iter([batch, batch.slice(0, 0)])))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts
    assert max(b.nbytes for b in got[:-1]) <= 1.1 * common.SLICE
