"""Language-model scores of documents from an Elias-Fano n-gram trie that is dealt over the cluster."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ironlog.llm.common import only, stored
from ironlog.llm.elias_fano import Trie, temporary
from ironlog.llm.words import mix, word_hashes

#: Tokens in a block, and vocabulary or bigram entries in a shard, about.
BLOCK, SHARD = 2_000_000, 2_000_000
#: Bigrams looked up at a time: each takes some 200 bytes meanwhile.
LOOK_UP = 1 << 16
#: Reserved weight of a context; bins of the held-out estimate: contexts by powers of two, gains by size.
RESERVE, CONTEXT_BINS, GAIN_BINS = 1.0, 48, 160
#: Added to a token's count in the base model.
EXTRA = 0.1

_U = np.uint64
_END = mix(np.array([3], _U))[0]


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(np.ascontiguousarray(x)), codec="zstd", asbytes=True) if x.nbytes else b""


def _unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of each value among them; holds less beside them than ``np.unique``."""
    order = np.argsort(x)
    values = x[order]
    fresh = np.empty(len(x), bool)
    fresh[:1] = True
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    values = values[fresh]
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(fresh, dtype=np.int32)
    at -= 1
    return values, at


def _dealt_words(vocab: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A vocabulary in the order in which it is sent, and where each shard's words begin."""
    to = ((vocab >> _U(33)) % _U(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(shards + 1))


def _held(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _blocks(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to blocks: ids of the block's own vocabulary, the commonest word first, texts end to end."""

    def make(ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in tokens], np.int32)
        every = np.concatenate(tokens)
        tokens.clear()
        vocab, at = _distinct(every)
        del every
        order = np.argsort(-np.bincount(at), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        local = rank[at]
        del at
        held = np.array([_held(i) for i in ids])
        counts = np.bincount(local[np.repeat(~held, lengths)], minlength=len(vocab)).astype(np.int32)
        row = [
            pa.array([uuid.uuid4().int >> 66], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([len(ids)], pa.int64()),
            pa.array([held.tobytes()]), pa.array([_pack(lengths)]), pa.array([len(local)], pa.int64()),
            pa.array([_pack(local)], pa.binary()), pa.array([len(vocab)], pa.int64()), pa.array([vocab[order].tobytes()], pa.binary()), pa.array([_pack(counts)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(row, ["block", "ids", "docs", "held", "lengths", "tokens", "local", "words", "vocab", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, held = [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                hashes, counts = word_hashes(part.column(1))
                ends = np.cumsum(counts)
                for i, (b, e) in enumerate(zip(ends - counts, ends, strict=True)):
                    ids.append(part.column(0)[i].as_py())
                    tokens.append(np.append(hashes[b:e], _END))
                    held += int(e - b) + 1
                    if held >= BLOCK:
                        yield make(ids, tokens)
                        ids, tokens, held = [], [], 0
        if ids:
            yield make(ids, tokens)

    return run


def _split_words(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, n, vocab, counts = (batch.column(x)[i].as_py() for x in ("block", "words", "vocab", "counts"))
                vocab, counts = np.frombuffer(vocab, _U), _unpack(counts, np.int32, n)
                order, cuts = _dealt_words(vocab, shards)
                rows = []
                for s in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[s] : cuts[s + 1]]
                    rows.append((int(s), block, len(own), vocab[own].tobytes(), _pack(counts[own])))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["shard", "block", "n", "vocab", "counts"])

    return run


def _count_words(shards: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Global counts and numbers of a shard's words, sent back to each block in the order it sent them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        vocab, at = _distinct(np.concatenate([np.frombuffer(v, _U) for v in rows["vocab"]]))
        total = np.bincount(at, np.concatenate([_unpack(c, np.int32, n) for c, n in zip(rows["counts"], rows["n"], strict=True)]), len(vocab)).astype(np.int64)
        number = np.arange(len(vocab), dtype=np.int64) * shards + int(key[0])
        cuts = np.cumsum([0, *rows["n"]])
        out = [(b, int(key[0]), int(n), _pack(number[at[x:y]]), _pack(total[at[x:y]]), 0, 0) for b, n, x, y in zip(rows["block"], rows["n"], cuts, cuts[1:], strict=False)]
        out.append((-1, int(key[0]), 0, b"", b"", int(total.sum()), int((total > 0).sum())))
        return pd.DataFrame(out, columns=["block", "shard", "n", "number", "total", "all_tokens", "all_words"])

    return run


class _Block:
    """A block's tokens with the numbers and training counts of its words, and its distinct bigrams."""

    def __init__(self, r: dict, replies: list[dict], shards: int) -> None:
        self.lengths = _unpack(r["lengths"], np.int32, r["docs"])
        self.local = _unpack(r["local"], np.int32, r["tokens"])
        vocab = np.frombuffer(r["vocab"], _U)
        order, cuts = _dealt_words(vocab, shards)
        self.number, self.total = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
        for x in replies:
            own = order[cuts[x["shard"]] : cuts[x["shard"] + 1]]
            self.number[own], self.total[own] = _unpack(x["number"], np.int64, x["n"]), _unpack(x["total"], np.int64, x["n"])
        self.held = np.frombuffer(r["held"], bool)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        # A text's last token is the end; it is also what comes before the first.
        key = np.empty(len(self.local), np.int64)
        key[1:] = self.local[:-1]
        key[self.begins] = self.local[self.ends - 1]
        key *= len(vocab)
        key += self.local
        pairs, self.pair = _distinct(key)
        del key
        self.u, self.w = (x.astype(np.int32) for x in np.divmod(pairs, len(vocab)))

    def times(self) -> np.ndarray:
        """How often each bigram occurs in training texts."""
        return np.bincount(self.pair[np.repeat(~self.held, self.lengths)], minlength=len(self.u)).astype(np.int32)

    def dealt(self, shards: int, all_tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Bigrams in the order in which they are sent, and where each shard's begin.

        A context goes to one shard, unless it is so common that it is split over all by what follows.
        """
        home = (mix(self.number.astype(_U)) >> _U(20)) % _U(shards)
        to = home[self.u]
        hot = np.flatnonzero((self.total * 4 * shards > all_tokens)[self.u])
        to[hot] = (to[hot] + (mix(self.number[self.w[hot]].astype(_U)) >> _U(20))) % _U(shards)
        to = to.astype(np.int32)
        order = np.lexsort((self.number[self.w], self.number[self.u], to))
        return order, np.searchsorted(to[order], np.arange(shards + 1))


def _base(total: np.ndarray, tokens: int, words: int) -> np.ndarray:
    return (total + EXTRA) / (tokens + EXTRA * (words + 1))


_PAIRS = "shard long, block long, n long, m long, contexts binary, context_total binary, degrees binary, wide boolean, followers binary, times binary, base binary"


def _split_pairs(word_shards: int, shards: int, tokens: int, words: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block and the answers about its words to its distinct bigrams, a row for each shard."""

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        (r,) = block.to_pylist()
        b = _Block(r, replies.to_pylist(), word_shards)
        order, cuts = b.dealt(shards, tokens)
        times = b.times()
        del b.pair, b.local
        base = np.clip(np.round(-20 * np.log10(_base(b.total, tokens, words))), 0, 255).astype(np.uint8)
        rows = []
        for s in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[s] : cuts[s + 1]]
            first = np.flatnonzero(np.diff(b.u[own], prepend=-1))
            u, w = b.u[own[first]], b.w[own]
            follow = b.number[w]
            wide = bool(follow.max() >= 1 << 32)
            rows.append(
                (
                    int(s), r["block"], len(own), len(u), b.number[u].tobytes(), _pack(b.total[u]), _pack(np.diff(first, append=len(own)).astype(np.int32)),
                    wide, (follow if wide else follow.astype(np.uint32)).tobytes(), _pack(times[own]), _pack(base[w]),
                )
            )
        return pa.table([pa.array(x) for x in zip(*rows, strict=True)], [x.split()[0] for x in _PAIRS.split(", ")])

    return run


def _codes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1 to 255 of probabilities, and each code's probability.

    More than 255 different ones are put in bins of equal width in the logarithm, each standing for the least that it
    may hold, so that no mass is gained: over six decades a token loses at most 0.024 in log10.
    """
    values = np.unique(q)
    if len(values) > 255:
        values = np.geomspace(values[0], values[-1], 255)
        values[0] = q.min()
    return np.searchsorted(values, q, "right").astype(np.uint8), np.concatenate([[0.0], values])


def gain_bin(x: np.ndarray) -> np.ndarray:
    """Bins of the gain of one held-out bigram: 32 below 0, the rest by quarter powers of two."""
    return np.where(x < 0, np.clip((x + 1) * 32, 0, 31), np.clip(32 + 4 * np.log2(1 + np.maximum(x, 0)), 32, GAIN_BINS - 1)).astype(np.int64)


def _answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Builds a shard's trie from all training bigrams, and looks up the bigrams of each block in it.

    Also returns, once, the histogram of gains from which the weights of the bigram model are learned.
    """
    rows = rows.sort_values("block")
    cuts = np.cumsum([0, *rows["n"]])
    u, total, w = (np.empty(cuts[-1], np.int64) for _ in range(3))
    times, base = np.empty(cuts[-1], np.int32), np.empty(cuts[-1], np.uint8)
    for r, x, y in zip(rows.itertuples(), cuts, cuts[1:], strict=False):
        degrees = _unpack(r.degrees, np.int32, r.m)
        u[x:y] = np.repeat(np.frombuffer(r.contexts, np.int64), degrees)
        total[x:y] = np.repeat(_unpack(r.context_total, np.int64, r.m), degrees)
        w[x:y] = np.frombuffer(r.followers, np.int64 if r.wide else np.uint32)
        times[x:y], base[x:y] = _unpack(r.times, np.int32, r.n), _unpack(r.base, np.uint8, r.n)
    rows = rows[["block", "n"]]
    live = np.flatnonzero(times)
    live = live[np.lexsort((w[live], u[live]))]
    uu, ww = u[live], w[live]
    fresh = np.flatnonzero((np.diff(uu, prepend=-1) != 0) | (np.diff(ww, prepend=-1) != 0))
    weights = np.zeros(CONTEXT_BINS * GAIN_BINS)
    sums = np.zeros(CONTEXT_BINS * GAIN_BINS)
    book = np.zeros(1)
    codes = np.zeros(len(u), np.uint8)
    if len(fresh):
        c = np.add.reduceat(times[live].astype(np.int64), fresh)
        cu, p0 = total[live[fresh]], 10 ** (base[live[fresh]] / -20.0)
        uu, ww = uu[fresh], ww[fresh]
        del live, fresh, total, times, base
        heads = np.flatnonzero(np.diff(uu, prepend=-1))
        own, book = _codes(c / (cu + RESERVE))
        rest = cu - 1 + RESERVE
        gain = (c - 1) / rest / p0 - (cu - 1) / rest
        at = np.minimum(np.log2(np.maximum(cu, 1)).astype(np.int64), CONTEXT_BINS - 1) * GAIN_BINS + gain_bin(gain)
        weights = np.bincount(at, c, len(weights))
        sums = np.bincount(at, c * gain, len(sums))
        del c, cu, p0, rest, gain, at
        with temporary() as file:
            trie = Trie.of(uu[heads], np.diff(heads, append=len(uu)), ww, own).mapped(file)
            del uu, ww, own
            for a in range(0, len(u), LOOK_UP):
                codes[a : a + LOOK_UP] = trie.look_up(u[a : a + LOOK_UP], w[a : a + LOOK_UP])
    out = []
    for r, x, y in zip(rows.itertuples(), cuts, cuts[1:], strict=False):
        # a block gets the probabilities that it needs, so that these grow with its bigrams and not with the shards
        needed, own = _distinct(codes[x:y])
        out.append((r.block, int(key[0]), int(r.n), _pack(own.astype(np.uint8)), book[needed].tobytes(), None, None))
    out.append((-1, int(key[0]), 0, b"", b"", weights, sums))
    return pd.DataFrame(out, columns=["block", "shard", "n", "codes", "book", "weights", "sums"])


def bigram_weights(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For each size of context, the part of the bigram model in the mixture that makes left-out training bigrams likeliest.

    With weight a, a bigram's probability is 1 + a * gain times its base probability; the best a has zero slope.
    """
    out = np.zeros(CONTEXT_BINS)
    for i, (n, s) in enumerate(zip(weights.reshape(CONTEXT_BINS, -1), sums.reshape(CONTEXT_BINS, -1), strict=True)):
        at = n > 0
        n, gain = n[at], s[at] / n[at]
        slope = lambda a, n=n, gain=gain: float((n * gain / (1 + a * gain)).sum())
        low, high = 0.0, 0.99
        if not len(n) or slope(0.0) <= 0:
            continue
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if slope(middle) > 0 else (low, middle)
        out[i] = low
    if not weights.reshape(CONTEXT_BINS, -1)[0].any() or out[0] == 0:
        out[0] = out[1]  # a context seen once says nothing about itself; its like is the next size
    return out


def _score(word_shards: int, shards: int, tokens: int, words: int, mixture: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block and the answers about its words and bigrams to the scores of its documents."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids = block.column("ids")[0].values
        (r,) = block.drop_columns(["ids"]).to_pylist()
        answers = answers.to_pylist()
        b = _Block(r, [{"shard": x["shard"], "n": x["n"], "number": x["first"], "total": x["second"]} for x in answers if not x["scored"]], word_shards)
        order, cuts = b.dealt(shards, tokens)
        q = np.zeros(len(order))
        for x in answers:
            if x["scored"]:
                own = order[cuts[x["shard"]] : cuts[x["shard"] + 1]]
                q[own] = np.frombuffer(x["second"], np.float64)[_unpack(x["first"], np.uint8, x["n"])]
        del order, answers
        base = _base(b.total, tokens, words)
        part = np.where(b.total > 0, mixture[np.minimum(np.log2(np.maximum(b.total, 1)).astype(np.int64), CONTEXT_BINS - 1)], 0.0)
        left = 1 - part * b.total / (b.total + RESERVE)
        q *= part[b.u]
        q += left[b.u] * base[b.w]
        log_pair = np.log10(q, out=q)
        add = lambda x: pa.array(np.add.reduceat(x, b.begins))
        known, plain = (b.total > 0).astype(np.int64), np.log10(base)
        columns = [
            ids, pa.array(b.held), pa.array(b.lengths.astype(np.int64)), add(known[b.local]),
            pa.array(np.full(len(b.lengths), tokens)), add(plain[b.local]), add(log_pair[b.pair]),
        ]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Tokens are the words, A-Z lower-cased, and one end per text; null counts as empty, so such a text has the end alone.
    The model learns from all documents but those with crc32(doc_id) mod 10 = 0.  Its probability of a token is a
    mixture, normalised for every context, of the smoothed relative frequency after the word before, quantised to 8 bits (never upwards), and
    the base probability.  The mixture's weight depends on the size of the context and is learned from the
    training bigrams, each left out of its own counts.  Without training tokens the base model alone is left, which then knows no word.
    Repeated rows are documents of their own.

    Texts become blocks of numbered tokens once.  A block sends each shard its distinct words, and later its distinct bigrams, and gets
    answers in the same order, so the shuffles carry distinct entries per block only.  A shard of bigrams is one trie.
    A worker that deals or scores bigrams holds one block with its answers at a time, one that answers a shard.
    Contexts with more than a quarter of a shard's share are split over all shards.  The driver sees sums only.
    """
    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    as_text = kind.simpleString()
    made = f"block long, ids array<{as_text}>, docs long, held binary, lengths binary, tokens long, local binary, words long, vocab binary, counts binary"
    blocks = stored(docs.mapInArrow(_blocks(to_arrow_type(kind)), made), "blocks")
    entries, tokens_all = blocks.agg(F.sum("words"), F.sum("tokens")).first()
    schema = T.StructType(
        [
            T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
        ]
    )
    word_shards, pair_shards = max(1, ceil((entries or 0) / SHARD)), max(1, ceil((tokens_all or 0) / SHARD))

    sent = blocks.select("block", "words", "vocab", "counts").mapInArrow(_split_words(word_shards), "shard long, block long, n long, vocab binary, counts binary")
    counted = sent.groupBy("shard").applyInPandas(_count_words(word_shards), "block long, shard long, n long, number binary, total binary, all_tokens long, all_words long")
    counted = stored(counted, "words")
    tokens, words = (int(x or 0) for x in counted.agg(F.sum("all_tokens"), F.sum("all_words")).first())
    replies = counted.where("block >= 0").select("block", "shard", "n", "number", "total")
    blocks = blocks.drop("counts")

    pairs = blocks.drop("ids").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_split_pairs(word_shards, pair_shards, tokens, words), _PAIRS)
    answered = pairs.groupBy("shard").applyInPandas(_answer, "block long, shard long, n long, codes binary, book binary, weights array<double>, sums array<double>")
    answered = stored(answered, "answers")
    bins = answered.where("block < 0").select(F.posexplode(F.arrays_zip("weights", "sums")).alias("at", "x")).groupBy("at").agg(F.sum("x.weights").alias("n"), F.sum("x.sums").alias("s"))
    weights, sums = np.zeros(CONTEXT_BINS * GAIN_BINS), np.zeros(CONTEXT_BINS * GAIN_BINS)
    for r in bins.collect():  # at most CONTEXT_BINS * GAIN_BINS rows
        weights[r["at"]], sums[r["at"]] = r["n"], r["s"]
    answers = answered.where("block >= 0").select("block", "shard", "n", F.col("codes").alias("first"), F.col("book").alias("second"), F.lit(True).alias("scored"))
    replies = replies.select("block", "shard", "n", F.col("number").alias("first"), F.col("total").alias("second"), F.lit(False).alias("scored"))
    told = replies.union(answers).groupBy("block")
    return blocks.groupBy("block").cogroup(told).applyInArrow(_score(word_shards, pair_shards, tokens, words, bigram_weights(weights, sums)), schema)
