"""Registered queries on the supplied tables: SQL twins, contracts and the pipeline."""

import glob
import os
import re

import cases
import corpus_pipeline
import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from test_dedup import plain_exact, plain_near

from ironlog.llm import bpe, queries
from ironlog.llm.common import stored

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not installed")


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    result = duck.execute(queries.statements()[name])
    names = [c[0] for c in result.description]
    got = queries.registry()[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(names)
    assert cases.rows(got, *names) == sorted(map(list, result.fetchall()), key=repr)


def test_near_duplicates_of_the_supplied_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert cases.rows(queries.op10_minhash_forest(spark, SF_DIR)) == plain_near(docs)


def test_main_text_of_the_supplied_pages(spark):
    from html import unescape

    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in queries.op6_line_blocks(spark, SF_DIR).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", html[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        lines = [re.sub(r"[ \t-\r]+", " ", unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in blocks]
        assert r["text"] == "\n".join(x for x in lines if x)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF_DIR), name)
        kept[name] = (before, docs)
        assert name == names[-1] or docs.columns == columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    plain = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    before, after = kept["quality"]
    scored = queries.op1_additive_quality(spark, SF_DIR).where("predicted = 1")
    assert ids(after) == ids(scored)
    before, after = kept["exact_dedup"]
    assert ids(after) == sorted(r[0] for r in plain_exact(plain(before)) if r[3])
    before, after = kept["near_dedup"]
    assert ids(after) == sorted(r[0] for r in plain_near(plain(before)) if r[3])
    before, after = kept["mixing"]
    text = dict(plain(before))
    assert all(t in text[i] for i, t in plain(after))
    total = lambda df: sum(len(cases.words(t)) for _, t in plain(df))
    assert total(after) == pytest.approx(1.5 * total(before), rel=0.01)
    before, after = kept["byte_bpe"]
    exact = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(queries.RANKS)), special_tokens={})
    want = sorted((i, exact.encode_ordinary(t)) for i, t in plain(before))
    assert sorted((r["doc_id"], list(r["ids"])) for r in after.collect()) == want
