"""Vectors, pages, the pipeline and the SQL of the queries."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from evenkeel.llm import maxscore, warc
from evenkeel.llm.oracles import ORACLES
from evenkeel.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_scores_of_a_shard_are_exact():
    rng = np.random.default_rng(3)
    for trial in range(60):
        n, d = rng.integers(1, 400), rng.integers(1, 40)
        postings = rng.integers(-5 if trial % 2 else -300, 6 if trial % 2 else 300, (d, n)).astype(np.int64)
        ids, copies = rng.integers(0, 300, n), rng.integers(1, 4, n)
        own, query = ids[0], (postings[:, 0] if trial % 3 else rng.integers(-300, 300, d))
        scores = query @ postings
        wanted = []
        for score, i, times, v in zip(scores, ids, copies, postings.T):
            wanted += [(-int(score), int(i))] * (int(times) - (i == own and (v == query).all()))
        wanted = sorted(wanted)[:5]
        assert maxscore.top_of_shard(query, postings, ids, copies, own, 5) == [(-s, i) for s, i in wanted]
        if len(wanted) == 5:
            least = -wanted[-1][0]
            assert maxscore.top_of_shard(query, postings, ids, copies, own, 5, least) == [(-s, i) for s, i in wanted]
            assert maxscore.top_of_shard(query, postings, ids, copies, own, 5, least - 7) == [(-s, i) for s, i in wanted]


def test_search_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 40)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(-50, 250)]
    rows += [(300, None), (None, [1.0] * 6), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6)]
    # rows that share an id: equal ones, others, shorter ones that are equal when filled up
    rows += [(7, rows[57][1]), (0, rows[50][1]), (0, [2.0] * 6), (1, [9.0] * 6), (1, [9.0] * 6), (50, [0.5, 0.25]), (50, [0.5, 0.25, 0.0])]
    rows += [(304, [0.5, 0.25]), (305, []), (350, [1e18] * 6), (351, [-1e300] + [0.25] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, shard int, rank int")
    found = Counter(tuple(r) for r in maxscore.search(df, F.col("vec_id") % 50 == 0).collect())
    edge = 2**63 - 1
    cut = lambda x: min(max(x, -edge - 1), edge)
    valid = [
        (i, [cut(math.floor(256 * x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    wanted = Counter()
    for n, (q, a) in enumerate(valid):
        if q % 50 == 0:
            scores = sorted((-cut(sum(x * y for x, y in zip(a, b))), i) for m, (i, b) in enumerate(valid) if m != n)
            wanted.update((q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:5]))
    assert found == wanted
    assert maxscore.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = maxscore.search(df.where("vec_id IN (0, 2)"), F.col("vec_id") % 50 == 0)
    assert sorted(r["rank"] for r in few.collect()) == sorted([1, 2, 3] * 3)


def test_scores_of_a_block_are_exact():
    rng = np.random.default_rng(5)
    for trial in range(40):
        n, d, m = rng.integers(1, 4000), rng.integers(1, 40), rng.integers(1, 30)
        most = (4, 300, 10**6)[trial % 3]
        columns = rng.integers(-most, most + 1, (d, n))
        if trial % 2:  # few dimensions that count: most candidates are left out by the others' bounds
            columns[3:] //= most
        ids, copies = np.sort(rng.integers(0, 2 * n, n)), rng.integers(1, 4, n)
        _, first = np.unique(np.vstack([ids, columns]), axis=1, return_index=True)
        ids, copies, columns = ids[np.sort(first)], copies[np.sort(first)], columns[:, np.sort(first)]
        at = rng.integers(0, len(ids), m)
        queries, own = columns[:, at].T.copy(), ids[at].copy()
        own[::3] = -1
        wanted = []
        for q, o in zip(queries, own):
            n_of = copies - ((ids == o) & (columns == q[:, None]).all(0))
            wanted.append(sorted((-int(s), int(i)) for s, i, c in zip(q @ columns, ids, n_of) for _ in range(c))[:5])
        kth = [w[-1] if len(w) == 5 else None for w in wanted]
        kind = maxscore._exact(queries, columns)
        for known in (0, 1):  # without and with thresholds
            least = np.array([-k[0] if known and k else maxscore._NONE for k in kth])
            after = np.array([k[1] if known and k else 2**63 - 1 for k in kth])
            row, i, score, c = maxscore.top_of_block(queries, own, ids, copies, columns, 5, least, after, kind)
            found = [sorted((-int(s), int(e)) for s, e, k in zip(score[row == r], i[row == r], c[row == r]) for _ in range(k))[:5] for r in range(m)]
            assert found == wanted and max(np.bincount(row, minlength=1)) <= 5


def test_search_does_not_copy_shards_for_every_block(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 20)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(6)
    vectors = rng.integers(-3, 4, (2000, 8))
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")

    def handed(top):
        def run(batches):
            for batch in batches:
                for n in range(batch.num_rows):
                    size = sum(len(c[n].as_py() or b"") for c in batch.columns if c.type == pa.binary())
                    cells = (0, random.getrandbits(30), 1, 0, 0, size)
                    types = (pa.int32(), pa.int32(), *[pa.int64()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], ["block", "row", "times", "query_id", "vec_id", "score"])

        return run

    with monkeypatch.context() as m:
        m.setattr(maxscore, "_search", handed)
        total = maxscore.search(df, F.lit(True)).agg(F.sum("score")).first()[0]
    assert total < 20 * 2000 * 80  # eight bytes a number; each pair of a block and a shard would be 200 times the table
    found = {(r.query_id, r.rank): (-r.score, r.vec_id) for r in maxscore.search(df, F.lit(True)).collect()}
    scores = vectors @ vectors.T
    for q in range(2000):
        wanted = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
        assert [found[q, rank] for rank in range(1, 6)] == wanted


def test_rows_of_one_id_are_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [5.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    best = maxscore.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in best] == [(1, 5 * 256**2), (2, 2 * 256**2), (1, 256**2)]


PAGES = [
    (1, "http://a.example/x", "<title>A &amp; B</title><style>p{}</style><p>one<br>two&nbsp;three</p><!-- no --><a href='/l?a=1&amp;b'>link</a><script>if (a</b>) x</script>end"),
    (2, None, None),
    (3, "http://b.example/", ""),
    (None, "http://c.example/", "<p>é \U0001f600 a < b</p>"),
    (4, "http://d.example/", "<div>" * 3000 + "deep"),
    (5, "http://e.example/", "line\r\n\r\nWARC/1.1\r\nX: y"),
]


def test_derived_records(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES + PAGES[:1]], "page_id long, url string, html string, block int")
    responses = warc.responses_of(pages)
    found = warc.derive(responses).collect()
    assert len(found) == 2 * (len(PAGES) + 1)
    sources = {r.record_id: r for r in responses.collect()}
    by_id = {r.record_id: r for r in found}
    for r in found:
        data = r.block.encode()
        assert r.refers_to in sources and r.target_uri == sources[r.refers_to].target_uri and r.content_length == len(data)
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        other = by_id[r.concurrent_to]
        assert other.concurrent_to == r.record_id and other.warc_type != r.warc_type and other.refers_to == r.refers_to
        if r.warc_type == "metadata":
            payload = sources[r.refers_to].payload.encode()
            assert f"source-payload-digest: {warc.digest(payload)}\r\n" in r.block
            assert "source-header-content-type: text/html; charset=utf-8\r\n" in r.block
    text = {r.target_uri: r.block for r in found if r.warc_type == "conversion"}
    assert text["http://a.example/x"] == "A & B\none\ntwo three\nlink end" and text[None] == "" and text["http://c.example/"] == "é \U0001f600 a < b"
    fields = next(r.block for r in found if r.warc_type == "metadata" and r.target_uri == "http://a.example/x")
    assert "title: A & B\r\n" in fields and "outlink: /l?a=1&b\r\n" in fields
    path = str(tmp_path / "warc")
    warc.write(warc.derive(responses), path)
    back = warc.read(spark, path).collect()
    assert all(r.whole for r in back)
    wanted = Counter((r.record_id, r.refers_to, r.block) for r in found)
    assert Counter((r.headers["warc-record-id"], r.headers["warc-refers-to"], r.block) for r in back) == wanted
    assert warc.derive(responses.limit(0)).count() == 0


def test_blocks_with_version_lines_are_put_together(spark, tmp_path):
    inner = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.0\r\n\r\nend é"
    records = [("1.1", "one", inner), ("1.0", "two", ""), ("1.1", "three", "plain"), ("1.0", "four", inner * 3)]
    for n, order in enumerate((records, records[::-1])):
        text = "".join(
            f"WARC/{v}\r\nWARC-Record-ID: {name}\r\ncontent-length: {len(b.encode())}\r\nX: 1\r\nx: 2\r\n\r\n{b}\r\n\r\n" for v, name, b in order
        )
        (tmp_path / f"{n}.warc.gz").write_bytes(gzip.compress(text.encode()))
    short = "WARC/1.1\r\nWARC-Record-ID: cut\r\nContent-Length: 100\r\n\r\nonly this"
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(short.encode()))
    found = warc.read(spark, str(tmp_path)).collect()
    wanted = Counter({(name, b, True): 2 for _, name, b in records}) + Counter({("cut", "only this", False): 1})
    assert Counter((r.headers["warc-record-id"], r.block, r.whole) for r in found) == wanted
    assert all(r.headers["x"] == "1" for r in found if r.whole)


# the plain patterns, which take time with the square of what is never closed
HIDDEN = re.compile(r"<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>", re.I | re.S)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
OUTLINKS = re.compile(r"""<a\s[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|["']?([^"'\s>][^\s>]*))""", re.I)
TOKENS = ["<!--", "-->", "<script", "</script>", "<style>", "</style >", ">", "<", "<p", "</P>", "<a ", "<A\n", "href=", "HREF = ", '"', "'", "x",
          " ", "/l", "<title>", "<title x", "</title>", "&amp;", "b>", "é"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(TOKENS), max_size=30))
def test_pages_are_read_as_by_plain_patterns(tokens):
    page = "".join(tokens)
    shown = HIDDEN.sub(" ", page)
    assert warc._shown(page) == shown
    text = html.unescape(warc._TAGS.sub("", warc._BREAKS.sub("\n", shown)))
    assert warc.plain_text(page) == warc._LINES.sub("\n", warc._SPACES.sub(" ", text)).strip()
    title = TITLE.search(page)
    assert warc._title(page) == (title[1] if title else None)
    assert warc._outlinks(page) == ["".join(q) for q in OUTLINKS.findall(page)]


@pytest.mark.parametrize("unit", ["<!--", "<script ", "<a ", "<title>", "<title ", "<p ", "<", '<a href="', "<a href=", "</script ", "<a b='"])
def test_what_is_never_closed_takes_no_more_time(unit):
    page = unit * (1_000_000 // len(unit))
    for text in (page, page + ">"):
        began = time.process_time()
        warc.plain_text(text)
        warc._fields("", text)
        assert time.process_time() - began < 20


def test_links_end_at_their_own_quote():
    page = """<a href="/o'brien"><a href='/say "hi"'><a href="/a b.html"><a href=/bare'x>y</a><a href=""><a class=k href = '/l?a=1&amp;b'>"""
    links = [line[9:] for line in warc._fields("", page).split("\r\n") if line.startswith("outlink: ")]
    assert links == ["/o'brien", '/say "hi"', "/a b.html", "/bare'x", "/l?a=1&b"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    mine = QUERIES[name](spark, SMALL)
    theirs = con.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(mine.columns)
    assert Counter(map(tuple, mine.select(columns).collect())) == Counter(theirs.fetchall())


def test_queries_have_numbers():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_keeps_its_contract(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert rows
        before = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert last.count() == before.count()
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in last.collect())


def test_pipeline_with_no_documents(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
