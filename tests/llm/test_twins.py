"""Queries against their SQL twins, and those without one against brute force, on whole small tables."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from lendframe.llm import pieces, quality
from lendframe.llm.common import remainder
from lendframe.llm.queries import QUERIES, SQL
from tests.llm.helpers import Union, brute_windows
from tools.check import TABLES, norm


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.sql("select doc_id, text from documents").fetchall()


def test_registered():
    q = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in q if k[:2] == "op"}
    assert "pipeline" in q and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(names) == cols
    assert sorted(got, key=key) == sorted(want, key=key)


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(docs):
    fp = {i: slow_fingerprint(t) for i, t in docs}
    u = Union()
    ids = sorted(fp)
    for k, a in enumerate(ids):
        u.find(a)
        for b in ids[:k]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                u.join(a, b)
    return fp, {i: u.find(i) for i in ids}


def test_op1(spark, sf, docs):
    fp, comp = near_components(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, sf).collect()}
    assert got == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


def test_op3(spark, sf, docs):
    from lendframe.llm.vocabulary import tokenizer
    rows = sorted(QUERIES["op3_training_order"](spark, sf).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert len({len(r.payload) for r in rows}) == 1
    enc, text = tokenizer(), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.part)):
        text.setdefault(r.doc_id, []).extend(np.frombuffer(r.payload, np.uint16)[:r.n_ids].tolist())
    assert {k: (enc.decode(v[:-1]), v[-1]) for k, v in text.items()} == {i: (t, 50256) for i, t in docs}
    assert [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)


def test_op6(spark, sf, docs):
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op6_maxent_lm"](spark, sf).collect()
    assert len(rows) == len(toks)
    for r in rows:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
        assert r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op7(spark, sf, docs):
    rows = {r.doc_id: r for r in QUERIES["op7_merge_dropout"](spark, sf).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(r.lossless and r.n_pieces == len(r.piece_ids) for r in rows.values())
    plain = sp.encode([t for _, t in docs])
    assert [sp.decode(list(rows[i].piece_ids)) for i, _ in docs] == [t for _, t in docs]
    differ = sum(list(rows[i].piece_ids) != p for (i, _), p in zip(docs, plain, strict=True))
    assert differ > 0.9 * len(docs) and sum(r.n_pieces for r in rows.values()) > sum(map(len, plain))


def auc(y, s):
    r = np.argsort(np.argsort(s)) + 1.0
    pos = y == 1
    return (r[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("name,label,floor", [("op9_toxic_spans", "toxic", 0.9), ("op10_quality_passages", "quality", 0.98)])
def test_held_out_accuracy(spark, name, label, floor):
    sf = "/root/testdata/sf0.1"
    lab = dict(duckdb.sql(f"select doc_id, {label} from '{sf}/labels.parquet'").fetchall())
    rows = QUERIES[name](spark, sf).collect()
    out = [r for r in rows if r.held_out and r.doc_id in lab]
    y, s = np.array([lab[r.doc_id] for r in out]), np.array([r.score for r in out])
    assert auc(y, s) > floor and np.mean([r.predicted == lab[r.doc_id] for r in out]) > 0.96
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_pipeline(spark, sf, con):
    """The stages after the trained one, by brute force over what that one keeps."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(table, labels.filter(remainder("doc_id", 3) != 1))
    docs = con.sql("select doc_id, text from documents order by doc_id").fetchall()
    good = [(i, t) for (i, t), s in zip(docs, model.score([(t or "").encode() for _, t in docs]), strict=True) if s >= 0.5]
    first = {}
    for i, t in good:
        first.setdefault(t or "", i)
    left = [(i, t) for i, t in good if first[t or ""] == i]
    _, comp = near_components(left)
    left = [(i, t) for i, t in left if comp[i] == i]
    grams = {tuple(g) for (t,) in con.sql("select text from benchmark").fetchall() for g in brute_windows(t)[1]}
    sizes = {len(g) for g in grams}

    def clean(t):
        w, _ = brute_windows(t)
        return not any(tuple(w[i:i + k]) in grams for k in sizes for i in range(len(w) - k + 1))
    want = {i: t for i, t in left if clean(t)}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(want) and len(rows) == len(want) and 0 < len(want) < len(docs)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(r.lossless and sp.decode(list(r.piece_ids)) == want[r.doc_id] for r in rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "encoding"]


def test_stages_keep_the_columns(spark, sf):
    from lendframe.llm.common import DOC_COLUMNS
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, sf).columns == list(DOC_COLUMNS)


def test_turn_digest_is_of_the_raw_turns(spark, sf):
    """The extra conversation, written out by hand."""
    text = r"\### Assistant: </turn> ok"
    r = [x for x in QUERIES["op4_chat_prefix_tree"](spark, sf).collect() if x.conv_id == -7][0]
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (r.loss_chars, r.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
