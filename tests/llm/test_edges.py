"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lendframe.llm import (chat_tree, decontaminate, exact_dedup, maxent_lm, pieces, quality, simhash, toxicity, training_order,
                           url_reputation)
from lendframe.llm.components import connected_components
from tests.llm.helpers import DOCS, LONG, Union, brute_windows, edge_docs, no_docs


def brute_links(values, bits):
    u = Union()
    for a, b in itertools.combinations(sorted(values), 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits:
            u.join(a, b)
    return {x: u.find(x) for x in values}


@pytest.mark.parametrize("bits,paired", [(1, 32), (2, 32), (2, 2), (1, 2)])
def test_links_equal_all_pairs(spark, bits, paired):
    r = random.Random(bits * 10 + paired)
    values = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            values.add(x)
            for _ in range(r.choice([1, 1, 2, 3])):
                x ^= 1 << r.randrange(64)
    values = {simhash._signed(v) for v in values}
    fps = spark.createDataFrame([(v,) for v in values], "fp bigint")
    e = simhash.links(fps, bits, paired)
    got = {row.node: row.root for row in connected_components(e).collect()}
    want = brute_links(values, bits)
    groups = lambda m: {frozenset(k for k in m if m[k] == r_) for r_ in set(m.values())}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(200)] + [(1000, 1000), (1001, 1000)]
    e = spark.createDataFrame(path + star, "a bigint, b bigint")
    got = {}
    for r in connected_components(e).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(301)), list(range(1000, 1201))]


def test_simhash_edges(spark):
    rows = simhash.near_groups(edge_docs(spark)).collect()
    assert len(rows) == 12
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[4] == by[11] == {("0" * 16, 2)}  # no words: zero, linked like any other
    assert by[1] == by[6] and len(by[7]) == 1
    assert simhash.near_groups(no_docs(spark)).count() == 0
    kept = simhash.keep_one(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert {3, 4, 6, 11}.isdisjoint(r.doc_id for r in kept.collect())


def test_fingerprint_of_a_long_text_is_cut_into_blocks(monkeypatch):
    want = simhash.fingerprint(LONG.encode())
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    assert simhash.fingerprint(LONG.encode()) == want


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    """``weak`` uses a hash of two bits, so that most groups hold several texts."""
    fn = (lambda t: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(t), F.lit(4))), 2, "0"))) if weak else exact_dedup.content_hash
    rows = [(i, r.text) for i, r in enumerate(edge_docs(spark).collect())] + [(100 + i, "hot") for i in range(50)]
    d = spark.createDataFrame([(*r, "x", "y", None) for r in rows], DOCS)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for keep, pick in (("min", min), ("max", max)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(d, keep=keep, hash_fn=fn).collect()}
        assert got == {i: (pick(groups[t or ""]), len(groups[t or ""]), pick(groups[t or ""]) == i) for i, t in rows}


def test_exact_edges(spark):
    d = edge_docs(spark)
    rows = exact_dedup.exact_groups(d, keep="max").collect()
    assert len(rows) == 12 and sum(r.kept for r in rows if r.doc_id == 7) == 2
    assert [r.keep_id for r in rows if r.doc_id is None] == [None]
    assert {r.doc_id for r in rows if r.kept} == {4, 5, 6, 7, None, 9, 10, 11}
    assert exact_dedup.exact_groups(no_docs(spark)).count() == 0
    assert exact_dedup.drop_copies(d).columns == d.columns and exact_dedup.drop_copies(d).count() == 8


def one_of_each(rows, group):
    """Brute force: of each group the row with the smallest id, null ids last."""
    best = {}
    for r in rows:
        best.setdefault(group(r), []).append(r)
    return sorted(min(((r[0] is None, r[0] or 0) for r in g)) for g in best.values()), {group(r) for r in rows}


@pytest.mark.parametrize("stage", ["exact", "near"])
def test_one_row_of_each_group_stays(spark, stage):
    """Ids that repeat with other texts, null ids, rows repeated whole, clashing columns."""
    a, b, c, d = "the cat sat on the mat all day long", "quite another text about ships and sails", "x", "numbers one two three four five six"
    space = (lambda t: t) if stage == "exact" else (lambda t: t.replace(" ", "  "))  # the same words: the same fingerprint
    rows = [(4, a), (5, space(a)), (5, b), (5, b), (None, space(b)), (None, c), (None, c), (None, d), (9, space(d)), (9, space(d)), (None, None), (None, ""),
            (7, a), (7, "rows of one id and another text"), (7, "and a third text of the same id 7")]
    df = spark.createDataFrame([(i, t, "en", k % 2, "z", 1.0) for k, (i, t) in enumerate(rows)],
                               "doc_id bigint, text string, lang string, grp int, id string, v double")
    keep = exact_dedup.drop_copies if stage == "exact" else simhash.keep_one
    got = keep(df)
    assert got.columns == df.columns
    words = lambda t: " ".join((t or "").split())
    out = [(r.doc_id, r.text) for r in got.collect()]
    want, groups = one_of_each(rows, lambda r: words(r[1]))
    assert sorted((i is None, i or 0) for i, _ in out) == want
    assert {words(t) for _, t in out} == groups and len(out) == len(groups)
    last = exact_dedup.drop_copies(df, keep="max").collect()
    assert len(last) == len({r.text or "" for r in last}) == len({t or "" for _, t in rows})


def test_dedup_stages_with_repeated_and_null_ids(spark, sf):
    """Both stages of the pipeline in a row, against brute force."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in table.orderBy("doc_id").limit(40).collect()]
    rows += [rows[3], rows[3], (None, *rows[5][1:]), (None, *rows[5][1:]), (rows[7][0], "a text of its own under an id that another row has", "en", None, None),
             (None, "a text whose rows have no id", "en", "s", 1), (None, "a text whose rows have no id", "en", "s", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, table.schema)
    for stage in (corpus_pipeline.without_copies, corpus_pipeline.without_near_copies):
        docs = stage(spark, docs, sf)
    got = [(r.doc_id, r.text) for r in docs.collect()]
    fps = {t or "": simhash.fingerprint((t or "").encode()) for _, t, *_ in rows}
    u = Union()
    for x, y in itertools.combinations(set(fps.values()), 2):
        if (x ^ y).bit_count() <= 2:
            u.join(x, y)
    want, groups = one_of_each(rows, lambda r: u.find(fps[r[1] or ""]))
    assert sorted((i is None, i or 0) for i, _ in got) == want
    assert {u.find(fps[t or ""]) for _, t in got} == groups and len(got) == len(groups)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://a.example.org/es/x?q#f", "x://b.co.uk:80/p?x",
            "http://h.com#f", "http://example.org/en/12", "http://notexample.org/en/12", "http://u://v/w"]
    p = spark.createDataFrame([(i, u, 1.0, "h", "p") for i, u in enumerate(urls + urls[4:6])],
                              "page_id bigint, url string, bound double, host string, path string")
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block")]
    out = spark.createDataFrame([("a.example.org", 1), ("h.com", 0), ("h.com", None)], "host string, good int")
    got = {r.page_id: r for r in url_reputation.judge(p, out, rules).collect()}
    assert [(got[i].host, got[i].path) for i in range(len(urls))] == [
        ("", ""), ("", ""), ("", ""), ("", ""), ("a.example.org", ""), ("a.example.org", "/es/x"), ("b.co.uk:80", "/p"), ("h.com", ""),
        ("example.org", "/en/12"), ("notexample.org", "/en/12"), ("u:", "//v/w")]
    assert [got[i].rule for i in (4, 5, 8, 9)] == [None, "example.org/es/", "example.org/en/1", "org/"]
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and len(got) == 13
    none = spark.createDataFrame([], "host string, good int")
    assert url_reputation.judge(p, none, []).count() == 13
    assert url_reputation.judge(p.limit(0), none, rules).count() == 0


def test_shrinkage_pulls_small_hosts_to_their_domain(spark):
    rows = [(f"h{i}.{d}.com", int(j < k)) for d, k in (("good", 4), ("bad", 1)) for i in range(40) for j in range(5)]
    rows += [("new.bad.com", 1)]
    hosts = spark.createDataFrame([(h,) for h in {h for h, _ in rows} | {"fresh.good.com", "other.net"}], "host string")
    post = {r.host: r.alpha / (r.alpha + r.beta) for r in url_reputation.host_posteriors(
        spark.createDataFrame(rows, "host string, good int"), hosts).collect()}
    assert post["fresh.good.com"] > 0.75 > 0.4 > post["new.bad.com"] > post["h1.bad.com"]
    assert post["h1.bad.com"] < post["other.net"] < post["h1.good.com"]


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        got = training_order.slots(np.arange(n), n, 5)
        assert sorted(got.tolist()) == list(range(n))
    assert training_order.slots(np.arange(1000), 1000, 5).tolist() != training_order.slots(np.arange(1000), 1000, 6).tolist()


def plain_levels(host, suffixes):
    """Registered domain and suffix, label by label."""
    label = host.split(".")
    best = 1
    for m in range(1, len(label) + 1):
        tail, above = ".".join(label[-m:]), ".".join(label[len(label) - m + 1:])
        if tail in suffixes or (m > 1 and "*." + above in suffixes):
            best = max(best, m)
    for m in range(1, len(label) + 1):
        if "!" + ".".join(label[-m:]) in suffixes:
            best = m - 1
    return ".".join(label[-best - 1:]), ".".join(label[-best:])


@pytest.mark.parametrize("suffixes", [(), url_reputation.LONG_SUFFIXES, ("uk.com", "a.b.c.jp", "*.ck", "!www.ck", "*.k.jp", "!city.k.jp")])
def test_suffixes_of_a_list(spark, suffixes):
    hosts = ["", "com", "a.com", "x.y.co.uk", "co.uk", "uk", "me.github.io", "b.c.jp", "a.b.c.jp", "q.a.b.c.jp", "www.ck", "x.www.ck", "shop.ck",
             "x.shop.ck", "ck", "city.k.jp", "t.city.k.jp", "t.u.k.jp", "k.jp", "n.uk.com", "..", "a..co.uk"]
    d = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_reputation.domain_levels(F.col("host"), suffixes)
    got = {r.host: (r.d, r.s) for r in d.select("host", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == {h: plain_levels(h, suffixes) for h in hosts}


def test_reputation_under_another_list(spark):
    pages = spark.createDataFrame([(1, "http://bad.github.io/x"), (2, "http://fine.github.io/y"), (3, "http://new.github.io/z"), (4, "http://a.com/" + "p" * 100_000)],
                                  "page_id bigint, url string")
    seen = spark.createDataFrame([("bad.github.io", 0)] * 40 + [("fine.github.io", 1)] * 40 + [("a.com", 1)], "host string, good int")
    for suffixes in ((), ("github.io",)):
        rows = {r.page_id: r for r in url_reputation.judge(pages, seen, [], suffixes=suffixes).collect()}
        assert (rows[1].verdict, rows[2].verdict, len(rows[4].path)) == ("block", "allow", 100_001)
        post = {r.host: (r.alpha, r.beta) for r in url_reputation.host_posteriors(seen, pages.select(
            url_reputation.host_of(F.col("url")).alias("host")), suffixes).collect()}
        assert len(post) == 4


def plain_slot(number, total, key):
    """The place of one number, with Python's integers and one step at a time."""
    full = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)
    half = 1
    while 1 << (2 * half) < total:
        half += 1
    while True:
        left, right = number >> half, number % (1 << half)
        for r in range(4):
            k = (key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & full
            left, right = right, left ^ (mix((mix((right + k) & full) + k) & full) % (1 << half))
        number = (left << half) | right
        if number < total:
            return number


def test_slots_equal_a_plain_network():
    for n, key in ((1, 3), (2, 3), (100, 0), (4097, 9), (70000, 20240607)):
        at = range(0, n, max(1, n // 500))
        assert training_order.slots(np.array(at), n, key).tolist() == [plain_slot(i, n, key) for i in at]


def plain_sequences(docs, length):
    """Every sequence of every text: (id, place in the text, ids without padding), as a sorted list."""
    from lendframe.llm.vocabulary import tokenizer
    out = []
    for r in docs.collect():
        ids = [*tokenizer().encode_ordinary(r.text or ""), training_order.END]
        out += [(r.doc_id, i // length, tuple(ids[i:i + length])) for i in range(0, len(ids), length)]
    return sorted(out, key=str)


def test_shards(spark, tmp_path):
    d = edge_docs(spark)
    s = training_order.ordered_sequences(d, 3, length=16, per_shard=8)
    rows = {r.slot: r for r in s.collect()}
    assert sorted((r.doc_id, r.part, tuple(np.frombuffer(r.payload, np.uint16)[:r.n_ids].tolist())) for r in rows.values()
                  if r.doc_id is not None) == sorted(x for x in plain_sequences(d, 16) if x[0] is not None)
    path = str(tmp_path / "shards")
    n = training_order.write_shards(d, 3, path, length=16, per_shard=8)
    assert sorted(rows) == list(range(n))
    for a, b in ((0, n), (5, 23), (n - 1, n), (3, 3), (n - 3, n + 50)):
        got = {r.slot: r for r in training_order.read_slots(spark, path, a, b).collect()}
        assert sorted(got) == list(range(a, min(b, n)))
        for k, r in got.items():
            w = rows[k]
            assert (r.shard, r.row, r.id, r.part, r.n_ids, r.payload) == (
                w.shard, w.row, None if w.doc_id is None else str(w.doc_id), w.part, w.n_ids, w.payload)
    files = sorted((tmp_path / "shards" / "shards").glob("shard=*/*.txt"))
    assert len(files) == -(-n // 8)
    assert len({f.stat().st_size for f in files}) <= 2  # a fixed stride; the last shard may be shorter
    assert s.filter("n_ids = 1").count() >= 3  # null and empty texts: the end mark alone
    assert training_order.ordered_sequences(no_docs(spark), 3).count() == 0


def test_shards_of_text_ids_and_of_nothing(spark, tmp_path):
    d = spark.createDataFrame([("a\nb", "one two"), (None, "three"), ("", None), ("\u00e9" * 40, LONG), ("a\nb", "one two")],
                              "doc_id string, text string")
    path = str(tmp_path / "named")
    training_order.write_shards(d, 11, path, length=8, per_shard=1000)
    got = [(r.id, r.part, tuple(np.frombuffer(r.payload, np.uint16)[:r.n_ids].tolist()))
           for r in training_order.read_slots(spark, path).collect()]
    assert sorted(got, key=str) == plain_sequences(d, 8)
    empty = str(tmp_path / "empty")
    assert training_order.write_shards(no_docs(spark), 11, empty) == 0
    assert training_order.read_slots(spark, empty).count() == 0


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|>\n<^| \\x"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"),
         (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (3, 2, "user", None), (4, 0, None, ""), (4, 0, "a|>\n%", "tie"),
         (5, 0, "user", "hi"), (5, 1, "assistant", "<|end|>\n<^| \\x"), (6, None, "system", "s"), (None, 0, "user", "no id"),
         (7, 0, "user", "hi"), (7, 1, "assistant", "<|end|>\n<^| \\x"), (7, 2, "user", "more"), (7, 3, "assistant", "<")]


def test_tree(spark):
    d = spark.createDataFrame([(*t, "x", 1) for t in TURNS],
                              "conv_id bigint, turn bigint, role string, text string, node string, depth int")
    tree = chat_tree.build(d)
    nodes = {bytes(r.node): r for r in tree.nodes.collect()}
    tokens = {k: np.frombuffer(r.tokens, np.uint16).tolist() for k, r in nodes.items()}
    stream = {}
    for k, r in nodes.items():
        for i, t in enumerate(tokens[k]):
            assert r.emit_start + i not in stream
            stream[r.emit_start + i] = t
    assert sorted(stream) == list(range(len(stream)))
    convs = {}
    for r in sorted(tree.paths.collect(), key=lambda r: r.depth):
        convs.setdefault(r.conv, []).append(nodes[bytes(r.node)])
    want = {}
    for c, t, ro, te in TURNS:
        want.setdefault(c, []).append((t if t is not None else -1, ro or "", te or ""))
    for c, path in convs.items():
        whole = [t for n in path for t in tokens[bytes(n.node)]]
        assert chat_tree.parse(chat_tree.tokenizer().decode(whole)) == [x[1:] for x in sorted(want[c])]
        pos = 0
        for n in path:
            assert n.position == pos
            seen = [stream[i] for a in n.attends for i in range(a.start, a.stop)]
            assert seen == whole[:pos]  # exactly the ancestors
            pos += len(tokens[bytes(n.node)])
    by = sorted(nodes.values(), key=lambda r: r.emit_start)
    done, stack = set(), []
    for n in by:  # depth first: the parent is on the current way down
        while stack and stack[-1] != n.parent:
            stack.pop()
        assert stack or n.parent is None
        stack.append(n.node)
        done.add(bytes(n.node))
    got = {r.conv_id: r for r in chat_tree.read_back(tree).collect()}
    assert set(got) == set(want) and got[3].n_turns == 3 and got[4].n_turns == 2
    assert chat_tree.read_back(chat_tree.build(d.limit(0))).count() == 0


def test_language_model_edges(spark):
    d = edge_docs(spark)
    rows = maxent_lm.score(d, F.col("doc_id") == 9).collect()
    assert len(rows) == 12 and all(np.isfinite([r.score, r.base_score]).all() for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 4, 11)] == [1] * 4
    assert maxent_lm.score(no_docs(spark), F.lit(False)).count() == 0
    only_held = maxent_lm.score(d, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in only_held)


def test_language_model_outside_the_head(spark, monkeypatch):
    """The same base scores when most words go through the join."""
    d = edge_docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    whole = {r.doc_id: r for r in maxent_lm.score(d, F.col("doc_id") == 9).collect()}
    monkeypatch.setattr(maxent_lm, "HEAD", 40)
    few = {r.doc_id: r for r in maxent_lm.score(d, F.col("doc_id") == 9).collect()}
    for i, r in whole.items():
        assert few[i].base_score == pytest.approx(r.base_score, rel=1e-9)
        assert (few[i].n_known, few[i].n_tokens) == (r.n_known, r.n_tokens)


def test_language_model_is_a_distribution(spark):
    """Known words, the end mark and each class's share for unseen words have probability one together."""
    d = spark.createDataFrame([(i, f"a b c{i % 3} d. e{i % 2}, a b") for i in range(40)], "doc_id bigint, text string")
    model, counts = maxent_lm.fit(d.select(F.col("text").alias("t"), F.lit(False).alias("held")))
    total = 0.0
    for w in [*(bytes(r.w) for r in counts.collect()), None]:
        code, kind, context, _, _ = model.read([b"a b" + (b" " + w if w else b"")])
        p = model.class_log10(kind, context, np.full(maxent_lm.CONTEXTS, np.nan, np.float32)) + model.within[code]
        at = len(code) - (2 if w else 1)
        total += 10 ** p[at]
    z = model.logits(context[-1:])[0].astype(float)
    share = np.exp(z - z.max())
    share /= share.sum()
    own = min(maxent_lm.SINGLE, model.m)
    empty = share[1 + own:maxent_lm.SINGLE + 1].sum()  # classes that have no word here
    unseen = sum(share[k] * 0.5 / (model.class_n[k] + 0.5 * (model.class_v[k] + 1)) for k in range(maxent_lm.SINGLE + 1, maxent_lm.CLASSES))
    assert total + empty + unseen == pytest.approx(1, abs=1e-4)


def test_language_model_gradient():
    """Observed less expected counts is the slope of the log-likelihood."""
    r = np.random.default_rng(2)
    m = maxent_lm.Weights()
    m.bias = r.normal(0, 1, maxent_lm.CLASSES)
    m.weight = r.normal(0, 1, (maxent_lm.ROWS, maxent_lm.CLASSES))
    context, kind = r.integers(0, maxent_lm.CONTEXTS, 30), r.integers(0, maxent_lm.CLASSES, 30)

    def likelihood():
        z = m.logits(context)
        return (z[np.arange(30), kind] - np.log(np.exp(z).sum(axis=1))).sum()
    seen = sum(np.bincount(f * maxent_lm.CLASSES + kind, minlength=maxent_lm.ROWS * maxent_lm.CLASSES) for f in maxent_lm.feature_rows(context))
    g = (seen - m.expected(context, np.ones(30))).reshape(maxent_lm.ROWS, maxent_lm.CLASSES)
    for f in maxent_lm.feature_rows(context):
        i, k = int(f[3]), int(kind[5])
        m.weight[i, k] += 1e-5
        up = likelihood()
        m.weight[i, k] -= 2e-5
        assert g[i, k] == pytest.approx((up - likelihood()) / 2e-5, abs=1e-5)
        m.weight[i, k] += 1e-5


def test_pieces_equal_the_library_without_dropout():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["", " ", "a", " a  b ", "日本語のテキスト 漢字", "\n\n\t x\r\n", "\U0001F600 emoji", "é" * 200, "a" * 300 + " " + "ab" * 90,
             "<s> </s> <unk> <0x41>", "    four", "ß" * 60 + " " * 40, LONG[:5000]]
    seg = pieces.Segmenter(pieces.Pieces(), rate=0.0)
    assert [p.tolist() for p in seg.encode(texts, list(range(len(texts))))] == sp.encode(texts)


def test_rounds_equal_the_heap():
    seg = pieces.Segmenter(pieces.Pieces(), rate=0.3)
    r = random.Random(1)
    chunks = ["▁" + "".join(r.choice("thereanding▁éx\n") for _ in range(r.randrange(1, 24))) for _ in range(400)]
    codes = pieces.code_points("".join(chunks))
    size = np.array([len(c) for c in chunks])
    starts = np.cumsum(size) - size
    key = pieces.chunk_keys(codes, starts, np.arange(len(chunks)) % 4, 9)
    flat, n = seg.in_rounds(codes, starts, size, key)
    want = [seg.by_heap(codes[a:a + b], k) for a, b, k in zip(starts, size, key, strict=True)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want


def test_pieces_edges(spark, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 500)  # the long text goes in parts
    d = edge_docs(spark)
    rows = pieces.encode_documents(d, carry=["doc_id", "text"]).collect()
    assert len(rows) == 12 and all(r.lossless for r in rows)
    assert [r.n_pieces for r in rows if not r.text] == [0, 0, 0]
    again = pieces.encode_documents(d, carry=["doc_id", "text"], seed=18).collect()
    assert [list(r.piece_ids) for r in rows] != [list(r.piece_ids) for r in again]
    back = pieces.decode_documents(pieces.encode_documents(d), ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in rows)
    assert pieces.encode_documents(no_docs(spark)).count() == 0


def test_slices_change_nothing(monkeypatch):
    seg = pieces.Segmenter(pieces.Pieces())
    whole = seg.encode([LONG], [1])[0].tolist()
    monkeypatch.setattr(pieces, "SLICE", 777)
    assert pieces.Segmenter(pieces.Pieces()).encode([LONG], [1])[0].tolist() == whole


BENCH = [(1, "The cat sat on the mat"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (3, None), (4, "..."), (5, "One"), (None, "no id"),
         (1, "The cat sat on the mat"), (6, "日本語")]


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_hits(spark, block):
    d = edge_docs(spark)
    b = spark.createDataFrame([(*x, 1) for x in BENCH], "item_id bigint, text string, hits int")
    rows = decontaminate.annotate_hits(d, b, block_chars=block).collect()
    pats = [(str(i) if i is not None else "", g) for i, t in BENCH for g in brute_windows(t)[1]]
    assert len(rows) == 12
    for r in rows:
        w, _ = brute_windows(r.text)
        hit, items = set(), set()
        for item, g in pats:
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    items.add(item)
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (len(w), len(hit), len(items), sorted(items))
        for s, h in zip(r.spans, r.hits, strict=True):
            inner, _ = brute_windows(r.text[s.start:s.stop])
            assert inner == w[h.start:h.stop]
    clean = decontaminate.drop_contaminated(d, b)
    assert clean.columns == d.columns and clean.count() == sum(r.n_hit == 0 for r in rows)
    assert decontaminate.report(no_docs(spark), b).count() == 0
    assert decontaminate.report(d, b.limit(0)).filter("contaminated").count() == 0


def test_hits_of_a_window_that_many_items_share(spark):
    """A third of the items hold one window: their ids are spread over blocks, and none is lost."""
    shared = "s1 s2 s3 s4 s5 s6 s7 s8 s9 s10"
    b = spark.createDataFrame([(i, shared if i % 3 == 0 else f"only{i} a b") for i in range(600)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, f"x {shared} y"), (2, "ONLY7 a b"), (3, f"{shared} only8, A b"), (4, "clean")], "doc_id bigint, text string")
    blocks = list(decontaminate._blocks(b, "item_id", "text", 10, 2000))
    assert len(blocks) > 5
    assert max(sum(len(w) + len(i) for w, ids in x.items() for i in ids) for x in blocks) <= 2000
    thirds = {str(i) for i in range(0, 600, 3)}
    got = {r.doc_id: set(r["items"]) for r in decontaminate.annotate_hits(d, b, block_chars=5000).collect()}
    assert got == {1: thirds, 2: {"7"}, 3: thirds | {"8"}, 4: set()}


def test_windows_of_a_long_item_come_in_pieces(spark):
    text = " ".join(f"w{i}" for i in range(25_000))
    b = spark.createDataFrame([(1, text), (2, text), (3, "w1")], "item_id bigint, text string")
    assert decontaminate.window_pairs(b, "item_id", "text").count() == 2 * (25_000 - 9) + 1


def small_field():
    r = np.random.default_rng(3)
    f = toxicity.Field({b"=a": 1, b"=b": 2, b"=c": 3})
    f.theta = r.normal(0, 1, 3 * 4 + 5)
    docs = [f.ids([b"abcx"[i:i + 1] for i in r.integers(0, 4, k)]) for k in (1, 5, 3, 7, 2)]
    return f, docs, r


def log_sum(f, k, tags=None):
    """Score of one tagging, or the log of the sum over all and the marginals."""
    n, th, w = f.n, f.theta, f.kinds()[:, 0]
    get = lambda block, i: th[block * n + w[i]] if w[i] else 0.0

    def one(tags):
        s = 0.0
        for t, g in enumerate(tags):
            if g:
                s += th[3 * n] + get(0, k[t]) + (get(1, k[t - 1]) if t else 0) + (get(2, k[t + 1]) if t + 1 < len(k) else 0)
            s += g * th[3 * n + 1] if t == 0 else [[0, th[3 * n + 2]], [th[3 * n + 3], th[3 * n + 4]]][tags[t - 1]][g]
        return s
    if tags is not None:
        return one(tags)
    allt = list(itertools.product((0, 1), repeat=len(k)))
    e = np.exp([one(t) for t in allt])
    return np.log(e.sum()), (e[:, None] * np.array(allt)).sum(0) / e.sum()


def test_field_marginals_and_gradient(monkeypatch):
    monkeypatch.setattr(toxicity, "COLS", 4)
    f, docs, r = small_field()
    ids, first = np.concatenate(docs), toxicity.first_marks(docs)
    assert f.marginals(ids, first)[0] == pytest.approx(np.concatenate([log_sum(f, k)[1] for k in docs]))
    tags = r.integers(0, 2, len(ids))
    parts = np.split(tags, np.cumsum([len(k) for k in docs])[:-1])
    g = toxicity.gradient(f, ids, first, tags.astype(float), f.kinds())
    for i in range(len(f.theta)):
        if i in (0, f.n, 2 * f.n):
            continue
        v = []
        for e in (1e-5, -1e-5):
            f.theta[i] += e
            v.append(sum(log_sum(f, k, t.tolist()) - log_sum(f, k)[0] for k, t in zip(docs, parts, strict=True)))
            f.theta[i] -= e
        assert g[i] == pytest.approx((v[0] - v[1]) / 2e-5, abs=1e-5)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_trained_operators_edges(spark):
    d = edge_docs(spark)
    for lab in (labels_of(spark, [(1, 1, 0), (5, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (99, 0, 1)]), labels_of(spark, [(1, 1, 1)]),
                labels_of(spark, [])):
        for mod in (toxicity, quality):
            rows = mod.score(d, mod.fit(d, lab)).collect()
            assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
            assert mod.score(no_docs(spark), mod.fit(no_docs(spark), lab)).count() == 0
    assert quality.keep_good(d, quality.QualityModel(0.7)).columns == d.columns


def test_spans_are_in_the_original_text(spark):
    good = [(i, f"Some text, calm word {i % 40} and calm again") for i in range(60)]
    bad = [(100 + i, f"Some Text,  RottenX word {i} and rottenx again") for i in range(40)]
    d = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    lab = labels_of(spark, [(i, 1, 0) for i, _ in good] + [(i, 1, 1) for i, _ in bad])
    for r in toxicity.score(d, toxicity.fit(d, lab)).collect():
        assert r.predicted == (r.doc_id >= 100)
        assert {r.text[s.start:s.stop].lower() for s in r.spans} == ({"rottenx"} if r.predicted else set())


def test_quality_gradient():
    r = np.random.default_rng(0)
    x, starts, y = r.normal(0, 1, (9, quality.WIDTH)), np.array([0, 1, 5, 7]), np.array([1.0, 0, 1, 0])
    theta = quality._initial()
    g = quality.gradient(theta, x, starts, y)

    def loss(t):
        z = quality.forward(t, x, starts)[0]
        return np.mean(np.logaddexp(0, z) - y * z) + quality.DECAY / 2 * (t * t).sum()
    for i in r.integers(0, len(theta), 25):
        e = np.zeros(len(theta))
        e[i] = 1e-5
        assert g[i] == pytest.approx((loss(theta + e) - loss(theta - e)) / 2e-5, abs=1e-6)


def test_pipeline_on_an_empty_table(spark, tmp_path, sf):
    from lendframe.llm.common import DOC_COLUMNS
    no_docs(spark).select(*DOC_COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_invalid_utf8_has_a_defined_result(spark):
    """Bytes that are not valid UTF-8 become replacement characters."""
    raw = [(1, b"good text"), (2, b"bad \xff\xfe byte"), (3, b"\xc3")]
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in raw], "doc_id bigint, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    want = {i: b.decode("utf-8", "replace") for i, b in raw}
    enc = pieces.encode_documents(docs, carry=["doc_id"])
    assert all(r.lossless for r in enc.collect())
    assert {r.doc_id: r.text for r in pieces.decode_documents(enc, ["doc_id"]).collect()} == want
    from lendframe.llm.vocabulary import tokenizer
    seqs = training_order.ordered_sequences(docs, 3).collect()
    assert {r.doc_id: tokenizer().decode(np.frombuffer(r.payload, np.uint16)[:r.n_ids - 1].tolist()) for r in seqs} == want
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    back = {r.conv_id: r for r in chat_tree.read_back(chat_tree.build(turns)).collect()}
    assert {i: r.loss_chars for i, r in back.items()} == {i: len(t) for i, t in want.items()}


def test_records_travel_in_blocks(spark, monkeypatch):
    """Few full blocks or many small ones: the same records in slot order, and fewer rows in the shuffle than records."""
    import random
    width, n = 20, 3000
    rows = list(enumerate(i.to_bytes(8, "big") + b"x" * (width - 8) for i in range(n)))
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "slot bigint, value binary").repartition(3)
    for block_rows, held in ((512, 96 << 20), (7, 96 << 20), (512, 4000)):
        monkeypatch.setattr(training_order, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(training_order, "HELD_BYTES", held)
        out = training_order._dealt_blocks(df, width, n, 100, 8)
        parts = out.rdd.mapPartitions(lambda it: [[(r.slot, r.shard, bytes(r.value)) for r in it]]).collect()
        for p in parts:
            assert [r[0] for r in p] == sorted(r[0] for r in p)
        assert sorted(r for p in parts for r in p) == [(s, s // 100, v) for s, v in sorted(rows)]
        assert len({r[1] for p in parts for r in p}) == sum(len({r[1] for r in p}) for p in parts) == 30
