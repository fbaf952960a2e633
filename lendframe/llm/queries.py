"""One query per corpus operator, over whole tables, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendframe.llm import (chat_tree, decontaminate, exact_dedup, jaccard, maxent_lm, pieces, quality, simhash, spelling, toxicity,
                           training_order, url_reputation, whiten)
from lendframe.llm.common import remainder
from lendframe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


#: Listed rules (host and path, verdict).
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
             ("com/de/", "block")]


def _level(name: str, keys: str, source: str, parent: str) -> str:
    """SQL of one level of shrinkage: weight by moments, then posterior."""
    return f"""
{name}_w AS (
  SELECT round((1 - rho) / rho, 9) AS w FROM (
    SELECT least(0.999, greatest(0.001, coalesce(
      sum((k - n * mu) * (k - n * mu) - n * (mu * (1 - mu))) / nullif(sum(n * (n - 1) * (mu * (1 - mu))), 0), 0.5))) AS rho
    FROM (SELECT g.*, {parent} FROM {source}) x)),
{name} AS (
  SELECT {keys}, a, b, a / (a + b) AS mean FROM (
    SELECT {keys}, mu * w + k AS a, (1 - mu) * w + (n - k) AS b FROM (SELECT g.*, {parent} FROM {source}) x, {name}_w))"""


def _sql_rules() -> str:
    return ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in URL_RULES)


_AZ = f"'{url_reputation.UPPER}', '{url_reputation.LOWER}'"
_LONG = ", ".join(f"'{s}'" for s in url_reputation.LONG_SUFFIXES)

OP2_SQL = f"""
WITH rules(rule, h, p, verdict) AS (VALUES {_sql_rules()}),
u AS (SELECT page_id, row_number() OVER () AS rid,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (
  SELECT p.rid, r.rule, r.verdict
  FROM p JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  QUALIFY row_number() OVER (PARTITION BY p.rid ORDER BY length(r.rule) DESC) = 1),
j AS (SELECT p.*, fit.rule, fit.verdict FROM p LEFT JOIN fit USING (rid)),
hh AS (SELECT host, count(verdict) AS n, count(*) FILTER (WHERE verdict = 'allow') AS k,
         string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM j GROUP BY host),
h2 AS (SELECT *, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three FROM hh),
h AS (SELECT host, n, k, CASE WHEN two IN ({_LONG}) THEN three ELSE two END AS domain,
        CASE WHEN two IN ({_LONG}) THEN two ELSE l[-1] END AS suffix FROM h2),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
t AS (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) AS mean FROM s),
{_level("sp", "suffix", "s g, t", "t.mean AS mu")},
{_level("dp", "suffix, domain", "d g JOIN sp USING (suffix)", "sp.mean AS mu")},
{_level("hp", "host", "h g JOIN dp USING (suffix, domain)", "dp.mean AS mu")}
SELECT page_id, j.host, path, rule, coalesce(verdict,
  CASE WHEN mean - {url_reputation.Z} * sqrt(mean * (1 - mean) / (a + b + 1)) >= {url_reputation.THRESHOLD}
       THEN 'allow' ELSE 'block' END) AS verdict
FROM j JOIN hp ON j.host = hp.host
"""


@query("op2_url_reputation", OP2_SQL)
def op2(spark, sf_dir):
    """The pages that a rule decides are the labelled outcomes; all other verdicts come from the reputation."""
    pages = table(spark, sf_dir, "pages")
    host, path = url_reputation.host_of(F.col("url")), url_reputation.path_of(F.col("url"))
    ruled = pages.select(host.alias("host"), url_reputation.match_rules(host, path, URL_RULES)["verdict"].alias("v"))
    outcomes = ruled.filter("v is not null").select("host", (F.col("v") == "allow").cast("int").alias("good"))
    return url_reputation.judge(pages, outcomes, URL_RULES).drop("bound")


#: Key of the training order.
ORDER_KEY = 2024


@query("op3_training_order")
def op3(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "shards")
    training_order.write_shards(docs, ORDER_KEY, path)
    return training_order.read_slots(spark, path).select(
        "slot", "shard", "row", F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "part", "n_ids", "payload")


#: The extra conversation of the query: its texts look like other templates' control strings.
TRICKY = r"\### Assistant: </turn> ok"

_OP4_HEAD = """'<|' || replace(replace(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), '|', '%7C'),
    chr(10), '%0A'), chr(13), '%0D') || '|>' || chr(10)"""

OP4_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}')),
f AS (SELECT *, {_OP4_HEAD} || regexp_replace(text, '<(\^*)\|', '<\1^|', 'g') || '<|end|>' || chr(10) AS formatted FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length(formatted)) AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM g
"""


@query("op4_chat_prefix_tree", OP4_SQL)
def op4(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    return chat_tree.read_back(chat_tree.build(turns.unionByName(tricky)))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op5_exact_dedup", OP5_SQL)
def op5(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), %s), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % _AZ

OP8_SQL = f"""
WITH iw AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM iw, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
grams AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM dw, (SELECT DISTINCT k FROM pat) ks, unnest(range(1, len(w) - k + 2)) t(i)),
occ AS (SELECT r, i, k, g FROM grams SEMI JOIN pat USING (k, g)),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM occ, unnest(range(i, i + k)) t(x) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM occ JOIN pat USING (k, g) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


@query("op8_decontamination", OP8_SQL)
def op8(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_maxent_lm")
def op6(spark, sf_dir):
    return maxent_lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)


@query("op7_merge_dropout")
def op7(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query("op9_toxic_spans")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.filter(~held_out))
    return toxicity.score(docs, model, carry=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "spans")


@query("op10_quality_passages")
def op10(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 3) == 1
    model = quality.fit(docs, labels.filter(~held_out))
    return quality.score(docs, model, carry=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    return spelling.forms(spelling.word_counts(table(spark, sf_dir, "documents"), typo_every=97))


OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT r, r AS x FROM d UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.x),
c AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.x GROUP BY reach.r),
k AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM d JOIN c USING (r) LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""


@query("op12_jaccard_tiles", OP12_SQL)
def op12(spark, sf_dir):
    return jaccard.components(table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"))
