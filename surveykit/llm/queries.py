"""The registered queries of the corpus operators, and their SQL twins for DuckDB."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, ctw, decontam, divergence, exact_dedup, fill_middle, html_extract, mixing, ngram_join,
               sharding, token_counts, toxicity, url_filter)
from .common import LOWER, UPPER, table

SHARDS = [f"shard-{i:02d}" for i in range(16)]
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs.select("doc_id", "text"), SHARDS, "doc_id", F.col("text")).select(
        "doc_id", "slot", "shard")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(table(spark, sf_dir, "documents"), width=3, percent=90)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return documents.select(F.col("id").alias("doc_id"), "size", "source_size",
                            F.round("target", 3).alias("target"), "taken")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    return toxicity.score_documents(docs, model)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                      digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: A conversation that says the template's own marks.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], chats.schema)
    out = chat_format.format_chats(chats.unionAll(own))
    line = F.transform(chat_format.chatml_turns(), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("conv_id", "n_turns", digest(F.array_join(line, "")).alias("turns_sha256"),
                      F.length(chat_format.loss_text()).cast("long").alias("loss_chars"),
                      digest(chat_format.loss_text()).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_join": op4_ngram_join,
    "op5_url_filter": op5_url_filter,
    "op6_html_extraction": op6_html_extraction,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_chat_formatting": op13_chat_formatting,
}

_MD5 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
_SPACE = r"[\x20\x09-\x0D]+"


def _sql_shards() -> str:
    slots = sharding.lookup_table(SHARDS)
    names = ", ".join(f"'{s}'" for s in SHARDS)
    key = "coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, '')))"
    return f"""
SELECT doc_id, slot, ([{names}])[(({slots})[slot + 1]) + 1] AS shard
FROM (SELECT doc_id, CAST({_MD5.format(key)} % {len(slots)} AS INTEGER) AS slot FROM documents) d"""


_SQL_DEDUP = rf"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""


def _sql_urls() -> str:
    fits, n = [], 0
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", rule, verdict))
    rules = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdicts = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*', 0) AS rest FROM a),
c AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0), '{upper}', '{lower}') AS host,
             regexp_extract(rest, '^[^/]*(.*)$', 1, 's') AS path FROM b)
SELECT page_id, host, path, CASE {rules} END AS rule, CASE {verdicts} ELSE 'allow' END AS verdict FROM c"""


_SQL_MIX = f"""
WITH d AS (SELECT doc_id, source,
       CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
       {_MD5.format("'0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')")} AS place
       FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx
      FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[idx % 3 + 1]::DOUBLE AS weight, words * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (CAST(sum(words) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, idx
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, idx, words, coalesce(least(most, weight * (SELECT level FROM l WHERE level <= most / weight ORDER BY most / weight, idx LIMIT 1)), most) AS target,
      CAST(greatest(ceil(words / 4096.0), 1) AS BIGINT) AS width FROM l),
p AS (SELECT *, CAST(ceil(words / width::DOUBLE) AS BIGINT) AS blocks, CAST(floor(target / words) AS BIGINT) AS passes
      FROM t WHERE words > 0),
q AS (SELECT *, passes * blocks + least(CAST(round((target - passes * words) / width) AS BIGINT), blocks) AS quota FROM p),
k AS (SELECT idx, block, count(*) AS times
      FROM (SELECT q.*, unnest(generate_series(0, blocks - 1)) AS block FROM q) b,
           (SELECT unnest(generate_series(0, 2)) AS pass) c
      WHERE pass * blocks + block < quota GROUP BY idx, block),
o AS (SELECT d.doc_id, d.size, t.idx, t.words, t.target, t.width,
             sum(d.size) OVER (PARTITION BY t.idx ORDER BY d.place, d.doc_id, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS first
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT idx, first, sum((least(first + size, (block + 1) * width) - greatest(first, block * width)) * times) AS got
      FROM (SELECT *, unnest(generate_series(CAST(first // width AS BIGINT), CAST((first + size - 1) // width AS BIGINT))) AS block
            FROM o WHERE size > 0) e JOIN k USING (idx, block) GROUP BY idx, first)
SELECT o.doc_id, o.size, o.words AS source_size, round(o.target, 3) AS target,
       CAST(CASE WHEN o.size > 0 THEN coalesce(x.got, 0) ELSE 0 END AS BIGINT) AS taken
FROM o LEFT JOIN x ON o.idx = x.idx AND o.first = x.first"""

_SQL_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
e AS (SELECT g.lang, g.source, k.term, k.c, CAST(coalesce(n.n, 0) AS HUGEINT) AS n
      FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n,
             1 + (1000000000 * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p,
             1 + (1000000000 * (c + 1)) // (sum(c) OVER s + count(*) OVER s) AS q
      FROM e WINDOW s AS (PARTITION BY lang, source)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS v
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.v, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM y)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 200"""

_SQL_FILL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                       OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
y AS (SELECT *, least(a, b) AS lo, abs(a - b) AS mid FROM x),
z AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, mid) AS m, substr(t, lo + mid + 1) AS s FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN mid END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM z"""


def _sql_chat() -> str:
    escaped = r"length(regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g'))"
    role = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
    around = len(chat_format.START) + len(chat_format.END) + 2
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{CONTROL_TEXT}'),
a AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             CAST(sum({escaped.format(role)} + {escaped.format('text')} + {around}) AS BIGINT) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM a"""


SQL: dict[str, str] = {
    "op1_sharding": _sql_shards(),
    "op2_exact_dedup": _SQL_DEDUP,
    "op5_url_filter": _sql_urls(),
    "op9_mixing": _SQL_MIX,
    "op11_source_divergence": _SQL_DIVERGENCE,
    "op12_fill_in_middle": _SQL_FILL,
    "op13_chat_formatting": _sql_chat(),
}
