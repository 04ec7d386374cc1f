"""The registered queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import chat, decontamination, mixing, packing, paragraphs, runs, sharding, simhash, tokens, topk, toxicity, trie, urls
from tickerloom.llm.common import WORD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_mixing", r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((rank - 1) % 3 + 1 AS INT)] AS weight FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0) AS remains, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights
      FROM f WINDOW o AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT remains AS r, weights AS w FROM l WHERE remains / weights <= fill ORDER BY fill, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * v.r / v.w) AS target, CAST(floor(least(cap, weight * v.r / v.w)) AS BIGINT) AS quota FROM l, v),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.quota,
             CASE WHEN t.source_size > 0 THEN t.quota // t.source_size ELSE 0 END AS epochs,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, quota - epochs * source_size - before)) AS BIGINT) AS taken FROM p""")
def op1_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_sharding")
def op2_sharding(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, shards=8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op10_simhash_near_duplicates")
def op10_simhash_near_duplicates(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, words=3, radius=2).select("doc_id", "fingerprint", "component_id")


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark, folder):
    found = decontamination.matches(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "matched_tokens", "item_tokens", "changed_slots")


@query("op8_toxicity")
def op8_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


#: (host, path, verdict) of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op3_url_rules", r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)', 2, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(.*?)://[^/?#]*([^?#]*)', 2, 's'), '') AS path FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
       coalesce((SELECT arg_max(v, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM p""")
def op3_url_rules(spark, folder):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


#: What both turns of conversation -7 say: control strings of the template.
PLANTED = "\\### Assistant: </turn> ok"


@query("op4_chat_formatting", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos,
             len(regexp_extract_all(text, '[^ 	-
]+')) + 4 AS tokens FROM c),
l AS (SELECT *, pos = 1 AND role = 'system' AS lead,
             length(role) + length(text) + length('### : </turn>') + 1
             + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
             + (length(role) - length(replace(role, ':', '')))
             + (length(text) - length(replace(text, '</turn>', ''))) // 7 + (length(role) - length(replace(role, '</turn>', ''))) // 7
             + CAST(coalesce(list_sum(list_transform(regexp_extract_all(role || chr(10) || text, '#{3,}'), lambda x: length(x) - 2)), 0) AS BIGINT) AS long FROM n),
r AS (SELECT *, 512 - coalesce(sum(CASE WHEN lead THEN tokens END) OVER (PARTITION BY conv_id), 0) AS beside,
             coalesce(sum(CASE WHEN lead THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
m AS (SELECT *, CAST(CASE WHEN beside > 0 THEN beside ELSE 512 END AS BIGINT) AS room FROM r),
b AS (SELECT *, least(128, (room - 1) // 2) AS history, CAST(before AS BIGINT) // (room - least(128, (room - 1) // 2)) AS stretch FROM m),
t AS (SELECT conv_id, stretch, sum(tokens) AS told, max(pos) AS final, count(*) AS turns FROM b WHERE NOT lead GROUP BY ALL),
w AS (SELECT b.*, 2 * b.stretch + CASE WHEN NOT lead AND told > room - history AND pos = final AND turns > 1 THEN 1 ELSE 0 END AS w
      FROM b LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.stretch = b.stretch),
s AS (SELECT conv_id, w, min(before) AS start, sum(tokens) AS fresh FROM w WHERE NOT lead GROUP BY ALL),
h AS (SELECT w.conv_id, sum(w.long) AS more FROM w JOIN s ON s.conv_id = w.conv_id AND s.w > w.w AND NOT w.lead
      AND s.start - w.before <= least(w.history, w.room - s.fresh) GROUP BY 1),
k AS (SELECT conv_id, count(DISTINCT CASE WHEN NOT lead OR w = 0 THEN w END) AS windows, max(CASE WHEN lead THEN long ELSE 0 END) AS lead_long FROM w GROUP BY 1)
SELECT w.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
       CAST(sum(long) + any_value(coalesce(h.more, 0)) + any_value(k.lead_long * (k.windows - 1)) AS BIGINT) AS formatted_chars
FROM w LEFT JOIN h ON h.conv_id = w.conv_id JOIN k ON k.conv_id = w.conv_id GROUP BY w.conv_id""")
def op4_chat_formatting(spark, folder):
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.windows(turns)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query("op9_exact_top_k", r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op9_exact_top_k(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


@query("op7_substring_dedup")
def op7_substring_dedup(spark, folder):
    found = paragraphs.spans(paragraphs.repeated(table(spark, folder, "documents").select("doc_id", "text")))
    return found.select(F.col("id").alias("doc_id"), "word", "words", "class_id", "kept")


@query("op6_token_counts")
def op6_token_counts(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents").select("doc_id", "text"))[["doc_id", "n_tokens"]]


#: Vocabulary of the registered packing.
TOKENIZER = "byte_bpe_50k.json"


@query("op11_packing")
def op11_packing(spark, folder):
    import public_tokenizers

    packed = packing.pack(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER), length=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc32_sql(number: str) -> str:
    """CRC-32 of a whole number's decimal digits: each byte is mixed in, then eight bits are shifted out."""
    text = f"CAST({number} AS VARCHAR)"
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_concat([CAST(ascii(({text})[i]) AS BIGINT)], list_transform(range(8), lambda z: -1::BIGINT))))"
    shift = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE {shift} END, 4294967295::BIGINT), 4294967295::BIGINT)"


@query("op12_periodic_runs", rf"""
WITH r AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql('doc_id')} AS h FROM documents),
s AS (SELECT *, len(w) AS n, h // 10 AS g FROM r),
m AS (SELECT *, h % 10 = 0 AND n > 0 AS changed, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM s),
d AS (SELECT id, doc_id, n, CASE WHEN changed THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM m),
k AS (SELECT id, w, unnest(range(n)) AS i, n FROM d),
x AS (SELECT id, i, w[i + 1] AS word, CASE WHEN i + 16 <= n THEN array_to_string(w[i + 1:i + 16], ' ') END AS gram FROM k),
e AS (SELECT a.id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.id = b.id AND a.gram = b.gram AND a.i < b.i),
l AS (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM e),
f AS (SELECT id, q, min(i) AS start, count(*) + 15 + q AS long FROM l GROUP BY id, q, island),
u AS (SELECT id, start, long AS length, min(q) AS period FROM f WHERE long >= greatest(24, 3 * q) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS rank FROM u),
t AS (SELECT id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM u GROUP BY id),
c AS (SELECT x.id, sha256(coalesce(string_agg(x.word, ' ' ORDER BY x.i), '')) AS collapsed_sha256
      FROM x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.id = x.id AND x.i >= u.start + u.period AND x.i < u.start + u.length) GROUP BY x.id)
SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
       coalesce(t.runs_sha256, sha256('')) AS runs_sha256, coalesce(c.collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN t ON t.id = d.id LEFT JOIN best ON best.id = d.id AND best.rank = 1 LEFT JOIN c ON c.id = d.id""")
def op12_periodic_runs(spark, folder):
    h = F.crc32(F.col("doc_id").cast("string"))
    split = table(spark, folder, "documents").select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    sized = split.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = sized.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(tail / F.col("p")).cast("int"))), F.lit(1), tail)
    planted = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text"))
    found = runs.periodic_runs(placed.select("doc_id", planted.alias("text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", "runs", "collapsed", runs.strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_conversation_prefix_trie", rf"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS own FROM o GROUP BY conv_id),
h AS (SELECT conv_id, own, {crc32_sql('conv_id')} % 6 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS n, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
k AS (SELECT conv_id, n, depth, md5(CAST(to_json(turns[1:depth]) AS VARCHAR)) AS key, CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS chars FROM p),
g AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM k GROUP BY depth, key),
u AS (SELECT g.*, a.key AS parent_key FROM g LEFT JOIN k a ON a.conv_id = g.conv_id AND a.depth = g.depth - 1),
s AS (SELECT depth, parent_key AS key, count(*) AS n_children FROM (SELECT depth - 1 AS depth, parent_key FROM u WHERE parent_key IS NOT NULL) GROUP BY ALL),
v AS (SELECT u.*, coalesce(s.n_children, 0) AS n_children FROM u LEFT JOIN s ON s.depth = u.depth AND s.key = u.key),
t AS (SELECT a.depth, a.key, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
      FROM v JOIN k a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.depth, a.key)
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN t ON t.depth = v.depth AND t.key = v.key LEFT JOIN v q ON q.depth = v.depth - 1 AND q.key = v.parent_key""")
def op13_conversation_prefix_trie(spark, folder):
    found = trie.trie(*trie.with_borrowed_heads(trie.number_turns(table(spark, folder, "conversations"))))
    told = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    lone = found.nodes.where("n_convs = 1").select(*told, F.when(F.col("n_ends") == 1, sha(F.col("conv_id").cast("string"))).otherwise(sha(F.lit(""))).alias("ends_sha256"))
    several = found.nodes.where("n_convs > 1").join(trie.ends_digests(found.ends), ["conv_id", "depth"], "left")
    return lone.unionByName(several.select(*told, F.coalesce("ends_sha256", sha(F.lit(""))).alias("ends_sha256")))
