"""Registered queries of the training-data operators, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import chat, clusters, decontaminate, licenses, minhash, pseudolikelihood, quality, sentencepieces, substrings, tokencounts, toxicity, trie, urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(text, '{_UPPER}', '{_LOWER}')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _words_sql(pattern: str, lowered: bool, source: str = "documents", key: str = "doc_id") -> str:
    return f"""
  SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n
  FROM (SELECT {key}, regexp_extract_all({_LOWERED if lowered else "text"}, '{pattern}') AS ws FROM {source})"""


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WHITE = r"[^\x20\x09-\x0D]+"


@query(f"""
WITH RECURSIVE words AS ({_words_sql(_WHITE, True)}),
runs AS (
  SELECT doc_id, p, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS g
  FROM words),
shingles AS (SELECT DISTINCT doc_id, g FROM runs WHERE p <= greatest(n - 2, 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * c >= 85 * (s.n + t.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS reached FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.reached = e.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(reached) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id""")
def op3_minhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, root, "documents"), words=3, percent=85)


@query(f"""
WITH words AS ({_words_sql(_WHITE, False)}),
runs AS (
  SELECT doc_id, w, p, CASE WHEN p <= n - 19 THEN string_agg(w, ' ') OVER (
    PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS g
  FROM words),
repeats AS (SELECT *, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS later FROM runs),
covered AS (
  SELECT *, bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM repeats),
kept AS (
  SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS kept
  FROM covered GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)""")
def op10_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, root, "documents"), length=20)
    flat = F.trim(F.regexp_replace(F.translate("kept_text", "\t\n\x0b\x0c\r", "     "), " +", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(flat, 256).alias("kept_sha256"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SPLIT = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_TEMPLATES = ", ".join("({}, '{}', '{}', {}, {})".format(k, name, body.replace("'", "''"), must.split(), never.split()) for k, (name, body, must, never) in enumerate(licenses.TEMPLATES))
_GRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"


@query(f"""
WITH known AS (
  SELECT template, license, len(ws) AS l, {_GRAMS.format("ws")} AS grams, must::VARCHAR[] AS must, never::VARCHAR[] AS never
  FROM (SELECT *, {_SPLIT.format("body")} AS ws FROM (VALUES {_TEMPLATES}) v(template, license, body, must, never))),
docs AS (SELECT doc_id, {_SPLIT.format("text")} AS ws FROM documents),
pairs AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format("ws")}) AS g FROM docs WHERE len(ws) > 1),
likely AS (
  SELECT doc_id, template FROM pairs JOIN (SELECT template, len(grams) AS m, unnest(grams) AS g FROM known) USING (g)
  GROUP BY doc_id, template, m HAVING 3 * count(*) >= 2 * m),
windows AS (
  SELECT doc_id, k.*, ws[b:b + l - 1] AS own
  FROM (SELECT d.doc_id, ws, template, unnest(range(1, len(ws))) AS b FROM docs d JOIN likely USING (doc_id)) JOIN known k USING (template)),
sized AS (
  SELECT *, {_GRAMS.format("own")} AS own_grams FROM windows
  WHERE len(list_intersect(must, own)) = len(must) AND len(list_intersect(never, own)) = 0),
shared AS (
  SELECT doc_id, license, len(grams) AS m, len(own_grams) AS n, len(list_intersect(own_grams, grams)) AS c FROM sized),
best AS (SELECT *, 2.0::DOUBLE * c / (n + m) AS dice FROM shared WHERE 200 * c >= 80 * (n + m))
SELECT doc_id, arg_min(license, (-dice, -m, license)) AS license, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
FROM best GROUP BY doc_id""")
def op1_license_scans(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(table(spark, root, "documents"), percent=80)


def _escaped_length(column: str) -> str:
    marks = r"[<\[](/?s>|/?INST\]|</?SYS>>|</?ROLE>>)"
    return f"length({column}) + length({column}) - length(replace({column}, '\\', '')) + len(regexp_extract_all({column}, '{marks}'))"


@query(f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, {_escaped_length("text")} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 21 + {_escaped_length("role")} END AS n
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""")
def op2_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))))).alias("t"))
    extra = extra.select(F.lit(-1).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.lit(tricky).alias("text"))
    out = chat.formatted(chat.turns_by_layout(rows.unionByName(extra))).select("conv_id", "text", "loss")
    out = out.withColumn("back", chat.read_back(F.col("text"))).withColumn("learnt", chat.masked(F.col("text"), F.col("loss")))
    line = F.lit("\n")
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


@query(f"""
WITH items AS ({_words_sql(_ALNUM, True, "benchmark", "item_id")}),
docs AS ({_words_sql(_ALNUM, True)}),
item_runs AS (
  SELECT item_id, n, p, list(w) OVER (PARTITION BY item_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM items),
windows AS (
  SELECT DISTINCT item_id, least(n, 10) AS l, array_to_string(ws[1:least(n, 10)], ' ') AS g FROM item_runs WHERE p <= greatest(n - 9, 1)),
doc_runs AS (
  SELECT doc_id, n, p, list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM docs),
places AS (
  SELECT doc_id, p, l, array_to_string(ws[1:l], ' ') AS g
  FROM doc_runs CROSS JOIN (SELECT DISTINCT l FROM windows) WHERE p + l - 1 <= n),
found AS (SELECT doc_id, p, l, item_id FROM places JOIN windows USING (l, g)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM found) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM found GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_words FROM docs GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)""")
def op4_benchmark_decontamination(spark: SparkSession, root: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, root, "documents"), table(spark, root, "benchmark"), window=10)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op5_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality.measure(table(spark, root, "documents"), vocabulary("piece_bpe_32k.model"))


@query()
def op7_sentencepiece_codec(spark: SparkSession, root: str) -> DataFrame:
    out = sentencepieces.encode(table(spark, root, "documents"), vocabulary("piece_bpe_32k.model"), ["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "parity", "round_trip")


@query()
def op9_token_counts(spark: SparkSession, root: str) -> DataFrame:
    out = tokencounts.count_tokens(table(spark, root, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


@query()
def op8_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, root, "labels").filter(~held_out))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query()
def op6_masked_pseudo_likelihood(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    words = pseudolikelihood.vocabulary(docs)
    own = pseudolikelihood.frequent(words)
    return pseudolikelihood.score(docs, pseudolikelihood.train(docs, own=own), words=words, own=own)


_CRC = """xor(4294967295, list_reduce([ascii(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')], lambda crc, byte:
    list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295))"""


@query(f"""
WITH turns AS (
  SELECT conv_id, role, turn, text, substr(sha256(length(role) || ':' || role || text), 1, 32) AS key
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
  WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS p FROM turns),
heads AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
joined AS (
  SELECT c.conv_id, 0 AS part, n.p, n.key, n.text FROM heads c JOIN numbered n ON n.conv_id = c.base AND n.p <= c.h
  UNION ALL
  SELECT c.conv_id, 1, n.p, n.key, n.text FROM heads c JOIN numbered n ON n.conv_id = c.conv_id AND n.p > c.h),
members AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path,
    len(regexp_extract_all(text, '{_WHITE}')) AS words
  FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)
  UNION ALL SELECT conv_id, 0, '', 0 FROM heads),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM members GROUP BY path, depth),
lasts AS (SELECT conv_id, arg_max(path, depth) AS path FROM members GROUP BY conv_id),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM lasts GROUP BY path),
born AS (SELECT path[1:32 * (depth - 1)] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes n LEFT JOIN born USING (path)),
sums AS (
  SELECT m.path, count_if(o.n_children = 0) AS n_leaves, sum(o.saved) AS saved_tokens
  FROM own o JOIN members m ON m.conv_id = o.conv_id AND m.depth <= o.depth GROUP BY m.path)
SELECT o.conv_id, o.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, o.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM own o JOIN sums s USING (path) LEFT JOIN ends e USING (path)
LEFT JOIN nodes u ON o.depth > 0 AND u.path = o.path[1:32 * (o.depth - 1)]""")
def op11_conversation_prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(table(spark, root, "conversations")))


#: Rules of the query, as (host, path, verdict).
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_RULES = f"(VALUES {', '.join(map(str, URL_RULES))}) rules(host, path, verdict)"


@query(f"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
numbered AS (SELECT *, row_number() OVER () AS k FROM cut),
fits AS (
  SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM numbered n JOIN {_RULES} ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
  GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN fits USING (k)""".replace(" rules(", " r("))
def op12_url_filters(spark: SparkSession, root: str) -> DataFrame:
    return urls.judge(table(spark, root, "pages"), spark.sql(f"SELECT * FROM {_RULES}"), carry=("page_id",))


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """The same rounds, one after the other, with exact integers."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT x.id, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d FROM vectors x CROSS JOIN c{r} c)
  GROUP BY id)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (
  SELECT cluster, i, sum(z)::BIGINT AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS z, generate_subscripts(v, 1) AS i FROM a{r} JOIN vectors USING (id)) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c
  LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY cluster) m USING (cluster))""")
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id IS NULL, sha256('3:' || vec_id), v) - 1 AS cluster, v FROM vectors
  QUALIFY cluster < {k}),{",".join(steps)}
SELECT vec_id, a.cluster::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
  sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN vectors USING (id) JOIN c{rounds} c ON c.cluster = a.cluster"""


@query(_clusters_sql())
def op13_centroid_clustering(spark: SparkSession, root: str) -> DataFrame:
    return clusters.cluster(table(spark, root, "embeddings"))
