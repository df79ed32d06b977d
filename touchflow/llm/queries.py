"""One query per operator over its whole table; ``SQL`` where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchflow.llm import (approximate, chat, html_text, mixing, neardup, packing, runs, secrets,
                           sharding, simhash, topk, toxicity, whitening)
from touchflow.llm.tables import table, whole_text
from touchflow.session import shared_folder

QUERIES = {}
SQL = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 by a stored map of slots, and by its next version with one shard more."""
    maps = shared_folder(spark, "slot-map")
    current = sharding.even_map(8)
    sharding.save_map(spark, maps, 1, current)
    sharding.save_map(spark, maps, 2, sharding.grown(current))
    return sharding.placed(table(spark, sf_dir, "documents"), sharding.load_map(spark, maps, 1),
                           sharding.load_map(spark, maps, 2))


@_query
def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all sources at temperature 0.7 and as many bytes as the input."""
    return mixing.mix(table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars"))


SQL["op2_poisson_mix"] = f"""
WITH sizes AS (
    SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS source_bytes
    FROM documents GROUP BY source),
weights AS (SELECT *, pow(CAST(source_bytes AS DOUBLE), {mixing.TEMPERATURE}) AS weight FROM sizes),
rates AS (
    SELECT source, weight / (SELECT sum(weight) FROM weights)
        * CAST((SELECT sum(source_bytes) FROM sizes) AS DOUBLE) / source_bytes AS rate
    FROM weights),
keyed AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.rate, '{mixing.SEED}:' ||
        coalesce(CAST(d.doc_id AS VARCHAR), 'text ' || md5(coalesce(d.text, ''))) AS doc_key
    FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
draws AS (
    SELECT *, (CAST(('0x' || substr(md5(doc_key || ':0'), 1, 13)) AS BIGINT) + 0.5)
        / pow(2.0, 52) AS u FROM keyed),
chances AS (
    SELECT r.source, k.k, sum(exp(-r.rate + k.k * ln(r.rate) - lgamma(k.k + 1.0)))
        OVER (PARTITION BY r.source ORDER BY k.k) AS cdf
    FROM rates r, (SELECT unnest(range(0, 200)) AS k) k),
counted AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.doc_key,
        CAST(count(*) FILTER (WHERE c.cdf <= d.u) AS INTEGER) AS copies
    FROM draws d JOIN chances c ON d.source IS NOT DISTINCT FROM c.source
    GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copies, CAST(copy AS INTEGER) AS copy,
    md5(doc_key || '/' || CAST(copy AS VARCHAR)) AS order_key
FROM (SELECT *, unnest(range(0, copies)) AS copy FROM counted)
"""


@_query
def op3_tag_ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@_query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations say when read back; one made-up conversation checks the
    escaping of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_conversations(turns.union(extra)))


@_query
def op9_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@_query
def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query
def op8_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


@_query
def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with the forest's verdict."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@_query
def op5_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query
def op11_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.col("deviation").cast("long"))


@_query
def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def made_periodic(docs: DataFrame) -> DataFrame:
    """One document in ten, by its id's hash, with the words from some place on made periodic."""
    white = r"[\x20\x09-\x0D]+"
    numbered = docs.select("doc_id", whole_text().alias("text"), F.crc32(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h")).select(
        "doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, F.filter(
            F.split("text", white), lambda w: w != "")).alias("words"))
    n, a = F.size("words"), F.col("a")
    placed = numbered.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int")).withColumn(
        "p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    repeated = F.flatten(F.array_repeat(F.slice("words", a + 1, F.col("p")),
                                        F.ceil((n - a) / F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), a),
                                    F.slice(repeated, F.lit(1), n - a)), " ")
    return placed.select("doc_id", F.when(a.isNotNull(), changed).otherwise(F.col("text"))
                         .alias("text"))


@_query
def op13_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run, and digests of all runs and of the text without repeats, of every document."""
    found = runs.periodic_runs(made_periodic(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", "n_runs", longest.alias("best"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", (-F.col("best.less")).alias("length"), "best.period",
        F.expr("1000 * -best.less div best.period").alias("exponent_milli"), "runs_sha256",
        "collapsed_sha256")


SQL["op5_kd_tree_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))
        AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(
        embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(
        list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored)
WHERE rank <= 5
"""

SQL["op6_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
    SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
        + length('<s>[INST][/INST]</s>') + 1 AS chars
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
        AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
        FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

SQL["op7_nn_descent"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(
        embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = e.vec_id) AS n_links, l.component_id,
    e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id
"""
