"""The thin queries over the test tables, one per operator, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, crosspoly, decontam, mixing, negatives, periods, pii, quality, simhash, substring, tokencount, tokenshards
from .cluster import new_path


#: The vocabulary that the token queries use; the operators take any path.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    from public_tokenizers import path

    return str(path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.hex_fingerprint().alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(quality.fold("id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.KEEP_SCORE).cast("int").alias("predicted"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary()))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.format_turns(rows.union(extra))).withColumnRenamed("conv", "conv_id")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crosspoly.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumnsRenamed({"id": "vec_id", "component": "component_id"})


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards into the shared folder and returns what they hold, a row for each sequence."""
    out = new_path(spark, "token-shards")
    pattern, _ = bpe.borders(vocabulary())
    tokenshards.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), out, pattern=pattern)
    return tokenshards.read_shards(spark, out).withColumnsRenamed({"id": "doc_id", "n": "n_tokens"})


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary())
    return found.withColumnRenamed("id", "doc_id")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item of which it holds a copy; clean documents have none."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "budget")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base_sha256 are of the base spans; spans has those that deobfuscation adds as well."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *(f"n_{kind}" for kind in pii.KINDS),
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: every tenth document, by its id's CRC, repeats a stretch of its words up to its end."""
    split = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", (h / 10).cast("long").alias("g"), F.when(h % 10 == 0, split).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    rows = found.select("id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.shares(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_chat": op4_chat,
    "op5_substrings": op5_substrings,
    "op6_embeddings": op6_embeddings,
    "op7_token_shards": op7_token_shards,
    "op8_token_counts": op8_token_counts,
    "op9_decontam": op9_decontam,
    "op10_pii": op10_pii,
    "op11_periods": op11_periods,
    "op12_mixing": op12_mixing,
    "op13_hard_negatives": op13_hard_negatives,
}

#: The others hash with functions that DuckDB lacks, learn, or need a tokenizer, positions or edit distances.
ORACLE_SQL: dict[str, str] = {
    "op4_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, CASE role WHEN 'user' THEN 'INST' WHEN 'system' THEN 'SYS' WHEN 'assistant' THEN 'OUT' WHEN 'tool' THEN 'TOOL' ELSE 'ROLE' END AS tag,
             regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:INST|SYS|OUT|TOOL)\]|/?ROLE[ \]]|\|(?:image|audio|document):)', '\1\\\2\3', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + 2 * length(tag) + 12 + CASE WHEN tag = 'ROLE' THEN 1 + length(role) ELSE 0 END) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS expanded_tokens
FROM f GROUP BY conv_id""",
    "op5_substrings": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
m AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN m USING (k) WHERE first < doc_id),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
r AS (SELECT e.doc_id, count(g.i) AS n, string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS kept FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
    "op6_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op11_periods": r"""
WITH c AS (SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
             lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS h,
             list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT doc_id, w, h % 10 = 0 AND len(w) > 0 AS hit, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM c),
d AS (SELECT doc_id, CASE WHEN hit THEN list_transform(w, lambda x, i: CASE WHEN i - 1 < a THEN x ELSE w[1 + a + (i - 1 - a) % (1 + (len(w) - a) // k)] END) ELSE w END AS w FROM a),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
b AS (SELECT doc_id, i, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM t),
f AS (SELECT * FROM b WHERE y IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, x, y) > 2),
m AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM f l JOIN f r ON l.doc_id = r.doc_id AND l.x = r.x AND l.y = r.y AND l.i < r.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m),
r AS (SELECT doc_id, min(i) AS start, count(*) + 1 + q AS length, q FROM s GROUP BY doc_id, q, g HAVING count(*) + 1 + q >= greatest(6, 4 * q)),
u AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
runs AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
kept AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.i) FILTER (g.i IS NULL) AS k FROM t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN runs ON runs.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.l = b.l AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
