"""Queries over the test tables, one or more for each operator, and the same in SQL.

The tables stand in for what the engine works on: embeddings for indexed
chunks, documents for files (a source is a project), conversations for commits
and passages, pages for marked-up texts, benchmark items for questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, vectors
from .functions.patterns import SECRETS, STOP_WORDS, looks_secret
from .operators import ancestry, answers, chunking, commits, embedding, evaluation, guards, ivf, leaks, retrieval
from .plans import runs
from .plans.index import Index, upserted
from .sources.documents import nearest_root
from .sources.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(column: str):
    return F.col(column).cast("long").alias(column)


# --- retrieval ---------------------------------------------------------------


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("project"),
        F.concat(F.lit("f"), (F.col("vec_id") % 5).cast("string")).alias("rel_path"),
        F.floor(F.col("vec_id") / 2).cast("string").alias("content_hash"),
        "embedding",
    )


def index_queries(chunks: DataFrame) -> DataFrame:
    """The stated query set: every chunk whose id is divisible by 20."""
    return chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", F.col("project").alias("own"))


def shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", long("rank"), "chunk_id", F.round("score", 6).alias("score"))


SCORED = """
WITH c AS (SELECT vec_id AS chunk_id, 'p' || label AS project, 'f' || (vec_id % 5) AS rel_path,
                  CAST(vec_id // 2 AS VARCHAR) AS content_hash, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.chunk_id AS query_id, q.project AS own, c.chunk_id, c.project, c.rel_path, c.content_hash,
             round(list_cosine_similarity(q.e, c.e), 12) AS score
      FROM c q, c WHERE q.chunk_id % 20 = 0 {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM s)"""
SHOWN = "SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, round(score, 6) AS score FROM"
PLAIN = SCORED + f" {SHOWN} (SELECT *, place AS rank FROM r WHERE place <= 5)"
DEDUPED = """,
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY place) AS copy FROM r WHERE place <= {pool}),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM d WHERE copy = 1)"""
CAPPED = """,
p AS (SELECT * FROM u WHERE rank <= 40),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, project, rel_path ORDER BY rank) AS nf FROM p),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY rank) AS np FROM f WHERE nf <= 3),
k AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM g WHERE np <= {most})"""


@query(PLAIN.format(where=""))
def knn_topk(spark, sf_dir):
    chunks = index_chunks(spark, sf_dir)
    return shown(retrieval.ranked(chunks, index_queries(chunks), 5))


@query(PLAIN.format(where="AND c.project NOT IN ('p3', q.project)"))
def knn_exclude(spark, sf_dir):
    chunks = index_chunks(spark, sf_dir)
    asked = index_queries(chunks).withColumn("exclude", F.array(F.lit("p3"), F.col("own")))
    return shown(retrieval.ranked(chunks, asked, 5))


@query(PLAIN.format(where="AND c.project = q.project"))
def knn_project_filter(spark, sf_dir):
    chunks = index_chunks(spark, sf_dir)
    return shown(retrieval.ranked(chunks, index_queries(chunks).withColumnRenamed("own", "project"), 5))


@query(SCORED.format(where="") + DEDUPED.format(pool=10) + f" {SHOWN} u WHERE rank <= 5")
def knn_dedup_overfetch(spark, sf_dir):
    chunks = index_chunks(spark, sf_dir)
    return shown(retrieval.search(chunks, index_queries(chunks), 5))


@query(SCORED.format(where="") + DEDUPED.format(pool=80) + CAPPED.format(most=5) + f" {SHOWN} k WHERE rank <= 10")
def answer_caps(spark, sf_dir):
    chunks = index_chunks(spark, sf_dir)
    return shown(retrieval.passages(chunks, index_queries(chunks)))


@query(SCORED.format(where="AND c.project = q.project") + DEDUPED.format(pool=80) + CAPPED.format(most=1000) + f" {SHOWN} k WHERE rank <= 10")
def answer_caps_one_project(spark, sf_dir):
    chunks = index_chunks(spark, sf_dir)
    asked = index_queries(chunks).withColumnRenamed("own", "project")
    return shown(retrieval.passages(chunks, asked, per_project=None))


@query("""
WITH c AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT unnest(e) AS v, generate_subscripts(e, 1) AS i FROM c), m AS (SELECT i, avg(v) AS v FROM x GROUP BY i),
q AS (SELECT list(v ORDER BY i) AS e FROM m)
SELECT c.chunk_id, CAST(row_number() OVER (ORDER BY round(list_cosine_similarity(c.e, q.e), 12) DESC, c.chunk_id) AS BIGINT) AS rank
FROM c, q QUALIFY rank <= 20""")
def knn_single(spark, sf_dir):
    """One query, ranked without leaving the JVM: the chunks that are most like all chunks together."""
    chunks = index_chunks(spark, sf_dir)
    each = chunks.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v"))
    vector = each.agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("e")).select("e.v").first()["v"]
    return retrieval.nearest(chunks, vector, 20).select("chunk_id", long("rank"))


@query(PLAIN.format(where=""))
def knn_lists(spark, sf_dir):
    """The same ranking over lists by centroid: few are read first, then those that could hold a nearer vector."""
    chunks = index_chunks(spark, sf_dir)
    lists = ivf.build(chunks, new_path(spark, "lists"), lists=32)
    return shown(lists.search(index_queries(chunks), 5, probes=6))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm,
round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 6) AS total
FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 7 + 1)) AS e FROM embeddings)""")
def normalise_vectors(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7 + 1))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v"))
    total = F.aggregate(vectors.unit(F.col("v")), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(vectors.norm(F.col("v")), 6).alias("norm"), F.round(total, 6).alias("total"))


@query("""
WITH o AS (SELECT vec_id, 'p' || label AS project, 'old' AS state FROM embeddings WHERE vec_id % 3 > 0),
n AS (SELECT vec_id, 'p' || label AS project, 'new' AS state FROM embeddings WHERE vec_id % 2 = 0)
SELECT project, state, count(*) AS chunks FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE vec_id NOT IN (SELECT vec_id FROM n)) GROUP BY ALL""")
def index_upsert(spark, sf_dir):
    chunks = index_chunks(spark, sf_dir).select("chunk_id", "project")
    old = chunks.where("chunk_id % 3 > 0").withColumn("state", F.lit("old"))
    new = chunks.where("chunk_id % 2 = 0").withColumn("state", F.lit("new"))
    return upserted(old, new).groupBy("project", "state").agg(F.count("*").alias("chunks"))


@query("""
WITH o AS (SELECT vec_id, 'p' || label AS project, 'f' || (vec_id % 5) AS rel_path FROM embeddings),
n AS (SELECT vec_id, project, rel_path, 'new' AS state FROM o WHERE rel_path = 'f1' AND vec_id % 2 = 0
      UNION ALL SELECT vec_id, project, rel_path, 'old' FROM o WHERE rel_path <> 'f1' AND vec_id % 3 > 0
      UNION ALL SELECT vec_id, project, rel_path, 'by id' FROM o WHERE rel_path <> 'f1' AND vec_id % 3 = 0)
SELECT project, rel_path, state, count(*) AS chunks FROM n GROUP BY ALL""")
def index_parts(spark, sf_dir):
    """An index in three parts: all chunks, then one file of each project anew with half of its chunks, then every third chunk of the others by id."""
    chunks = index_chunks(spark, sf_dir).withColumn("chunk_index", F.col("chunk_id")).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    held = Index(spark, new_path(spark, "index"))
    held.replace(chunks.withColumn("state", F.lit("old")), "space")
    file = chunks.where("rel_path = 'f1'")
    held.upsert(file.where("chunk_index % 2 = 0").withColumn("state", F.lit("new")), "space", file)
    held.upsert(chunks.where("rel_path <> 'f1' and chunk_index % 3 = 0").withColumn("state", F.lit("by id")), "space")
    return held.chunks().groupBy("project", "rel_path", "state").agg(F.count("*").alias("chunks"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN -doc_id WHEN doc_id % 2 = 0 THEN doc_id END AS first FROM documents""")
def cached_vectors(spark, sf_dir):
    """Vectors of even documents from a cache that was written twice for ids divisible by 6."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("content_hash"))
    held = Index(spark, new_path(spark, "index"))
    for sign, step in ((1, 2), (-1, 6)):
        rows = docs.where(F.col("doc_id") % step == 0)
        held.save_vectors(rows.select(F.concat(F.lit("space|"), "content_hash").alias("key"), F.array(F.col("doc_id").cast("double") * sign).alias("vector")))
    found = embedding.with_cache(docs, held.cache(), "space")
    return found.select("doc_id", F.get("vector", F.lit(0)).cast("long").alias("first"))


# --- documents and chunks ----------------------------------------------------


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.col("source").alias("project"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("doc_id").cast("double").alias("mtime"),
        "text",
    )


#: The splitter as a recursion over start positions; documents have no headings, so each is one section.
SPLIT = r"""
WITH RECURSIVE t AS (SELECT doc_id, source, trim(text, E' \n\t\r\x0B\x0C') AS x FROM documents),
w AS (
  SELECT doc_id, source, x, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s,
         CAST(CASE WHEN length(x) <= 1500 THEN length(x) ELSE -1 END AS BIGINT) AS e FROM t
  UNION ALL
  SELECT doc_id, source, x, n + 1,
         CASE WHEN e = -1 THEN s ELSE greatest(CASE WHEN NOT inword THEN b ELSE b + length(regexp_extract(substring(x, b + 1, e - b), '^\S*')) END, s + 1) END,
         CASE WHEN e = -1 THEN cut ELSE -1 END
  FROM (SELECT *, e - 150 AS b,
          regexp_matches(substring(x, e - 150, 2), '^\S\S$') AS inword,
          CASE WHEN s + 1500 >= length(x) THEN length(x)
               WHEN nn > -1 THEN s + 1050 + nn
               WHEN n1 > -1 THEN s + 1050 + n1
               WHEN regexp_matches(substring(x, s + 1500, 2), '^\S\S$') AND regexp_matches(tail, '\s') THEN s + 1500 - length(regexp_extract(tail, '\S*$')) - 1
               ELSE s + 1500 END AS cut
        FROM (SELECT *, substring(x, s + 1051, 450) AS tail,
                CASE WHEN contains(substring(x, s + 1051, 450), E'\n\n') THEN 450 - instr(reverse(substring(x, s + 1051, 450)), E'\n\n') - 1 ELSE -1 END AS nn,
                CASE WHEN contains(substring(x, s + 1051, 450), E'\n') THEN 450 - instr(reverse(substring(x, s + 1051, 450)), E'\n') ELSE -1 END AS n1 FROM w))
  WHERE e < length(x)
),
p AS (SELECT doc_id, source, n, trim(substring(x, s + 1, e - s), E' \n\t\r\x0B\x0C') AS piece FROM w WHERE e >= 0),
k AS (SELECT doc_id, source, piece, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index FROM p WHERE length(piece) >= 50)
"""


@query(SPLIT + """SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(length(piece) AS BIGINT) AS n_chars,
sha256(source || '|doc-' || doc_id || '.md|' || chunk_index) AS chunk_id, sha256(piece) AS content_hash FROM k""")
def chunk_documents(spark, sf_dir):
    rows = chunking.chunk_documents(files(spark, sf_dir))
    number = F.regexp_extract("rel_path", r"doc-(\d+)", 1).cast("long")
    return rows.select(number.alias("doc_id"), long("chunk_index"), F.length("text").cast("long").alias("n_chars"), "chunk_id", "content_hash")


@query(SPLIT + "SELECT source AS project, count(*) AS chunks FROM k GROUP BY source")
def chunks_per_project(spark, sf_dir):
    return runs.chunks_per_project(chunking.chunk_documents(files(spark, sf_dir)))


@query(SPLIT + """SELECT count(*) AS chunks, count(DISTINCT source) AS projects, CAST(0 AS BIGINT) AS git_chunks,
count(DISTINCT doc_id) AS documents FROM k""")
def index_totals(spark, sf_dir):
    return runs.index_totals(chunking.chunk_documents(files(spark, sf_dir)))


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their headings as markdown."""
    body = F.col("html")
    for depth in range(1, 7):
        body = F.regexp_replace(body, f"<h{depth}>([^<]*)</h{depth}>", "\n" + "#" * depth + " $1\n")
    return table(spark, sf_dir, "pages").select("page_id", body.alias("text"))


_MARKED = "html"
for _depth in range(1, 7):
    _MARKED = f"regexp_replace({_MARKED}, '<h{_depth}>([^<]*)</h{_depth}>', E'\\n{'#' * _depth} \\\\1\\n', 'g')"


@query(rf"""
WITH RECURSIVE m AS (SELECT page_id, {_MARKED} AS md FROM pages),
l AS (SELECT page_id, unnest(string_split(md, E'\n')) AS line, generate_subscripts(string_split(md, E'\n'), 1) AS i FROM m),
h AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n, length(regexp_extract(line, '^(#{{1,6}})\s+', 1)) AS d,
      regexp_extract(line, '^(#{{1,6}})\s+(.*?)\s*#*\s*$', 2) AS t FROM l WHERE regexp_matches(line, '^(#{{1,6}})\s+(.*?)\s*#*\s*$')),
w AS (SELECT page_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS stack FROM m
      UNION ALL SELECT h.page_id, h.n, list_append(w.stack[1:h.d - 1], h.t) FROM w JOIN h ON h.page_id = w.page_id AND h.n = w.n + 1)
SELECT page_id, n AS section, array_to_string(stack, ' > ') AS heading_path FROM w""")
def sections_headings(spark, sf_dir):
    rows = chunking.section_rows(marked_up(spark, sf_dir), "page_id")
    return rows.select(F.col("id").alias("page_id"), F.col("n").cast("long").alias("section"), "heading_path")


@query("""SELECT source AS project, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
CASE WHEN sum(strlen(text)) < 1024 THEN printf('%d B', CAST(sum(strlen(text)) AS BIGINT)) WHEN sum(strlen(text)) < 1048576 THEN printf('%.1f KB', sum(strlen(text)) / 1024.0)
ELSE printf('%.1f MB', sum(strlen(text)) / 1048576.0) END AS size FROM documents GROUP BY ROLLUP (source)""")
def discover_listing(spark, sf_dir):
    from .sources.documents import per_project

    found = files(spark, sf_dir).withColumn("size_bytes", F.octet_length("text").cast("long"))
    return per_project(found).withColumn("size", text.human_bytes("bytes"))


@query("""SELECT doc_id FROM documents
WHERE regexp_matches('doc-' || doc_id || '.md', '(?i)^(doc-1.*\\.md|doc-.5\\.md|DOC-[2-3].\\.MD|doc-[^0-8]\\.md)$')""".replace("\\\\", "\\"))
def fnmatch_filter(spark, sf_dir):
    patterns = ("doc-1*.md", "doc-?5.md", "DOC-[2-3]?.MD", "doc-[!0-8].md")
    return files(spark, sf_dir).where(text.matches_any("rel_path", patterns)).select("doc_id")


@query(r"""
WITH f AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS rel FROM pages),
r AS (SELECT DISTINCT split_part(rel, '/', 1) AS root FROM f WHERE page_id % 2 = 0
      UNION SELECT split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2) FROM f WHERE page_id % 3 = 0)
SELECT page_id, (SELECT max_by(root, length(root)) FROM r WHERE rel LIKE root || '/%') AS root FROM f""")
def nearest_git_root(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("rel"))
    host, lang = F.split("rel", "/")[0], F.split("rel", "/")[1]
    roots = pages.where("page_id % 2 = 0").select(host.alias("root")).union(
        pages.where("page_id % 3 = 0").select(F.concat_ws("/", host, lang).alias("root"))
    )
    return nearest_root(pages, roots).select("page_id", "root")


@query(r"""SELECT doc_id, CASE WHEN length(f) <= 240 THEN f ELSE rtrim(substring(f, 1, 240)) || '...' END AS snippet,
source || ' / doc-' || doc_id || '.md' || CASE WHEN doc_id % 2 = 0 THEN ' > ' || lang ELSE '' END AS citation
FROM (SELECT *, trim(regexp_replace(text, '[\s\x0B\x0C]+', ' ', 'g')) AS f FROM documents)""")
def snippets_and_citations(spark, sf_dir):
    docs = files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    heading = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    return docs.select("doc_id", text.snippet("text").alias("snippet"), text.citation("project", "rel_path", heading).alias("citation"))


# --- embedding ---------------------------------------------------------------

_STOPPED = ", ".join(f"'{w}'" for w in STOP_WORDS)
COUNTED = f"""
WITH x AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark),
w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM x),
k AS (SELECT id, CAST(('0x' || substr(sha256(word), 1, 8))::BIGINT % 256 AS INTEGER) AS dimension, count(*) AS weight
      FROM w WHERE word NOT IN ({_STOPPED}) GROUP BY ALL)"""


@query(COUNTED + " SELECT id AS doc_id, CAST(dimension AS BIGINT) AS dimension, weight FROM k WHERE id >= 0")
def keyword_counts(spark, sf_dir):
    found = embedding.keyword_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), long("dimension"), "weight")


FOUND = COUNTED + """,
z AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM k GROUP BY id),
d AS (SELECT q.id AS query_id, c.id AS chunk_id, CAST(sum(q.weight * c.weight) AS DOUBLE) AS dot FROM k q JOIN k c USING (dimension) WHERE q.id < 0 AND c.id >= 0 GROUP BY ALL),
v AS (SELECT -1 - query_id AS query_id, chunk_id, round(dot / (zq.norm * zc.norm), 12) AS score
      FROM d JOIN z zq ON zq.id = query_id JOIN z zc ON zc.id = chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM v QUALIFY rank <= 10)"""


def keyword_results(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The k documents nearest to each benchmark item, by keyword vectors."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "project")
    chunks = embedding.keyword_vectors(docs, "doc_id", "text", carry=["project"]).withColumnRenamed("id", "chunk_id")
    chunks = chunks.withColumns({"rel_path": F.lit(""), "content_hash": F.col("chunk_id").cast("string")})
    asked = embedding.keyword_vectors(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return retrieval.ranked(chunks, asked.withColumnRenamed("id", "query_id"), k)


@query(FOUND + " SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, round(score, 6) AS score FROM r")
def keyword_search(spark, sf_dir):
    return shown(keyword_results(spark, sf_dir))


def hashed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents as chunks, a cache that holds the texts of even ids)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("embed_text"), F.sha2("text", 256).alias("content_hash"))
    saved = rows.where("doc_id % 2 = 0").select(F.concat(F.lit("space|"), "content_hash").alias("key"), F.array(F.lit(1.0)).alias("vector"))
    return rows, saved.dropDuplicates(["key"])


KEYED = "WITH c AS (SELECT doc_id, text, sha256(text) AS h FROM documents), s AS (SELECT DISTINCT h FROM c WHERE doc_id % 2 = 0)"


@query(KEYED + """ SELECT count(*) FILTER (h IN (SELECT h FROM s)) AS reused,
count(DISTINCT CASE WHEN h NOT IN (SELECT h FROM s) THEN h END) AS to_embed FROM c""")
def embedding_plan(spark, sf_dir):
    rows, cache = hashed(spark, sf_dir)
    return embedding.embedding_plan(embedding.with_cache(rows, cache, "space"))


@query(KEYED + " SELECT h AS content_hash, min(doc_id) AS first_doc FROM c WHERE h NOT IN (SELECT h FROM s) GROUP BY h")
def pending_first_seen(spark, sf_dir):
    rows, cache = hashed(spark, sf_dir)
    found = embedding.pending(embedding.with_cache(rows, cache, "space"), ["doc_id"])
    return found.select(F.substring_index("key", "|", -1).alias("content_hash"), F.col("first_seen.doc_id").alias("first_doc"))


BATCHED = """
WITH RECURSIVE o AS (SELECT doc_id, source, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
b AS (SELECT source, doc_id, n, CAST(1 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS held, t AS total FROM o WHERE n = 1
      UNION ALL
      SELECT o.source, o.doc_id, o.n, CASE WHEN shut THEN batch + 1 ELSE batch END, CASE WHEN shut THEN 1 ELSE held + 1 END, CASE WHEN shut THEN o.t ELSE total + o.t END
      FROM (SELECT b.*, o.doc_id AS nd, o.t AS nt, held >= 100 OR total + o.t > 12000 AS shut FROM b JOIN o ON o.source = b.source AND o.n = b.n + 1) x
      JOIN o ON o.source = x.source AND o.n = x.n + 1)"""


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", text.estimate_tokens("text").cast("long").alias("tokens"))
    return embedding.plan_batches(rows, ["source"], ["doc_id"])


@query(BATCHED + " SELECT doc_id, source, batch FROM b")
def plan_batches(spark, sf_dir):
    return batched(spark, sf_dir).select("doc_id", "source", "batch")


@query(BATCHED + """ SELECT source, CAST(max(batch) AS BIGINT) AS batches, CAST((max(batch) - 1) * 60 AS BIGINT) AS seconds,
CASE WHEN (max(batch) - 1) * 60 < 60 THEN 'under a minute' ELSE printf('~%d min', CAST(max(batch) - 1 AS BIGINT)) END AS shown FROM b GROUP BY source""")
def estimate_seconds(spark, sf_dir):
    waits = batched(spark, sf_dir).groupBy("source").agg(F.max("batch").alias("batches"))
    waits = waits.withColumn("seconds", embedding.pacing_seconds(F.col("batches")).cast("long"))
    return waits.withColumn("shown", text.duration("seconds"))


# --- commits -----------------------------------------------------------------


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as commits: the role is the author, the text subject and body."""
    rows = table(spark, sf_dir, "conversations")
    bump = F.concat(F.lit("v1."), F.col("conv_id").cast("string"))
    return rows.select(
        "conv_id",
        "turn",
        F.concat(F.lit("repo"), (F.col("conv_id") % 7).cast("string")).alias("project"),
        F.when(F.col("turn") % 4 == 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("parents"),
        F.col("role").alias("author_name"),
        F.concat("role", F.lit("@Example.com")).alias("author_email"),
        F.when(F.col("turn") == 2, bump).otherwise(F.substring("text", 1, 40)).alias("subject"),
        F.expr("substring(text, 41)").alias("body"),
        F.split("text", " ").alias("files"),
    )


HISTORY = """
WITH h AS (SELECT conv_id, turn, 'repo' || (conv_id % 7) AS project, turn % 4 = 3 AS merged, role,
  CASE WHEN turn = 2 THEN 'v1.' || conv_id ELSE substring(text, 1, 40) END AS subject, substring(text, 41) AS body, string_split(text, ' ') AS files FROM conversations)"""


@query(HISTORY + r""" SELECT project, count(*) FILTER (c = 1) AS merges, count(*) FILTER (c = 2) AS version_bumps, count(*) FILTER (c = 3) AS other_authors,
count(*) FILTER (c = 4) AS kept FROM (SELECT project, CASE WHEN merged THEN 1
WHEN regexp_matches(trim(subject, E' \n'), '(?i)^(?:chore(?:\([^)]*\))?:\s*bump version\b.*|v?\d+(?:\.\d+)+)$') THEN 2
WHEN role NOT IN ('user', 'assistant') THEN 3 ELSE 4 END AS c FROM h) GROUP BY project""")
def commit_filter_counts(spark, sf_dir):
    found = commits.classified(history(spark, sf_dir), ["USER@example.com "], [" Assistant"])
    return commits.class_counts(found, "project")


@query(HISTORY + r""" SELECT conv_id, turn, body = '' OR length(CASE WHEN body = '' THEN subject ELSE subject || E'\n\n' || body END) < 200 AS thin,
sha256(concat_ws(E'\n\n', subject, nullif(body, ''), CASE WHEN len(files) > 0 THEN E'Files changed:\n' || array_to_string(files[1:30], E'\n') ||
CASE WHEN len(files) > 30 THEN E'\n... and ' || (len(files) - 30) || ' more' ELSE '' END END)) AS digest FROM h""")
def commit_texts(spark, sf_dir):
    whole = commits.commit_text(F.col("subject"), F.col("body"), F.col("files"), F.lit(""))
    return history(spark, sf_dir).select("conv_id", "turn", commits.is_thin(F.col("subject"), F.col("body")).alias("thin"), F.sha2(whole, 256).alias("digest"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id AS id FROM documents),
e AS (SELECT id AS child, CASE WHEN id % 10 = 0 THEN id // 2 ELSE id - 1 END AS parent FROM d WHERE id > 0
      UNION SELECT id, id - 17 FROM d WHERE id % 13 = 0 AND id >= 17),
s AS (SELECT source AS project, max(doc_id) AS ours, max(doc_id) FILTER (doc_id % 3 = 0) AS theirs FROM documents GROUP BY source),
r AS (SELECT project, 'ours' AS side, ours AS id FROM s UNION SELECT project, 'theirs', theirs FROM s WHERE theirs IS NOT NULL
      UNION SELECT r.project, r.side, e.parent FROM r JOIN e ON e.child = r.id WHERE e.parent IN (SELECT id FROM d))
SELECT project, side, count(*) AS commits FROM (SELECT project, id, CASE WHEN count(*) = 2 THEN 'both' ELSE min(side) END AS side FROM r GROUP BY project, id) GROUP BY ALL""")
def commit_sides(spark, sf_dir):
    """Documents as commits with lines, forks and merges; each source has two branches, by its last ids."""
    docs = table(spark, sf_dir, "documents")
    one = F.when(F.col("doc_id") % 10 == 0, F.floor(F.col("doc_id") / 2)).otherwise(F.col("doc_id") - 1)
    two = F.when((F.col("doc_id") % 13 == 0) & (F.col("doc_id") >= 17), F.col("doc_id") - 17)
    log = docs.select(F.col("doc_id").alias("hash"), F.array_compact(F.array(F.when(F.col("doc_id") > 0, one), two)).alias("parents"))
    heads = docs.groupBy(F.col("source").alias("project")).agg(
        F.max("doc_id").alias("ours"), F.max(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).alias("theirs")
    )
    return ancestry.sides(log, heads).groupBy("project", "side").agg(F.count("*").alias("commits"))


_COMMIT = r"""concat_ws(E'\n\n', subject, nullif(body, ''), CASE WHEN len(files) > 0 THEN E'Files changed:\n' || array_to_string(files[1:30], E'\n') ||
CASE WHEN len(files) > 30 THEN E'\n... and ' || (len(files) - 30) || ' more' ELSE '' END END)"""


@query("WITH RECURSIVE" + HISTORY.strip()[4:] + rf""",
t AS (SELECT conv_id * 1000 + turn AS doc_id, project AS source, trim({_COMMIT}, E' \n\t\r\x0B\x0C') AS x FROM h),
""" + SPLIT.split("FROM documents),", 1)[1] + r""",
g AS (SELECT k.*, sha256(conv_id || '/' || turn) AS hash, subject, conv_id, turn FROM k JOIN h ON h.conv_id * 1000 + h.turn = k.doc_id)
SELECT conv_id, turn, CAST(chunk_index AS BIGINT) AS chunk_index, sha256(source || '|git:' || hash || '|' || chunk_index) AS chunk_id,
sha256(source || ' · commit ' || substring(hash, 1, 7) || ' · 2024-03-' || printf('%02d', CAST(turn % 28 + 1 AS INTEGER)) || E'\n' || CASE WHEN starts_with(piece, subject) THEN piece ELSE subject || E'\n\n' || piece END) AS content_hash FROM g""")
def commit_chunks(spark, sf_dir):
    rows = history(spark, sf_dir).withColumns(
        {
            "path": F.lit("/repo"), "hash": F.sha2(F.concat_ws("/", "conv_id", "turn"), 256),
            "author_date": F.format_string("2024-03-%02dT10:00:00+00:00", (F.col("turn") % 28 + 1).cast("int")),
        }
    )
    chunks = commits.commit_chunks(rows).withColumnRenamed("commit", "hash")
    return chunks.join(rows.select("hash", "conv_id", "turn"), "hash").select("conv_id", "turn", long("chunk_index"), "chunk_id", "content_hash")


def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a commit that adds it, every tenth under the name of a lock file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, "yarn.lock").otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")))
    head = F.concat(
        F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +1,9 @@\n+")
    )
    return docs.select(F.col("doc_id").alias("hash"), F.concat(head, F.regexp_replace("text", "\n", "\n+")).alias("diff"))


_SECRET = " OR ".join(f"regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}')" for p in SECRETS)
LINES = r"WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS i FROM documents)"


@query(LINES + rf""" SELECT doc_id, regexp_replace(substring('@@ -0,0 +1,9 @@' || coalesce(string_agg(E'\n+' || line, '' ORDER BY i) FILTER (NOT ({_SECRET.replace("(line", "('+' || line")})), ''), 1, 800), '\s+$', '') AS excerpt
FROM l WHERE doc_id % 10 <> 0 GROUP BY doc_id""")
def diff_excerpts(spark, sf_dir):
    return commits.diff_excerpts(document_diffs(spark, sf_dir)).select(F.col("hash").alias("doc_id"), "excerpt")


@query(LINES + """ SELECT doc_id, CAST(i AS BIGINT) AS line, CASE WHEN doc_id % 10 = 0 THEN 'yarn.lock' ELSE 'doc-' || doc_id || '.md' END AS file,
CAST(length(line) AS BIGINT) AS n_chars FROM l""")
def diff_added_lines(spark, sf_dir):
    found = leaks.added_lines(document_diffs(spark, sf_dir))
    return found.select(F.col("hash").alias("doc_id"), long("line"), "file", F.length("text").cast("long").alias("n_chars"))


@query(LINES + f" SELECT doc_id, CAST(i AS BIGINT) AS line FROM l WHERE {_SECRET}")
def secret_lines(spark, sf_dir):
    each = leaks.numbered_lines(table(spark, sf_dir, "documents"), "doc_id")
    return each.where(looks_secret(F.col("text"))).select("doc_id", long("line"))


# --- leaks -------------------------------------------------------------------

HITS = LINES + r""", e AS (
  SELECT doc_id, i, 'email' AS kind, unnest(regexp_extract_all(line, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+')) AS m FROM l
  UNION ALL SELECT doc_id, i, 'drive path', unnest(regexp_extract_all(line, '(?:^|[^A-Za-z])([A-Za-z]:[\\/][^\s''"`)\]>,;]*)', 1)) FROM l
  UNION ALL SELECT doc_id, i, 'home path', unnest(regexp_extract_all(line, '(?:^|[^\w:.])((?:/home/|/Users/)[^\s''"`)\]>,;]+)', 1)) FROM l
  UNION ALL SELECT doc_id, i, 'google api key', unnest(regexp_extract_all(line, 'AIza[0-9A-Za-z_\-]{35}')) FROM l),
t AS (SELECT doc_id, i, m, CASE WHEN kind = 'email' AND regexp_matches(m, '(?i)@(?:[\w-]+\.)*(?:example\.(?:com|org|net)|[\w-]+\.(?:invalid|test|local|localhost|example))$') THEN 'placeholder email' ELSE kind END AS kind FROM e)"""


def document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.pattern_hits(leaks.numbered_lines(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


@query(HITS + " SELECT doc_id, CAST(i AS BIGINT) AS line, kind, m AS match FROM t")
def leak_hits(spark, sf_dir):
    return document_hits(spark, sf_dir).select("doc_id", long("line"), "kind", "match")


@query(r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark), t AS (SELECT term FROM w WHERE length(term) = 7),
d AS (SELECT doc_id, lower(text) AS x FROM documents),
h AS (SELECT doc_id, term, (length(x) - length(replace(x, term, ''))) // 7 AS hits FROM d, t WHERE contains(x, term))
SELECT doc_id, term, CAST(hits AS BIGINT) AS hits FROM h""")
def private_terms(spark, sf_dir):
    """Words of seven letters that the benchmark has, as terms that documents must not hold; one pass for all of them."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    found = table(spark, sf_dir, "benchmark").select(words.alias("term")).where("length(term) = 7").distinct()
    terms = sorted(r["term"] for r in found.collect())
    lines = leaks.numbered_lines(table(spark, sf_dir, "documents"), "doc_id")
    return leaks.term_hits(lines, terms, "doc_id").groupBy("doc_id", F.lower("match").alias("term")).agg(F.count("*").alias("hits"))


@query("""SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND strlen(substring(text, 1, doc_id * 97 % 12000)) < 8000""")
def binary_files(spark, sf_dir):
    """Documents as files, of which every third has a NUL somewhere; only one near the start makes a file binary."""
    at = (F.col("doc_id") * 97 % 12_000).cast("int")
    nul = F.concat(F.substring(F.col("text"), F.lit(1), at), F.lit("\0"), F.substring(F.col("text"), at + 1, F.length("text")))
    content = F.when(F.col("doc_id") % 3 == 0, nul).otherwise(F.col("text")).cast("binary")
    return table(spark, sf_dir, "documents").where(leaks.is_binary(content)).select("doc_id")


def accepted_hits(hits: DataFrame) -> DataFrame:
    """An entry for each hit of ids divisible by 3 or 2; that of ids divisible by 3 counts a line too many."""
    counted = hits.groupBy("doc_id", "match").agg(F.count_distinct("line").alias("n"))
    return counted.where("doc_id % 3 = 0 or doc_id % 2 = 0").select("doc_id", "match", (F.col("n") + (F.col("doc_id") % 3 == 0).cast("int")).alias("count"))


ACCEPTED = HITS + ", a AS (SELECT doc_id, m, count(DISTINCT i) + CAST(doc_id % 3 = 0 AS INTEGER) AS c FROM t WHERE doc_id % 3 = 0 OR doc_id % 2 = 0 GROUP BY doc_id, m)"


@query(ACCEPTED + """, n AS (SELECT doc_id, lower(m) AS m, count(DISTINCT i) AS n FROM t GROUP BY ALL)
SELECT t.doc_id, CAST(i AS BIGINT) AS line, kind, CASE WHEN n.n = a.c AND kind <> 'google api key' THEN 'accepted' ELSE 'new' END AS state
FROM t JOIN n ON n.doc_id = t.doc_id AND n.m = lower(t.m) LEFT JOIN a ON a.doc_id = t.doc_id AND lower(a.m) = lower(t.m)""")
def classify_hits(spark, sf_dir):
    hits = document_hits(spark, sf_dir)
    return leaks.classified(hits, accepted_hits(hits), "doc_id").select("doc_id", long("line"), "kind", "state")


@query(ACCEPTED + """ SELECT a.doc_id, a.m AS match, CAST(a.c AS BIGINT) AS count, (SELECT count(DISTINCT i) FROM t WHERE t.doc_id = a.doc_id AND lower(t.m) = lower(a.m)) AS found
FROM a WHERE found < a.c""")
def stale_entries(spark, sf_dir):
    hits = document_hits(spark, sf_dir)
    return leaks.stale(hits, accepted_hits(hits), "doc_id").select("doc_id", "match", long("count"), "found")


@query(ACCEPTED + """ SELECT kind, count(*) FILTER (NOT ok) AS new, count(*) FILTER (ok) AS accepted FROM (
SELECT kind, coalesce((SELECT count(DISTINCT i) FROM t u WHERE u.doc_id = t.doc_id AND lower(u.m) = lower(t.m)) = (SELECT min(c) FROM a WHERE a.doc_id = t.doc_id AND lower(a.m) = lower(t.m)), false)
AND kind <> 'google api key' AS ok FROM t) GROUP BY kind""")
def scan_totals(spark, sf_dir):
    hits = document_hits(spark, sf_dir)
    return leaks.totals(leaks.classified(hits, accepted_hits(hits), "doc_id"))


# --- evaluation --------------------------------------------------------------


def suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions: a text, a project, a lure or a no-answer check by id modulo 4."""
    kind = F.col("item_id") % 4
    project = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    some = F.array(project, F.lit("src1"), F.lit("src2"), F.lit("src3"), F.lit("src4"))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"),
        F.when(kind < 2, some).otherwise(none).alias("expected_projects"),
        F.when(kind == 0, F.array(F.upper("text"), F.lit("no such text"))).otherwise(none).alias("expected_text"),
        F.when(kind == 2, project).alias("lure_project"),
        F.when(kind == 2, F.col("text")).alias("lure_text"),
    )


def suite_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    found = keyword_results(spark, sf_dir).join(docs, "chunk_id")
    return found.withColumnRenamed("query_id", "id").withColumn("chunk_index", F.col("chunk_id"))


JUDGED = FOUND + r""",
q AS (SELECT item_id AS id, item_id % 4 AS kind, text, 'src' || (item_id % 20) AS own FROM benchmark),
xr AS (SELECT r.query_id AS id, r.rank, d.source, r.chunk_id, r.score, replace(lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))), 'ß', 'ss') AS hay FROM r JOIN documents d ON d.doc_id = r.chunk_id),
mt AS (SELECT xr.* FROM xr JOIN q USING (id) WHERE ((kind = 0 AND source IN (own, 'src1', 'src2', 'src3', 'src4')) OR (kind = 2 AND source = own))
       AND contains(hay, replace(lower(trim(regexp_replace(q.text, '\s+', ' ', 'g'))), 'ß', 'ss')) QUALIFY row_number() OVER (PARTITION BY xr.id ORDER BY rank) = 1),
ex AS (SELECT DISTINCT id, unnest([own, 'src1', 'src2', 'src3', 'src4']) AS p FROM q WHERE kind < 2),
fo AS (SELECT id, count(*) FILTER (hit) AS found, count(*) FILTER (NOT hit) AS missing FROM (SELECT id, p, EXISTS (SELECT 1 FROM xr WHERE xr.id = ex.id AND xr.source = ex.p) AS hit FROM ex) GROUP BY id),
oc AS (SELECT q.id, kind, coalesce(found, 0) AS found, coalesce(missing, 0) AS missing,
  CASE kind WHEN 0 THEN mt.id IS NOT NULL WHEN 2 THEN mt.id IS NOT NULL WHEN 1 THEN missing = 0 END AS passed FROM q LEFT JOIN fo USING (id) LEFT JOIN mt USING (id))"""


@query(JUDGED + " SELECT id, CAST(rank AS BIGINT) AS rank, source AS project, chunk_id AS chunk_index FROM mt")
def eval_text_match(spark, sf_dir):
    needles = evaluation.needles(evaluation.with_check(suite(spark, sf_dir)))
    found = evaluation.text_matches(needles, suite_results(spark, sf_dir))
    return found.select("id", long("rank"), "project", "chunk_index")


@query(JUDGED + """ SELECT id, CASE kind WHEN 0 THEN 'text' WHEN 1 THEN 'project' WHEN 2 THEN 'lure' ELSE 'no-answer' END AS "check",
CAST(found AS BIGINT) AS found, CAST(missing AS BIGINT) AS missing, passed FROM oc""")
def eval_outcomes(spark, sf_dir):
    found = evaluation.evaluate(suite(spark, sf_dir), suite_results(spark, sf_dir))
    return found.select("id", "check", F.size("found").cast("long").alias("found"), F.size("missing").cast("long").alias("missing"), "passed")


@query(JUDGED + """ SELECT count(*) AS questions, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS no_answer,
count(*) FILTER (kind >= 2) AS traps, count(*) FILTER (kind = 0) AS text_scored, count(*) FILTER (kind = 0 AND passed) AS text_passed,
count(*) FILTER (kind = 1) AS project_scored, count(*) FILTER (kind = 1 AND passed) AS project_passed, count(*) FILTER (kind = 2) AS lure_scored,
count(*) FILTER (kind = 2 AND passed) AS lure_passed, count(*) FILTER (kind < 2) AS expecting_an_answer,
count(*) FILTER (kind < 2 AND missing = 0) AS all_expected_found, count(*) FILTER (kind < 2 AND found > 0) AS any_expected_found FROM oc""")
def eval_summary(spark, sf_dir):
    return evaluation.summary(evaluation.evaluate(suite(spark, sf_dir), suite_results(spark, sf_dir)))


@query("""SELECT item_id AS id, CASE item_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'project' WHEN 2 THEN 'lure' ELSE 'no-answer' END AS "check", item_id % 4 > 1 AS expects_no_answer FROM benchmark""")
def question_checks(spark, sf_dir):
    return evaluation.with_check(suite(spark, sf_dir)).select("id", "check", "expects_no_answer")


# --- guards ------------------------------------------------------------------


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("project")).distinct()


def names(spark: SparkSession, sf_dir: str, factor: int = 1) -> DataFrame:
    """Project names from the labels of embeddings, in another case."""
    number = F.col("label") * factor
    rows = table(spark, sf_dir, "embeddings").select("label", F.concat(F.lit(" SRC"), number.cast("string")).alias("name")).distinct()
    return rows.withColumnRenamed("label", "position")


@query("SELECT DISTINCT source AS project FROM documents WHERE source NOT IN (SELECT 'src' || label FROM embeddings)")
def new_projects(spark, sf_dir):
    return guards.new_projects(sources(spark, sf_dir), names(spark, sf_dir).select(F.col("name").alias("project")))


@query("""WITH n AS (SELECT DISTINCT source AS p FROM documents), a AS (SELECT DISTINCT 'src' || label * 3 AS p FROM embeddings)
SELECT ' ' || upper(p) AS project, 'not new' AS problem FROM a WHERE p NOT IN (SELECT p FROM n)
UNION ALL SELECT p, 'not accepted' FROM n WHERE p NOT IN (SELECT p FROM a)""")
def acceptance(spark, sf_dir):
    return guards.acceptance(sources(spark, sf_dir), names(spark, sf_dir, 3).select(F.col("name").alias("project")))


@query("""SELECT DISTINCT CAST(label AS BIGINT) AS position, ' SRC' || label * 3 AS name FROM embeddings
WHERE 'src' || label * 3 NOT IN (SELECT source FROM documents)""")
def exclusion_validation(spark, sf_dir):
    return guards.unmatched(names(spark, sf_dir, 3), sources(spark, sf_dir)).select(long("position"), "name")


@query("""SELECT source AS project, count(*) AS files FROM documents WHERE source NOT IN (SELECT 'src' || label FROM embeddings) GROUP BY source""")
def exclude_projects(spark, sf_dir):
    left = guards.without_excluded(files(spark, sf_dir), names(spark, sf_dir))
    return left.groupBy("project").agg(F.count("*").alias("files"))


@query("""WITH n AS (SELECT DISTINCT CAST(label AS BIGINT) AS position, label * 3 AS k FROM embeddings), s AS (SELECT DISTINCT source FROM documents)
SELECT position, s.source AS project, CASE WHEN s.source IS NOT NULL THEN 'hidden' WHEN k = 21 THEN 'absent' ELSE 'unknown' END AS state
FROM n LEFT JOIN s ON s.source = 'src' || k""")
def hidden_projects(spark, sf_dir):
    out = table(spark, sf_dir, "embeddings").where("label = 7").select(F.concat(F.lit("src"), (F.col("label") * 3).cast("string")).alias("project"))
    return guards.hidden(names(spark, sf_dir, 3), sources(spark, sf_dir), out).select(long("position"), "project", "state")


# --- answers -----------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.col("role").alias("project"),
                       F.lit("chat.md").alias("rel_path"), F.when(F.col("turn") > 0, F.lit("later")).otherwise("").alias("heading_path"), "text")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each conversation that cites by its first turn's length."""
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    n = (F.length("text") % 9).cast("int")
    return first.select(
        F.col("conv_id").alias("query_id"), (F.col("conv_id") % 5 > 0).alias("answerable"), F.col("text").alias("answer"),
        F.array(n, n, F.lit(0), (n + 2).cast("int"), F.lit(-1)).alias("citations"),
    )


CITED = """
WITH f AS (SELECT conv_id, length(text) % 9 AS n, text FROM conversations WHERE turn = 0),
c AS (SELECT DISTINCT conv_id, unnest([n, n + 2]) AS number FROM f),
v AS (SELECT c.conv_id, number, role FROM c JOIN conversations t ON t.conv_id = c.conv_id AND t.turn + 1 = number)"""


@query(CITED + " SELECT conv_id AS query_id, CAST(number AS BIGINT) AS number, role AS project FROM v")
def citations_resolve(spark, sf_dir):
    found = answers.citations(replies(spark, sf_dir), turns(spark, sf_dir))
    return found.select("query_id", long("number"), "project")


@query(CITED + """ SELECT conv_id AS query_id, verdict, CASE WHEN verdict = 'answered' THEN text END AS answer FROM (
SELECT conv_id, text, CASE WHEN conv_id % 5 = 0 OR trim(text, E' \\n\\t\\r\\x0B\\x0C') = '' THEN 'refused' WHEN conv_id NOT IN (SELECT conv_id FROM v) THEN 'uncited' ELSE 'answered' END AS verdict FROM f)""")
def answer_verdicts(spark, sf_dir):
    said = replies(spark, sf_dir)
    return answers.verdicts(said, answers.citations(said, turns(spark, sf_dir)))


@query(r"""SELECT query_id, sha256(E'rules\nQuestion: ' || query_id || E'\n\nPassages:\n\n' || string_agg(b, E'\n' ORDER BY n)) AS digest FROM (
SELECT conv_id AS query_id, turn AS n, '<<<PASSAGE ' || (turn + 1) || E'>>>\nproject: ' || role || E'\nfile: chat.md\nsection: ' || CASE WHEN turn > 0 THEN 'later' ELSE '(no heading)' END
|| E'\n---\n' || replace('<<<' || text, '<<<', '< <<') || E'\n<<<END PASSAGE ' || (turn + 1) || '>>>' AS b FROM conversations) GROUP BY query_id""")
def prompt_blocks(spark, sf_dir):
    held = turns(spark, sf_dir).withColumn("text", F.concat(F.lit("<<<"), "text"))
    asked = held.select("query_id", F.col("query_id").cast("string").alias("question")).distinct()
    return answers.prompts("rules", asked, held).select("query_id", F.sha2("prompt", 256).alias("digest"))


@query("""WITH e AS (SELECT event_id, event_id % 9 AS k, round(value) AS v FROM events)
SELECT event_id, CASE k WHEN 2 THEN 'missing: citations' WHEN 3 THEN 'no JSON' WHEN 4 THEN 'answerable is not true or false' WHEN 5 THEN 'answer is not a text'
WHEN 6 THEN 'citations are not passage numbers' WHEN 7 THEN 'no object' WHEN 8 THEN 'an empty reply' END AS problem,
CASE WHEN k < 2 THEN 'said' END AS answer, CASE WHEN k < 2 THEN '1,' || CAST(v AS BIGINT) END AS citations FROM e""")
def parse_replies(spark, sf_dir):
    n = F.round("value").cast("long").cast("string")
    good = F.concat(F.lit('{"answerable": true, "answer": "said", "citations": [1, "'), n, F.lit('"]}'))
    kinds = [
        good, F.concat(F.lit("```json\n"), good, F.lit("\n```")), F.lit('{"answerable": true, "answer": "said"}'), F.lit("I think so"),
        F.regexp_replace(good, "true", "1"), F.regexp_replace(good, '"said"', "7"), F.regexp_replace(good, r"\[1", "[true"), F.lit("[1, 2]"), F.lit(" \n "),
    ]
    reply = F.element_at(F.array(*kinds), (F.col("event_id") % 9 + 1).cast("int"))
    parsed = answers.parse_replies(table(spark, sf_dir, "events").select("event_id", "value", reply.alias("reply")))
    return parsed.select("event_id", "problem", F.col("raw.answer").alias("answer"), F.array_join("raw.citations", ",").alias("citations"))


@query("""SELECT event_id, event_type <> 'view' AND value > 1.0 AS changed,
CASE WHEN event_id % 3 = 0 THEN 'undated' ELSE event_type || ' ' || strftime(ts, '%Y-%m-%d') END || CASE WHEN event_type <> 'view' AND value > 1.0 THEN ', changed since indexed' ELSE '' END AS line
FROM events""")
def changed_since_indexed(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", F.lit("git")).otherwise("doc")
    changed = answers.changed_since_indexed(F.col("value") + F.lit(0.0), F.lit(0.0), kind)
    day = F.when(F.col("event_id") % 3 == 0, F.lit("unknown")).otherwise(text.day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    rows = table(spark, sf_dir, "events").withColumns({"changed": changed, "day": day})
    return rows.select("event_id", "changed", text.source_line("event_type", "day", "changed").alias("line"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def commit_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T01:00:00+05:30"))
    said = F.when(F.col("o_orderkey") % 4 > 0, iso).when(F.col("o_orderkey") % 8 > 0, F.lit("2024-13-45T00:00:00Z"))
    return orders.select("o_orderkey", text.day(said).alias("day"))
