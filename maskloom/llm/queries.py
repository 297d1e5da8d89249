"""One thin query per operator, its digest columns derived from the operator's output, and DuckDB forms."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, collocations, content_sort, huffman_ids, line_chunks, minhash, mixing, periodic_runs, pieces, prefix_free, topk, toxicity, warc_store
from .common import scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


@query(r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)""")
def op8_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_sort_dedup(table(spark, sf_dir, "documents"))


@query()
def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(table(spark, sf_dir, "documents"))
    each = F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))
    return chosen.select("*", each.alias("one")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


PLANTED = r"\### Assistant: </turn> ok"


@query(r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\s'), '</turn>', '\e'), '### ', '\h'), ': ', '\c') AS esc,
  row_number() OVER w - 1 AS place, (coalesce(lag(role) OVER w, 'start') || ' ' || role) IN
    ('start system', 'start user', 'system user', 'user assistant', 'assistant user') AS fits FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(esc) + 8) AS BIGINT) AS formatted_chars, bool_and(fits) AS valid,
  CAST(min(CASE WHEN NOT fits THEN place END) AS INTEGER) AS bad_turn
FROM e GROUP BY conv_id""")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    read = chat_format.read_chats(chat_format.format_chats(rows.unionByName(planted)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "valid", "bad_turn")


@query()
def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


LINE_HASH = "CAST('0x' || substr(md5(l), 1, 7) AS BIGINT)"


@query(rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM d),
h AS (SELECT doc_id, i, l, {LINE_HASH} AS h FROM x),
b AS (SELECT doc_id, i, l, CASE WHEN i = 0 OR ((lag(h) OVER w * 31 + h) % 65521) % 3 = 0 THEN 1 ELSE 0 END AS s FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, l, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
g AS (SELECT doc_id, k, min(i) AS start, count(*) AS n, string_agg(l, chr(10) ORDER BY i) AS t FROM c GROUP BY doc_id, k),
r AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY t, n > 1 ORDER BY doc_id, start) > 1 AS gone FROM g)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN t END, chr(10) ORDER BY start), '')) AS kept_sha256
FROM r GROUP BY doc_id""")
def op4_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, ls, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM d),
s AS (SELECT doc_id, ls, l, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM x WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, i, j, array_to_string(ls[i:j], chr(10)) AS t FROM s WHERE j IS NOT NULL
  UNION ALL SELECT doc_id, i, i, l FROM s WHERE len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 50),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS place FROM w) WHERE place > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, j)) AS i FROM r)
SELECT x.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN l END, chr(10) ORDER BY x.i), '')) AS kept_sha256
FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id""")
def op4_line_runs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line dedup of the pipeline; the query before is held to whole chunks by its SQL."""
    out = line_chunks.dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op6_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, labels))
    return scored.select("doc_id", F.coalesce(toxicity.fold_of("doc_id") == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def op2_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows, rows.filter("id % 50 = 0"))


@query()
def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = scratch(spark, "id-files")
    huffman_ids.encode_and_write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return huffman_ids.read_ids(spark, path, digest_only=True)


@query()
def op5_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return back.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), F.sha2("decoded", 256).alias("decoded_sha256"),
                       F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("exact"))


@query()
def op3_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS b FROM pages),
k AS (SELECT *, b >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER (PARTITION BY h) AS again, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, b AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN keeper END AS refers_to, true AS intact FROM k""")
def op11_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc_store.write_archive(table(spark, sf_dir, "pages"), path)
    return warc_store.described(warc_store.read_archive(spark, path))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Texts of ids whose crc32 is divisible by ten repeat their words from the a-th on with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    rows = rows.withColumn("a", F.when(F.size("words") > 0, F.col("g") % F.size("words")))
    rows = rows.withColumn("p", 1 + F.floor((F.size("words") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence(F.col("a"), F.size("words") - 1), lambda i: F.col("words")[(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")])
    periodic = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


@query()
def op13_lcp_kruskal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


@query(r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT lang, phrase, m, a, ws, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * k.a // (x.a + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s) WHERE place = 1),
h AS (SELECT lang, unnest(flatten(list_transform(range(2, m), lambda z: list_transform(range(1, m - z + 2), lambda i: array_to_string(ws[i:i + z - 1], ' '))))) AS phrase, a
  FROM c WHERE m > 2),
o AS (SELECT lang, phrase, max(a) AS held FROM h GROUP BY lang, phrase),
q AS (SELECT b.*, n.n FROM b JOIN n USING (lang) LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE held IS NULL OR CAST(100 AS HUGEINT) * held < CAST(80 AS HUGEINT) * b.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q) WHERE rank <= 2000""")
def op12_era_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
