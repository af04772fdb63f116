"""The queries opN_<name>, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, class_lm, embedding_dedup, exact_dedup, html_extract, language_id, lexical_search, licence_scan, mixing, ngram_join, secret_scan, vector_codes, vector_search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    base = "filter(secrets, s -> s.kind <> 'token')"
    written = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    kinds = [F.expr(f"size(filter(secrets, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("doc_id", *kinds, F.sha2(F.expr(written.format(base)).cast("binary"), 256).alias("base_sha256"), F.expr(written.format("secrets")).alias("spans"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    model = language_id.fit(docs, where=~held)
    return language_id.identify(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.licence_scan(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

#: Components of the table links (a < b) of nodes (id), by walking all links.
REACH = """sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(id, least) AS (SELECT id, id FROM nodes UNION SELECT l.b, w.least FROM walk w JOIN sym l ON l.a = w.id),
component AS (SELECT id, min(least) AS component_id FROM walk GROUP BY id)"""

OP7_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
nodes AS (SELECT doc_id AS id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
links AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL) x JOIN nodes m ON m.id = x.a JOIN nodes n ON n.id = x.b WHERE 100 * c >= 80 * (m.n + n.n - c)),
{REACH}
SELECT id AS doc_id, n AS n_shingles, component_id FROM nodes JOIN component USING (id)
"""

OP8_SQL = rf"""
WITH rows_ AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
weighed AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM sizes),
-- With the k sources of the smallest cap per weight stopped, the others share the rest; the first k whose level stops no more is right.
stopped AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM weighed),
level AS (SELECT (1.5::DOUBLE * (SELECT sum(size) FROM rows_) - caps) / free AS level FROM stopped WHERE (1.5::DOUBLE * (SELECT sum(size) FROM rows_) - caps) / free <= cap / weight ORDER BY cap / weight, source LIMIT 1),
targets AS (SELECT source, source_size, least(cap, weight * level) AS target FROM weighed, level),
rated AS (SELECT r.doc_id, r.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, ('0x' || substring(md5('7:' || coalesce(r.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""

OP10_SQL = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.9::DOUBLE),
links AS (SELECT a, b FROM near WHERE a < b), counts AS (SELECT a AS id, count(*) AS n FROM near GROUP BY a),
{REACH}
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN counts USING (id)
"""

OP12_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}'), '{lexical_search.TERM}') AS w FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}'), '{lexical_search.TERM}')) AS term FROM benchmark),
whole AS (SELECT (count(*) FILTER (len(w) > 0))::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM words),
lengths AS (SELECT doc_id, len(w)::BIGINT AS n, 50 + (50 * len(w)::BIGINT * docs) // terms AS m FROM words, whole WHERE len(w) > 0),
counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM counts, whole GROUP BY term),
scores AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op13_sql() -> str:
    """The rounds one after the other, each a table of entries made from the one before."""
    n, last = vector_codes.ENTRIES, vector_codes.ROUNDS
    near = "SELECT p.vec_id, p.part, arg_min(b.entry, list_aggregate(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum')::BIGINT * {n} + b.entry) AS entry, min(list_aggregate(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum'))::BIGINT AS far FROM parts p JOIN book{r} b USING (part) GROUP BY ALL"
    rounds = []
    for r in range(last):
        rounds.append(f"near{r} AS MATERIALIZED ({near.format(n=n, r=r)})")
        rounds.append(f"means{r} AS (SELECT part, entry, list(mean ORDER BY pos) AS x FROM (SELECT q.part, entry, pos, floor(sum(v) / count(*)::DOUBLE)::BIGINT AS mean FROM (SELECT part, vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM parts) q JOIN near{r} USING (vec_id, part) GROUP BY ALL) GROUP BY ALL)")
        rounds.append(f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN means{r} m USING (part, entry))")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
parts AS MATERIALIZED (SELECT vec_id, part, x[len(x) // {vector_codes.PARTS} * part + 1 : len(x) // {vector_codes.PARTS} * (part + 1)] AS x FROM kept, range({vector_codes.PARTS}) AS t(part)),
book0 AS (SELECT part, entry, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {n}) USING (vec_id)),
{", ".join(rounds)},
finally AS MATERIALIZED ({near.format(n=n, r=last)}),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM finally GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""


QUERIES = {f.__name__: f for f in (op1_bpe, op2_secrets, op3_class_lm, op4_language_id, op5_main_text, op6_license_scan, op7_ngram_join, op8_mixing, op9_exact_dedup, op10_embedding_dedup, op11_vector_search, op12_lexical_search, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": licence_scan.scan_sql(), "op7_ngram_join": OP7_SQL, "op8_mixing": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op10_embedding_dedup": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_vector_codes": op13_sql()}
