"""The operators of this subpackage as named queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontam, fingerprints, forest, jaccard, lines, lm, negatives, runs, secrets, toxicity, unigram, urlfilter
from .common import hex_digest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECE_MODEL = "piece_bpe_32k.model"
#: Of the unigram scores: lower ones only mark runs of spaces.
SCORE_FLOOR = -32_000.0
#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def piece_model(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(PIECE_MODEL), "rb") as file:
        return file.read()


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the merge-type vocabulary."""
    model = piece_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        hex_digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                        hex_digest(F.col("decoded")).alias("decoded_sha256"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return urlfilter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op3_url_filter"] = r"""
WITH p AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, host, path, max_by(h || r.p, length(h || r.p)) AS rule, max_by(v, length(h || r.p)) AS v
    FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)
    GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best"""


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document, with the piece scores of the vocabulary file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.token_counts(docs, piece_model(), SCORE_FLOOR).select("doc_id", "n_tokens", "best_score")


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan_secrets(docs, reach=None).drop("text"))


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fingerprints.fingerprint_documents(docs).withColumn("edited_sha256", hex_digest(F.col("edited_text")))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


#: A document is called toxic from this score on.
TOXIC_FROM = 0.3


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "offending")


@query
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the counts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_documents(docs)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later repeated passages: what was cut, and what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = lines.dedup_lines(docs)
    cut = F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    return cleaned.select("doc_id", "runs", cut.cast("long").alias("n_words_in_runs"),
                          F.length("text").cast("long").alias("n_chars_left"), hex_digest(F.col("text")).alias("text_sha256"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, exactly or within a fifth of their length in edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leaks(docs, table(spark, sf_dir, "benchmark"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that links of 0.8 or more on five-word shingles connect."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_groups(docs)


ORACLES["op10_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


@query
def op11_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies that links of 0.85 or more on five-word shingles connect; the smallest id stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return forest.near_copies(docs)


ORACLES["op11_lsh_forest"] = ORACLES["op10_jaccard_join"].replace("100 * k >= 80 *", "100 * k >= 85 *").replace(
    "component_id FROM n JOIN", "component_id, doc_id = component_id AS kept FROM n JOIN")



@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, the one with the greatest exponent, and the text with runs collapsed."""
    docs = runs.with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines_of = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       hex_digest(F.array_join(lines_of, "")).alias("runs_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
                      "runs_sha256", hex_digest(F.col("collapsed")).alias("collapsed_sha256"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and each of its positives, the first rows of other labels nearly as close."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", label.alias("label"), negatives.whole_vector(F.col("embedding"), 256).alias("vector"))
    return negatives.hard_negatives(whole, F.col("vec_id") % 100 == 0, id="vec_id")


ORACLES["op12_hard_negatives"] = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
        CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5"""
