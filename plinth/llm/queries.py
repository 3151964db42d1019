"""One query per operator of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from plinth.llm import chatformat, decontam, neardup, pii, quality as good, topk, toxicity as tox, urlfilter
from plinth.llm.common import ship, table
from plinth.llm.mixing import mix
from plinth.llm.tokencount import token_counts


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names no pairs: each conversation is preferred to itself with the last answer of its neighbour."""
    rows = chatformat.mismatched(table(spark, sf_dir, "conversations"))
    return chatformat.paired(chatformat.preference(rows, F.col("pair_id"), F.col("side")))


#: The base rules of the URL filter.
BASE_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), BASE_RULES)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pii.digest(scanned, pii.bootstrap(scanned))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.5, max_epochs=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def held_out(of: int, rest: int):
    """Whether crc32 of a doc_id as text leaves this remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % of == rest


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1)).select("doc_id", "toxic")
    out = tox.toxicity(docs, tox.learn(docs, labels), threshold=0.7)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0)).select("doc_id", "quality")
    out = good.quality(docs, good.learn(docs, labels), threshold=0.3)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), model, limit=4096)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, threshold=0.8)


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS clamp
  FROM by_source
), ranked AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS wanted, sum(weight) OVER () AS all_weight,
         coalesce(sum(clamp) OVER below, 0) AS clamp_before, coalesce(sum(weight) OVER below, 0) AS weight_before
  FROM weighed
  WINDOW below AS (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
  SELECT *, clamp * (all_weight - weight_before) <= (wanted - clamp_before) * weight AS clamped FROM ranked
), settled AS (
  SELECT *, wanted - coalesce(sum(CASE WHEN clamped THEN clamp END) OVER (), 0) AS words,
         sum(CASE WHEN NOT clamped THEN weight END) OVER () AS open_weight
  FROM flagged
), targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN clamp ELSE words * weight / open_weight END AS target FROM settled
), extras AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
         CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS extra FROM targets
), places AS (SELECT source, place, sum(size)::BIGINT AS n FROM sized GROUP BY source, place
), running AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM places)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (t.epochs * d.size + CASE WHEN r.upto <= t.extra THEN d.size WHEN r.upto - r.n >= t.extra THEN 0 ELSE floor(d.size * (t.extra - (r.upto - r.n)) / r.n) END)::BIGINT AS taken
FROM sized d JOIN extras t ON d.source IS NOT DISTINCT FROM t.source JOIN running r ON d.source IS NOT DISTINCT FROM r.source AND d.place = r.place
"""


OP1_SQL = r"""
WITH answers AS (
  SELECT conv_id, max(turn) AS ends, max_by(text, (turn, text)) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), both_sides AS (
  SELECT a.conv_id AS pair_id, a.ends, a.answer, b.answer AS wrong FROM answers a JOIN answers b ON b.conv_id = a.conv_id + 1
), turns AS (
  SELECT DISTINCT p.pair_id, s.side, c.turn, c.role, c.text FROM conversations c JOIN both_sides p ON c.conv_id = p.pair_id AND c.turn < p.ends, (VALUES ('chosen'), ('rejected')) s(side)
  UNION ALL SELECT pair_id, 'chosen', ends, 'assistant', answer FROM both_sides
  UNION ALL SELECT pair_id, 'rejected', ends, 'assistant', wrong FROM both_sides
), t AS (
  SELECT pair_id, side, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS text FROM turns
), places AS (
  SELECT pair_id, turn, count(DISTINCT side) = 2 AND count(DISTINCT (role, text)) = 1 AS same FROM t GROUP BY pair_id, turn
), parts AS (SELECT pair_id, min(turn) AS parts_at FROM places WHERE NOT same GROUP BY pair_id
), parted AS (
  SELECT t.pair_id, t.turn // 256 AS piece, CASE WHEN p.parts_at IS NULL OR t.turn < p.parts_at THEN 'prompt' ELSE t.side END AS part, t.turn, t.text,
         t.role = 'assistant' AND p.parts_at IS NOT NULL AND t.turn >= p.parts_at AS trained, t.side
  FROM t LEFT JOIN parts p ON t.pair_id = p.pair_id
), kept AS (SELECT * FROM parted WHERE part <> 'prompt' OR side = 'chosen'
), spans AS (
  SELECT *, sum(length(text)) OVER (PARTITION BY pair_id, piece, part ORDER BY turn, text) AS upto FROM kept
), joined AS (
  SELECT pair_id, piece, part, string_agg(text, '' ORDER BY turn, text) AS text,
         coalesce(string_agg((upto - length(text) + 14)::BIGINT || ':' || upto::BIGINT, ',' ORDER BY turn, text) FILTER (WHERE trained), '') AS mask
  FROM spans GROUP BY pair_id, piece, part
)
SELECT pair_id, piece, coalesce(max(text) FILTER (WHERE part = 'prompt'), '') AS prompt, coalesce(max(text) FILTER (WHERE part = 'chosen'), '') AS chosen,
       coalesce(max(text) FILTER (WHERE part = 'rejected'), '') AS rejected, coalesce(max(mask) FILTER (WHERE part = 'chosen'), '') AS chosen_mask,
       coalesce(max(mask) FILTER (WHERE part = 'rejected'), '') AS rejected_mask
FROM joined GROUP BY pair_id, piece
"""

OP6_SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP10_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) END AS s
  FROM worded
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l ON s.doc_id = l.doc_id
"""


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_preference_format, op2_url_filter, op3_pii, op4_mixing, op5_toxicity, op6_topk, op7_decontamination, op8_quality, op9_token_counts, op10_near_dedup)}
ORACLES = {"op1_preference_format": OP1_SQL, "op4_mixing": OP4_SQL, "op6_topk": OP6_SQL, "op10_near_dedup": OP10_SQL}
