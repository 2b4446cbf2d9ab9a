"""Registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import backoff, bpe, exact, fim, mixing, near, negatives, packing, private, sharding, sketch, suffixes, toxicity
from redactlake.llm.tables import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


@query()
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    want = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return bpe.bpe_columns(docs, public_tokenizers.path("byte_bpe_50k.json"), want=want).select("doc_id", *want)


@query()
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, folder).select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.stratified_shards(rows, 40, F.struct("doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w keep_id, count(*) OVER (PARTITION BY norm) group_size,
    row_number() OVER w = 1 kept, sha256(norm) text_sha256 FROM d
    WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)"""
)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.duplicate_groups(documents(spark, folder))


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    grammar = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, grammar)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: Target weights of the mixture; every other source weighs OTHER_WEIGHT.
WEIGHTS, OTHER_WEIGHT = {"src0": 4.0, "src1": 2.0, "src2": 0.5}, 1.0


@query()
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", "source", F.xxhash64("text").alias("_text"))
    mixed = mixing.mix_to_weights(rows, WEIGHTS, F.struct("doc_id", "_text"), other=OTHER_WEIGHT)
    return mixed.select("doc_id", "source", "block", "slot", "position")


@query(
    r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) g FROM w),
    n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT doc_id id, doc_id c FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON r.c = u.a)
    SELECT id AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY id"""
)
def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_groups(documents(spark, folder).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query()
def op4_private_data(spark: SparkSession, folder: str) -> DataFrame:
    found = private.find_spans(documents(spark, folder).select("doc_id", "text")).select("doc_id", F.col("spans").alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("s", lambda x: x["kind"].isin(*private.BASE))
    return found.select("doc_id", *map(count, private.BASE), F.sha2(private.listed(base), 256).alias("base_sha256"), private.listed(F.col("s")).alias("spans"))


@query()
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.edited_neighbours(documents(spark, folder).select("doc_id", "text"))


@query()
def op7_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.backoff_scores(documents(spark, folder).select("doc_id", "text"), min_count=1)


@query()
def op8_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    packs = packing.packed(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packing.read_packs(packs).select("doc_id", "start", "n_tokens", "ids_crc32")


@query(
    """WITH e AS MATERIALIZED (SELECT vec_id id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (SELECT a.id anchor, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) score
      FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
    p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
    SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id,
      p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    WINDOW w AS (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 10"""
)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END")
    return negatives.hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("id") % 100 == 0, label=label)


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') t, sha256('42:' || doc_id) h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u,
      [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] r FROM d),
    c AS (SELECT doc_id, t, u, len(u) n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
        WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END form FROM u),
    x AS (SELECT *, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:n], '') s FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(t) AS restored_sha256 FROM x"""
)
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.fill_in_middle(documents(spark, folder).select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256")]
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", *digests)


@query()
def op13_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_strings(documents(spark, folder).select("doc_id", "text"), keep_text=False)
