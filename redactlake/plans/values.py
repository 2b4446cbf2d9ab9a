"""Queries over labelled values and check digits."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.operators import records as V
from redactlake.plans import duck as D
from redactlake.plans import fixtures as fx
from redactlake.plans.registry import query
from redactlake.plans.tables import derive

_TRUSTED = f"CASE WHEN {D.few_words(D.trim('label'))} THEN {D.trim('label')} ELSE '' END"
_JUDGED = f"""WITH a AS MATERIALIZED (SELECT *, {_TRUSTED} trusted, {D.trim('value')} trimmed FROM ({fx.LABELLED_VALUES})),
b AS MATERIALIZED (SELECT *, {D.label_kind('trusted')} bl FROM a),
c AS MATERIALIZED (SELECT *, {D.decide('trusted', 'bl', 'value', 'trimmed', 'type')} kind FROM b)"""


def _values(spark, folder):
    return derive(spark, folder, fx.LABELLED_VALUES)


@query(
    f"""{_JUDGED} SELECT k, label, value, type, kind, CASE WHEN kind IS NOT NULL THEN 'High' END AS confidence,
    coalesce(kind IN ('PASSWORD', 'OTP'), false) AS never_read FROM c"""
)
def classify_values(spark, folder):
    return V.classify_values(_values(spark, folder))


@query(f"{_JUDGED} SELECT k, label, bl AS label_kind FROM b")
def label_kinds(spark, folder):
    return V.label_kinds(_values(spark, folder).select("k", "label"))


@query(
    f"{_JUDGED} SELECT bl AS kind, count(*) AS n, count(*) FILTER (NOT {D.prompt_like('trimmed')} AND CASE bl "
    + " ".join(f"WHEN '{k}' THEN {D.valid(k, 'trimmed')}" for k in R.VALUE_KINDS)
    + " END) AS n_valid FROM b WHERE bl IS NOT NULL GROUP BY bl"
)
def validate_values(spark, folder):
    """Share of values that fit the kind their label asks for."""
    labelled = V.label_kinds(_values(spark, folder)).filter(F.col("label_kind").isNotNull())
    checked = V.validate_values(labelled.withColumnRenamed("label_kind", "kind"))
    return checked.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid"))


@query(
    f"{_JUDGED} SELECT k, {D.has('lower(value)', D.AMOUNT)} OR {D.has('value', '(?i)₹|' + chr(92) + 'bINR' + chr(92) + 'b')}"
    f" OR {D.has('trusted', D.AMOUNT)} AS amount, {D.prompt_like('trimmed')} AS prompt FROM b"
)
def amount_and_prompt(spark, folder):
    """Amount context and prompt-like values."""
    v = _values(spark, folder)
    trusted = R.trusted_label(F.col("label"))
    return v.select(
        "k",
        (R.amount_context(trusted, F.col("value"), F.lit("")) | F.lower("value").rlike(R.AMOUNT)).alias("amount"),
        R.is_empty_like(R.trim(F.col("value"))).alias("prompt"),
    )


@query(f"SELECT source, k, {D.luhn('sixteen')} AS card_ok FROM ({fx.CHECKSUMS})")
def luhn_check(spark, folder):
    return derive(spark, folder, fx.CHECKSUMS).select("source", "k", R.luhn(F.col("sixteen")).alias("card_ok"))


@query(
    f"SELECT source, k, {D.verhoeff('twelve')} AS check_ok, {D.valid('AADHAAR', 'twelve')} AS id_ok FROM ({fx.CHECKSUMS})"
)
def verhoeff_check(spark, folder):
    c = derive(spark, folder, fx.CHECKSUMS)
    ids = V.validate_values(c.withColumn("kind", F.lit("AADHAAR")), "kind", "twelve")
    return ids.select("source", "k", R.verhoeff(F.col("twelve")).alias("check_ok"), F.col("is_valid").alias("id_ok"))


_DAYS = f"SELECT c_custkey AS k, {fx.birthday('c_custkey')} AS value FROM customer"


@query(f"SELECT k, value, {D.valid('DOB', 'value')} AS is_valid FROM ({_DAYS})")
def dob_check(spark, folder):
    days = derive(spark, folder, _DAYS).withColumn("kind", F.lit("DOB"))
    return V.validate_values(days).drop("kind")


@query(f"{_JUDGED} SELECT k, kind, value AS raw, {D.norm_key('kind', 'value')} AS norm_key FROM c WHERE kind IS NOT NULL")
def norm_keys(spark, folder):
    judged = V.classify_values(_values(spark, folder)).filter(F.col("kind").isNotNull())
    return V.with_norm_key(judged.select("k", "kind", F.col("value").alias("raw")))


_WORDS = f"SELECT item, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS part FROM ({fx.TEXT_LINES})"


@query(
    f"SELECT part, count(*) AS n FROM ({_WORDS}) WHERE part <> '' AND lower(part) NOT IN ("
    + ", ".join(f"'{w}'" for w in R.COMMON_WORDS)
    + ") GROUP BY part"
)
def name_words(spark, folder):
    """Words of the derived texts that may be name parts."""
    words = derive(spark, folder, fx.TEXT_LINES).select(F.explode(F.split("text", "[^A-Za-z]+")).alias("part"))
    kept = V.drop_common_names(words.filter("part <> ''"))
    return kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
