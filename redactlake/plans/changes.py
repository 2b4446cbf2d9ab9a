"""Queries for review lists, overrides, changes between scans and debouncing."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.operators import redaction as X
from redactlake.operators import review as W
from redactlake.operators import records as V
from redactlake.operators import tokens as T
from redactlake.plans import duck as D
from redactlake.plans import fixtures as fx
from redactlake.plans.documents import _NUMBERED
from redactlake.plans.registry import query
from redactlake.plans.tables import derive, table
from redactlake.session import checkpointed
from redactlake.streaming import jobs as S
from redactlake.streaming import state as Z

# kinds in order of appearance, from the tokens of the redacted text
_KIND_LIST = r"""CASE WHEN len(regexp_extract_all(redacted, '\b[A-Z]+_[0-9]+\b')) = 0 THEN 'PRIVATE' ELSE array_to_string(list_transform(list_filter(
  list_transform(regexp_extract_all(redacted, '\b[A-Z]+_[0-9]+\b'), lambda t, i: {'k': regexp_replace(t, '_[0-9]+$', ''), 'i': i}),
  lambda e: list_position(list_transform(regexp_extract_all(redacted, '\b[A-Z]+_[0-9]+\b'), lambda u: regexp_replace(u, '_[0-9]+$', '')), e.k) = e.i),
  lambda e: e.k), ', ') END"""
_TEXTS = f"""{_NUMBERED}, txt AS MATERIALIZED (SELECT d.doc_id, d.text AS original, r.t AS redacted, d.lang FROM documents d JOIN t_DOB r ON r.id = d.doc_id WHERE d.text <> r.t),
det AS MATERIALIZED (SELECT doc_id AS scope_id, CAST(doc_id AS VARCHAR) AS item_id, 'text' AS source, {_KIND_LIST} AS kind, original, redacted, false AS locked FROM txt)"""
_TR = f"CASE WHEN {D.few_words(D.trim('label'))} THEN {D.trim('label')} ELSE '' END"
_FIELDS = f"""fa AS MATERIALIZED (SELECT *, {_TR} tr, {D.trim('value')} tv FROM ({fx.FIELDS})), fb AS MATERIALIZED (SELECT *, {D.label_kind('tr')} bl FROM fa),
fk AS MATERIALIZED (SELECT field_id, page_id, form_id, label, value, type, name, autocomplete, {D.decide('tr', 'bl', 'value', 'tv', 'type')} kind FROM fb)"""
# numbers of detected field values per page, and decisions about fields: every seventh is unmarked, every eleventh marked later
_SECRETS = "('PASSWORD', 'OTP')"
_MARKED = f"""fv AS MATERIALIZED (SELECT *, {D.norm_key('kind', 'value')} k, {D.trim('value')} <> '' filled,
  CASE WHEN field_id % 11 = 0 THEN true WHEN field_id % 7 = 0 THEN false END mark FROM fk),
fn AS MATERIALIZED (SELECT page_id, kind, k, row_number() OVER (PARTITION BY page_id, kind ORDER BY min(field_id)) n FROM fv WHERE kind NOT IN {_SECRETS} GROUP BY page_id, kind, k),
pv AS MATERIALIZED (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY min(field_id)) n FROM (
  SELECT page_id, field_id, lower({D.trim('value')}) k FROM fv WHERE kind IS NULL AND mark AND filled) GROUP BY page_id, k),
fr AS MATERIALIZED (SELECT fv.*, coalesce(fv.kind IN {_SECRETS}, false) locked, fn.n, pv.n p FROM fv LEFT JOIN fn USING (page_id, kind, k)
  LEFT JOIN pv ON fv.kind IS NULL AND fv.mark AND fv.filled AND pv.page_id = fv.page_id AND pv.k = lower({D.trim('fv.value')})),
fs AS MATERIALIZED (SELECT *, locked OR (kind IS NOT NULL AND filled AND coalesce(mark, true)) OR p IS NOT NULL AS record FROM fr),
fd AS MATERIALIZED (SELECT page_id AS scope_id, 'f' || field_id AS item_id, 'field' AS source, label,
  CASE WHEN record AND kind IS NOT NULL THEN kind ELSE 'PRIVATE' END kind, CASE WHEN NOT locked THEN value END AS original,
  CASE WHEN locked OR NOT record THEN '' WHEN p IS NOT NULL THEN 'PRIVATE_' || p ELSE kind || '_' || n END AS redacted, locked, record
  FROM fs WHERE record OR (mark IS NOT NULL AND NOT locked))"""
_REVIEW = f"""{_TEXTS}, {_FIELDS}, {_MARKED}, ovr AS (SELECT item_id, arg_max(is_private, ts) AS mark FROM (
   SELECT item_id, false AS is_private, 1 AS ts FROM det WHERE scope_id % 5 = 0 UNION ALL SELECT item_id, true, 2 FROM det WHERE scope_id % 10 = 0) GROUP BY item_id),
rv AS MATERIALIZED (SELECT a.scope_id, a.item_id, a.source, a.label, a.kind, CASE WHEN locked THEN 'Never read' ELSE original END AS value,
  CASE WHEN locked THEN '[HIDDEN]' ELSE redacted END AS safe_value, coalesce(record, mark, true) AS is_private, NOT locked AS can_unmark
  FROM (SELECT scope_id, item_id, source, kind AS label, kind, original, redacted, locked, NULL record FROM det UNION ALL SELECT * FROM fd) a
  LEFT JOIN ovr USING (item_id))"""


def _texts(spark, folder):
    rows = X.redact_rows(table(spark, folder, "documents"))
    ids = rows.withColumns({"scope_id": F.col("doc_id"), "item": F.col("doc_id").cast("string")})
    return W.text_detections(ids, "item", keep=["scope_id"])


def _field_tokens(fields):
    """Fields with the tokens of their values, and the token map of their pages."""
    mentions = V.with_norm_key(fields.filter("kind IS NOT NULL AND NOT locked"), "kind", "value").select(
        "page_id", "item_id", F.col("node_ord").alias("item_ord"), F.lit(0).alias("phase"), F.lit(0).alias("pos"), "kind", F.col("value").alias("raw"), "norm_key"
    )
    named, tokens = T.token_mentions(mentions, T.no_tokens(mentions, ["page_id"]), ["page_id"], aliases=False)
    return fields.join(named.select("page_id", "item_id", "token"), ["page_id", "item_id"], "left"), tokens


def _derived_fields(spark, folder):
    f = V.classify_values(derive(spark, folder, fx.FIELDS))
    return f.select(
        "page_id", F.concat(F.lit("f"), F.col("field_id").cast("string")).alias("item_id"), F.col("field_id").cast("bigint").alias("node_ord"), "label", "type",
        "value", "kind", F.coalesce("never_read", F.lit(False)).alias("locked"), F.lit(False).alias("authentication"),
    )


def _fields(spark, folder):
    """Fields of the review list after decisions about them."""
    fields, tokens = _field_tokens(_derived_fields(spark, folder))
    off = fields.filter("node_ord % 7 = 0").select("page_id", "item_id", F.lit(False).alias("is_private"), F.lit(1).alias("ts"))
    on = fields.filter("node_ord % 11 = 0").select("page_id", "item_id", F.lit(True).alias("is_private"), F.lit(2).alias("ts"))
    listed, _ = W.field_detections(fields, off.unionByName(on), tokens)
    return listed.withColumnRenamed("page_id", "scope_id")


def _overrides(texts):
    """Every fifth text is unmarked; every tenth is marked again later."""
    off = texts.filter("scope_id % 5 = 0").select("scope_id", "item_id", F.lit(False).alias("is_private"), F.lit(1).alias("ts"))
    on = texts.filter("scope_id % 10 = 0").select("scope_id", "item_id", F.lit(True).alias("is_private"), F.lit(2).alias("ts"))
    return off.unionByName(on)


def _review(spark, folder):
    texts = checkpointed(_texts(spark, folder))  # the decisions read them again
    return W.review(texts, _fields(spark, folder), _overrides(texts))


@query(f"{_TEXTS} SELECT scope_id, kind FROM det")
def kinds_per_item(spark, folder):
    return _texts(spark, folder).select("scope_id", "kind")


@query(f"{_REVIEW} SELECT * FROM rv")
def review_union(spark, folder):
    return _review(spark, folder)


@query(f"{_REVIEW} SELECT scope_id, count(*) FILTER (is_private) AS protected FROM rv GROUP BY scope_id")
def protected_count(spark, folder):
    return W.protected_count(_review(spark, folder), ["scope_id"])


_NAMES = " ".join(f"WHEN '{k}' THEN {D.q(v)}" for k, v in W.KIND_NAMES.items())


@query(
    f"""{_REVIEW} SELECT item_id, coalesce(CASE kind {_NAMES} END, nullif(label, ''), 'Private detail') AS display,
    CASE WHEN length(value) > 0 THEN value WHEN is_private THEN 'Hidden on the page' ELSE 'Visible on the page' END AS shown_value,
    CASE WHEN NOT can_unmark THEN 'Always hidden' WHEN is_private THEN 'Unmark' ELSE 'Mark private' END AS action FROM rv"""
)
def display_kinds(spark, folder):
    return W.display_kinds(_review(spark, folder)).select("item_id", "display", "shown_value", "action")


# Fields of which every fourth lost its detection (someone unmarked it before); every third is decided about, some have changed since.
_ITEMS = f"""WITH {_FIELDS}, d AS (SELECT page_id, 'f' || field_id AS item_id, field_id, kind AS said, value AS original, coalesce(kind IN {_SECRETS}, false) AS locked,
  field_id % 9 = 0 AS authentication, {D.trim('value')} <> '' filled, {D.norm_key('kind', 'value')} k, lower({D.trim('value')}) w, kind NOT IN {_SECRETS} AND field_id % 4 <> 2 AS found FROM fk),
 n AS MATERIALIZED (SELECT page_id, said, k, row_number() OVER (PARTITION BY page_id, said ORDER BY min(field_id)) n FROM d WHERE found GROUP BY page_id, said, k),
 d1 AS (SELECT d.*, CASE WHEN found THEN said END kind, CASE WHEN found THEN said || '_' || n END AS redacted FROM d LEFT JOIN n USING (page_id, said, k)),
 d2 AS (SELECT *, CASE WHEN field_id % 8 = 5 THEN 'typed anew' ELSE coalesce(redacted, original) END AS current, CASE WHEN field_id % 3 = 0 THEN field_id % 2 = 0 END AS mark FROM d1),
 d3 AS MATERIALIZED (SELECT *, mark IS NOT NULL AND NOT (locked OR authentication) AND (current IS NOT DISTINCT FROM original OR current IS NOT DISTINCT FROM redacted) AS applied FROM d2),
 b AS MATERIALIZED (SELECT page_id, field_id, coalesce(said, 'PRIVATE') mk, CASE WHEN said IS NULL THEN w ELSE k END k FROM d3 WHERE applied AND mark AND redacted IS NULL AND filled),
 bn AS MATERIALIZED (SELECT b.page_id, b.mk, b.k, coalesce(n.n, coalesce((SELECT max(m.n) FROM n m WHERE m.page_id = b.page_id AND m.said = b.mk), 0)
   + row_number() OVER (PARTITION BY b.page_id, b.mk, n.n IS NULL ORDER BY b.f)) n FROM (SELECT page_id, mk, k, min(field_id) f FROM b GROUP BY page_id, mk, k) b
   LEFT JOIN n ON n.page_id = b.page_id AND n.said = b.mk AND n.k = b.k),
 m AS (SELECT page_id, field_id, mk, mk || '_' || n AS token FROM b JOIN bn USING (page_id, mk, k)),
 d4 AS (SELECT d3.*, mk, token, CASE WHEN applied THEN mark ELSE kind IS NOT NULL AND NOT authentication END AS is_private FROM d3 LEFT JOIN m USING (page_id, field_id))"""


@query(
    f"""{_ITEMS} SELECT page_id, item_id, kind, original, redacted, current, locked, authentication, applied,
    CASE WHEN mark IS NOT NULL AND (locked OR authentication) THEN 'refused' WHEN mark IS NOT NULL AND NOT applied THEN 'changed' END AS why_not, is_private,
    CASE WHEN is_private AND kind IS NULL THEN coalesce(mk, 'PRIVATE') ELSE kind END AS shown_kind,
    CASE WHEN applied AND NOT mark THEN original WHEN applied THEN coalesce(redacted, token, original) ELSE current END AS shown FROM d4"""
)
def apply_overrides(spark, folder):
    fields = _derived_fields(spark, folder)
    kind = F.when(~F.col("locked") & (F.col("node_ord") % 4 != 2), F.col("kind"))
    detected, tokens = _field_tokens(fields.withColumn("kind", kind))
    d = detected.select(
        "page_id", "item_id", "node_ord", "label", "type", "kind", F.col("value").alias("original"), F.col("token").alias("redacted"),
        "locked", (F.col("node_ord") % 9 == 0).alias("authentication"),
    ).withColumn(
        "current", F.when(F.col("node_ord") % 8 == 5, F.lit("typed anew")).otherwise(F.coalesce("redacted", "original"))
    )
    marks = d.filter("node_ord % 3 = 0")
    overrides = marks.select(
        "page_id", "item_id", (F.col("node_ord") % 2 == 0).alias("is_private"), F.lit(2).alias("ts")
    ).unionByName(marks.select("page_id", "item_id", (F.col("node_ord") % 2 == 1).alias("is_private"), F.lit(1).alias("ts")))
    return W.apply_overrides(d, overrides, tokens, ["page_id"], "node_ord").drop("node_ord", "label", "type")


@query(
    f"""WITH {_FIELDS}, m AS (SELECT page_id, field_id, lower({D.trim('value')}) k FROM fk WHERE kind IS NULL AND field_id % 3 <> 0 AND {D.trim('value')} <> ''),
    n AS (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY min(field_id)) n FROM m GROUP BY page_id, k)
    SELECT page_id, field_id, 'PRIVATE_' || n AS mark_token FROM m JOIN n USING (page_id, k)"""
)
def manual_marks(spark, folder):
    """Fields without a detection that someone marked: numbered per page."""
    f = V.classify_values(derive(spark, folder, fx.FIELDS)).filter(F.col("kind").isNull() & (F.col("field_id") % 3 != 0))
    marks, _ = W.mark_tokens(f, ["page_id"], "field_id", keep=["field_id"])
    return marks.select("page_id", "field_id", "mark_token")


@query(
    f"""{_TEXTS}, o AS (SELECT scope_id, item_id, t AS ts, t % 2 = 0 AS is_private FROM det, range(1, 5) r(t) WHERE scope_id % 4 <= t), 
    c AS (SELECT scope_id, 1 + scope_id % 3 AS ts FROM det WHERE scope_id % 2 = 0)
    SELECT scope_id, item_id, arg_max(is_private, o.ts) AS is_private FROM o LEFT JOIN c USING (scope_id) WHERE c.ts IS NULL OR o.ts > c.ts GROUP BY scope_id, item_id"""
)
def overrides_as_of(spark, folder):
    """Decisions about documents that still count, as some documents changed after some decisions."""
    texts = _texts(spark, folder).select("scope_id", "item_id")
    log = texts.select("*", F.explode(F.array(*[F.lit(t) for t in range(1, 5)])).alias("ts")).filter("scope_id % 4 <= ts")
    changes = texts.filter("scope_id % 2 = 0").select("scope_id", "item_id", (F.col("scope_id") % 3 + 1).alias("ts"))
    keys = ["scope_id", "item_id"]
    left = W.overrides_as_of(log.withColumn("is_private", F.col("ts") % 2 == 0), changes, keys)
    return W.latest_overrides(left, keys).withColumnRenamed("is_marked", "is_private")


# --- two scans of the documents: thirds dropped, changed and kept -------------
_STATE = f"{_NUMBERED}, st AS (SELECT d.doc_id, d.text AS original, r.t AS redacted FROM documents d JOIN t_DOB r ON r.id = d.doc_id WHERE d.text <> r.t)"
_NEXT = "nx AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN original || chr(10) || 'call 9876543210' ELSE redacted END AS current FROM st WHERE doc_id % 3 <> 0)"


def _two_scans(spark, folder):
    rows = X.redact_rows(table(spark, folder, "documents").select("doc_id", "text")).filter(F.col("redacted") != F.col("text"))
    state = checkpointed(rows.select("doc_id", F.col("text").alias("original"), "redacted"))  # both scans come from it
    now = state.filter("doc_id % 3 <> 0").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 1, F.concat("original", F.lit("\ncall 9876543210"))).otherwise(F.col("redacted")).alias("current"),
    )
    return state, now


@query(
    f"""{_STATE}, {_NEXT} SELECT doc_id, CASE WHEN current IS NULL THEN 'removed' WHEN current = redacted THEN 'ours' ELSE 'replaced' END AS change FROM st LEFT JOIN nx USING (doc_id)"""
)
def changed_items(spark, folder):
    return W.changed_items(*_two_scans(spark, folder), ["doc_id"]).select("doc_id", "change")


@query(f"{_STATE}, {_NEXT} SELECT doc_id, redacted FROM st WHERE doc_id IN (SELECT doc_id FROM nx)")
def prune_missing(spark, folder):
    return W.prune_missing(*_two_scans(spark, folder), ["doc_id"]).select("doc_id", "redacted")


_AGAIN = f"{_STATE}, {_NEXT}, src2 AS (SELECT doc_id AS id, current AS t FROM nx),{D.pattern_passes('src2', prefix='again_')}"


@query(f"{_AGAIN} SELECT doc_id, current, CASE WHEN current = redacted THEN current ELSE r.t END AS redacted FROM nx JOIN st USING (doc_id) JOIN again_t_DOB r ON r.id = doc_id")
def rescan_changed(spark, folder):
    """Only the replaced documents are redacted again; the others keep their text."""
    return W.rescan(*_two_scans(spark, folder), ["doc_id"])


@query(
    f"""SELECT page_id, rev, request, reply FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rev DESC, request DESC) rn FROM ({fx.REVISIONS})) WHERE rn = 1"""
)
def latest_revision(spark, folder):
    return W.latest_revision(derive(spark, folder, fx.REVISIONS), ["page_id"])


@query(
    f"""WITH {_FIELDS}, r AS (SELECT field_id, value AS original, kind || '_0' AS token, CASE WHEN field_id % 5 = 0 THEN 'typed anew' ELSE kind || '_0' END AS current,
      field_id % 4 = 0 AS locked, field_id % 4 <> 0 AND field_id % 3 = 0 AS authentication FROM fk WHERE kind IS NOT NULL)
    SELECT field_id, CASE WHEN locked THEN 'locked' WHEN authentication THEN 'released' ELSE 'kept' END AS outcome,
    CASE WHEN locked THEN NULL WHEN authentication AND token = current THEN original ELSE current END AS shown,
    CASE WHEN locked OR authentication THEN NULL ELSE original END AS kept_original FROM r"""
)
def role_change(spark, folder):
    f = V.classify_values(derive(spark, folder, fx.FIELDS)).filter(F.col("kind").isNotNull())
    token = F.concat("kind", F.lit("_0"))
    before = f.select("field_id", F.col("value").alias("original"), token.alias("token"))
    now = f.select(
        "field_id", F.when(F.col("field_id") % 5 == 0, F.lit("typed anew")).otherwise(token).alias("current"),
        (F.col("field_id") % 4 == 0).alias("locked"),
        ((F.col("field_id") % 4 != 0) & (F.col("field_id") % 3 == 0)).alias("authentication"),
    )
    return W.role_change(before, now, ["field_id"])


_QUIET = """SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) nx FROM events)
 WHERE nx IS NULL OR nx >= ts + INTERVAL 30 MINUTE"""


@query(_QUIET)
def debounce_events(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return W.debounce(events, ["user_id"], "ts", "event_id", "30 MINUTE").select("event_id", "user_id")


@query(_QUIET)
def debounce_stream(spark, folder):
    """The same over a stream."""
    return S.run_debounce(spark, f"{folder}/events.parquet", "30 minutes", "10 minutes")


@query(
    """SELECT user_id, event_id, event_type, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) rn FROM events) WHERE rn <= 40"""
)
def recent_events_40(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return W.recent_audit(events, ["user_id"], "ts", "event_id").drop("ts")


@query(
    f"""{_AGAIN} SELECT CAST(d.doc_id AS VARCHAR) AS scope, CASE WHEN st.doc_id IS NULL THEN 'plain' WHEN st.doc_id % 3 = 1 THEN 'replaced' WHEN st.doc_id % 5 = 0 THEN 'unmarked' ELSE 'ours' END AS change,
    CASE WHEN st.doc_id IS NULL OR (st.doc_id % 3 = 2 AND st.doc_id % 5 = 0) THEN d.text WHEN st.doc_id % 3 = 1 THEN r.t ELSE st.redacted END AS shown,
    coalesce(st.doc_id % 3 = 1 OR st.doc_id % 5 <> 0, false) AS is_private
    FROM documents d LEFT JOIN st USING (doc_id) LEFT JOIN again_t_DOB r ON r.id = d.doc_id WHERE st.doc_id IS NULL OR st.doc_id % 3 <> 0"""
)
def revised_stream(spark, folder):
    """Documents in three revisions: put; removed, replaced or shown as we wrote them; some unmarked."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    state, now = _two_scans(spark, folder)

    def events(rows, rev, event, text):
        scope = F.col("doc_id").cast("string")
        order = F.lit(0).cast("bigint").alias("item_ord")
        return rows.select(
            scope.alias("scope"), F.lit("d").alias("item_id"), F.lit(rev).cast("bigint").alias("rev"), order, F.lit(event).alias("event"), text.alias("text")
        )

    none = F.lit(None).cast("string")
    second = events(now, 2, "put", F.col("current")).unionByName(events(state.filter("doc_id % 3 = 0"), 2, "delete", none))
    third = events(state.filter("doc_id % 3 = 2 AND doc_id % 5 = 0"), 3, "unmark", none)
    records = S.run_revisions(spark, [events(docs, 1, "put", F.col("text")), second, third])
    return Z.latest_items(records).select("scope", "change", "shown", "is_private")
