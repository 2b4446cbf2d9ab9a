"""Queries over scopes with people: conversations whose turns share tokens and names.

The checks fold the mentions of each conversation one after another, as they are
said, and put the names in item by item.
"""

from __future__ import annotations

from redactlake.functions import rules as R
from redactlake.operators import scopes as C
from redactlake.operators import tokens as T
from redactlake.plans import duck as D
from redactlake.plans import fixtures as fx
from redactlake.plans.documents import line_phases
from redactlake.plans.registry import query
from redactlake.plans.tables import derive
from redactlake.streaming import jobs as S

_COMMON = ", ".join(f"'{w}'" for w in R.COMMON_WORDS)
_LINE_ROWS = " UNION ALL ".join(
    f"SELECT id, {phase} phase, i, kind, raw, {D.norm_key('kind', 'raw')} k FROM {cte} WHERE kind NOT IN ('PASSWORD', 'OTP')"
    for phase, cte in ((1, "ea"), (2, "eb"), (3, "eg"))
)
_MATCH_ROWS = " UNION ALL ".join(f"SELECT id, {4 + D.TEXT_KINDS.index(k)}, i, '{k}', m, k FROM e_{k}" for k in D.TEXT_KINDS)
# one row for each mention, then people folded in order: which earlier person a name stands for
_PEOPLE = f"""WITH RECURSIVE items AS MATERIALIZED (SELECT conv_id, turn, conv_id * 1000 + turn AS id, text AS t FROM ({fx.CONVERSATION_ITEMS})),
src AS (SELECT id, t FROM items),{line_phases('src', placed=True)},{D.pattern_passes('tg', 'placed')},
al AS MATERIALIZED (SELECT id // 1000 AS conv_id, id % 1000 AS turn, phase, i, kind, k FROM ({_LINE_ROWS} UNION ALL {_MATCH_ROWS})),
pm AS MATERIALIZED (SELECT conv_id, turn, phase, i, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn, phase, i) s, string_split_regex(k, {D.q(D.SP + '+')}) ws,
  list_distinct(list_filter(list_transform(regexp_extract_all(k, {D.q(chr(92) + "p{L}[" + chr(92) + "p{L}" + "'’-]*")}), lambda p: lower(p)), lambda p: length(p) >= 3 AND p NOT IN ({_COMMON}))) ps
  FROM al WHERE kind = 'PERSON'),
fold AS (SELECT conv_id, CAST(0 AS BIGINT) s, CAST('' AS VARCHAR) k, CAST('' AS VARCHAR) leader, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) names, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) parts
    FROM (SELECT DISTINCT conv_id FROM pm)
  UNION ALL SELECT conv_id, s, k, lead, map_concat(names, MAP {{k: lead}}), map_concat(parts, map_from_entries(list_transform(ps, lambda p: {{'k': p, 'v': lead}})))
  FROM (SELECT f.conv_id, m.s, m.k, m.ps, f.names, f.parts, CASE WHEN f.names[m.k] IS NOT NULL THEN f.names[m.k] WHEN len(known) = 1 THEN known[1] ELSE m.k END lead
    FROM (SELECT f.*, m.s ms, list_distinct(list_filter(list_transform(m.ws, lambda w: f.parts[w]), lambda x: x IS NOT NULL)) known FROM fold f JOIN pm m ON m.conv_id = f.conv_id AND m.s = f.s + 1) f
    JOIN pm m ON m.conv_id = f.conv_id AND m.s = f.ms)),
lead AS MATERIALIZED (SELECT DISTINCT conv_id, k, leader FROM fold WHERE s > 0)"""
_TOKENS = f"""{_PEOPLE}, keyed AS MATERIALIZED (SELECT al.*, coalesce(lead.leader, al.k) leader FROM al LEFT JOIN lead ON al.kind = 'PERSON' AND lead.conv_id = al.conv_id AND lead.k = al.k),
num AS MATERIALIZED (SELECT conv_id, kind, leader, row_number() OVER (PARTITION BY conv_id, kind ORDER BY min((turn, phase, i))) n FROM keyed GROUP BY conv_id, kind, leader),
tok AS MATERIALIZED (SELECT keyed.*, n, kind || '_' || n AS token FROM keyed JOIN num USING (conv_id, kind, leader))"""


def _named(text: str, entries: str) -> str:
    """``text`` with a list of entries, each spelling and token, put in one after another."""
    shape = r"'(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(split_part(e, chr(1), 1)) || '($|[^\p{L}\p{N}_])'"
    into = r"'\1' || split_part(e, chr(1), 2) || '\2'"
    once = lambda t: f"regexp_replace({t}, {shape}, {into}, 'g')"
    # twice, as a match takes the character behind it and the next name may need it
    return f"list_reduce({entries}, lambda acc, e: {once(once('acc'))}, {text})"


# texts with the scope's numbers, the entries that each turn knows, and those of the whole conversation
_TURNS = f"""{_TOKENS}, spots AS (SELECT conv_id, turn, list(kind || '_0' || chr(CAST(57344 + 400 * phase + i AS INT)) || chr(1) || token) l FROM tok GROUP BY conv_id, turn),
numbered AS MATERIALIZED (SELECT i.conv_id, i.turn, i.t AS original, list_reduce(coalesce(l, CAST([] AS VARCHAR[])),
  lambda acc, e: replace(acc, split_part(e, chr(1), 1), split_part(e, chr(1), 2)), x.t) t FROM items i JOIN t_DOB x ON x.id = i.id LEFT JOIN spots USING (conv_id, turn)),
fulls AS MATERIALIZED (SELECT conv_id, k e, token, min((turn, phase, i)) s, min(turn) first FROM tok WHERE kind = 'PERSON' GROUP BY conv_id, k, token),
uses AS MATERIALIZED (SELECT conv_id, turn, phase, i, token, ps[x] e, x FROM (SELECT tok.*, pm.ps, unnest(range(1, len(pm.ps) + 1)) x FROM tok JOIN pm USING (conv_id, turn, phase, i, k) WHERE kind = 'PERSON')),
heads AS MATERIALIZED (SELECT conv_id, e, min((turn, phase, i, x)) s, min(turn) first FROM uses GROUP BY conv_id, e),
n1 AS (SELECT n.conv_id, n.turn, list(e || chr(1) || token ORDER BY s) l FROM numbered n JOIN fulls f ON f.conv_id = n.conv_id AND f.first <= n.turn GROUP BY 1, 2),
p0 AS (SELECT n.conv_id, n.turn, u.e, arg_max(u.token, (u.turn, u.phase, u.i)) token FROM numbered n JOIN uses u ON u.conv_id = n.conv_id AND u.turn <= n.turn GROUP BY 1, 2, 3),
p1 AS (SELECT conv_id, turn, list(e || chr(1) || token ORDER BY s) l FROM p0 JOIN heads USING (conv_id, e) GROUP BY 1, 2),
n2 AS (SELECT conv_id, list(e || chr(1) || token ORDER BY s) l FROM fulls GROUP BY 1),
p2 AS (SELECT conv_id, list(e || chr(1) || token ORDER BY s) l FROM (SELECT conv_id, e, arg_max(token, (turn, phase, i)) token FROM uses GROUP BY 1, 2) JOIN heads USING (conv_id, e) GROUP BY 1),
none AS (SELECT CAST([] AS VARCHAR[]) l),
pass1 AS MATERIALIZED (SELECT n.*, {_named(_named('t', 'coalesce(n1.l, none.l)'), 'coalesce(p1.l, none.l)')} one FROM numbered n CROSS JOIN none LEFT JOIN n1 USING (conv_id, turn) LEFT JOIN p1 USING (conv_id, turn))"""


def _items(spark, folder):
    return derive(spark, folder, fx.CONVERSATION_ITEMS)


@query(f"{_PEOPLE} SELECT conv_id, k AS norm_key, leader FROM lead")
def person_aliases(spark, folder):
    found = C.item_entities(_items(spark, folder), ["conv_id"], "turn", "text").filter("kind = 'PERSON'")
    return T.resolve_person_aliases(found, ["conv_id"])


@query(f"{_TOKENS} SELECT conv_id, kind, k AS norm_key, n, token, count(*) AS mentions FROM tok GROUP BY conv_id, kind, k, n, token")
def conversation_tokens(spark, folder):
    found = C.item_entities(_items(spark, folder), ["conv_id"], "turn", "text")
    return T.assign_tokens(found, ["conv_id"]).select("conv_id", "kind", "norm_key", "n", "token", "mentions")


@query(
    f"""{_TURNS} SELECT p.conv_id, p.turn, CASE WHEN one = original THEN {_named(_named('t', 'coalesce(n2.l, none.l)'), 'coalesce(p2.l, none.l)')} ELSE one END AS redacted
    FROM pass1 p CROSS JOIN none LEFT JOIN n2 ON n2.conv_id = p.conv_id LEFT JOIN p2 ON p2.conv_id = p.conv_id"""
)
def name_substitution(spark, folder):
    """Turns with all tokens, known names included."""
    done, _ = C.redact_scopes(_items(spark, folder), ["conv_id"], "turn")
    return done.select("conv_id", "turn", "redacted")


@query(f"{_TURNS} SELECT CAST(conv_id AS VARCHAR) AS scope, turn AS item_ord, one AS redacted FROM pass1")
def redact_stream(spark, folder):
    """Conversation turns arriving as a stream: tokens stay stable, and a turn knows the people met so far."""
    return S.run_redact_stream(spark, _items(spark, folder))
