"""Per-row detection and rewriting of free text.

One row is rewritten by a fixed sequence of phases, each seeing the output of
the one before it::

    1 account lines   label and number on one line, or on two following lines
    2 label lines     "label: value", value possibly on the next line
    3 greetings       salutation followed by a capitalised name
    4..11 patterns    MOBILE, EMAIL, PAN, AADHAAR, IFSC, UPI, CARD, DOB
    12 known names    full names, then single name parts

All of it is column expressions over the row itself: no shuffle, no Python
worker, and nothing but a cheap guard is evaluated on rows without candidates.
Numbering happens inside the row; scopes that span several rows are numbered
with :mod:`redactlake.operators.scopes`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.functions.rules import let

STYLES = ("numbered", "kind_only", "hash")
PHASE_ACCOUNT, PHASE_LABEL, PHASE_GREETING = 1, 2, 3
PHASE_OF_KIND = {kind: 4 + i for i, kind in enumerate(R.TEXT_KINDS)}
ALL_PHASES = (PHASE_ACCOUNT, PHASE_LABEL, PHASE_GREETING, *PHASE_OF_KIND.values())

ENTITY = "struct<phase:int,pos:int,kind:string,raw:string,norm_key:string,token:string>"
PEOPLE = "struct<names:array<struct<key:string,token:string>>,parts:array<struct<part:string,token:string>>,n:int>"

STATE = f"struct<t:string,keys:array<string>,people:{PEOPLE},ents:array<{ENTITY}>>"

_DIGITS_9 = r"[0-9](?:[ \t-]*[0-9]){8}"
_LINE_CHAR = r"[^\n\r\u2028\u2029]"
_INLINE_ACCOUNT = (
    rf"^([{R.SPACE}]*{_LINE_CHAR}*?)([:\-][{R.SPACE}]*|[{R.SPACE}]+)"
    rf"([0-9](?:[ \t-]*[0-9]){{8,17}})([{R.SPACE}]*)\z"
)
_LABEL_LINE = (
    rf"^[{R.SPACE}]*([\p{{L}}\p{{N}}][\p{{L}}\p{{N}} /#&.'’\-]{{0,58}}?)[{R.SPACE}]*[:\-]"
    rf"[{R.SPACE}]*({_LINE_CHAR}*?)[{R.SPACE}]*\z"
)
_LABEL_SOMEWHERE = rf"(?m)^[{R.SPACE}]*[\p{{L}}\p{{N}}][\p{{L}}\p{{N}} /#&.'’\-]{{0,58}}?[{R.SPACE}]*[:\-]"
_CAPITALISED = r"\p{Lu}[\p{L}'’\-]{2,}"
_GREETING = (
    rf"(?<![{R.WORD}])({'|'.join(R.GREETING_WORDS)})([{R.SPACE}]*,?[{R.SPACE}]+)"
    rf"({_CAPITALISED}(?:[{R.SPACE}]+{_CAPITALISED}){{0,2}})(?![\p{{L}}\p{{N}}_])"
)
_NAME_PART = r"\p{L}[\p{L}'’\-]*"


# --- tokens -----------------------------------------------------------------
def hashed_token(kind: Column, key: Column, salt: str) -> Column:
    """Keyed token that needs no numbering; letters only, so no pattern can match it."""
    digest = F.sha2(F.concat_ws(":", F.lit(salt), kind, key), 256)
    letters = F.translate(F.substring(digest, 1, 32), "0123456789abcdef", "ghijklmnopqrstuv")
    return F.concat(kind, F.lit("_"), letters)


def name_parts(name: Column) -> Column:
    """Parts of a name that identify a person by themselves, lower case."""
    parts = F.transform(F.regexp_extract_all(name, F.lit(_NAME_PART), 0), F.lower)
    return F.array_distinct(
        F.filter(parts, lambda p: (F.length(p) >= R.MIN_NAME_PART) & ~R.is_common_word(p))
    )


def _meet_person(how: "_Style"):
    """Fold step: take one mentioned name into the people known so far.

    A name seen before keeps its token.  A new name all of whose known parts
    point to one single token is an alias and takes that token.
    """

    def step(state: Column, name: Column) -> Column:
        def with_basics(b: Column) -> Column:
            same = F.get(F.filter(state["names"], lambda x: x["key"] == b["key"]), F.lit(0))["token"]
            by_part = F.array_distinct(
                F.filter(
                    F.transform(
                        b["words"],
                        lambda w: F.get(F.filter(state["parts"], lambda p: p["part"] == w), F.lit(0))["token"],
                    ),
                    lambda t: t.isNotNull(),
                )
            )
            fresh = how.new_person(b["key"], state["n"] + 1)
            found = same
            if how.numbers_here:
                found = F.coalesce(same, F.when(F.size(by_part) == 1, F.get(by_part, F.lit(0))))

            def with_token(t: Column) -> Column:
                names = F.when(same.isNotNull(), state["names"]).otherwise(
                    F.array_append(state["names"], F.struct(b["key"].alias("key"), t["token"].alias("token")))
                )
                kept = F.transform(
                    state["parts"],
                    lambda p: F.struct(
                        p["part"].alias("part"),
                        F.when(F.array_contains(b["parts"], p["part"]), t["token"])
                        .otherwise(p["token"])
                        .alias("token"),
                    ),
                )
                added = F.transform(
                    F.array_except(b["parts"], F.transform(state["parts"], lambda p: p["part"])),
                    lambda w: F.struct(w.alias("part"), t["token"].alias("token")),
                )
                return F.struct(
                    names.alias("names"),
                    F.concat(kept, added).alias("parts"),
                    (state["n"] + F.when(t["found"].isNull(), 1).otherwise(0)).alias("n"),
                ).cast(PEOPLE)

            return let(F.struct(found.alias("found"), F.coalesce(found, fresh).alias("token")), with_token)

        v = R.trim(name)
        return let(
            F.struct(
                F.lower(v).alias("key"),
                F.split(F.lower(v), rf"[{R.SPACE}]+").alias("words"),
                name_parts(v).alias("parts"),
            ),
            with_basics,
        )

    return step


_STEPS = ", ".join(str(1 << i) for i in range(23, -1, -1))


def _place(entries: Column, key: Column, field: str = "k") -> Column:
    """Place of the first entry not below ``key`` in an array sorted by ``field``.

    A binary search by halving steps: an array or a map would be read from its
    start for every key.
    """

    def advance(at: Column, step: Column) -> Column:
        return F.when(F.get(entries, at + step)[field] < key, at + step).otherwise(at)

    return F.aggregate(F.expr(f"array({_STEPS})"), F.lit(-1), advance) + 1


def _sorted_lookup(entries: Column, key: Column) -> Column:
    """``v`` of the entry ``(k, v)`` with that ``k``, null if there is none."""
    return let(_place(entries, key), lambda at: F.when(F.get(entries, at)["k"] == key, F.get(entries, at)["v"]))


class _Style:
    """How tokens are spelled during one job."""

    def __init__(self, style: str, salt: str, known: Column | None, late: str = "zero"):
        self.style, self.salt, self.known, self.late = style, salt, known, late
        self.numbers_here = style == "numbered" and known is None

    def ranks(self, keys: Column, kind: str | None) -> Column:
        """The number of each key ``KIND:key`` among those of its kind, sorted by key; built once a phase."""
        if not self.numbers_here:
            return F.lit(None).cast("array<struct<k:string,v:int>>")
        if kind:
            own = F.filter(keys, lambda k: F.startswith(k, F.lit(f"{kind}:")))
            return F.array_sort(F.transform(own, lambda k, i: F.struct(k.alias("k"), (i + 1).alias("v"))))
        by_kind = F.transform(keys, lambda k, i: F.struct(F.substring_index(k, ":", 1).alias("kind"), i.alias("i"), k.alias("k")))

        def numbered(entries: Column) -> Column:
            number = lambda e, at: (at - _place(entries, e["kind"], "kind") + 1).cast("int")
            return F.array_sort(F.transform(entries, lambda e, at: F.struct(e["k"].alias("k"), number(e, at).alias("v"))))

        return let(F.array_sort(by_kind), numbered)

    def token(self, ranks: Column, kind: Column, key: Column) -> Column:
        if self.known is not None:
            spare = hashed_token(kind, key, self.salt) if self.late == "hash" else F.concat(kind, F.lit("_0"))
            return F.coalesce(_sorted_lookup(self.known, F.concat_ws(":", kind, key)), spare)
        if self.style == "kind_only":
            return F.concat(kind, F.lit("_0"))
        if self.style == "hash":
            return hashed_token(kind, key, self.salt)
        return F.concat(kind, F.lit("_"), _sorted_lookup(ranks, F.concat_ws(":", kind, key)).cast("string"))

    def new_person(self, key: Column, n: Column) -> Column:
        if self.numbers_here:
            return F.concat(F.lit("PERSON_"), n.cast("string"))
        return self.token(None, F.lit("PERSON"), key)


def _apply(s: Column, hits: Column, phase: int, how: _Style, rebuild) -> Column:
    """Next state: tokens for the hits of this phase, rewritten text, entities.

    Hits are structs ``(kind, raw, pre, ...)`` in text order; kind is null for
    matches that stay as they are.  ``rebuild`` turns hits with tokens into text.
    """
    has_people = phase in (PHASE_LABEL, PHASE_GREETING)
    has_secrets = phase == PHASE_LABEL
    fixed = {PHASE_ACCOUNT: "ACCOUNT", PHASE_GREETING: "PERSON", **{p: k for k, p in PHASE_OF_KIND.items()}}.get(phase)

    def is_detail(h: Column) -> Column:
        real = h["kind"].isNotNull()
        return real & ~h["kind"].isin(*R.SECRET_KINDS) if has_secrets else real

    def number(h: Column) -> Column:
        keys, people = s["keys"], s["people"]
        if how.numbers_here:
            fresh = F.transform(
                F.filter(h, lambda x: is_detail(x) & (x["kind"] != "PERSON") if has_people else is_detail(x)),
                lambda x: F.concat_ws(":", x["kind"], x["key"]),
            )
            keys = F.array_distinct(F.concat(keys, fresh))
        if has_people:
            met = F.transform(F.filter(h, lambda x: x["kind"] == "PERSON"), lambda x: x["raw"])
            people = F.aggregate(met, people, _meet_person(how))
        counted = F.struct(h.alias("h"), keys.alias("keys"), people.alias("people"))
        return let(counted, lambda c: let(c.withField("ranks", how.ranks(c["keys"], fixed)), spell))

    def spell(b: Column) -> Column:
        def token(x: Column) -> Column:
            out = F.when(x["kind"].isNull(), x["raw"])
            if has_secrets:
                out = out.when(x["kind"].isin(*R.SECRET_KINDS), F.lit(R.HIDDEN))
            if has_people:
                met = F.filter(b["people"]["names"], lambda p: p["key"] == x["key"])
                out = out.when(x["kind"] == "PERSON", F.get(met, F.lit(0))["token"])
            return out.otherwise(how.token(b["ranks"], x["kind"], x["key"]))

        def state(h: Column) -> Column:
            entities = F.transform(
                F.filter(h, is_detail),
                lambda x, i: F.struct(
                    F.lit(phase).alias("phase"),
                    i.alias("pos"),
                    x["kind"].alias("kind"),
                    x["raw"].alias("raw"),
                    x["key"].alias("norm_key"),
                    x["token"].alias("token"),
                ),
            )
            return F.struct(
                rebuild(h).alias("t"),
                b["keys"].alias("keys"),
                b["people"].alias("people"),
                F.concat(s["ents"], entities).alias("ents"),
            ).cast(STATE)

        return let(F.transform(b["h"], lambda x: x.withField("token", token(x))), state)

    keyed = F.transform(hits, lambda x: x.withField("key", R.norm_key(fixed or x["kind"], x["raw"])))
    return F.when(F.size(hits) > 0, let(keyed, number)).otherwise(s)


# --- line phases ------------------------------------------------------------
def _splice_lines(lines: Column, hits: Column) -> Column:
    """Lines with the hit lines replaced; hits are in line order."""
    before = lambda j: F.coalesce(F.get(hits, j - 1)["line"], F.lit(-1))
    chunks = F.transform(
        hits,
        lambda h, j: F.array_append(
            F.slice(lines, before(j) + 2, h["line"] - before(j) - 1),
            F.concat(h["pre"], h["token"], h["post"]),
        ),
    )
    last = F.element_at(hits, -1)["line"]
    tail = F.slice(lines, last + 2, F.size(lines) - last - 1)
    return F.array_join(F.concat(F.flatten(chunks), tail), "\n")


def _is_account(label: Column, value: Column) -> Column:
    """Would this label and value be classified as an account number?"""

    def test(x: Column) -> Column:
        none = F.lit("")
        return R.is_account_label(x) & ~R.is_secret(x, none) & ~R.amount_context(x, value, none)

    # Cheapest test first: most lines do not hold an account-like number at all.
    return F.when(R.valid_account(R.trim(value)), let(R.trusted_label(label), test)).otherwise(F.lit(False))


def _account_lines(s: Column, how: _Style) -> Column:
    guard = s["t"].rlike(_DIGITS_9) & s["t"].rlike(rf"(?i)acc|iban|a[{R.SPACE}]*/[{R.SPACE}]*c")
    part = lambda x, g: F.regexp_extract(x, _INLINE_ACCOUNT, g)

    def on_lines(lines: Column) -> Column:
        inline = F.transform(
            lines,
            lambda x: F.when(x.rlike(_DIGITS_9), _is_account(part(x, 1), part(x, 3))).otherwise(F.lit(False)),
        )

        def with_inline(fired: Column) -> Column:
            def hit(x: Column, i: Column) -> Column:
                above = F.get(lines, i - 1)
                pair = above.isNotNull() & ~F.get(fired, i - 1) & _is_account(above, x)
                base = lambda pre, raw, post: F.struct(
                    i.alias("line"), F.lit("ACCOUNT").alias("kind"), raw.alias("raw"),
                    pre.alias("pre"), post.alias("post"),
                )
                return (
                    F.when(~x.rlike(_DIGITS_9), F.lit(None))
                    .when(F.get(fired, i), base(F.concat(part(x, 1), part(x, 2)), part(x, 3), part(x, 4)))
                    .when(
                        pair,
                        base(
                            F.regexp_extract(x, rf"^[{R.SPACE}]*", 0),
                            R.trim(x),
                            F.regexp_extract(x, rf"[{R.SPACE}]*\z", 0),
                        ),
                    )
                )

            hits = F.filter(F.transform(lines, hit), lambda h: h.isNotNull())
            return let(
                hits, lambda h: _apply(s, h, PHASE_ACCOUNT, how, lambda done: _splice_lines(lines, done))
            )

        return let(inline, with_inline)

    return F.when(guard, let(F.split(s["t"], "\n", -1), on_lines)).otherwise(s)


def _label_hits(lines: Column) -> Column:
    """Lines of the form "label: value" whose value is private, in line order."""
    found = F.filter(
        F.transform(
            lines,
            lambda x, i: F.when(
                x.rlike(_LABEL_LINE),
                F.struct(
                    i.alias("line"),
                    R.trim(F.regexp_extract(x, _LABEL_LINE, 1)).alias("label"),
                    R.trim(F.regexp_extract(x, _LABEL_LINE, 2)).alias("own"),
                    R.trim(F.coalesce(F.get(lines, i + 1), F.lit(""))).alias("below"),
                    F.regexp_extract(x, r"^[^:\-]*[:\-]", 0).alias("head"),
                ),
            ),
        ),
        lambda h: h.isNotNull(),
    )
    valued = F.transform(
        F.filter(found, lambda h: R.has_few_words(h["label"])),
        lambda h: h.withField("raw", F.when(h["own"] != "", h["own"]).otherwise(h["below"])),
    )
    open_ = F.transform(
        F.filter(valued, lambda h: ~R.is_empty_like(h["raw"]) & ~h["raw"].rlike(R.ONLY_TOKENS)),
        lambda h: h.withField("by_label", R.label_kind(h["label"])),
    )
    judged = F.transform(
        open_,
        lambda h: h.withField("kind", R.decide_kind(h["label"], h["by_label"], h["raw"], h["raw"], F.lit(""))),
    )
    hit = "array<struct<line:int,own:string,head:string,kind:string,raw:string>>"
    slim = F.transform(
        F.filter(judged, lambda h: h["kind"].isNotNull()),
        lambda h: F.struct(*[h[c].alias(c) for c in ("line", "own", "head", "kind", "raw")]),
    ).cast(hit)

    # A line taken as the value of the line above is no longer a label line itself.
    def take(acc: Column, h: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        taken = F.coalesce((last["own"] == "") & (last["line"] == h["line"] - 1), F.lit(False))
        return F.when(taken, acc).otherwise(F.array_append(acc, h))

    return F.transform(
        F.aggregate(slim, F.array().cast(hit), take),
        lambda h: F.struct(
            F.when(h["own"] == "", h["line"] + 1).otherwise(h["line"]).alias("line"),
            h["kind"].alias("kind"),
            h["raw"].alias("raw"),
            F.when(h["own"] == "", F.lit("")).otherwise(F.concat(h["head"], F.lit(" "))).alias("pre"),
            F.lit("").alias("post"),
        ),
    )


def _label_lines(s: Column, how: _Style, allow: Column) -> Column:
    def on_lines(lines: Column) -> Column:
        return let(
            _label_hits(lines),
            lambda h: _apply(s, h, PHASE_LABEL, how, lambda done: _splice_lines(lines, done)),
        )

    guard = allow & (s["t"].contains(":") | s["t"].contains("-")) & s["t"].rlike(_LABEL_SOMEWHERE)
    return F.when(guard, let(F.split(s["t"], "\n", -1), on_lines)).otherwise(s)


# --- splice phases ----------------------------------------------------------
def _splice_matches(text: Column, shape: str):
    """Put the pieces between matches and the hits back together."""
    return lambda hits: F.array_join(
        F.zip_with(
            F.split(text, shape, -1),
            hits,
            lambda piece, h: F.concat(piece, F.coalesce(F.concat(h["pre"], h["token"]), F.lit(""))),
        ),
        "",
    )


def _greetings(s: Column, how: _Style) -> Column:
    def hit(m: Column) -> Column:
        g = lambda i: F.regexp_extract(m, _GREETING, i)
        real = F.exists(F.split(g(3), rf"[{R.SPACE}]+"), lambda w: ~R.is_common_word(w))
        return F.struct(
            F.when(real, F.lit("PERSON")).alias("kind"),
            F.when(real, g(3)).otherwise(m).alias("raw"),
            F.when(real, F.concat(g(1), g(2))).otherwise(F.lit("")).alias("pre"),
        )

    hits = F.transform(F.regexp_extract_all(s["t"], F.lit(_GREETING), 0), hit)
    full = let(hits, lambda h: _apply(s, h, PHASE_GREETING, how, _splice_matches(s["t"], _GREETING)))
    said = reduce(lambda a, b: a | b, [s["t"].contains(w) for w in R.GREETING_WORDS])
    return F.when(said & s["t"].rlike(_GREETING), full).otherwise(s)


def _patterns(how: _Style, kind: str):
    def step(s: Column) -> Column:
        return _pattern_step(s, how, kind)

    return step


def _pattern_step(s: Column, how: _Style, kind: str) -> Column:
    text, shape = s["t"], R.SHAPES[kind]
    # Every match has at least five characters, so nine of them fill the look-back.
    reach = R.LOOK_BACK // 5

    def on_matches(b: Column) -> Column:
        def before(i: Column) -> Column:
            window = F.transform(
                F.sequence(F.greatest(i - reach, F.lit(0)), i),
                lambda j: F.concat(
                    F.right(F.get(b["pieces"], j), F.lit(R.LOOK_BACK)),
                    F.when(j < i, F.get(b["matches"], j)).otherwise(F.lit("")),
                ),
            )
            return F.right(F.array_join(window, ""), F.lit(R.LOOK_BACK))

        def hit(m: Column, i: Column) -> Column:
            def judge(near: Column) -> Column:
                ok = R.text_match_ok(kind, m) & ~near.rlike(R.AMOUNT) & ~near.rlike(R.CURRENCY_BEFORE)
                return F.struct(F.when(ok, F.lit(kind)).alias("kind"), m.alias("raw"), F.lit("").alias("pre"))

            return let(before(i), judge)

        return let(
            F.transform(b["matches"], hit),
            lambda h: _apply(s, h, PHASE_OF_KIND[kind], how, _splice_matches(text, shape)),
        )

    quick = R.SHAPE_GUARDS[kind]
    guard = text.contains(quick) if quick == "@" else text.rlike(quick)
    both = F.struct(
        F.split(text, shape, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(shape), 0).alias("matches"),
    )
    return F.when(guard, let(both, on_matches)).otherwise(s)


def _steps(how: _Style, allow: Column) -> dict[int, Column]:
    """Expression per phase that takes column ``_s`` to the next state."""
    build = {
        PHASE_ACCOUNT: lambda s: _account_lines(s, how),
        PHASE_LABEL: lambda s: _label_lines(s, how, allow),
        PHASE_GREETING: lambda s: _greetings(s, how),
        **{phase: _patterns(how, kind) for kind, phase in PHASE_OF_KIND.items()},
    }
    return {phase: let(F.col("_s"), step) for phase, step in build.items()}


@lru_cache(maxsize=32)
def _shared_steps(style: str, salt: str, given: bool, late: str) -> dict[int, Column]:
    """Steps are unbound expressions, so all jobs of a process can share them."""
    return _steps(_Style(style, salt, F.col("_known") if given else None, late), F.col("_allow"))


def replace_names(text: Column, names: Column, parts: Column) -> Column:
    """Known full names first, then known parts, each as a separate word."""
    full = F.aggregate(
        names, text, lambda t, e: F.regexp_replace(t, R.name_pattern(e["key"]), e["token"])
    )
    return F.aggregate(
        parts, full, lambda t, e: F.regexp_replace(t, R.name_pattern(e["part"]), e["token"])
    )


# --- jobs -------------------------------------------------------------------
def redact_rows(
    df: DataFrame,
    text: str = "text",
    *,
    allow_labels: bool | Column = True,
    style: str = "numbered",
    salt: str = "",
    phases: Sequence[int] = ALL_PHASES,
    known: Column | None = None,
    late: str = "zero",
    own_names: bool = True,
    out: str = "redacted",
    entities: str = "entities",
) -> DataFrame:
    """Add ``redacted`` and ``entities`` to every row; each row is its own scope.

    ``style`` picks the token: ``numbered`` (KIND_1, KIND_2 … per row),
    ``kind_only`` or ``hash`` (keyed with ``salt``; equal across the corpus
    without any shuffle).  ``known`` maps "KIND:key" to ready-made tokens and
    replaces the numbering, for scopes that span rows.  A detail that it does not
    hold becomes KIND_0, for the caller to number and look again, or with ``late``
    "hash" a keyed token, where nobody can.  ``own_names`` also rewrites later
    mentions of names found in the same row.
    """
    keep = [c for c in df.columns if c not in (out, entities)]
    if style not in STYLES:
        raise ValueError(f"unknown token style {style!r}, expected one of {STYLES}")
    if known is not None:
        # sorted once a row, for the binary search
        entries = F.transform(F.map_entries(known), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
        df = df.withColumn("_known", F.array_sort(entries))
    allow = allow_labels if isinstance(allow_labels, Column) else F.lit(allow_labels)
    state = F.struct(
        F.coalesce(F.col(text), F.lit("")).alias("t"),
        F.array().alias("keys"),
        F.struct(F.array().alias("names"), F.array().alias("parts"), F.lit(0).alias("n")).alias("people"),
        F.array().alias("ents"),
    ).cast(STATE)
    # One projection per phase.  Each mentions the state before it exactly once,
    # so however the optimizer merges or pushes projections, no work is multiplied.
    steps = _shared_steps(style, salt, known is not None, late)
    df = df.withColumns({"_raw": F.col(text), "_allow": allow, "_s": state})
    for phase in ALL_PHASES:
        if phase in phases:
            df = df.withColumn("_s", steps[phase])

    def result(s: Column) -> Column:
        people = s["people"]
        named = s["t"]
        if own_names:
            named = F.when(
                F.size(people["names"]) > 0, replace_names(s["t"], people["names"], people["parts"])
            ).otherwise(s["t"])
        return F.struct(named.alias("t"), s["ents"].alias("ents"))

    done = df.select(*keep, "_raw", let(F.col("_s"), result).alias("_done"))
    return done.select(
        *keep,
        F.when(F.col("_raw").isNotNull(), F.col("_done.t")).alias(out),
        F.col("_done.ents").alias(entities),
    )


def find_entities(
    df: DataFrame, keys: Sequence[str], text: str = "text", kinds: Sequence[str] | None = None, **options
) -> DataFrame:
    """One row per private detail: ``keys`` + phase, pos, kind, raw, norm_key."""
    rows = redact_rows(df.select(*keys, text), text, own_names=False, **options)
    # The outer form keeps the optimizer from evaluating the fold once more in an inferred filter.
    found = rows.select(*keys, F.inline_outer("entities")).drop("token")
    wanted = F.col("kind").isNotNull() if kinds is None else F.col("kind").isin(*kinds)
    return found.filter(wanted)


def leak_audit(
    df: DataFrame, text: str = "redacted", known_values: Column | None = None
) -> DataFrame:
    """Add ``is_safe`` and ``reason``: nothing detectable and no known value is left.

    ``known_values`` is an array column with the raw values of the row's scope.
    """
    checked = redact_rows(
        df, text, style="kind_only", own_names=False, out="_again", entities="_found"
    )
    leaked = F.lit(False)
    if known_values is not None:
        leaked = F.coalesce(
            F.exists(known_values, lambda v: (F.length(v) >= 3) & F.contains(F.col(text), v)), F.lit(False)
        )
    reason = F.when(leaked, F.lit("known value")).when(
        F.col("_again") != F.col(text), F.lit("detectable value")
    )
    return checked.select(*df.columns, reason.alias("reason")).withColumn("is_safe", F.col("reason").isNull())


def assert_safe(audited: DataFrame) -> None:
    """Raise if an audited table holds an unsafe row (stops at the first one)."""
    if not audited.filter(~F.col("is_safe")).isEmpty():
        raise ValueError("blocked: the table still holds a detectable private value")
