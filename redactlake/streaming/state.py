"""Redaction of streams with keyed state: tokens, names and item records live in the state store.

Two queries, each with its state, stand around the rewriting, which stays a column
expression:

* per scope: counters, the token of every value, and the people met so far.  A
  batch reads and writes the state of the scopes that it holds rows of, nothing
  else; no token table is read again.
* per item: what stood there, what we wrote and a manual decision.  Puts,
  deletes, marks and unmarks change that record, and revisions that come late are
  dropped.

The second query reads what the first one has written.  State goes with a query's
checkpoint, so a batch that runs again after a failure starts from the same state,
and the file sink takes its rows once.

Scopes are dealt to ``BUCKETS`` buckets by a hash.  Python is called once for each
bucket that a batch holds rows of, and not once a scope, as a call costs more than
the work on a scope with a row or two.  Within a bucket each scope and item still
has a state of its own, looked up by its key; one that holds nothing is not stored.

The state holds keyed hashes of values and names; a name is found in later texts by
the hashes of its words, and its spelling is taken from the text itself.  Item
records hold texts in clear only if ``keep_texts`` is set, as unmarking gives the
original back; otherwise they hold hashes, and an unmarked item is shown once its
text is put again.

Defined cases: null scopes and items are keys like any others; a put without text
shows nothing and keeps the record; events of one revision go by ``item_ord``, then
``item_id``; columns besides those of ``EVENTS`` are not taken along.
"""

from __future__ import annotations

import json
import re
from collections import namedtuple
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from redactlake.functions import rules as R
from redactlake.operators.redaction import redact_rows, replace_names

PUT, DELETE, MARK, UNMARK = "put", "delete", "mark", "unmark"
BUCKETS = 2048  # a checkpoint keeps to its number
STORES_A_CORE = 4  # state stores at most, by the cores at the first run

_RUN = re.compile(r"\w+")
_PART = re.compile(r"[^\W\d_](?:[^\W\d_]|['’\-])*")
_WHITE = re.compile(rf"[{R.SPACE}]+")
_COMMON = frozenset(R.COMMON_WORDS)


def _hash(salt: str, *words: str) -> str:
    return blake2b("\x1f".join(words).encode(), key=salt.encode()[:64], digest_size=12).hexdigest()


class People:
    """Names and name parts of one scope, by the hashes of their words."""

    def __init__(self, salt: str, saved: dict | None = None):
        saved = saved or {}
        self.salt = salt
        self.names: dict[str, str] = saved.get("names", {})  # hash of the whole name -> token
        self.parts: dict[str, str] = saved.get("parts", {})  # hash of a part -> token of its last use
        # what is searched in texts, in the order of first use: hash -> [is part, edges]
        self.entries: dict[str, list] = saved.get("entries", {})
        # hash of a first word -> numbers of words of the entries that begin with it
        self.starts: dict[str, list[int]] = saved.get("starts", {})

    def saved(self) -> dict:
        return {"names": self.names, "parts": self.parts, "entries": self.entries, "starts": self.starts}

    def alias(self, name: str) -> str | None:
        """The one person that all known words of a new name belong to."""
        known = {self.parts.get(_hash(self.salt, w)) for w in _WHITE.split(name)} - {None}
        return known.pop() if len(known) == 1 else None

    def meet(self, name: str, token: str) -> None:
        self.names.setdefault(_hash(self.salt, name), token)
        self._search(name, False)
        for part in dict.fromkeys(p.lower() for p in _PART.findall(name)):
            if len(part) >= R.MIN_NAME_PART and part not in _COMMON:
                self.parts[_hash(self.salt, part)] = token
                self._search(part, True)

    def _search(self, entry: str, is_part: bool) -> None:
        runs = list(_RUN.finditer(entry))
        if not runs:
            return
        core = entry[runs[0].start() : runs[-1].end()]
        key = f"{'p' if is_part else 'n'}{_hash(self.salt, entry)}"
        if key not in self.entries:
            self.entries[key] = [_hash(self.salt, core), entry[: runs[0].start()], entry[runs[-1].end() :]]
            sizes = self.starts.setdefault(_hash(self.salt, runs[0][0]), [])
            if len(runs) not in sizes:
                sizes.append(len(runs))

    def found_in(self, text: str) -> tuple[list[list[str]], list[list[str]]]:
        """Known names and parts that may stand in the text: spelling and token, in the order in which they are replaced."""
        if not self.entries:
            return [], []
        text = text.lower()
        runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
        seen: dict[str, list[int]] = {}
        cores: dict[str, str] = {}
        for i, (begin, end) in enumerate(runs):
            word = text[begin:end]
            sizes = seen.get(word)
            if sizes is None:
                sizes = seen[word] = self.starts.get(_hash(self.salt, word), [])
            for size in sizes:
                if i + size <= len(runs):
                    core = text[begin : runs[i + size - 1][1]]
                    cores[_hash(self.salt, core)] = core
        names, parts = [], []
        if cores:
            for key, (core, before, after) in self.entries.items():
                if core in cores:
                    spelled = before + cores[core] + after
                    if key[0] == "p":
                        parts.append([spelled, self.parts[_hash(self.salt, spelled)]])
                    else:
                        names.append([spelled, self.names[_hash(self.salt, spelled)]])
        return names, parts


class Scope:
    """Tokens of one scope."""

    def __init__(self, salt: str, saved: dict | None = None):
        saved = saved or {}
        self.salt = salt
        self.counts: dict[str, int] = saved.get("counts", {})
        self.tokens: dict[str, str] = saved.get("tokens", {})
        self.people = People(salt, saved.get("people"))

    def saved(self) -> dict:
        return {"counts": self.counts, "tokens": self.tokens, "people": self.people.saved()}

    def token(self, kind: str, key: str) -> str:
        """The value's token: the one that it has, an alias's, or the next number of its kind."""
        at = _hash(self.salt, kind, key)
        token = self.tokens.get(at)
        if token is None and kind == "PERSON":
            token = self.people.alias(key)
        if token is None:
            self.counts[kind] = self.counts.get(kind, 0) + 1
            token = f"{kind}_{self.counts[kind]}"
        self.tokens[at] = token
        if kind == "PERSON":
            self.people.meet(key, token)
        return token


_ORDER = ["rev", "item_ord", "item_id"]


@lru_cache(maxsize=8)
def _row_type(columns: tuple[str, ...]) -> type:
    return namedtuple("Row", columns)


def _whole(x: float | str | None) -> int | None:
    """Numbers come as floats where a group has nulls among them, or spelled out."""
    return None if x is None or x != x else int(x)


def _in_order(batches: Iterator[pd.DataFrame]) -> list:
    """The rows of a group by ``_ORDER``, nulls first, in plain Python: most groups have a row or two, and pandas takes longer to sort those than the job does."""
    rows = []
    for batch in batches:
        columns = [list(map(_whole, batch[c].tolist())) if c in ("rev", "item_ord") else batch[c].tolist() for c in batch.columns]
        rows.extend(map(_row_type(tuple(batch.columns))._make, zip(*columns, strict=True)))
    if len(rows) > 1:
        rows.sort(key=lambda r: [(getattr(r, c) is not None, getattr(r, c)) for c in _ORDER])
    return rows


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows for Spark; Arrow makes the types, nulls and all."""
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def _grouped(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> dict[tuple, list]:
    """The rows of a bucket by scope or item, each group in order."""
    groups: dict[tuple, list] = {}
    for r in _in_order(batches):
        groups.setdefault(tuple(getattr(r, c) for c in by), []).append(r)
    return groups


def _in_buckets(rows: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    # numbers are spelled out: pandas makes floats of those that have nulls among them
    dealt = rows.withColumns({"rev": F.col("rev").cast("string"), "item_ord": F.col("item_ord").cast("string"), "bucket": F.pmod(F.xxhash64("scope"), F.lit(BUCKETS))})
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "none")


_TOKENED = "scope string, item_id string, rev bigint, item_ord bigint, event string, text string, known string, names string, parts string"


class _Tokens(StatefulProcessor):
    """The state of each scope, as JSON."""

    def __init__(self, salt: str):
        self.salt = salt

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("scopes", "scope string", "saved string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        any_held = self.held.exists()
        out = []
        for (name,), events in _grouped(rows, ["scope"]).items():
            at = (json.dumps(name),)
            saved = self.held.getValue(at) if any_held else None
            scope, met = Scope(self.salt, json.loads(saved[0]) if saved else None), False
            for r in events:
                known, names, parts = None, [], []
                if r.event == PUT and isinstance(r.text, str):
                    if isinstance(r.entities, str):
                        known = {}
                        for e in json.loads(r.entities):  # in order of phase and place
                            known[f"{e['kind']}:{e['norm_key']}"] = scope.token(e["kind"], e["norm_key"])
                            met = True
                    names, parts = scope.people.found_in(r.text)
                dumped = (json.dumps(x, ensure_ascii=False) if x is not None else None for x in (known, names or None, parts or None))
                out.append((name, r.item_id, r.rev, r.item_ord, r.event, r.text, *dumped))
            if met:
                self.held.updateValue(at, (json.dumps(scope.saved()),))
        yield _frame(out, _TOKENED)

    def close(self) -> None:
        pass


def _with_tokens(events: DataFrame, salt: str) -> DataFrame:
    """Events with the tokens of what they mention and the known people in their texts; ``known`` is null where a text holds no detail."""
    found = redact_rows(events, "text", own_names=False, out="_", entities="entities")
    detailed = (F.size("entities") > 0) | (F.col("_") != F.col("text"))
    rows = found.select("scope", *_ORDER, "event", "text", F.when(detailed, F.to_json("entities")).alias("entities"))
    return _in_buckets(rows, _Tokens(salt), _TOKENED)


def _rewritten(tokened: DataFrame) -> DataFrame:
    """Events with ``redacted``; a text without details is not looked through again."""
    pair = lambda x, name: F.struct(x[0].alias(name), x[1].alias("token"))
    pairs = lambda c, name: F.transform(F.from_json(F.coalesce(c, F.lit("[]")), "array<array<string>>"), lambda x: pair(x, name))
    detailed = tokened.withColumn("detailed", F.when(F.col("known").isNotNull(), F.col("text")))
    done = redact_rows(detailed, "detailed", known=F.from_json("known", "map<string,string>"), own_names=False, late="hash")
    shown = F.when(F.col("known").isNotNull(), F.col("redacted")).otherwise(F.col("text"))
    return done.withColumn("redacted", replace_names(shown, pairs("names", "key"), pairs("parts", "part"))).drop("detailed", "known", "names", "parts", "entities")


_SHOWN = "scope string, item_id string, rev bigint, item_ord bigint, event string, change string, shown string, is_private boolean"


class Item:
    """Record of one item: what stood there, what we wrote, and a manual decision."""

    def __init__(self, saved: tuple | None, keep_texts: bool):
        self.rev, self.original, self.redacted, self.is_private = saved or (None, None, None, None)
        self.keep = keep_texts

    def _kept(self, text: str) -> str:
        return text if self.keep else blake2b(text.encode(), digest_size=16).hexdigest()

    def put(self, text: str | None, redacted: str | None) -> tuple[str, str | None, bool]:
        """What happened, what is shown, and whether that hides something."""
        if text is None:
            return "plain", None, False
        if self.original is not None:
            if self.is_private is False and self._kept(text) == self.original:
                return "unmarked", text, False
            if self._kept(text) == self.redacted:
                return "ours", text, True
        before, self.is_private = self.original, None
        if redacted == text:
            self.original = self.redacted = None
            return ("plain" if before is None else "replaced"), text, False
        self.original, self.redacted = self._kept(text), self._kept(redacted)
        return ("new" if before is None else "replaced"), redacted, True

    def decide(self, is_private: bool) -> tuple[str, str | None, bool]:
        if self.original is None:
            return "refused", None, False
        self.is_private = is_private
        shown = (self.redacted if is_private else self.original) if self.keep else None
        return ("marked" if is_private else "unmarked"), shown, is_private

    def saved(self) -> tuple:
        return self.rev, self.original, self.redacted, self.is_private


class _Records(StatefulProcessor):
    """What each event does to its item, and the record of each item."""

    def __init__(self, keep_texts: bool):
        self.keep_texts = keep_texts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("items", "item string", "rev bigint, original string, redacted string, is_private boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        any_held = self.held.exists()
        out = []
        for name, events in _grouped(rows, ["scope", "item_id"]).items():
            at = (json.dumps(name),)
            item = Item(self.held.getValue(at) if any_held else None, self.keep_texts)
            for r in events:
                rev = r.rev
                if item.rev is not None and (rev is None or rev < item.rev):
                    out.append((*name, rev, r.item_ord, r.event, "stale", None, False))
                    continue
                item.rev = rev
                if r.event == PUT:
                    done = item.put(r.redacted if r.text is None else r.text, r.redacted)
                elif r.event == DELETE:
                    item = Item((rev, None, None, None), self.keep_texts)  # its revision stays, so late events of older ones are told
                    done = ("removed", None, False)
                else:
                    done = item.decide(r.event == MARK)
                out.append((*name, rev, r.item_ord, r.event, *done))
            self.held.updateValue(at, item.saved())
        yield _frame(out, _SHOWN)

    def close(self) -> None:
        pass


EVENTS = "scope string, item_id string, rev bigint, item_ord bigint, event string, text string"


def redact_events(events: DataFrame, salt: str = "") -> DataFrame:
    """A stream of events with ``redacted`` for every put.

    ``event`` is put, delete, mark or unmark; ``rev`` orders the events of a scope,
    ``item_ord`` those of one revision.  A value keeps its token in all later texts
    of its scope; a text sees the people met up to and including itself.
    """
    return _rewritten(_with_tokens(events, salt))


def item_records(rows: DataFrame, keep_texts: bool = False) -> DataFrame:
    """What each event of :func:`redact_events` does to its item.

    ``change`` is new, replaced, plain (nothing to hide), ours (our own text came
    back), removed, marked, unmarked, refused (there is no record) or stale (a
    later revision was there before); ``shown`` is the text, ``is_private`` whether
    it hides something.
    """
    return _in_buckets(_texts_once(rows.select("scope", *_ORDER, "event", "text", "redacted")), _Records(keep_texts), _SHOWN)


def _texts_once(rows: DataFrame) -> DataFrame:
    """``text`` only where ``redacted`` differs from it; both are null together."""
    return rows.withColumn("text", F.when(~F.col("text").eqNullSafe(F.col("redacted")), F.col("text")))


#: States by key need RocksDB.  Its stores are many and small: no space is taken ahead, and all those of an executor share their memory.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for a query that starts meanwhile; it takes a copy, and the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what has come so far, and go on after the last checkpoint."""
    sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).option("compression", "zstd")
    spark = stream.sparkSession
    # opening a store and its Python worker takes most of a second, in every run
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), STORES_A_CORE * spark.sparkContext.defaultParallelism)
    with _settings(spark, _STORE | {"spark.sql.shuffle.partitions": str(parts)}):
        return sink.outputMode("append").trigger(availableNow=True).start()


def run_events(spark: SparkSession, source: str, base: str, salt: str = "", keep_texts: bool = False, files: int = 1) -> DataFrame:
    """Take the events that have been put into the folder ``source`` since the last run; the records of all events."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(source)
    rewritten = redact_events(events, salt)
    start(_texts_once(rewritten), f"{base}/redacted", f"{base}/redacted-checkpoint").awaitTermination()
    rows = spark.readStream.schema(rewritten.schema).parquet(f"{base}/redacted").withColumn("text", F.coalesce("text", "redacted"))
    start(item_records(rows, keep_texts), f"{base}/records", f"{base}/records-checkpoint").awaitTermination()
    return spark.read.schema(_SHOWN).parquet(f"{base}/records")


def latest_items(records: DataFrame) -> DataFrame:
    """What every item shows now, by its latest event that counted; removed items are gone."""
    last = records.filter("change NOT IN ('stale', 'refused')").groupBy("scope", "item_id").agg(
        F.max_by(F.struct("change", "shown", "is_private"), F.struct("rev", "item_ord")).alias("last")
    )
    return last.select("scope", "item_id", "last.*").filter("change <> 'removed'")
