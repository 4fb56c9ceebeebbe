"""Document store (S-10, A-10, K-16): typed filters over VARIANT payloads and
updates as a field log.

A filter is a tree: a field with a value (equality), with ``None`` (missing or
null), or with ``(operator, value)``; ``$and``, ``$or`` and ``$not`` combine
filters.  Values are compared by their kind: a number with numbers, a text
with texts, a boolean with booleans, a time with ISO texts.  A field of another
kind matches nothing but ``$ne``, ``$nin`` and ``$exists``.

An update appends rows (id, field, value, seq) to a log instead of writing
documents again; reading folds the log, the highest seq of a field winning.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_SCHEMA = "id long, field string, value string, seq long"
COMPARE = {"$eq": lambda a, b: a == b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b,
           "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b}
NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"


def _variant(field: str) -> Column:
    """The payload's field as a variant; null where there is none."""
    if "'" not in field:
        return F.try_variant_get("payload", f"$['{field}']", "variant")
    if '"' not in field:
        return F.try_variant_get("payload", f'$["{field}"]', "variant")
    # paths know no escapes
    return F.try_element_at(F.from_json(F.to_json("payload"), "map<string,variant>"), F.lit(field))


def _typed(field: str, value) -> tuple[Column, Column]:
    """The field as the kind of ``value`` (null where it is of another), and
    the value."""
    if field in ("id", "type"):
        return F.col(field), F.lit(value)
    kind = F.schema_of_variant(_variant(field))
    get = lambda t: F.try_variant_get(_variant(field), "$", t)
    if isinstance(value, bool):
        return F.when(kind == "BOOLEAN", get("boolean")), F.lit(value)
    if isinstance(value, int):
        exact = F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), get("decimal(38,0)").cast("decimal(38,6)")).otherwise(get("decimal(38,6)"))
        return F.when(kind.rlike(NUMBERS), exact), F.lit(value).cast("decimal(38,6)")
    if isinstance(value, float):
        return F.when(kind.rlike(NUMBERS), get("double")), F.lit(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return F.when(kind == "STRING", get("string").try_cast("timestamp_ntz")), F.lit(value).cast("timestamp_ntz")
    return F.when(kind == "STRING", get("string")), F.lit(str(value))


def _blank(field: str) -> Column:
    """Whether the field is missing or null."""
    if field in ("id", "type"):
        return F.col(field).isNull()
    v = _variant(field)
    return v.isNull() | F.is_variant_null(v)


def _one(field: str, wanted) -> Column:
    if wanted is None:
        return _blank(field)
    if not isinstance(wanted, tuple):
        wanted = ("$eq", wanted)
    op, value = wanted
    if op == "$exists":
        here = F.col(field).isNotNull() if field in ("id", "type") else _variant(field).isNotNull()
        return here if value else ~here
    if op in ("$ne", "$nin"):
        return ~F.coalesce(_one(field, ("$eq", value) if op == "$ne" else ("$in", value)) if value is not None else _blank(field), F.lit(False))
    if op == "$in":
        out = F.lit(False)
        for v in value:
            out = out | F.coalesce(_one(field, v), F.lit(False))
        return out
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op}")
    if value is None:
        return _blank(field) if op == "$eq" else F.lit(False)
    return COMPARE[op](*_typed(field, value))


def predicate(filters: dict) -> Column:
    """The condition of a filter tree; never null."""
    cond = F.lit(True)
    for k, v in filters.items():
        if k in ("$and", "$or"):
            parts = [predicate(x) for x in v]
            made = F.lit(k == "$and")
            for p in parts:
                made = made & p if k == "$and" else made | p
        elif k == "$not":
            made = ~predicate(v)
        else:
            made = F.coalesce(_one(k, v), F.lit(False))
        cond = cond & made
    return cond


def find(docs: DataFrame, filters: dict) -> DataFrame:
    """Documents (id, type, payload) that match ``filters``."""
    return docs.where(predicate(filters))


def update_log(docs: DataFrame, filters: dict, updates: dict, seq: int) -> DataFrame:
    """Log rows of an update: each field of ``updates`` (JSON values, or columns
    over ``docs``) of every document that matches."""
    value = lambda v: v if isinstance(v, Column) else F.lit(json.dumps(v))
    rows = F.array(*[F.struct(F.lit(k).alias("field"), value(v).cast("string").alias("value")) for k, v in updates.items()])
    return find(docs, filters).select("id", F.explode(rows).alias("u")).select(
        "id", "u.field", "u.value", F.lit(seq).cast("long").alias("seq"))


def fold_log(docs: DataFrame, log: DataFrame) -> DataFrame:
    """The documents with their log applied: of each field the value of the
    highest seq (of one seq, the greatest text).  Repeated log rows change
    nothing; rows of unknown documents neither; a payload that is no object
    stays as it is."""
    last = log.groupBy("id", "field").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))
    put = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.parse_json("value").alias("value")))).alias("_put"))
    fields = F.from_json(F.to_json("payload"), "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: ~F.map_contains_key("_put", k))
    is_object = F.schema_of_variant("payload").startswith("OBJECT")
    made = F.when(F.col("_put").isNotNull() & is_object, F.parse_json(F.to_json(F.map_concat(kept, F.col("_put"))))).otherwise(F.col("payload"))
    return docs.join(put, "id", "left").select("id", "type", made.alias("payload"))


def start_run_log(docs: DataFrame, run_id: int, start_time: dt.datetime, seq: int) -> DataFrame:
    """A run starts: it takes the new artifacts that no run has, and the
    triggers from before ``start_time`` that started none."""
    taken = update_log(docs, {"type": "artifact", "run_id": None, "state": "new"}, {"run_id": run_id, "state": "current"}, seq)
    caused = update_log(docs, {"type": "trigger", "run_triggered": None, "trigger_time": ("$lt", start_time)}, {"run_triggered": run_id}, seq)
    return taken.unionByName(caused)


def end_run_log(docs: DataFrame, end_time: dt.datetime, seq: int) -> DataFrame:
    """The open runs end, and their current artifacts are old."""
    stamp = end_time.isoformat()
    runs = update_log(docs, {"type": "run", "end_time": None}, {"end_time": stamp}, seq)
    return runs.unionByName(update_log(docs, {"type": "artifact", "end_time": None, "state": "current"}, {"end_time": stamp, "state": "old"}, seq))
