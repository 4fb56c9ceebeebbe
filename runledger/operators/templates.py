"""Cards from templates (N-12, X-8): a template is a table of parts.

``template_parts`` reads template texts into rows (position, literal or slot,
default, conditions); ``render_cards`` joins them to the cards' fields and
folds them in order.  Understood are ``{{ slot }}``, ``{{ slot |
default("text") }}`` (a missing field), ``{{ slot | default("text", true) }}``
(a missing or empty one) and ``{% if slot %} ... {% endif %}`` (also ``if
not``, nested), which is what card templates use; other ``{{ }}`` are an error
in the part table (kind ``unknown``) and come out as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .card_templates import TEMPLATES
from .headers import encode_scalar, leaves_yaml

TOKEN = r"\{\{[\s\S]*?\}\}|\{%[\s\S]*?%\}"
SLOT = (r"^\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:\|\s*default\(\s*(\"(?:[^\"\\]|\\[\s\S])*+\"|'(?:[^'\\]|\\[\s\S])*+')"
        r"\s*(?:,\s*(true|false|True|False))?\s*\)\s*)?\}\}\z")
BLOCK = r"^\{%\s*if\s+(not\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*%\}\z"
BLOCK_END = r"^\{%\s*endif\s*%\}\z"


def default_templates(spark: SparkSession) -> DataFrame:
    """(template, text): the templates ``model`` and ``dataset``."""
    return spark.createDataFrame(list(TEMPLATES.items()), "template string, text string")


def _unescaped(quoted: Column) -> Column:
    inner = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    return F.regexp_replace(F.replace(inner, F.lit("\\n"), F.lit("\n")), r"\\([\s\S])", "$1")


def template_parts(templates: DataFrame) -> DataFrame:
    """Parts of templates (template, text): template, position, kind (literal,
    slot or unknown), text (of a literal), slot, default, falsy (the default
    also stands for an empty field), conds (fields that must be filled, ``!``
    before those that must not).  A line break at the end of a template is not
    part of it."""
    body = F.regexp_replace("text", r"\n\z", "")
    tokens = F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))
    # literal 0, token 0, literal 1, token 1, ...
    mixed = F.flatten(F.zip_with(F.split(body, TOKEN), tokens, lambda a, b: F.array(
        F.struct(F.lit("literal").alias("kind"), a.alias("text")), F.struct(F.lit("token").alias("kind"), b.alias("text")))))
    none = F.array().cast("array<string>")
    part = "struct<kind: string, text: string, conds: array<string>>"

    def step(s, p):
        t = p["text"]
        opens, closes = (p["kind"] == "token") & t.rlike(BLOCK), (p["kind"] == "token") & t.rlike(BLOCK_END)
        cond = F.concat(F.when(F.regexp_extract(t, BLOCK, 1) != "", "!").otherwise(""), F.regexp_extract(t, BLOCK, 2))
        conds = F.when(opens, F.concat(s["conds"], F.array(cond))).when(
            closes, F.slice(s["conds"], F.lit(1), F.greatest(F.size(s["conds"]) - 1, F.lit(0)))).otherwise(s["conds"])
        row = F.struct(p["kind"].alias("kind"), t.alias("text"), s["conds"].alias("conds"))
        out = F.when(opens | closes | t.isNull() | (t == ""), s["out"]).otherwise(F.concat(s["out"], F.array(row)))
        return F.struct(conds.alias("conds"), out.alias("out"))

    read = templates.select("template", F.aggregate(
        mixed, F.struct(none.alias("conds"), F.array().cast(f"array<{part}>").alias("out")), step, lambda s: s["out"]).alias("parts"))
    rows = read.select("template", F.posexplode("parts").alias("position", "p"))
    t = F.col("p.text")
    literal, slot = F.col("p.kind") == "literal", (F.col("p.kind") == "token") & t.rlike(SLOT)
    given = F.regexp_extract(t, SLOT, 2)
    return rows.select(
        "template", "position", F.when(literal, "literal").when(slot, "slot").otherwise("unknown").alias("kind"),
        F.when(~slot, t).alias("text"), F.when(slot, F.regexp_extract(t, SLOT, 1)).alias("slot"),
        F.when(slot & (given != ""), _unescaped(given)).alias("default"),
        (slot & (F.lower(F.regexp_extract(t, SLOT, 3)) == "true")).alias("falsy"), F.col("p.conds").alias("conds"))


def render_cards(cards: DataFrame, parts: DataFrame, id_col: str = "card_id") -> DataFrame:
    """N-12: (id, text) of ``cards`` (id, template, fields: a map of texts) from
    the ``parts`` of their templates.  A field that is missing, null, or empty
    where the slot says so, gives way to the slot's default, and to nothing
    without one.  A template's parts meet its cards as one array (as long as
    the template); cards of unknown templates have a null text.  The templates
    are broadcast, whatever the planner thinks of the sizes: cards of one
    template would otherwise meet in one task, or be broadcast themselves."""
    folded = parts.groupBy("template").agg(F.array_sort(F.collect_list(F.struct(
        "position", "kind", "text", "slot", "default", "falsy", "conds"))).alias("_parts"))
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    filled = lambda name: F.coalesce(F.try_element_at(fields, name), F.lit("")) != ""
    shown = F.filter("_parts", lambda p: F.forall(p["conds"], lambda c: F.when(
        c.startswith("!"), ~filled(F.substr(c, F.lit(2)))).otherwise(filled(c))))
    value = lambda p: F.try_element_at(fields, p["slot"])
    text = F.array_join(F.transform(shown, lambda p: F.when(p["kind"] != "slot", p["text"]).otherwise(
        F.coalesce(F.when(p["falsy"], F.nullif(value(p), F.lit(""))).otherwise(value(p)), p["default"], F.lit("")))), "")
    return cards.join(F.broadcast(folded), "template", "left").select(id_col, F.when(F.col("_parts").isNotNull(), text).alias("text"))


# ---------------------------------------------------------------------------
# Fields and header of a card from its metadata
# ---------------------------------------------------------------------------

_LEAF = "struct<path: array<string>, value: string, raw: string>"


def _leaf(path: Column, value: Column, raw: Column | None = None) -> Column:
    return F.struct(path.alias("path"), value.alias("value"), (encode_scalar(value) if raw is None else raw).alias("raw"))


def _is_list(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "array"


def _item_leaf(name: str):
    return lambda v, i: _leaf(F.array(F.lit(name), F.concat(F.lit("["), i.cast("string"), F.lit("]"))), v)


def metadata_leaves(df: DataFrame, names: list[str]) -> Column:
    """Header leaves of metadata columns (texts and lists of texts), in the
    order given; nulls are left out."""
    made = []
    for n in names:
        if _is_list(df, n):
            made.append(F.transform(F.coalesce(F.col(n), F.array().cast("array<string>")), _item_leaf(n)))
        else:
            v = F.col(n).cast("string")
            made.append(F.filter(F.array(_leaf(F.array(F.lit(n)), v)), lambda x: x["value"].isNotNull()))
    return F.concat(*made) if made else F.array().cast(f"array<{_LEAF}>")


def metadata_fields(df: DataFrame, names: list[str]) -> Column:
    """Map of metadata columns for slots; a list reads ``['a', 'b']``."""
    text = lambda n: (F.when(F.col(n).isNotNull(), F.concat(F.lit("['"), F.array_join(n, "', '"), F.lit("']")))
                      if _is_list(df, n) else F.col(n).cast("string"))
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(text, names))) if names else F.create_map().cast("map<string,string>")


def number_text(value: Column) -> Column:
    """A number as YAML reads it back: whole ones with one decimal place, an
    exponent with its sign."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, F.concat(F.floor(value).cast("string"), F.lit(".0"))).otherwise(
        F.regexp_replace(value.cast("string"), "E(?=[0-9])", "e+"))


def index_leaves(name: str = "name", results: str = "results") -> Column:
    """Header leaves of a model index (as ``cards.model_index_build`` makes
    it); no results, no leaves."""
    at = lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))
    top = F.array(F.lit("model-index"), F.lit("[0]"))

    def texts(base: Column, s: Column, keys: list[str]) -> list[Column]:
        out = []
        for k in keys:
            path = F.concat(base, F.array(F.lit(k)))
            if k == "args":
                v = F.to_json(s[k])
                out.append(_leaf(path, v, v))            # JSON is YAML flow style
            elif k == "value":
                out.append(_leaf(path, s[k].cast("string"), number_text(s[k])))
            elif k == "verified":
                out.append(_leaf(path, s[k].cast("string"), s[k].cast("string")))
            else:
                out.append(_leaf(path, s[k]))
        return out

    def result(r, i):
        base = F.concat(top, F.array(F.lit("results"), at(i)))
        under = lambda k: F.concat(base, F.array(F.lit(k)))
        metrics = F.flatten(F.transform(r["metrics"], lambda m, j: F.array(*texts(
            F.concat(base, F.array(F.lit("metrics"), at(j))), m, ["type", "value", "name", "config", "args", "verified", "verifyToken"]))))
        return F.concat(F.array(*texts(under("task"), r["task"], ["type", "name"]),
                                *texts(under("dataset"), r["dataset"], ["name", "type", "config", "split", "revision", "args"])),
                        metrics, F.array(*texts(under("source"), r["source"], ["name", "url"])))

    head = F.array(_leaf(F.concat(top, F.array(F.lit("name"))), F.col(name)))
    all_leaves = F.concat(head, F.flatten(F.transform(results, result)))
    return F.when(F.size(results) > 0, F.filter(all_leaves, lambda x: x["value"].isNotNull())).otherwise(
        F.array().cast(f"array<{_LEAF}>"))


def cards_from_metadata(meta: DataFrame, template: str, names: list[str], id_col: str = "card_id",
                        index: bool = False, kwargs: str | None = None) -> DataFrame:
    """X-8: (id, template, fields) for ``render_cards``: the metadata columns
    ``names`` as slots, with the map column ``kwargs`` before them, and the
    slot ``card_data``: the YAML header of the metadata, and of the model index
    (columns name, results) where ``index`` says so."""
    leaves = metadata_leaves(meta, names)
    df = meta.withColumn("_leaves", F.concat(leaves, index_leaves()) if index else leaves)
    header = F.when(F.size("_leaves") > 0, leaves_yaml("_leaves")).otherwise("{}")
    given = F.coalesce(F.col(kwargs), F.create_map().cast("map<string,string>")) if kwargs else F.create_map().cast("map<string,string>")
    own = F.map_filter(metadata_fields(meta, names), lambda k, v: ~F.map_contains_key(given, k))
    fields = F.map_concat(F.map_filter(own, lambda k, v: k != "card_data"),
                          F.map_filter(given, lambda k, v: k != "card_data"), F.create_map(F.lit("card_data"), header))
    return df.select(id_col, F.lit(template).alias("template"), fields.alias("fields"))
