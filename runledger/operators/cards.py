"""Model cards, dataset cards and evaluation results as tables.

* evaluation results <-> model index (A-8 / C-1 / C-2), conflict and
  validation checks (C-3 / C-4), null-free JSON (N-10);
* card text: front matter split (N-8), line endings (N-9), bulk rendering
  from fields (N-12), reassembly (N-19);
* dataset cards (JSON-LD): build from the artifact catalog (A-9 / C-5),
  distribution and record-set views (C-6 / C-7).

The header functions here read flat ``key: value`` lines and block lists;
nested headers are read by ``headers``, templates by ``templates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import date_stamp, line_ending

# --- fixed values -----------------------------------------------------------
# Front-matter block pattern (group 2 is the YAML block; the body starts
# right after the whole match).  The block goes on, run by run, to the first line
# breaks with the closing marks after them.
YAML_BLOCK = r"^(\s*---[\r\n]+)((?:[^\r\n]++|[\r\n]++(?!---(?:\r\n|\n|$)))*+)([\r\n]+---(\r\n|\n|$))"
# Dataset-card key renames on output.
DATASET_KEY_RENAMES = {"train_eval_index": "train-eval-index"}
# Identity of an evaluation (results with equal identity share one model-index entry).
EVAL_IDENTITY = ["task_type", "dataset_type", "dataset_config", "dataset_split", "dataset_revision"]
# Fields compared by "equal except value" (everything but metric_value and verify_token).
EVAL_COMPARE = ["model_name", "task_type", "task_name", "dataset_type", "dataset_name", "dataset_config",
                "dataset_split", "dataset_revision", "dataset_args", "metric_type", "metric_name", "metric_config",
                "metric_args", "verified", "source_name", "source_url"]
# Dataset card body: (heading, bullet labels or None for a placeholder paragraph).
DATASET_CARD_SECTIONS = [
    ("## Dataset Details", None),
    ("### Dataset Description", ["Curated by", "Funded by [optional]", "Shared by [optional]",
                                 "Language(s) (NLP)", "License"]),
    ("### Dataset Sources [optional]", ["Repository", "Paper [optional]", "Demo [optional]"]),
    ("## Uses", None),
    ("### Direct Use", None),
    ("### Out-of-Scope Use", None),
    ("## Dataset Structure", None),
    ("## Dataset Creation", None),
    ("### Curation Rationale", None),
    ("### Source Data", None),
    ("#### Data Collection and Processing", None),
    ("#### Who are the source data producers?", None),
    ("### Annotations [optional]", None),
    ("#### Annotation process", None),
    ("#### Who are the annotators?", None),
    ("#### Personal and Sensitive Information", None),
    ("## Bias, Risks, and Limitations", None),
    ("### Recommendations", None),
    ("## Citation [optional]", None),
    ("## Glossary [optional]", None),
    ("## More Information [optional]", None),
    ("## Dataset Card Authors [optional]", None),
    ("## Dataset Card Contact", None),
]
# Sections that are headings only (their subsections carry the text).
HEADING_ONLY = {"## Dataset Details", "## Dataset Creation", "### Source Data"}
CROISSANT_CONTEXT = "https://mlcommons.org/croissant/1.0"
PART_FILES = 100_000


# ---------------------------------------------------------------------------
# Evaluation results and the model index
# ---------------------------------------------------------------------------

def _metric_struct() -> Column:
    return F.struct(F.col("metric_type").alias("type"), F.col("metric_value").alias("value"),
                    F.col("metric_name").alias("name"), F.col("metric_config").alias("config"),
                    F.parse_json("metric_args").alias("args"), F.col("verified").alias("verified"), F.col("verify_token").alias("verifyToken"))


def _in_order(entries: Column, by: str) -> Column:
    """Structs sorted by one field (variants among the others have no order)."""
    return F.array_sort(entries, lambda l, r: F.when(l[by] < r[by], -1).when(l[by] > r[by], 1).otherwise(0))


def model_index_build(evals: DataFrame) -> DataFrame:
    """A-8 / C-2: one row per model: ``name`` and ``results`` (model-index form).

    Results are grouped by the evaluation identity; task, dataset and source
    fields come from the group's first result (lowest ``seq``), metrics keep
    input order.  This is the card's own nested format: one row holds a
    model's whole index, as the card file does, so it is meant for cards
    (small per-model documents); bulk analysis uses ``model_index_summary``.
    ``dataset_args`` and ``metric_args`` are JSON texts and become nested
    values of the index."""
    keys = ["model_name", *EVAL_IDENTITY]
    first = F.struct("task_type", "task_name", "dataset_name", "dataset_type", "dataset_config",
                     "dataset_split", "dataset_revision", "dataset_args", "source_name", "source_url")
    g = evals.groupBy(*keys).agg(
        F.min("seq").alias("first_seq"),
        F.min_by(first, "seq").alias("f"),
        F.transform(_in_order(F.collect_list(F.struct("seq", _metric_struct().alias("m"))), "seq"),
                    lambda x: x["m"]).alias("metrics"))
    source = F.when(F.col("f.source_url").isNotNull(),
                    F.struct(F.col("f.source_url").alias("url"), F.col("f.source_name").alias("name")))
    result = F.struct(
        F.struct(F.col("f.task_type").alias("type"), F.col("f.task_name").alias("name")).alias("task"),
        F.struct(F.col("f.dataset_name").alias("name"), F.col("f.dataset_type").alias("type"),
                 F.col("f.dataset_config").alias("config"), F.col("f.dataset_split").alias("split"),
                 F.col("f.dataset_revision").alias("revision"), F.parse_json("f.dataset_args").alias("args")).alias("dataset"),
        F.col("metrics"), source.alias("source"))
    return (g.groupBy("model_name")
            .agg(F.transform(_in_order(F.collect_list(F.struct("first_seq", result.alias("r"))), "first_seq"),
                             lambda x: x["r"]).alias("results"))
            .select(F.col("model_name").alias("name"), "results"))


def model_index_summary(evals: DataFrame) -> DataFrame:
    """A-8 flattened: one row per model-index entry (no nesting): the entry's
    first-result fields, its metric count and its distinct metric types
    (a set bounded by the metric vocabulary, not by the entry's size)."""
    keys = ["model_name", *EVAL_IDENTITY]
    first = F.struct("task_name", "dataset_name", "source_name", "source_url")
    return (evals.groupBy(*keys)
            .agg(F.min("seq").alias("first_seq"), F.min_by(first, "seq").alias("f"),
                 F.count(F.lit(1)).alias("n_metrics"),
                 F.array_join(F.array_sort(F.collect_set("metric_type")), ",").alias("metric_types"))
            .select(*keys, "first_seq", F.col("f.task_name").alias("task_name"),
                    F.col("f.dataset_name").alias("dataset_name"), F.col("f.source_name").alias("source_name"),
                    F.col("f.source_url").alias("source_url"), "n_metrics", "metric_types"))


def model_index_json(model_index: DataFrame) -> DataFrame:
    """N-10: JSON text of each model's index; ``to_json`` drops NULL fields."""
    return model_index.select("name", F.to_json(F.array(F.struct("name", "results"))).alias("model_index"))


def model_index_flatten(model_index: DataFrame) -> DataFrame:
    """C-1: model index -> one flat evaluation result per metric."""
    # outer, by position: a plain explode has the optimizer write the whole
    # making of the array into filters below it
    r = model_index.select(F.col("name").alias("model_name"), F.posexplode_outer("results").alias("_i", "r")).where("_i IS NOT NULL")
    m = r.select("model_name", "r", F.posexplode_outer("r.metrics").alias("_j", "m")).where("_j IS NOT NULL")
    return m.select(
        "model_name",
        F.col("r.task.type").alias("task_type"), F.col("r.task.name").alias("task_name"),
        F.col("r.dataset.type").alias("dataset_type"), F.col("r.dataset.name").alias("dataset_name"),
        F.col("r.dataset.config").alias("dataset_config"), F.col("r.dataset.split").alias("dataset_split"),
        F.col("r.dataset.revision").alias("dataset_revision"), F.to_json("r.dataset.args").alias("dataset_args"),
        F.col("m.type").alias("metric_type"), F.col("m.value").alias("metric_value"),
        F.col("m.name").alias("metric_name"), F.col("m.config").alias("metric_config"),
        F.to_json("m.args").alias("metric_args"),
        F.col("m.verified").alias("verified"), F.col("m.verifyToken").alias("verify_token"),
        F.col("r.source.name").alias("source_name"), F.col("r.source.url").alias("source_url"))


def eval_conflicts(evals: DataFrame) -> DataFrame:
    """C-3: results that describe the same evaluation (equal on every field
    but the value and the verify token).  One row per member of a group with
    more than one result, pointing at the group's first result; pairs are
    never materialised."""
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in EVAL_COMPARE])
    tagged = evals.withColumn("_k", key)
    groups = (tagged.groupBy("_k", *EVAL_COMPARE)
              .agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_in_group"),
                   F.countDistinct("metric_value").alias("n_values"))
              .where(F.col("n_in_group") > 1))
    cond = [tagged["_k"] == groups["_k"]] + [tagged[c].eqNullSafe(groups[c]) for c in EVAL_COMPARE]
    return (tagged.join(groups, cond, "inner")
            .select(tagged["seq"], "first_seq", "n_in_group", "n_values"))


def eval_violations(evals: DataFrame) -> DataFrame:
    """C-4: one row per broken rule per result (never raised, always reported)."""
    rules = [
        ("source_name_without_url", F.col("source_name").isNotNull() & F.col("source_url").isNull()),
        ("missing_model_name", F.col("model_name").isNull()),
        ("missing_required_field", F.col("task_type").isNull() | F.col("dataset_type").isNull()
         | F.col("dataset_name").isNull() | F.col("metric_type").isNull()),
        ("missing_metric_value", F.col("metric_value").isNull()),
    ]
    arr = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull())
    return evals.select("seq", F.explode(arr).alias("rule"))


# ---------------------------------------------------------------------------
# Card text
# ---------------------------------------------------------------------------

def split_front_matter(cards: DataFrame, text_col: str = "text") -> DataFrame:
    """N-8: ``header`` (the YAML block, '' when absent), ``body`` (text after
    the block, the whole text when absent), ``has_header``."""
    t = F.col(text_col)
    whole = F.regexp_extract(t, YAML_BLOCK, 0)           # the whole match
    found = F.length(whole) > 0
    return cards.withColumn("has_header", found) \
        .withColumn("header", F.when(found, F.regexp_extract(t, YAML_BLOCK, 2)).otherwise(F.lit(""))) \
        .withColumn("body", F.when(found, F.substr(t, F.length(whole) + 1)).otherwise(t))


HEADER_KEY = r"^([^:\s#-][^:]*):\s*(.*?)\s*$"
HEADER_ITEM = r"^\s*-\s+(.*?)\s*$"


def header_entries(cards: DataFrame, id_col: str = "card_id") -> DataFrame:
    """``key: value`` lines of the header, one row each, with position, and
    ``items``: the values of the ``- item`` lines below the key (a block list;
    empty where there is none)."""
    made = cards.select(id_col, F.split(F.col("header"), r"\r\n|\r|\n").alias("_lines"))
    made = made.withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1),
                                           lambda i: F.get("_lines", i).rlike(HEADER_KEY)))

    def entry(i, k):
        until = F.coalesce(F.get("_at", k + 1), F.size("_lines"))
        below = F.filter(F.slice("_lines", i + 2, until - i - 1), lambda x: x.rlike(HEADER_ITEM))
        line = F.get("_lines", i)
        return F.struct(i.cast("long").alias("pos"), F.regexp_extract(line, HEADER_KEY, 1).alias("key"),
                        F.regexp_extract(line, HEADER_KEY, 2).alias("value"),
                        F.transform(below, lambda x: F.regexp_extract(x, HEADER_ITEM, 1)).alias("items"))

    return made.select(id_col, F.explode_outer(F.transform("_at", entry)).alias("e")).where("e IS NOT NULL").select(id_col, "e.*")


def reassemble(cards: DataFrame, entries: DataFrame, id_col: str = "card_id") -> DataFrame:
    """N-19: header entries (in original order) + body -> card text, written
    with the card's own line break (``\\n`` when it has none); list values as
    ``- item`` lines below their key."""
    lb = F.coalesce(line_ending(F.col("text")), F.lit("\n"))

    def lines(x):
        head = F.when(x["value"] == "", F.concat(x["key"], F.lit(":"))).otherwise(F.concat(x["key"], F.lit(": "), x["value"]))
        return F.array_join(F.concat(F.array(head), F.transform(x["items"], lambda i: F.concat(F.lit("- "), i))), "\u0001")

    hdr = (entries.groupBy(id_col)
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", "value", "items"))), lines).alias("_lines")))
    j = cards.join(hdr, id_col, "left")
    head = F.array_join(F.coalesce("_lines", F.array().cast("array<string>")), "\u0001")
    return j.select(id_col, F.concat(F.lit("---"), lb, F.replace(head, F.lit("\u0001"), lb), lb,
                                      F.lit("---"), lb, F.col("body")).alias("content"))


def render_dataset_cards(meta: DataFrame) -> DataFrame:
    """N-12: card text from fields, one row per card.

    ``meta`` columns: ``card_id, pretty_name, language (array), license,
    size_categories, curated_by, repository``.  Header keys with no value
    are left out; body fields with no value get the placeholder."""
    ph = F.lit(S.MORE_INFO_NEEDED)

    def val(c):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), ph)

    lang_text = F.array_join("language", ", ")
    header_lines = F.filter(F.array(
        F.when(F.size("language") > 0, F.concat(F.lit("language: ["), lang_text, F.lit("]"))),
        F.when(F.col("license").isNotNull(), F.concat(F.lit("license: "), "license")),
        F.when(F.col("size_categories").isNotNull(), F.concat(F.lit("size_categories: "), "size_categories")),
        F.when(F.col("pretty_name").isNotNull(), F.concat(F.lit("pretty_name: "), "pretty_name")),
    ), lambda x: x.isNotNull())
    bullets = {
        "Curated by": val("curated_by"), "Funded by [optional]": ph, "Shared by [optional]": ph,
        "Language(s) (NLP)": F.coalesce(F.nullif(lang_text, F.lit("")), ph), "License": val("license"),
        "Repository": val("repository"), "Paper [optional]": ph, "Demo [optional]": ph,
    }
    parts: list[Column] = [F.lit("---"), F.array_join(header_lines, "\n"), F.lit("---"), F.lit(""),
                           F.concat(F.lit("# Dataset Card for "), F.coalesce("pretty_name", F.lit("Dataset Name"))),
                           F.lit("")]
    for heading, labels in DATASET_CARD_SECTIONS:
        parts += [F.lit(heading), F.lit("")]
        if labels:
            parts += [F.concat(F.lit(f"- **{lab}:** "), bullets[lab]) for lab in labels] + [F.lit("")]
        elif heading not in HEADING_ONLY:
            parts += [ph, F.lit("")]
    return meta.select("card_id", F.concat_ws("\n", *parts).alias("text"))


def dataset_card_meta(artifacts: DataFrame, nodes: DataFrame, langs: DataFrame) -> DataFrame:
    """Card fields per dataset (resource node): languages seen, size bucket."""
    per = (artifacts.join(nodes.select(F.col("id").alias("node_id"), "node_name"), "node_id")
           .groupBy("node_name").agg(F.count(F.lit(1)).alias("n_files")))
    lang = langs.groupBy("node_name").agg(F.array_sort(F.collect_set("lang")).alias("language"))
    size = (F.when(F.col("n_files") < 1000, "n<1K").when(F.col("n_files") < 10_000, "1K<n<10K")
            .when(F.col("n_files") < 100_000, "10K<n<100K").when(F.col("n_files") < 1_000_000, "100K<n<1M")
            .when(F.col("n_files") < 10**7, "1M<n<10M").when(F.col("n_files") < 10**8, "10M<n<100M")
            .when(F.col("n_files") < 10**9, "100M<n<1B").when(F.col("n_files") < 10**10, "1B<n<10B")
            .when(F.col("n_files") < 10**11, "10B<n<100B").when(F.col("n_files") < 10**12, "100B<n<1T")
            .otherwise("n>1T"))
    return per.join(lang, "node_name", "left").select(
        F.col("node_name").alias("card_id"), F.col("node_name").alias("pretty_name"),
        F.coalesce("language", F.array().cast("array<string>")).alias("language"),
        F.lit(None).cast("string").alias("license"), size.alias("size_categories"),
        F.lit(None).cast("string").alias("curated_by"), F.lit(None).cast("string").alias("repository"))


# ---------------------------------------------------------------------------
# Dataset cards (JSON-LD)
# ---------------------------------------------------------------------------

def dataset_card_summary(artifacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """A-9 flattened: per dataset the file count, bytes, and a digest of the
    distribution (``name|sha256`` lines)."""
    from .fingerprint import tree_digest
    a = artifacts.join(nodes.select(F.col("id").alias("node_id"), "node_name"), "node_id")
    d = tree_digest(a.select("node_name", F.concat_ws("|", "location", "hash").alias("line")), ["node_name"])
    per = a.groupBy("node_name").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"))
    return per.join(d, "node_name").select("node_name", "n_files", "total_bytes",
                                           F.col("digest").alias("distribution_digest"))


def dataset_cards(artifacts: DataFrame, nodes: DataFrame, published, description: Column | None = None,
                  part_files: int = PART_FILES) -> DataFrame:
    """A-9 / C-5: the JSON-LD card of each dataset (resource node), in numbered
    parts of some ``part_files`` files each, so that no row has to hold an
    unbounded list.

    Every file is listed as a ``FileObject`` (name, contentUrl,
    encodingFormat, sha256) in exactly one part, by a hash of its name; a card
    of up to ``part_files`` files is part 0 alone.  The record set is "one
    record per file: filename, content"."""
    a = artifacts.join(nodes.select(F.col("id").alias("node_id"), "node_name"), "node_id")
    sized = a.groupBy("node_name").agg(F.count(F.lit(1)).alias("n_files"))
    parts = F.ceil(F.col("n_files") / F.lit(part_files))
    fobj = F.struct(F.lit("cr:FileObject").alias("type"), F.col("location").alias("name"),
                    F.col("location").alias("contentUrl"), F.col("content_type").alias("encodingFormat"),
                    F.col("hash").alias("sha256"), F.lit(None).cast("string").alias("includes"))
    dist = (a.join(sized, "node_name").groupBy("node_name", F.pmod(F.xxhash64("location"), parts).cast("int").alias("part"))
            .agg(F.array_sort(F.collect_list(fobj), lambda l, r: F.when(l["name"] < r["name"], -1)
                              .when(l["name"] > r["name"], 1).otherwise(0)).alias("distribution")))
    record_set = F.array(F.struct(
        F.lit("cr:RecordSet").alias("type"), F.lit("files").alias("name"),
        F.array(F.struct(F.lit("filename").alias("name"), F.lit("sc:Text").alias("dataType")),
                F.struct(F.lit("content").alias("name"), F.lit("sc:Text").alias("dataType"))).alias("field")))
    return dist.select(
        F.col("node_name").alias("name"), "part",
        (description if description is not None else F.concat(F.lit("Files of "), "node_name")).alias("description"),
        F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("url"),
        F.lit(CROISSANT_CONTEXT).alias("conformsTo"),
        date_stamp(F.lit(published).cast("timestamp_ntz")).alias("datePublished"),
        "distribution", record_set.alias("recordSet"))


def card_distribution(cards: DataFrame) -> DataFrame:
    """C-6: one row per distribution entry, FileObject and FileSet views."""
    d = cards.select(F.col("name").alias("dataset"), F.explode("distribution").alias("d"))
    kind = F.col("d.type")
    return d.select("dataset", kind.alias("type"), F.col("d.name").alias("name"),
                    F.col("d.encodingFormat").alias("encoding_format"),
                    F.when(kind == "cr:FileObject", F.col("d.contentUrl")).alias("content_url"),
                    F.when(kind == "cr:FileObject", F.col("d.sha256")).alias("sha256"),
                    F.when(kind == "cr:FileSet", F.col("d.includes")).alias("includes"))


def card_record_fields(cards: DataFrame) -> DataFrame:
    """C-7: record set x field; the parts of one card have the same ones."""
    r = cards.select(F.col("name").alias("dataset"), F.explode("recordSet").alias("r"))
    return r.select("dataset", F.col("r.name").alias("record_set"), F.explode("r.field").alias("f")) \
        .select("dataset", "record_set", F.col("f.name").alias("field"), F.col("f.dataType").alias("data_type")).distinct()


def unique_tags(cards: DataFrame, col: str = "tags") -> DataFrame:
    """U-4: ordered de-duplication (first occurrence wins)."""
    return cards.withColumn(col, F.array_distinct(col))


# ---------------------------------------------------------------------------
# JSON-LD text (K-18 writer side, S-7 reader side)
# ---------------------------------------------------------------------------

JSONLD_SCHEMA = (
    "`@type` string, name string, description string, license string, url string, conformsTo string, "
    "datePublished string, distribution array<struct<`@type`: string, name: string, contentUrl: string, "
    "encodingFormat: string, sha256: string, includes: string>>, recordSet array<struct<`@type`: string, "
    "name: string, field: array<struct<`@type`: string, name: string, dataType: string>>>>")


def card_to_jsonld(cards: DataFrame) -> DataFrame:
    """K-18: one JSON-LD document per card part (``name``, ``part``, ``json``);
    NULL fields are left out by ``to_json``."""
    dist = F.transform("distribution", lambda d: F.struct(
        d["type"].alias("@type"), d["name"].alias("name"), d["contentUrl"].alias("contentUrl"),
        d["encodingFormat"].alias("encodingFormat"), d["sha256"].alias("sha256"), d["includes"].alias("includes")))
    recs = F.transform("recordSet", lambda r: F.struct(
        r["type"].alias("@type"), r["name"].alias("name"),
        F.transform(r["field"], lambda f: F.struct(F.lit("cr:Field").alias("@type"), f["name"].alias("name"),
                                                   f["dataType"].alias("dataType"))).alias("field")))
    doc = F.struct(F.lit("sc:Dataset").alias("@type"), "name", "description", "license", "url", "conformsTo",
                   "datePublished", dist.alias("distribution"), recs.alias("recordSet"))
    return cards.select("name", "part", F.to_json(doc).alias("json"))


def write_cards(cards: DataFrame, root: str, ext: str = ".md", overwrite: bool = True) -> int:
    """K-18: one file per card, ``<card_id><ext>`` with the card text (for
    JSON-LD pass ``card_to_jsonld`` output renamed to ``card_id, text``)."""
    from ..sources.files import write_text_files
    return write_text_files(cards.select(F.concat("card_id", F.lit(ext)).alias("rel"), "text"), root, overwrite)


def card_from_jsonld(docs: DataFrame) -> DataFrame:
    """S-7 read side: JSON-LD columns back to the in-memory card shape."""
    dist = F.transform("distribution", lambda d: F.struct(
        d["@type"].alias("type"), d["name"].alias("name"), d["contentUrl"].alias("contentUrl"),
        d["encodingFormat"].alias("encodingFormat"), d["sha256"].alias("sha256"), d["includes"].alias("includes")))
    recs = F.transform("recordSet", lambda r: F.struct(
        r["@type"].alias("type"), r["name"].alias("name"),
        F.transform(r["field"], lambda f: F.struct(f["name"].alias("name"), f["dataType"].alias("dataType")))
        .alias("field")))
    return docs.select("name", "description", "license", "url", "conformsTo", "datePublished",
                       dist.alias("distribution"), recs.alias("recordSet"))


# C-5 -----------------------------------------------------------------------


def dataset_card_metadata(meta: DataFrame) -> DataFrame:
    """C-5: the card's metadata block as JSON, one row per card: the known
    dataset-card fields present in ``meta`` (others are kept too), NULLs
    dropped, and keys renamed for output (``train_eval_index`` ->
    ``train-eval-index``)."""
    cols = [c for c in meta.columns if c != "card_id"]
    fields = [F.col(c).alias(DATASET_KEY_RENAMES.get(c, c)) for c in cols]
    return meta.select("card_id", F.to_json(F.struct(*fields)).alias("metadata"))


# J-3 -----------------------------------------------------------------------
def model_registry_view(models: DataFrame, links: DataFrame) -> DataFrame:
    """Models with their card when one is linked (left join on the
    ``model_card_path`` link tag of the same node and location); models
    without a card are kept."""
    card = links.where(F.col("tag_name") == "model_card_path").select(
        "node_name", "location", F.col("tag_value").alias("card_location"))
    return models.join(card, ["node_name", "location"], "left")
