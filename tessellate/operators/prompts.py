"""Sample filters and prompt preparation (PRJ-01 .. PRJ-08, PRJ-11 .. PRJ-18).

Every filter is a predicate on light columns only, so Catalyst pushes it
below the heavy media columns (and into the Parquet scan when it is a plain
comparison); prompt building is a projection of built-in string and array
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import scheme
from ..functions import text as TX

# FIXED VALUES: modality keywords and inline tags, the format-prompt
# template, the audio system prompt, and the judge prompt template.
MODALITY_KEYWORDS = {"images": "image", "videos": "video", "audio": "audio"}
MODALITY_TAGS = {"images": "<image>", "videos": "<video>", "audio": "<audio>"}
MEDIA_COLUMNS = {"images": "images", "videos": "videos", "audio": "audios"}
FORMAT_PROMPT = ("{{ content }}You FIRST think about the reasoning process as an internal monologue and then "
                 "provide the final answer. The reasoning process MUST BE enclosed within <think> </think> tags. "
                 "The final answer MUST BE put in \\boxed{}.")
AUDIO_SYSTEM_PROMPT = ("You are Qwen, a virtual human developed by the Qwen Team, Alibaba Group, "
                       "capable of perceiving auditory and visual inputs, as well as generating text and speech.")
JUDGE_TEMPLATE = (
    '\nQuestion:\n"%s"\nCandidate Answer:\n"%s"\nReference Answer:\n"%s"\n\n'
    "Please evaluate the candidate answer based on the dataset-specific instructions.\n\n"
    "Respond with exactly this format - a JSON object with two fields:\n"
    '- "correct": true or false (boolean)\n'
    '- "explanation": a very short, few phrases explanation of your decision (string)\n'
    "Only respond with the JSON object, no other text or comments.\n")

LIST_COLUMNS = ["images", "videos", "audios", "texts", "ext_video_feats", "ext_audio_feats"]


def filter_task(df: DataFrame, suffix: str) -> DataFrame:
    """PRJ-01: the text after the last '_' of ``task`` equals ``suffix``."""
    return df.filter(F.col("task").isNotNull() & (F.substring_index("task", "_", -1) == suffix))


def modality_predicate(modalities: list[str], sig: str = "modality_signature") -> Column:
    """PRJ-02 predicate: the lower-cased signature contains any active
    keyword; null signature never matches; no keyword keeps everything."""
    kws = [MODALITY_KEYWORDS[m] for m in modalities if m in MODALITY_KEYWORDS]
    if not kws:
        return F.lit(True)
    low = F.lower(F.coalesce(F.col(sig), F.lit("")))
    cond = F.lit(False)
    for k in kws:
        cond = cond | low.contains(k)
    return cond


def filter_modality(df: DataFrame, modalities: list[str], counts: Observation | None = None) -> DataFrame:
    """PRJ-02.  ``counts`` fills, in the pass that reads the result, with the rows
    ``kept``, ``dropped`` and ``null_signature`` (those dropped for lack of one)."""
    keep = modality_predicate(modalities)
    if counts is not None:
        df = df.observe(counts, F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"),
                        F.count_if(~keep & F.col("modality_signature").isNull()).alias("null_signature"))
    return df.filter(keep)


def filter_max_length(df: DataFrame, max_len: int, length: Column | str) -> DataFrame:
    """PRJ-03: keep rows whose prompt length is <= max_len."""
    length = F.col(length) if isinstance(length, str) else length
    return df.filter(length <= max_len)


def require_signature(df: DataFrame, strict: bool = True, counts: Observation | None = None) -> DataFrame:
    """PRJ-04: strict raises on a null/blank signature when rows are read;
    batching mode marks null signatures as rejected (blank stays a group).
    Adds ``signature_status``.  ``counts`` fills with ``rows`` and ``rejected``."""
    sig = F.col("modality_signature")
    if counts is not None:
        df = df.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(sig.isNull()).alias("rejected"))
    if strict:
        bad = sig.isNull() | (TX.py_strip(sig) == "")
        return df.withColumn("signature_status", F.when(bad, F.raise_error(
            F.lit("Missing modality_signature"))).otherwise(F.lit("ok")))
    return df.withColumn("signature_status", F.when(sig.isNull(), "rejected").otherwise("ok"))


def ground_truth(df: DataFrame) -> DataFrame:
    """PRJ-05: ``answer or ground_truth`` (Python ``or``: '' falls through);
    both missing -> status 'missing'."""
    gt = F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.col("ground_truth"))
    return df.withColumn("reward_ground_truth", gt) \
             .withColumn("gt_status", F.when(gt.isNull(), "missing").otherwise("ok"))


def null_to_empty(df: DataFrame, cols: list[str] = LIST_COLUMNS) -> DataFrame:
    """PRJ-06: null list columns become empty lists."""
    out = df
    for c in cols:
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)))
    return out


def first_feature_path(col: str, base_dir: str) -> Column:
    """PRJ-07: first list element joined to the base directory, else null."""
    first = F.get(F.col(col), 0)
    return F.when(first.isNotNull(),
                  F.when(first.startswith("/"), first).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), first)))


def first_existing_path(df: DataFrame, col: str, base_dir: str, existing: DataFrame, out: str, key: str = "sample_id") -> DataFrame:
    """PRJ-07, the variant that tests for existence: the first list element (in
    list order, joined to the base directory) that is in ``existing`` (one
    column ``path``, a listing of the store), else null.  The listing is joined,
    no file is opened; ``key`` identifies rows."""
    items = df.select(key, F.posexplode(col).alias("_pos", "_item")).filter(F.col("_item").isNotNull())
    full = F.when(F.col("_item").startswith("/"), F.col("_item")).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), F.col("_item")))
    hit = items.withColumn("path", full).join(existing.select("path").distinct(), "path")
    return df.join(hit.groupBy(key).agg(F.min_by("path", "_pos").alias(out)), key, "left")


def task_suffix(task: Column) -> Column:
    """The task type of a dataset's first row: text after the last '_', or
    'cls' when there is no '_'."""
    return F.when(task.contains("_"), F.substring_index(task, "_", -1)).otherwise(F.lit("cls"))


def dataset_inventory(df: DataFrame, split: str = "split", order: str = "sample_id") -> DataFrame:
    """PRJ-08: per dataset train/validation counts, any non-empty video /
    audio feature list, task type of the first row; datasets with zero train
    or zero validation rows are skipped."""
    nonempty = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    g = df.groupBy("dataset").agg(
        F.count_if(F.col(split) == "train").alias("n_train"),
        F.count_if(F.col(split) == "validation").alias("n_val"),
        F.bool_or(nonempty("ext_video_feats")).alias("has_video_feats"),
        F.bool_or(nonempty("ext_audio_feats")).alias("has_audio_feats"),
        F.min_by(F.coalesce(F.col("task"), F.lit("")), F.col(order)).alias("_task"))
    g = g.withColumn("task_type", task_suffix(F.col("_task"))).drop("_task")
    return g.filter((F.col("n_train") > 0) & (F.col("n_val") > 0))


def route_row(df: DataFrame, qa: DataFrame | None = None) -> DataFrame:
    """PRJ-11: QA when lower(task) ends with '_qa' or the dataset is a QA
    dataset (then lm_label = lower(answer), label 0); else classification."""
    names = qa if qa is not None else df.sparkSession.createDataFrame(
        [(d,) for d in scheme.QA_DATASETS], "dataset string")
    flag = names.select(F.lower("dataset").alias("_ds")).distinct().withColumn("_isqa", F.lit(True))
    j = df.join(flag, F.lower(df["dataset"]) == flag["_ds"], "left").drop("_ds")
    is_qa = F.lower(F.coalesce(F.col("task"), F.lit(""))).endswith("_qa") | F.coalesce(F.col("_isqa"), F.lit(False))
    return (j.withColumn("route", F.when(is_qa, "qa").otherwise("cls"))
             .withColumn("lm_label", F.when(is_qa, F.lower(F.coalesce(F.col("answer"), F.lit("")))).otherwise(F.lit("")))
             .drop("_isqa"))


def strip_inactive_tags(text: Column, modalities: list[str]) -> Column:
    """PRJ-12: remove the literal tag of each disabled modality."""
    out = text
    for mod, tag in MODALITY_TAGS.items():
        if mod not in modalities:
            out = F.replace(out, F.lit(tag), F.lit(""))
    return out


def count_tag(text: Column, tag: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit("")))) / len(tag)).cast("int")


def prepend_missing_tags(text: Column, n_images: Column, n_videos: Column, n_audios: Column) -> Column:
    """PRJ-13: for image, then video, then audio, prepend the missing tag
    copies, so the final order is audio, video, image, text."""
    out = text
    for tag, n in (("<image>", n_images), ("<video>", n_videos), ("<audio>", n_audios)):
        miss = F.greatest(F.coalesce(n, F.lit(0)) - count_tag(out, tag), F.lit(0))
        out = F.concat(F.repeat(F.lit(tag), miss), out)
    return out


def segment_prompt(text: Column, modalities: list[str]) -> Column:
    """PRJ-14: split on the active tags, keep the tags, drop empty pieces ->
    array<struct<type, text>>; tags become {type: image|video|audio}.
    ``split`` cannot keep delimiters, so tags are first wrapped in U+0001."""
    tags = [MODALITY_TAGS[m] for m in ("images", "videos", "audio") if m in modalities]
    marked = text
    for t in tags:
        marked = F.replace(marked, F.lit(t), F.lit("\u0001" + t + "\u0001"))
    parts = F.filter(F.split(marked, "\u0001"), lambda s: s != "")
    kind = {"<image>": "image", "<video>": "video", "<audio>": "audio"}

    def seg(s):
        typ = F.lit("text")
        for t in tags:
            typ = F.when(s == t, F.lit(kind[t])).otherwise(typ)
        return F.struct(typ.alias("type"), F.when(typ == "text", s).alias("text"))
    return F.transform(parts, seg)


def render_prompt(text: Column, template: str = FORMAT_PROMPT) -> Column:
    """PRJ-15: substitute the only placeholder ``{{ content }}``."""
    pre, _, post = template.partition("{{ content }}")
    return F.concat(F.lit(pre), text, F.lit(post))


def build_chat(df: DataFrame, modalities: list[str], form: str = "path",
               template: str | None = None) -> DataFrame:
    """PRJ-16: messages array<struct<role, content array<struct<type,text>>>>.

    The user message holds the segmented prompt when the row has media of an
    active modality, else one text piece.  A system message goes first: in
    path form whenever audio is an active modality, in binary form only when
    this row has audio.
    """
    text = strip_inactive_tags(F.coalesce(F.col("problem"), F.lit("")), modalities)
    if template:
        text = render_prompt(text, template)
    has = {m: ((F.lit(m in modalities)) & F.coalesce(F.size(MEDIA_COLUMNS[m]) > 0, F.lit(False)))
           for m in MEDIA_COLUMNS}
    any_media = has["images"] | has["videos"] | has["audio"]
    single = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    user = F.struct(F.lit("user").alias("role"),
                    F.when(any_media, segment_prompt(text, modalities)).otherwise(single).alias("content"))
    system = F.struct(F.lit("system").alias("role"),
                      F.array(F.struct(F.lit("text").alias("type"), F.lit(AUDIO_SYSTEM_PROMPT).alias("text")))
                      .alias("content"))
    with_sys = has["audio"] if form == "binary" else F.lit("audio" in modalities)
    msgs = F.when(with_sys, F.array(system, user)).otherwise(F.array(user))
    return df.withColumn("messages", msgs)


def render_judge_prompt(df: DataFrame, instructions: DataFrame, template: str = JUDGE_TEMPLATE) -> DataFrame:
    """PRJ-17: per-dataset grading instruction plus the question / candidate /
    reference text.  Of several instructions for a dataset the smallest in text
    order is taken, so no row is doubled."""
    one = instructions.groupBy("dataset").agg(F.min("instruction").alias("instruction"))
    j = df.join(one, "dataset", "left")
    return j.withColumn("judge_prompt", F.format_string(template, F.col("question"), F.col("pred"), F.col("gold")))


def decode_text(c: Column, strict: bool = False) -> Column:
    """PRJ-18: bytes -> UTF-8 text."""
    return TX.decode_text(c, strict)
