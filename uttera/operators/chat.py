"""Chat records: prompts, targets, subtasks and rewriting of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions.text import gold, json_target, n_tokens, text_or_empty, with_marker

AUDIO = "<audio>"


def label_prompt(template: str, labels: DataFrame) -> DataFrame:
    """(prompt, n_labels): ``template`` with {n} and {labels} filled from a bounded, sorted inventory (label)."""
    g = labels.agg(F.array_sort(F.collect_set("label")).alias("l"))
    p = F.replace(F.replace(F.lit(template), F.lit("{n}"), F.size("l").cast("string")), F.lit("{labels}"), F.concat_ws(", ", "l"))
    return g.select(p.alias("prompt"), F.size("l").alias("n_labels"))


def user_content(prompt: Column, family: Column, subtask: Column) -> Column:
    """The user's turn: the sound before the prompt for one family, after it for the other; alone for slot filling of the first."""
    first = family == "qwen"
    return F.when(first & (subtask == "slot_filling"), F.lit(AUDIO)).when(first, F.concat(F.lit(AUDIO), prompt)).otherwise(F.concat(prompt, F.lit(AUDIO)))


def records(rows: DataFrame, prompts: DataFrame, families: tuple[str, ...] = ("qwen", "gemma"), split: str = "train", training: bool = True) -> DataFrame:
    """(messages, audios, meta) of manifest rows (ID, wav, tun_slu_annotation, intent) for each family and subtask of ``prompts`` (subtask, prompt).

    For training, rows without gold of the subtask are left out and the answer
    is the last turn.  Each row is read once and exploded by the prompts, of
    which there may be 100.
    """
    given = [(r.subtask, r.prompt) for r in prompts.select("subtask", "prompt").limit(101).collect()]
    if len(given) > 100:
        raise ValueError("prompts: more than 100")
    kinds = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("subtask"), F.lit(p).alias("prompt")) for f in families for s, p in given])
    r = rows.select("*", F.inline(kinds))
    target = F.when(F.col("subtask") == "intent", json_target(gold(F.col("intent")))).otherwise(gold(F.col("tun_slu_annotation")))
    r = r.withColumn("_t", target)
    if training:
        r = r.where("_t is not null")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = [turn("user", user_content(F.col("prompt"), F.col("family"), F.col("subtask")))]
    if training:
        turns.append(turn("assistant", F.col("_t")))
    meta = F.struct(
        F.col("ID").alias("id"), "subtask", "family", F.lit(split).alias("split"),
        F.when(F.col("subtask") == "intent", text_or_empty(F.col("intent"))).alias("intent"),
        F.when(F.col("subtask") != "intent", text_or_empty(F.col("tun_slu_annotation"))).alias("ref"),
    )
    return r.select(F.array(*turns).alias("messages"), F.array("wav").alias("audios"), meta.alias("meta"))


def joint_targets(rows: DataFrame) -> DataFrame:
    """(ID, subtask, target): each utterance once for either subtask, marked; those without gold left out."""
    pair = F.array(
        F.struct(F.lit("intent").alias("subtask"), with_marker(json_target(gold(F.col("intent"))), "INTENT").alias("target")),
        F.struct(F.lit("slot_filling").alias("subtask"), with_marker(gold(F.col("tun_slu_annotation")), "SLOT").alias("target")),
    )
    return rows.select("ID", F.inline(pair)).where("target is not null")


def within(df: DataFrame, col: str, most: int = 225, length: Callable[[Column], Column] = n_tokens) -> DataFrame:
    """Rows whose target has at most ``most`` tokens, as ``length`` counts them: words, or a tokenizer's tokens."""
    return df.where(length(F.col(col)) <= most)


def without_field(chats: DataFrame, *fields: str, col: str = "meta") -> DataFrame:
    """``chats`` without the given fields of a struct; those it doesn't have are ignored."""
    there = [f for f in fields if f in chats.schema[col].dataType.names]
    return chats.withColumn(col, F.col(col).dropFields(*there)) if there else chats


def with_defaults(chats: DataFrame, values: dict[str, str], col: str = "meta") -> DataFrame:
    """``chats`` with fields of a struct filled where they are null or absent."""
    have, out = chats.schema[col].dataType.names, F.col(col)
    for k, v in values.items():
        out = out.withField(k, F.coalesce(F.col(f"{col}.{k}"), F.lit(v)) if k in have else F.lit(v))
    return chats.withColumn(col, out)


def reprompted(chats: DataFrame, prompt: str, suffix: str = "_open") -> DataFrame:
    """``chats`` with the user's and system's prompt exchanged; the sound keeps its place, the split's name gets a suffix."""
    after = lambda c: F.endswith(c, F.lit(AUDIO))
    new = lambda m: F.when(m.role == "system", F.lit(prompt)).when(m.role == "user", F.when(m.content == AUDIO, m.content).when(after(m.content), F.concat(F.lit(prompt), F.lit(AUDIO))).otherwise(F.concat(F.lit(AUDIO), F.lit(prompt)))).otherwise(m.content)
    msgs = F.transform("messages", lambda m: F.struct(m.role.alias("role"), new(m).alias("content")))
    return chats.withColumn("messages", msgs).withColumn("meta", F.col("meta").withField("split", F.concat(F.col("meta.split"), F.lit(suffix))))


def classifications(results: DataFrame, pred_col: str = "pred") -> DataFrame:
    """(id, hyp, ref) of parsed results: an unparsed response stands for itself."""
    return results.select("id", F.coalesce(pred_col, text_or_empty(F.col("response"))).alias("hyp"), gold(F.col("gold")).alias("ref"))
