"""The registered queries of the general operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from uttera.functions import annotation, edits, responses, text
from uttera.operators import acoustic, adapters, batches, chat, checkpoints, inventory, mixing, neardup, panel, records, reference_pool, scoring, seeds, submission, validate
from uttera.plans import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Sums of floats depend on their order in the last digits; rounded, they are the same on any cluster."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def slot_labels(spark: SparkSession, d: str) -> Column:
    """The slot inventory, a fixed list, as an array of literals."""
    return F.array(*[F.lit(r[0]) for r in table(spark, d, "slot_inventory").select("label").where("label is not null").distinct().orderBy("label").collect()])


def intent_list(spark: SparkSession, d: str) -> list[str]:
    """The intent inventory, a fixed list."""
    return [r[0] for r in table(spark, d, "intent_targets").select("intent").where("intent is not null").distinct().orderBy("intent").collect()]


def train(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """(id, *cols) of train, one row an id; only these columns are read."""
    return _by_id(table(spark, d, "train"), *cols)


def train_dev(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """(dev, id, *cols) of train (dev 0) and of the validation split (dev 1), one row an id of either."""
    dev = _by_id(table(spark, d, "heldout").where("split = 'validation'"), *cols)
    return train(spark, d, *cols).withColumn("dev", F.lit(0)).unionByName(dev.withColumn("dev", F.lit(1)))


def _by_id(t: DataFrame, *cols: str) -> DataFrame:
    t = t.select("id", *cols)
    return t.groupBy("id").agg(F.min(F.struct(*cols)).alias("r")).select("id", "r.*")


def checked(spark: SparkSession, d: str) -> DataFrame:
    return validate.cascade(table(spark, d, "gen_kept"), slot_labels(spark, d), table(spark, d, "intent_targets"))


def gold_texts(spark: SparkSession, d: str) -> DataFrame:
    """(intent, text) of train and of the validation split."""
    t = table(spark, d, "train").select("intent", F.col("tun_transcription").alias("text"))
    return t.unionByName(table(spark, d, "heldout").where("split = 'validation'").select("intent", F.col("tun_transcription").alias("text")))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Renditions as model results: the intent written in synth as a JSON response, the item's own intent as gold."""
    base = F.regexp_replace("id", "_ft$", "")
    s = table(spark, d, "synth").groupBy("id").agg(F.min("intent").alias("said")).select("id", base.alias("item"), "said")
    g = table(spark, d, "gen_kept").groupBy("id").agg(F.min("intent").alias("gold")).select(F.col("id").alias("item"), "gold")
    r = s.join(g, "item").withColumn("response", text.json_target(F.col("said")))
    return r.select("id", "gold", "response")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """(id, seq, gold, hyp): each training text against the one before it."""
    t = train(spark, d, "tun_transcription").where("tun_transcription is not null").select("id", F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("seq"), F.col("tun_transcription").alias("gold"))
    return t.join(t.select((F.col("seq") + 1).alias("seq"), F.col("gold").alias("hyp")), "seq").select("id", "seq", "gold", "hyp")


# -- inventories and seed pools ------------------------------------------------


@query
def label_inventory(s, d):
    both = table(s, d, "train").select("tun_slu_annotation").unionByName(table(s, d, "heldout").select("tun_slu_annotation"))
    return inventory.label_inventory(both, "tun_slu_annotation")


@query
def intent_inventory(s, d):
    return inventory.value_inventory(table(s, d, "train"), "intent")


@query
def intent_counts(s, d):
    return inventory.counts_over(table(s, d, "intent_targets").select(F.col("intent").alias("label")), train(s, d, "intent"), "intent")


@query
def intent_shares(s, d):
    return inventory.histogram(table(s, d, "synth"), "intent")


@query
def slot_values(s, d):
    both = table(s, d, "train").select("tun_slu_annotation").unionByName(table(s, d, "heldout").where("split = 'validation'").select("tun_slu_annotation"))
    return seeds.value_bank(both, "tun_slu_annotation")


@query
def slot_combinations(s, d):
    seq = F.struct("dev", F.regexp_extract("id", r"(\d+)$", 1).cast("long"))  # train comes before validation
    t = train_dev(s, d, "intent", "tun_slu_annotation").where("intent is not null").withColumn("seq", seq)
    return seeds.label_combinations(t, "intent", "tun_slu_annotation", "seq")


@query
def seed_pool(s, d):
    """All seeds of each intent, in order."""
    t = train(s, d, "intent", "tun_transcription").where("intent is not null and tun_transcription is not null")
    return seeds.seeds(t, "intent", "id", []).select("intent", "position", "id")


@query
def intent_quotas(s, d):
    return seeds.quotas(intent_counts(s, d))


def _plan(s, d):
    t = train_dev(s, d, "intent", "tun_slu_annotation").where("intent is not null")
    bare = F.max(F.size(annotation.slots(F.coalesce("tun_slu_annotation", F.lit("")))) == 0).alias("bare")
    have = t.groupBy(F.col("intent").alias("label")).agg(bare, F.max(F.col("dev") == 0).alias("seeded"))
    q = intent_quotas(s, d).join(have, "label", "left")
    return batches.batch_plan(q.select(F.col("label").alias("intent"), "quota", F.coalesce("seeded", F.lit(False)).alias("has_seeds"), F.coalesce("bare", F.lit(True)).alias("plain")))


@query
def batch_plan(s, d):
    return _plan(s, d)


@query
def batch_plan_resumed(s, d):
    return batches.resume(_plan(s, d), table(s, d, "gen_kept").select(F.col("meta.batch").alias("id")), "batch_id")


@query
def batch_shots(s, d):
    pool = train(s, d, "intent").where("intent is not null").select("intent", "id")
    return batches.shots(_plan(s, d), pool)


def picks_of(s, d):
    pool = slot_combinations(s, d).select("intent", (F.col("rank") - 1).alias("pos"), F.array_join("combo", ",").alias("item"))
    return batches.picks(_plan(s, d).where("mode = 'coverage'"), pool)


@query
def batch_combinations(s, d):
    """A label list for each place of the coverage batches, drawn with replacement from the intent's most frequent ones."""
    return picks_of(s, d)


@query
def batch_sources(s, d):
    return batches.sources(_plan(s, d), train(s, d, "intent").where("intent is not null").select("intent", "id"))


HEAD = "Write utterances in the style of the examples."
TASKS = {"coverage": "{n} new ones of {intent}, with these labels:", "paraphrase": "{n} paraphrases for {intent} of:", "distractor": "{n} new ones of {intent} without slots."}


@query
def batch_prompts(s, d):
    """The whole prompt of each batch: head, anchor, drawn examples, task, label lists or the source of paraphrases."""
    t = train(s, d, "intent", "tun_slu_annotation").where("intent is not null")
    markup = t.select("id", F.coalesce("tun_slu_annotation", F.lit("")).alias("markup"))
    drawn = batch_shots(s, d).join(markup, "id").select("batch_id", "pos", F.col("markup").alias("example"))
    source = batches.sources(_plan(s, d), t.select("intent", "id")).join(markup, "id").select("batch_id", F.col("markup").alias("source"))
    combos = picks_of(s, d).select("batch_id", "place", "item")
    return batches.prompts(_plan(s, d), drawn, combos, source, HEAD, TASKS, ("x <time> y >",))


@query
def rarest_intents(s, d):
    return inventory.rarest(train(s, d, "intent").where("intent is not null"), "intent")


@query
def item_ids(s, d):
    """Ids built from the batch and the position of the items of a batch."""
    g = table(s, d, "gen_kept").where("meta.batch is not null").groupBy("id").agg(F.min("meta.batch").alias("batch"))
    pos = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    return g.select("id", text.item_id(F.col("batch"), pos).alias("built"))


# -- validation ------------------------------------------------------------------


@query
def markup_parsed(s, d):
    """Strict parse of every generated item's markup."""
    g = table(s, d, "gen_kept").select("seq", annotation.parse(F.col("annotated"), slot_labels(s, d)).alias("p"))
    return g.select("seq", F.col("p.reason").alias("reason"), F.size("p.slots").alias("n_slots"), F.to_json("p.slots").alias("slots"), F.col("p.text").alias("text"))


@query
def validated(s, d):
    return checked(s, d).select("id", "seq", "reject_reason")


@query
def reject_reasons(s, d):
    return validate.reasons(checked(s, d))


@query
def near_gold(s, d):
    items = checked(s, d).where("reject_reason is null").select("id", "intent", "text")
    return neardup.near_gold(items, gold_texts(s, d)).select("id", "near_gold")


@query
def near_duplicates_dropped(s, d):
    items = checked(s, d).where("reject_reason is null").select("id", "seq", "intent", "text")
    return neardup.greedy(items, gold_texts(s, d)).select("id", "accepted")


@query
def text_measures(s, d):
    t = F.col("text")
    g = table(s, d, "gen_kept").where("text is not null")
    return g.select("seq", text.n_tokens(t).alias("n_tokens"), text.n_arabic(t).alias("n_arabic"), text.n_letters(t).alias("n_letters"), text.script_ok(t).alias("script_ok"), F.size(text.trigrams(t)).alias("n_trigrams"))


@query
def text_score_form(s, d):
    return table(s, d, "heldout").where("tun_transcription is not null").select("id", text.score_form(F.col("tun_transcription")).alias("form")).distinct()


# -- judging -----------------------------------------------------------------------

#: A named panel; its first annotator may repair markup.
PANEL = ["judge_01", "judge_02", "judge_03", "judge_08", "judge_09"]


@query
def panel_majority(s, d):
    return panel.majority(table(s, d, "gen_judged"))


@query
def panel_repair(s, d):
    r = panel.repair(table(s, d, "gen_judged"), slot_labels(s, d), PANEL)
    return r.select("item_id", "votes", "of", "keep", "repaired", "annotated", "text")


@query
def panel_named(s, d):
    return panel.majority(table(s, d, "gen_judged"), PANEL)


@query
def panel_verdicts(s, d):
    m = panel.verdict_map(table(s, d, "gen_judged"))
    return m.select("item_id", F.size("per_annotator").alias("n"), F.array_join(F.array_sort(F.map_keys("per_annotator")), ",").alias("annotators"))


@query
def panel_verdicts_named(s, d):
    """Every annotator of the panel for every item, with null answers where a verdict is missing."""
    m = panel.verdict_map(table(s, d, "gen_judged"), PANEL)
    return m.select("item_id", F.explode("per_annotator").alias("annotator", "v")).select("item_id", "annotator", "v.derja", "v.natural", "v.intent_match", "v.slots_ok")


@query
def unjudged_items(s, d):
    done = table(s, d, "gen_judged").select(F.col("item_id").alias("id"))
    return batches.resume(table(s, d, "gen_kept").select("id").distinct(), done, "id")


# -- transcripts, reference pools, sound -------------------------------------------


@query
def transcript_scores(s, d):
    return reference_pool.scored(transcripts(s, d)).select("id", "wer")


@query
def transcript_character_scores(s, d):
    return reference_pool.scored(transcripts(s, d)).select("id", "cer")


@query
def reference_best(s, d):
    p = reference_pool.reference_pool(reference_pool.scored(transcripts(s, d)), top=150)
    return p.select("pos", "id", "wer")


@query
def reference_stats(s, d):
    return rounded(reference_pool.pool_stats(reference_pool.scored(transcripts(s, d))), "mean")


@query
def references_assigned(s, d):
    pool = batches.positions(table(s, d, "name_list").where("given_name is not null"), ["given_name", "script"]).select(F.col("position").alias("pos"), F.col("given_name").alias("ref_id"))
    items = table(s, d, "gen_kept").select("id").distinct()
    first, again = reference_pool.assign(items, pool), reference_pool.assign(items, pool, retry=True)
    return first.join(again.select("id", F.col("ref_id").alias("retry_ref_id")), "id").select("id", "pos", "ref_id", "retry_ref_id")


@query
def duration_filtered(s, d):
    t = table(s, d, "train").withColumn("d", F.col("duration").cast("string"))
    return rounded(t.where(records.duration_between(F.col("d"))).groupBy("intent").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds")), "seconds")


@query
def acoustic_measures(s, d):
    e = table(s, d, "embeddings").withColumn("text", F.lpad(F.lit(""), 20, "x"))
    return rounded(acoustic.measures(e, "embedding", 16, "text", frame=8, loud=0.12).select("vec_id", "dur", "rms", "clip", "activity", "sec_per_char"), "rms")


@query
def acoustic_gate(s, d):
    e = table(s, d, "embeddings").withColumn("text", F.lpad(F.lit(""), 20, "x"))
    m = acoustic.measures(e, "embedding", 16, "text", frame=8, loud=0.12)
    return m.select("vec_id", acoustic.gate(activity=0.5).alias("sound"))


@query
def rendition_rows(s, d):
    items = table(s, d, "gen_kept").groupBy("id").agg(F.min("intent").alias("intent"))
    files = table(s, d, "synth").where("wav is not null").select(F.col("wav").alias("path"))
    return mixing.renditions(items, files).select("ID", "wav", "intent")


@query
def ratio_capped(s, d):
    t = train(s, d, "intent")
    y = table(s, d, "synth").groupBy(F.col("id").alias("ID")).agg(F.min("intent").alias("intent"))
    return mixing.ratio_cap(t, y, ratio=2.0)


@query
def rare_intents(s, d):
    return mixing.rare_labels(train(s, d, "intent"), table(s, d, "synth"))


@query
def training_mix(s, d):
    t = train(s, d, "intent", "duration").select(F.col("id").alias("ID"), "intent", "duration")
    y = table(s, d, "synth").groupBy(F.col("id").alias("ID")).agg(F.min("intent").alias("intent"), F.min("duration").alias("duration"))
    m = mixing.mix({"real": t, "synthetic": y}, ["ID", "intent", "duration"])
    return rounded(m.groupBy("origin", "intent").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds")), "seconds")


# -- scoring -------------------------------------------------------------------------


@query
def intent_scores(s, d):
    p = responses.predicted_intent(predictions(s, d), "response", intent_list(s, d))
    return scoring.scores(p)


@query
def intent_confusion(s, d):
    p = responses.predicted_intent(predictions(s, d), "response", intent_list(s, d))
    return scoring.label_scores(p)


@query
def intent_scores_exact(s, d):
    """Scores where a name must equal a label but for case."""
    return rounded(scoring.scores(responses.predicted_intent(predictions(s, d), "response", intent_list(s, d), cutoff=None)), "accuracy", "macro_f1", "weighted_f1")


@query
def intent_confusion_exact(s, d):
    return scoring.label_scores(responses.predicted_intent(predictions(s, d), "response", intent_list(s, d), cutoff=None))


@query
def event_scores(s, d):
    """Each user's previous event as the prediction of the next, as four runs of users."""
    w = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(s, d, "events").select((F.col("user_id") % 4).alias("run"), F.col("event_type").alias("gold"), w.alias("pred"))
    return rounded(scoring.scores(e, by=("run",)), "accuracy", "macro_f1", "weighted_f1")


@query
def result_accounting(s, d):
    p = responses.predicted_intent(predictions(s, d), "response", intent_list(s, d))
    return scoring.accounting(p, "gold", "pred")


@query
def gold_filled(s, d):
    """Results without gold, filled from the manifest."""
    r = predictions(s, d).select("id", F.lit("  ").alias("gold"))
    m = table(s, d, "synth").select("id", "intent", F.col("rendered_at").alias("seq"))
    return scoring.with_manifest_gold(r, m).groupBy("gold").agg(F.count("*").alias("n"))


@query
def corpus_error_rates(s, d):
    """Renditions' markup against the items'."""
    y = table(s, d, "synth").groupBy("id").agg(F.min("tun_slu_annotation").alias("hyp")).withColumn("item", F.regexp_replace("id", "_ft$", ""))
    g = table(s, d, "gen_kept").groupBy(F.col("id").alias("item")).agg(F.min("annotated").alias("ref"))
    return scoring.corpus_rates(y.join(g, "item"), "ref", "hyp")


@query
def abstentions(s, d):
    p = predictions(s, d).select("id", responses.strict_intent(F.col("response")).alias("said"))
    known = table(s, d, "intent_targets").select(F.col("intent").alias("label"))
    a = submission.abstain(p, "said", {"chat": "general_chat", "lamp": "lamp_switch"}, "general_chat", known, ("timer", "reminder", "bus", "lamp", "recipe"))
    return a.select("id", "hyp", "rule")


@query
def abstention_rules(s, d):
    return inventory.histogram(abstentions(s, d), "rule")


@query
def labels_replaced(s, d):
    y = table(s, d, "synth").select("intent", submission.replaced(F.col("intent"), ("general_chat", "chat")).alias("hyp"))
    return submission.changes(y, "intent", "hyp")


@query
def numeric_order(s, d):
    """Ids in the order of their numbers, with their place."""
    h = table(s, d, "heldout").select(F.concat(F.regexp_extract("id", r"(\d+)$", 1), F.lit("-"), "split").alias("id")).distinct()
    return batches.positions(h.withColumn("k", text.number_prefix(F.col("id"))), ["k"]).select("id", "position")


@query
def chat_records(s, d):
    t = train(s, d, "wav", "tun_slu_annotation", "intent").withColumnRenamed("id", "ID")
    prompts = chat.label_prompt("One of {n}: {labels}", table(s, d, "intent_targets").select(F.col("intent").alias("label"))).select(F.lit("intent").alias("subtask"), "prompt")
    prompts = prompts.unionByName(chat.label_prompt("Mark {labels}", table(s, d, "slot_inventory")).select(F.lit("slot_filling").alias("subtask"), "prompt"))
    c = chat.records(t, prompts)
    return c.select(F.col("meta.id").alias("id"), F.col("meta.family").alias("family"), F.col("meta.subtask").alias("subtask"), F.element_at("messages", 1).content.alias("user"), F.element_at("messages", 2).content.alias("answer"), F.get("audios", F.lit(0)).alias("audio"))


@query
def chat_reprompted(s, d):
    t = train(s, d, "wav", "tun_slu_annotation", "intent").withColumnRenamed("id", "ID")
    prompts = s.range(1).select(F.lit("intent").alias("subtask"), F.lit("Name it.").alias("prompt"))
    c = chat.reprompted(chat.records(t, prompts, split="dev"), "Open question.")
    return c.groupBy(F.col("meta.family").alias("family"), F.col("meta.split").alias("split"), F.element_at("messages", 1).content.alias("user")).agg(F.count("*").alias("n"))


@query
def joint_targets(s, d):
    return chat.joint_targets(train(s, d, "tun_slu_annotation", "intent").withColumnRenamed("id", "ID"))


@query
def classified(s, d):
    p = predictions(s, d).withColumn("pred", responses.named_intent(F.col("response")))
    return chat.classifications(p)


@query
def best_checkpoints(s, d):
    """Events as training logs: a run for each user, the value as loss."""
    loss = F.when(F.col("event_type") != "click", F.col("value"))
    rows = table(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), F.col("event_id").alias("step"), loss.alias("eval_loss"))
    return checkpoints.best_steps(rows).select("run", "step", "eval_loss")


def adapter_factors(s: SparkSession, d: str) -> DataFrame:
    """Embeddings as low-rank factors: of each 32, the first 16 are the rows of A and the others the columns of B."""
    e = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "val")).withColumn("val", F.col("val").cast("double"))
    k, name = F.col("vec_id") % 32, lambda part: F.concat(F.lit("base_model.model.q"), F.floor(F.col("vec_id") / 32).cast("string"), F.lit(f".lora_{part}.weight")).alias("key")
    a = e.where(k < 16).select(name("A"), k.alias("row"), F.col("pos").cast("bigint").alias("col"), "val")
    b = e.where(k >= 16).select(name("B"), F.col("pos").cast("bigint").alias("row"), (k - 16).alias("col"), "val")
    return a.unionByName(b)


@query
def adapter_deltas(s, d):
    return adapters.deltas(adapter_factors(s, d)).select("key", "row", "col", (F.round("val", 6) + 0.0).alias("val"))


@query
def funnel(s, d):
    raw = table(s, d, "gen_kept").select("id").distinct()
    ok = checked(s, d).where("reject_reason is null").select("id")
    kept = panel.majority(table(s, d, "gen_judged")).where("keep").select(F.col("item_id").alias("id"))
    judged = ok.join(kept, "id", "left_semi")
    done = judged.join(table(s, d, "synth").select(F.regexp_replace("id", "_ft$", "").alias("id")).distinct(), "id", "left_semi")
    return scoring.funnel([("generated", raw), ("valid", ok), ("kept", judged), ("rendered", done)])


# -- records ---------------------------------------------------------------------------


@query
def first_records(s, d):
    return records.first_wins(table(s, d, "gen_kept").select("id", "seq", "text"), "id", "seq")


@query
def last_records(s, d):
    return records.last_wins(table(s, d, "gen_kept").select("id", "seq", "text"), "id", "seq")


@query
def holdout_rows(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    return records.last_n(o, "o_orderdate", 50, ("o_orderkey",)).select("o_orderkey", "holdout")


@query
def chunked_rows(s, d):
    return batches.chunks(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 10, shards=4).select("o_orderkey", "chunk", "shard")


@query
def gold_present(s, d):
    t = table(s, d, "train")
    kept = records.with_gold(t, "tun_slu_annotation")
    return kept.groupBy("intent").agg(F.count("*").alias("n"))
