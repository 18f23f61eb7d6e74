"""Queries that write a format and read it back, call models, or select rows by the remaining rules; with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttera.functions import responses, text
from uttera.operators import adapters, chat, checkpoints, mixing, records, reference_pool
from uttera.plans.catalogue import adapter_factors, intent_list, intent_scores_exact, predictions, table, train, transcripts
from uttera.plans.sql import ADAPTERS, PRED, TRAIN, TRANSCRIPTS, strip, words
from uttera.schemas import ITEM, LOG, MANIFEST, conform
from uttera.session import shared_dir
from uttera.sources import models, readers, tensors, writers
from uttera.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def folder(s: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(s)}/files-{uuid.uuid4().hex}"


def manifest(s: SparkSession, d: str) -> DataFrame:
    return train(s, d, "duration", "wav", "tun_transcription", "tun_slu_annotation", "intent").withColumnRenamed("id", "ID")


# -- readers and writers ---------------------------------------------------------


@query(f"with {TRAIN} select id as \"ID\", duration, nullif(wav, '') as wav, nullif(tun_transcription, '') as tun_transcription, nullif(tun_slu_annotation, '') as tun_slu_annotation, nullif(intent, '') as intent from train1")
def csv_round_trip(s, d):
    """A manifest through CSV; empty cells come back as null."""
    at = folder(s)
    writers.csv_manifest(manifest(s, d), at)
    return readers.csv_manifest(s, at)


@query("select nullif(intent, '') as intent, count(*) as n from heldout group by 1")
def csv_splits_read(s, d):
    """Several splits as one manifest; a split without a file is skipped."""
    h, at = table(s, d, "heldout").withColumnRenamed("id", "ID"), folder(s)
    for split in ("validation", "test", "test_far"):
        writers.csv_manifest(h.where(F.col("split") == split), f"{at}/{split}")
    return readers.csv_splits(s, [f"{at}/{x}" for x in ("validation", "missing", "test", "test_far")]).groupBy("intent").agg(F.count("*").alias("n"))


@query("select id, text, annotated, intent, cast(len(slots) as int) as n_slots, list_aggregate(list_transform(slots, lambda x: coalesce(x.label, '') || '=' || coalesce(x.value, '')), 'string_agg', '|') as slots, meta.batch as batch from gen_kept qualify row_number() over (partition by id order by seq) = 1")
def jsonl_round_trip(s, d):
    g, at = records.first_wins(table(s, d, "gen_kept").select("id", "seq", "text", "annotated", "intent", "slots", "meta"), "id", "seq"), folder(s)
    writers.jsonl(g.drop("seq"), at, nulls=True)
    r = readers.jsonl(s, at, ITEM)
    joined = F.array_join(F.transform("slots", lambda x: F.concat(F.coalesce(x.label, F.lit("")), F.lit("="), F.coalesce(x.value, F.lit("")))), "|")
    return r.select("id", "text", "annotated", "intent", F.nullif(F.size("slots"), F.lit(-1)).alias("n_slots"), F.nullif(joined, F.lit("")).alias("slots"), F.col("meta.batch").alias("batch"))


@query("select count(*) as lines, count(*) filter (where seq % 7 <> 0 and id is not null) as readable from gen_kept")
def jsonl_lenient(s, d):
    """Broken lines among good ones are rows of nulls where reading isn't strict."""
    g, at = table(s, d, "gen_kept"), folder(s)
    g.select(F.when(F.col("seq") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("id", "text"))).alias("value")).write.text(at)
    return readers.jsonl(s, at, ITEM, strict=False).agg(F.count("*").alias("lines"), F.count("id").alias("readable"))


@query("select distinct id, 1::bigint as n from gen_kept where id is not null")
def jsonl_appended(s, d):
    """What is finished isn't appended again."""
    g, at = table(s, d, "gen_kept").where("id is not null"), folder(s)
    writers.jsonl(g.where("seq % 2 = 0").select("id").distinct(), at)
    writers.append_new(g.select("id").distinct(), s.read.schema("id string").json(at), "id", at)
    return s.read.schema("id string").json(at).groupBy("id").agg(F.count("*").alias("n"))


@query("select cast(user_id as varchar) as run, arg_min(event_id, (value, event_id)) as step, min(value) as eval_loss from events where event_type <> 'click' and value is not null and event_id % 3 <> 0 group by 1")
def training_logs(s, d):
    """A log document for each user's events in a folder of its own; the best of the checkpoints that survive."""
    e, at = table(s, d, "events"), folder(s)
    entry = F.struct(F.col("event_id").alias("step"), F.when(F.col("event_type") != "click", F.col("value")).alias("eval_loss"))
    docs = e.groupBy(F.col("user_id").alias("run")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("log_history"))).alias("value"))
    docs.write.partitionBy("run").text(at)
    r = checkpoints.log_rows(readers.runs(s, f"{at}/run=*/*.txt", LOG, r"run=([^/]+)/"))
    return checkpoints.best_steps(r, e.where("event_id % 3 <> 0").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step")))


@query("select distinct trim(label, ' ') as label from slot_inventory where label is not null")
def label_list_round_trip(s, d):
    at = folder(s)
    writers.label_list(table(s, d, "slot_inventory").where("label is not null").unionByName(s.createDataFrame([("# a comment",), ("  ",)], "label string")), at)
    return readers.label_list(s, at)


@query("select cast(row_number() over (order by intent) - 1 as int) as pos, intent as label from intent_targets where intent is not null")
def ordered_labels_round_trip(s, d):
    at = folder(s)
    writers.label_list(table(s, d, "intent_targets").where("intent is not null"), at, "intent")
    return readers.ordered_labels(s, at)


@query("select cast(row_number() over (order by given_name, script) - 1 as int) as pos, given_name as wav, script as text from name_list where given_name is not null")
def tsv_round_trip(s, d):
    at = folder(s)
    n = table(s, d, "name_list").where("given_name is not null").orderBy("given_name", "script").coalesce(1)
    writers.tsv_pool(n.select(F.monotonically_increasing_id().alias("pos"), F.col("given_name").alias("wav"), F.col("script").alias("gold")), at)
    return readers.tsv_pool(s, at)


@query("select cast(vec_id as varchar) as name, 16::bigint as rate, round(len(embedding) / 16.0::double, 3) as duration, cast(list_sum(list_transform(embedding, lambda v: round_even(v::double * 32768, 0))) as bigint) as total from embeddings")
def sound_round_trip(s, d):
    """Embeddings as sound files: their headers, and the sum of their samples."""
    at = folder(s)
    _local_folder(at)
    writers.wav_files(table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("samples")), at, 16)
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("name")
    heads = readers.wav_headers(s, f"{at}/*.wav").select(name, "rate", "duration")
    x = s.read.format("binaryFile").load(f"{at}/*.wav").select(name, readers.pcm(F.col("content")).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + F.round(v.cast("double") * 32768).cast("bigint"))
    return heads.join(x.select("name", total.alias("total")), "name")


def _local_folder(at: str) -> None:
    import os

    os.makedirs(at, exist_ok=True)


@query("select 'block' || (vec_id // 32) as key, vec_id % 32 as row, cast(p - 1 as bigint) as col, embedding[p]::double as val from embeddings, unnest(range(1, len(embedding) + 1)) t(p)")
def tensor_round_trip(s, d):
    at = folder(s)
    _local_folder(at)
    e = table(s, d, "embeddings").select(F.concat(F.lit("block"), F.floor(F.col("vec_id") / 32).cast("string")).alias("key"), (F.col("vec_id") % 32).alias("row"), F.posexplode("embedding").alias("col", "val"))
    tensors.write_tensors(e.select("key", "row", F.col("col").cast("bigint").alias("col"), F.col("val").cast("double").alias("val")), at, 4)
    return tensors.read_tensors(s, at)


@query(f"with {PRED}, pr as (select (gold is not distinct from pred)::int as hit, gold from pred) select round(round(sum(hit) / count(*), 6), 4) as accuracy, cast(count(*) as bigint) as scored from pr where gold is not null")
def metrics_file(s, d):
    """The scores' file, read back."""
    at = folder(s)
    _local_folder(at)
    writers.metrics(intent_scores_exact(s, d), f"{at}/metrics.json")
    return readers.json_document(s, f"{at}/metrics.json", "accuracy double, scored long").select("accuracy", "scored")


@query(f"with {TRAIN} select id as \"ID\", duration, wav, null::varchar as tun_transcription, tun_slu_annotation, intent from train1")
def manifest_conformed(s, d):
    """Columns in other case and order, one too many and one missing."""
    m = manifest(s, d).withColumn("DURATION_", F.col("duration").cast("string")).drop("duration", "tun_transcription").withColumnRenamed("DURATION_", "DURATION")
    return conform(m.withColumn("extra", F.lit(1)), MANIFEST)


@query("select distinct id as \"ID\" from synth where id in (select id from train union all select id from gen_kept where seq % 2 = 0)")
def kept_by_list(s, d):
    """Renditions whose item a list of ids names."""
    at = folder(s)
    table(s, d, "train").select("id").unionByName(table(s, d, "gen_kept").where("seq % 2 = 0").select("id")).where("id is not null").select(F.concat_ws(" ", "id", F.lit("")).alias("value")).write.text(at)
    y = table(s, d, "synth").select(F.col("id").alias("ID")).distinct()
    return mixing.keep_listed(y, "ID", readers.id_set(s, at))


# -- models ------------------------------------------------------------------------

_SHA = "list_reduce(list_concat([0::bigint], list_transform(string_split(sha1({0}), ''), lambda c: (instr('0123456789abcdef', c) - 1)::bigint)), lambda a, x: (a * 16 + x) % {1})"


@query(f"with i as (select list(distinct intent order by intent) as l from intent_targets where intent is not null) select distinct id, '{{\"intent\": \"' || l[{_SHA.format('id', 'len(l)')} + 1] || '\"}}' as response from gen_kept, i where id is not null")
def model_responses(s, d):
    ids = table(s, d, "gen_kept").select("id").where("id is not null").distinct()
    return models.respond(ids, "id", models.stub(intent_list(s, d)))


def _hear(path: str) -> str:
    if path.endswith("7.wav"):
        raise OSError(f"no sound in {path}")
    return "a b"


@query("select distinct id, case when wav like '%7.wav' then null else 'a b' end as hyp, case when wav like '%7.wav' then 'no sound in ' || wav end as error, case when wav like '%7.wav' then null else 1.0 end::double as wer from synth where wav is not null")
def transcripts_heard(s, d):
    """Sounds that fail every time stay as rows without a score."""
    y = table(s, d, "synth").where("wav is not null").select("id", "wav", F.lit("c d").alias("gold")).distinct()
    return models.scored_transcripts(y, _hear, reference_pool.scored, sleep=_no_pause).select("id", "hyp", "error", "wer").distinct()


def _no_pause(seconds: float) -> None:
    pass


def _speak(said: str, ref: str, attempt: int) -> tuple[list[float], int]:
    return [0.1 if (len(said) + attempt) % 4 == 0 else 0.0] * 160, 320


@query("""with t as (select distinct id, length(text) as n from gen_kept where id is not null and text is not null qualify row_number() over (partition by id order by text) = 1),
 k as (select *, (4 - n % 4) % 4 as first from t) select id, cast(case when first < 3 then first + 1 else 3 end as int) as attempts, case when first < 2 then id else id || '#' end as ref_id, case when first < 3 then 160 end as n_samples, case when first = 3 then 'silent or short' end as error from k""")
def sounds_spoken(s, d):
    """Silent sounds are tried again, the last time with the other reference."""
    g = table(s, d, "gen_kept").where("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text"))
    items = g.select("id", "text", F.col("id").alias("ref_id"), F.concat("id", F.lit("#")).alias("retry_ref_id"))
    r = models.spoken(items, _speak, rate=320)
    return r.select("id", "attempts", "ref_id", F.when(F.col("samples").isNotNull(), F.size("samples")).alias("n_samples"), "error")


@query(f"with {PRED} select syn.id, nullif({strip('syn.said')}, '') as intent from syn join gk using (item)")
def responses_json(s, d):
    """The intent of responses fenced as code, among words, or plain."""
    p = predictions(s, d)
    fenced = F.when(F.length("id") % 3 == 0, F.concat(F.lit("```json\n"), "response", F.lit("\n```"))).when(F.length("id") % 3 == 1, F.concat(F.lit("Well: "), "response", F.lit(" so."))).otherwise(F.col("response"))
    return p.select("id", text.gold(F.try_variant_get(responses.extract_json(fenced), "$.intent", "string")).alias("intent"))


# -- selections --------------------------------------------------------------------


@query("select intent, count(*) as n from train where duration is null or duration between 2.5 and 10 group by 1")
def duration_kept_bad(s, d):
    """What is no number stays."""
    t = table(s, d, "train")
    return t.where(records.duration_between(F.col("duration").cast("string"), keep_bad=True)).groupBy("intent").agg(F.count("*").alias("n"))


@query(f"with {TRAIN} select id as \"ID\", 'slot_filling' as subtask from train1 where {strip(chr(34) + 'tun_slu_annotation' + chr(34))} <> '' and len({words('tun_slu_annotation')}) <= 7")
def targets_within(s, d):
    """Targets of at most eight words, the marker one of them."""
    t = chat.joint_targets(manifest(s, d)).where("subtask = 'slot_filling'")
    return chat.within(t, "target", 8).select("ID", "subtask")


@query(f"with {TRAIN} select id, coalesce({strip('intent')}, '') as intent, 'open' as inventory, 'train' as split from train1 where {strip('intent')} <> ''")
def chat_meta(s, d):
    """A field of a record's meta dropped, one filled."""
    prompts = s.range(1).select(F.lit("intent").alias("subtask"), F.lit("Name it.").alias("prompt"))
    c = chat.with_defaults(chat.without_field(chat.records(manifest(s, d), prompts, families=("qwen",)), "family", "ref", "absent"), {"inventory": "open", "split": "x"})
    return c.select("meta.*").drop("subtask")


@query(f"with {TRANSCRIPTS}, best as (select id, seq, wer, 0 as late from ts where wer <= 0.9 union all select id, seq, wer, 1 from ts where wer > 0.9 and seq in (11, 12, 13)) select cast(row_number() over (order by late, wer, seq) - 1 as bigint) as pos, id, wer from best")
def reference_threshold(s, d):
    """The pool of all up to a rate, and some that are always in it."""
    t = reference_pool.scored(transcripts(s, d))
    always = tuple(r[0] for r in transcripts(s, d).where("seq in (11, 12, 13)").select("id").collect())
    return reference_pool.reference_pool(t, most=0.9, always=always).select("pos", "id", "wer")


@query(f"with {ADAPTERS} select d.key, row, col, round(val + (row * 10 + col), 6) as val from d where key <> 'q0.weight'")
def adapters_merged(s, d):
    """Deltas added to base weights, of which one is missing."""
    t = adapters.deltas(adapter_factors(s, d))
    base = t.where("key <> 'q0.weight'").select("key", "row", "col", (F.col("row") * 10 + F.col("col")).cast("double").alias("val"))
    return adapters.merged(base, t).select("key", "row", "col", F.round("val", 6).alias("val"))


@query(f"with {ADAPTERS} select distinct key from d where key = 'q0.weight'")
def adapters_unseen(s, d):
    """Deltas without a base weight, which make a merge incomplete."""
    t = adapters.deltas(adapter_factors(s, d))
    return adapters.unseen(t.where("key <> 'q0.weight'"), t)


@query("select id from (select distinct id from gen_kept where id is not null) order by sha1('17:' || id), id limit 100")
def shuffled_head(s, d):
    """The first hundred in an order by hash."""
    return records.shuffled(table(s, d, "gen_kept").where("id is not null").select("id").distinct(), "id").limit(100)


@query("select id, seq from gen_kept order by seq limit 200")
def first_in_order(s, d):
    return table(s, d, "gen_kept").select("id", "seq").orderBy("seq").limit(200)


@query(f"select id, {_SHA.format(chr(39) + '42:' + chr(39) + ' || id', '100')} < 5 as is_test from (select distinct id from gen_kept where id is not null)")
def random_split_rows(s, d):
    return records.random_split(table(s, d, "gen_kept").where("id is not null").select("id").distinct(), "id", 5)


@query("select distinct wav, cast(regexp_extract(wav, '(\\d+)[^/]*$', 1) as bigint) as number from synth where wav is not null and regexp_matches(wav, '\\d[^/]*$')")
def checkpoint_numbers(s, d):
    """The numbers of checkpoint paths."""
    y = table(s, d, "synth").where(r"wav is not null and regexp_like(wav, '\\d[^/]*$')").select("wav").distinct()
    return y.select("wav", checkpoints.checkpoint_number(F.concat(F.lit("out/checkpoint-"), F.regexp_extract("wav", r"(\d+)[^/]*$", 1))).alias("number"))


@query("select event_type, count(*) as n from (select distinct event_id, event_type from events) group by 1")
def stream_first_seen(s, d):
    """Files read as a stream, twice over: each event counts once."""
    at, e = folder(s), table(s, d, "events").select("event_id", "event_type", "user_id")
    for k in range(2):
        e.repartition(3).write.mode("append").json(f"{at}/in")
        stream = incremental.new_files(s, f"{at}/in", "event_id long, event_type string, user_id long", per_trigger=4)
        incremental.process(incremental.first_seen(stream, "event_id"), lambda x: x, f"{at}/out", f"{at}/state", name=f"q{uuid.uuid4().hex}").awaitTermination()
    return s.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"))
