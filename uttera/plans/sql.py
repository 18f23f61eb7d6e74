"""The catalogue's queries in DuckDB's SQL, written independently of the operators."""

from __future__ import annotations

WS = r"[\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def words(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def slots(x: str) -> str:
    """Lenient slots as a list of struct(label, value)."""
    rx = r"(?s)<([a-z_]+)>(.*?)(?: >|$)"
    return f"list_transform(list_zip(regexp_extract_all({x}, '{rx}', 1), regexp_extract_all({x}, '{rx}', 2)), lambda s: struct_pack(label := s[1], val := {strip('s[2]')}))"


def score_form(x: str) -> str:
    """Points, commas and apostrophes are kept by context with a private mark, for RE2 has no look-around."""
    x = rf"regexp_replace({x}, '[\x{{64B}}-\x{{652}}\x{{670}}]', '', 'g')"
    x = f"translate({x}, 'أإآٱ', 'اااا')"
    for _ in range(2):  # twice, for neighbours that share a character
        x = rf"regexp_replace({x}, '(\p{{Nd}})\.(\p{{Nd}})', '\1\x{{E000}}\2', 'g')".replace(r"\x{E000}", "")
        x = rf"regexp_replace({x}, '(\p{{Nd}}),(\p{{Nd}})', '\1\x{{E001}}\2', 'g')".replace(r"\x{E001}", "")
        x = rf"regexp_replace({x}, '([^\s\v])''([^\s\v])', '\1\x{{E002}}\2', 'g')".replace(r"\x{E002}", "")
    keep = "[^ء-ي٠-٩پچڤگa-zA-Z0-9@%\\s]"
    x = f"regexp_replace({x}, '{keep}', ' ', 'g')"
    x = f"translate({x}, '', '.,''')"
    return f"lower({squeeze(x)})"


def levenshtein_words(a: str, b: str) -> str:
    """Distance of two lists of words of at most 90 different ones: each becomes one byte."""
    code = "list_aggregate(list_transform({0}, lambda w: chr((32 + list_position(v, w))::int)), 'string_agg', '')"
    return f"levenshtein(coalesce({code.format(a)}, ''), coalesce({code.format(b)}, ''))"


def levenshtein_of(a: str, b: str) -> str:
    """Distance of two lists of words or characters of at most 90 different ones."""
    code = f"coalesce(list_aggregate(list_transform({{0}}, lambda w: chr((33 + list_position(list_distinct(list_concat({a}, {b})), w))::int)), 'string_agg', ''), '')"
    return f"levenshtein({code.format(a)}, {code.format(b)})"


def letters(x: str) -> str:
    return f"list_filter(string_split({x}, ''), lambda w: w <> '')"


TRAIN = """train1 as (select id, r.* from (select id, min(struct_pack(tun_transcription := tun_transcription, tun_slu_annotation := tun_slu_annotation, intent := intent, wav := wav, duration := duration)) as r from
 (select * from train) group by id) t)"""
# Spark's order of structs has nulls first, as this one
TRAIN = """train1 as (select id, tun_transcription, tun_slu_annotation, intent, wav, duration from train
 qualify row_number() over (partition by id order by tun_transcription nulls first, tun_slu_annotation nulls first, intent nulls first, wav nulls first, duration nulls first) = 1)"""

DEV = """dev1 as (select id, tun_slu_annotation, intent from heldout where split = 'validation'
 qualify row_number() over (partition by id order by intent nulls first, tun_slu_annotation nulls first) = 1),
 own1 as (select id, tun_slu_annotation, intent from train qualify row_number() over (partition by id order by intent nulls first, tun_slu_annotation nulls first) = 1),
 both1 as (select 0 as dev, id, tun_slu_annotation, intent from own1 union all select 1, id, tun_slu_annotation, intent from dev1)"""

FIRST = "first1 as (select * from gen_kept qualify row_number() over (partition by id order by seq) = 1)"


def parsed(x: str) -> str:
    """Columns of a strict parse, as a chain of selects over ``src`` with column a."""
    return f"""
inv as (select list(label) as inv from slot_inventory),
p0 as (select *, string_split({x}, '>') as seg from src, inv),
p1 as (select *, len(seg) as m, list_transform(range(0, len(seg) // 2), lambda k: struct_pack(
  label := regexp_extract(seg[2 * k + 1], '<([a-z_]+)$', 1), head := regexp_replace(seg[2 * k + 1], '<[a-z_]+$', ''), val := {strip('seg[2 * k + 2]')}, final := 2 * k + 2 = len(seg))) as pr from p0),
p2 as (select *, list_filter(list_transform(pr, lambda q: case when q.label = '' then 'stray_close' when not list_contains(inv, q.label) then 'bad_label:' || q.label
  when q.final then 'unclosed' when q.val = '' then 'empty_value' end), lambda w: w is not null)[1] as reason from p1),
p3 as (select *, case when reason is null and {x} is not null then {squeeze("coalesce(list_aggregate(list_transform(pr, lambda q: q.head || ' ' || q.val || ' '), 'string_agg', ''), '') || case when m % 2 = 1 then seg[m] else '' end")} end as parsed_text from p2)"""


_LETTERS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{Nl}}\p{{No}}]'))"
_ARABIC = r"len(regexp_extract_all({0}, '[\x{{600}}-\x{{6FF}}]'))"

CHECKED = f"""{FIRST},
src as (select id, seq, intent, {squeeze("coalesce(annotated, '')")} as a, {squeeze("coalesce(text, '')")} as t from first1),{parsed('a')},
checked as (select id, seq, intent, a, t2 as text, case when reason is not null then 'format:' || reason when parsed_text <> t2 then 'text_match'
  when intent is null or intent not in (select intent from intent_targets) then 'intent'
  when {_LETTERS.format('t2')} > 0 and {_ARABIC.format('t2')} / {_LETTERS.format('t2')} < 0.5 then 'arabic_ratio'
  when len({words('t2')}) not between 2 and 25 then 'length' end as reject_reason
  from (select *, coalesce(nullif(t, ''), parsed_text, '') as t2 from p3))"""

VERDICTS = "v as (select * from gen_judged qualify row_number() over (partition by item_id, annotator order by seq) = 1)"
PASS = "coalesce(derja >= 4 and \"natural\" >= 3 and intent_match and slots_ok, false)"
MAJORITY = f"{VERDICTS}, maj as (select item_id, count(*) filter (where {PASS}) as votes, count(*) as n from v group by 1)"

QUOTAS = f"""{TRAIN}, cnt as (select t.intent as label, count(r.id) as n from (select distinct intent from intent_targets) t left join train1 r on r.intent = t.intent group by 1),
tier as (select label, n, label in ('Emails','set','addcontact','greet','joke','querycontact','sendemail','quirky','query') as bare from cnt),
tier2 as (select *, case when bare then case when n = 0 then 0 else least(120, 20 * n) end when n < 40 then 400 when n < 150 then 250 else 150 end as tier from tier),
sc as (select greatest(0.1::double, (12000 - coalesce(sum(tier) filter (where bare), 0))::double / greatest(1, coalesce(sum(tier) filter (where not bare), 0))) as scale from tier2),
quo as (select label, n, cast(case when bare then tier else greatest(40, floor(tier * scale)) end as bigint) as quota from tier2, sc)"""

PLAN = f"""{QUOTAS}, {DEV},
have as (select intent, bool_or(len({slots("coalesce(tun_slu_annotation, '')")}) = 0) as bare, bool_or(dev = 0) as seeded from both1 where intent is not null group by 1),
q2 as (select label as intent, quota, coalesce(h.seeded, false) as has_seeds, coalesce(h.bare, true) as plain from quo left join have h on h.intent = label where quota > 0),
kinds as (select intent, 'cov' as k, 'coverage' as mode, quota as upto from q2
  union all select intent, 'par', 'paraphrase', least(60, greatest(quota // 2, 20)) from q2 where has_seeds
  union all select intent, 'dis', 'distractor', greatest(20, quota // 6) from q2 where plain),
plan as (select k || ':' || intent || ':' || b as batch_id, mode, intent, cast(case when k = 'dis' then 20 else least(20, upto - b) end as bigint) as n from (select *, unnest(range(0, upto, 20)) as b from kinds))"""

PRED = f"""syn as (select id, min(intent) as said, regexp_replace(id, '_ft$', '') as item from synth group by id),
gk as (select id as item, min(intent) as gold from gen_kept group by id),
lab as (select distinct intent as label from intent_targets),
resp as (select syn.id, gold, case when said is null then '' else '{{"intent": ' || to_json(said) || '}}' end as response from syn join gk using (item)),
named as (select *, nullif({strip("""regexp_extract(response, '"intent"\\s*:\\s*"([^"]+)"', 1)""")}, '') as said from resp),
pred as (select id, gold, response, coalesce(lab.label, said) as pred from named left join lab on lower(lab.label) = lower(said))"""


def pairs_scores(pairs: str, by: str = "") -> str:
    """F1 scores by label of ``pairs`` (gold, pred)."""
    b = f"{by}, " if by else ""
    return f"""legs as (select {b}gold as label, (pred is not distinct from gold)::int as tp, 0 as fp, (pred is distinct from gold)::int as fn, 1 as support from {pairs} where gold is not null
  union all select {b}pred, 0, 1, 0, 0 from {pairs} where gold is not null and pred is not null and pred <> gold),
conf as (select {b}label, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(support) as support from legs group by all),
pre as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall from conf),
lsc as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from pre)"""


TRANSCRIPTS = f"""{TRAIN}, tt as (select id, cast(regexp_extract(id, '(\\d+)$', 1) as bigint) as seq, tun_transcription as gold, {score_form('tun_transcription')} as form from train1 where tun_transcription is not null),
tp as (select a.id, a.seq, {words('a.form')} as r, {words('b.form')} as h, list_distinct(list_concat({words('a.form')}, {words('b.form')})) as v from tt a join tt b on a.seq = b.seq + 1),
tc as (select a.id, {letters('a.form')} as rc, {letters('b.form')} as hc from tt a join tt b on a.seq = b.seq + 1),
ts as (select tp.id, seq, {levenshtein_words('r', 'h')} / greatest(len(r), 1) as wer, {levenshtein_of('rc', 'hc')} / greatest(len(rc), 1) as cer from tp join tc using (id))"""

SHA = "list_reduce(list_concat([0::bigint], list_transform(string_split(sha1({0}), ''), lambda c: (instr('0123456789abcdef', c) - 1)::bigint)), lambda a, x: (a * 16 + x) % {1})"

FRAMES = "list_transform(range(0, len(embedding) // 8), lambda i: sqrt(list_sum(list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda v: v::double * v::double)) / 8 + 1e-12))"
CLIPS = f"""clips as (select vec_id, len(embedding) / 16.0::double as dur, sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double)) / len(embedding) + 1e-12) as rms,
 len(list_filter(embedding, lambda v: abs(v) > 0.999)) / len(embedding) as clip, len(list_filter({FRAMES}, lambda x: x > 0.12)) / (len(embedding) // 8) as activity, len(embedding) / 16.0::double / 20 as sec_per_char from embeddings)"""

MIX = "y as (select id as \"ID\", min(intent) as intent, min(duration) as duration from synth group by id)"

COMBOS = f"""c0 as (select intent, dev, cast(regexp_extract(id, '(\\d+)$', 1) as bigint) as seq, list_sort(list_transform({slots("coalesce(tun_slu_annotation, '')")}, lambda s: s.label)) as combo from both1 where intent is not null),
 c1 as (select intent, combo, count(*) as n, min((dev, seq)) as first from c0 group by 1, 2), combos as (select intent, combo, n, row_number() over (partition by intent order by n desc, first) as rank from c1 qualify rank <= 8)"""

ABSTENTIONS = f"""with syn as (select id, min(intent) as said, regexp_replace(id, '_ft$', '') as item from synth group by id), p as (select syn.id, {strip('said')} as said from syn join (select distinct id from gen_kept) g on g.id = item),
 c as (select id, case said when 'chat' then 'general_chat' when 'lamp' then 'lamp_switch' else said end as i from p),
 r as (select id, i, case when i is null then 'unparseable' when i = 'general_chat' then 'catch_all' when i not in (select intent from intent_targets) or split_part(i, '_', 1) not in ('timer', 'reminder', 'bus', 'lamp', 'recipe') then 'out_of_scope' else 'keep' end as rule from c)
 select id, case when rule = 'keep' then i else 'unknown' end as hyp, rule from r"""

ADAPTERS = "e as (select vec_id, unnest(range(0, len(embedding))) as pos, unnest(embedding)::double as val from embeddings), d as (select 'q' || (a.vec_id // 32) || '.weight' as key, b.pos as row, a.pos as col, sum(a.val * b.val) * 2 as val from e a join e b on a.vec_id // 32 = b.vec_id // 32 and a.vec_id % 32 + 16 = b.vec_id % 32 group by 1, 2, 3)"

PANEL = "('judge_01', 'judge_02', 'judge_03', 'judge_08', 'judge_09')"
PANEL_LIST = PANEL.replace("(", "[").replace(")", "]")

# four draws without replacement out of an intent's count: a place that is taken gives way to the last one in reach
SHOTS = f"""pool as (select intent, id, row_number() over (partition by intent order by id) - 1 as place, count(*) over (partition by intent) as size from own1 where intent is not null),
 sizes as (select distinct intent, size from pool), dr as (select batch_id, intent, size - 4 + d as upto, {SHA.format("'17:' || batch_id || ':' || d", 'greatest(size - 3 + d, 1)')} as hit from plan join sizes using (intent), unnest(range(0, 4)) t(d) where size - 4 + d >= 0),
 took as (select batch_id, intent, unnest(list_reduce(list_concat([[]::bigint[]], list([upto::bigint, hit::bigint] order by upto)), lambda a, x: list_append(a, case when list_contains(a, x[2]) then x[1] else x[2] end))) as place from dr group by 1, 2),
 shots as (select batch_id, id, row_number() over (partition by batch_id order by sha1('17:' || batch_id || ':' || id), id) as pos from took join pool using (intent, place))"""
SOURCES = f"sources as (select batch_id, id from (select batch_id, intent, {SHA.format("'17:' || batch_id || ':source'", 'size')} as place from plan join sizes using (intent) where mode = 'paraphrase') join pool using (intent, place))"
PICKS = f"""items as (select intent, rank - 1 as pos, array_to_string(combo, ',') as item from combos), many as (select intent, max(pos) + 1 as size from items group by 1),
 pp as (select batch_id, intent, many.size as m, unnest(range(0, plan.n)) as place from plan join many using (intent) where mode = 'coverage'), qq as (select *, {SHA.format("'17:' || batch_id || ':' || place", 'm')} as pos from pp), picks as (select batch_id, place, item from qq join items using (intent, pos))"""

SQL: dict[str, str] = {
    "label_inventory": r"select distinct unnest(regexp_extract_all(m, '<([^<>/\s]+)>', 1)) as label from (select tun_slu_annotation as m from train union all select tun_slu_annotation from heldout)",
    "intent_inventory": "select distinct trim(intent, ' ') as label from train where trim(intent, ' ') <> ''",
    "intent_counts": f"with {TRAIN} select t.intent as label, count(r.id) as n from intent_targets t left join train1 r on r.intent = t.intent group by 1",
    "intent_shares": "select intent as value, count(*) as n, count(*) / sum(count(*)) over () as share from synth group by 1",
    "slot_values": f"select distinct s.label as label, s.val as value from (select unnest({slots('tun_slu_annotation')}) as s from (select tun_slu_annotation from train union all select tun_slu_annotation from heldout where split = 'validation'))",
    "slot_combinations": f"with {DEV}, {COMBOS} select * from combos",
    "seed_pool": f"with {TRAIN} select intent, row_number() over (partition by intent order by id) - 1 as position, id from train1 where intent is not null and tun_transcription is not null",
    "intent_quotas": f"with {QUOTAS} select label, n, quota from quo",
    "batch_plan": f"with {PLAN} select * from plan",
    "batch_plan_resumed": f"with {PLAN} select * from plan where batch_id not in (select meta.batch from gen_kept where meta.batch is not null)",
    "batch_shots": f"with {PLAN}, {SHOTS} select batch_id, id, pos from shots",
    "batch_sources": f"with {PLAN}, {SHOTS}, {SOURCES} select batch_id, id from sources",
    "batch_combinations": f"with {PLAN}, {COMBOS}, {PICKS} select batch_id, cast(place as int) as place, item from picks",
    "batch_prompts": f"""with {PLAN}, {SHOTS}, {SOURCES}, {COMBOS}, {PICKS}, mark as (select id, coalesce(tun_slu_annotation, '') as markup from own1),
 ex as (select batch_id, string_agg(markup, chr(10) order by pos) as example from shots join mark using (id) group by 1), it as (select batch_id, string_agg(item, chr(10) order by place) as item from picks group by 1), so as (select batch_id, markup as source from sources join mark using (id))
 select batch_id, concat_ws(chr(10), 'Write utterances in the style of the examples.', 'x <time> y >', example, case mode when 'coverage' then n || ' new ones of ' || intent || ', with these labels:' when 'paraphrase' then n || ' paraphrases for ' || intent || ' of:' else n || ' new ones of ' || intent || ' without slots.' end,
  case mode when 'coverage' then item when 'paraphrase' then source end) as prompt from plan left join ex using (batch_id) left join it using (batch_id) left join so using (batch_id)""",
    "rarest_intents": f"with {TRAIN} select intent as value, count(*) as n from train1 where intent is not null group by 1 order by n, value limit 8",
    "item_ids": r"select id, 'synth_' || replace(batch, ':', '_') || '_' || lpad(cast(p as varchar), greatest(3, length(cast(p as varchar)))::int, '0') as built from (select id, min(meta.batch) as batch, cast(regexp_extract(id, '(\d+)$', 1) as int) as p from gen_kept where meta.batch is not null group by id)",
    "markup_parsed": f"""with src as (select seq, annotated as a from gen_kept),{parsed('a')}
 select seq, reason, case when reason is null and a is not null then len(pr) end as n_slots, case when reason is null and a is not null then '[' || coalesce(list_aggregate(list_transform(pr, lambda q: '{{"label":' || to_json(q.label) || ',"value":' || to_json(q.val) || '}}'), 'string_agg', ','), '') || ']' end as slots, parsed_text as text from p3""",
    "validated": f"with {CHECKED} select id, seq, reject_reason from checked",
    "reject_reasons": f"with {CHECKED} select coalesce(reject_reason, 'kept') as reason, count(*) as n from checked group by 1",
    "near_gold": f"""with {CHECKED}, g as (select distinct intent, tun_transcription as t from (select intent, tun_transcription from train union all select intent, tun_transcription from heldout where split = 'validation') where tun_transcription is not null),
 tri as (select k, t, list_distinct(list_transform(range(1, greatest(1, length(b) - 2) + 1), lambda i: substr(b, i, 3))) as s from (select distinct t as k, t, regexp_replace(t, '{WS}+', '', 'g') as b from (select t from g union select text from checked))),
 c as (select id, checked.intent, tri.s from checked join tri on tri.k = checked.text where reject_reason is null), gg as (select intent, s from g join tri on tri.k = g.t)
 select id, exists (select 1 from gg where gg.intent = c.intent and len(list_intersect(gg.s, c.s)) >= 0.85 * (len(gg.s) + len(c.s) - len(list_intersect(gg.s, c.s)))) as near_gold from c""",
    "text_measures": f"select seq, len({words('text')}) as n_tokens, {_ARABIC.format('text')} as n_arabic, {_LETTERS.format('text')} as n_letters, ({_LETTERS.format('text')} = 0 or {_ARABIC.format('text')} / {_LETTERS.format('text')} >= 0.5) as script_ok, len(list_distinct(list_transform(range(1, greatest(1, length(b) - 2) + 1), lambda i: substr(b, i, 3)))) as n_trigrams from (select *, regexp_replace(text, '{WS}+', '', 'g') as b from gen_kept where text is not null)",
    "text_score_form": f"select distinct id, {score_form('tun_transcription')} as form from heldout where tun_transcription is not null",
    "panel_majority": f"with {MAJORITY} select item_id, votes, n as \"of\", 0::bigint as n_missing, votes >= n // 2 + 1 as keep from maj",
    "panel_named": f"with {VERDICTS} select item_id, count(*) filter (where annotator in {PANEL} and {PASS}) as votes, 5::bigint as \"of\", 5 - count(*) filter (where annotator in {PANEL}) as n_missing, count(*) filter (where annotator in {PANEL} and {PASS}) >= 3 as keep from v group by 1",
    "panel_repair": f"""with {VERDICTS}, votes as (select item_id, count(*) filter (where annotator in {PANEL} and {PASS}) as votes from v group by 1),
 src as (select votes.item_id, votes, {squeeze('lead.fixed_annotated')} as a, coalesce(not {PASS} and derja >= 4 and "natural" >= 3 and intent_match and fixed_annotated <> '', false) as may from votes left join (select * from v where annotator = 'judge_01') lead using (item_id)),{parsed('a')},
 r as (select *, may and reason is null and votes + 1 >= 3 as rep from p3)
 select item_id, votes, 5::bigint as "of", votes >= 3 or rep as keep, rep as repaired, case when rep then a end as annotated, case when rep then parsed_text end as text from r""",
    "panel_verdicts_named": f"with {VERDICTS}, i as (select distinct item_id from v), n as (select unnest({PANEL_LIST}) as annotator) select i.item_id, n.annotator, derja, \"natural\", intent_match, slots_ok from i cross join n left join v on v.item_id = i.item_id and v.annotator = n.annotator",
    "panel_verdicts": f"with {VERDICTS} select item_id, cast(count(*) as int) as n, string_agg(annotator, ',' order by annotator) as annotators from v group by 1",
    "unjudged_items": "select distinct id from gen_kept where id is not null and id not in (select item_id from gen_judged where item_id is not null)",
    "transcript_character_scores": f"with {TRANSCRIPTS} select id, cer from ts",
    "corpus_error_rates": f"""with y as (select regexp_replace(id, '_ft$', '') as item, hyp from (select id, min(tun_slu_annotation) as hyp from synth group by id)), g as (select id as item, min(annotated) as ref from gen_kept group by id),
 p0 as (select coalesce(ref, '') as ref, coalesce(hyp, '') as hyp from y join g using (item)), p1 as (select ref, hyp, {score_form("regexp_replace(ref, '<[a-z_]+>|>', ' ', 'g')")} as r, {score_form("regexp_replace(hyp, '<[a-z_]+>|>', ' ', 'g')")} as h from p0),
 p2 as (select {words('r')} as rw, {words('h')} as hw, {letters('r')} as rc, {letters('h')} as hc, list_transform({slots('ref')}, lambda s: s.label) as rl, list_transform({slots('hyp')}, lambda s: s.label) as hl, list_transform({slots('ref')}, lambda s: s.label || '=' || {score_form('s.val')}) as rv, list_transform({slots('hyp')}, lambda s: s.label || '=' || {score_form('s.val')}) as hv from p1)
 select {', '.join(f"sum({levenshtein_of(f'r{x}', f'h{x}')}) / sum(len(r{x})) as {n}" for x, n in (('w', 'wer'), ('c', 'cer'), ('l', 'coer'), ('v', 'cver')))} from p2""",
    "transcript_scores": f"with {TRANSCRIPTS} select id, wer from ts",
    "intent_scores_exact": f"with {PRED}, {pairs_scores('pred')} select round(sum(tp) / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1, cast(sum(support) as bigint) as scored from lsc where support > 0",
    "intent_confusion_exact": f"with {PRED}, {pairs_scores('pred')} select * from lsc",
    "result_accounting": f"with {PRED} select count(*) as total, count(gold) as scored, count(*) filter (where said is null) as unparsed from named",
    "classified": f"with {PRED} select id, coalesce(said, response) as hyp, nullif({strip('gold')}, '') as ref from named",
    "reference_best": f"with {TRANSCRIPTS} select cast(row_number() over (order by wer, seq) - 1 as int) as pos, id, wer from ts qualify pos < 150",
    "reference_stats": f"with {TRANSCRIPTS} select count(*) as n, min(wer) as least, median(wer) as median, round(avg(wer), 6) as mean from ts",
    "references_assigned": f"with pool as (select cast(row_number() over (order by given_name, script) - 1 as int) as pos, given_name as ref_id from name_list where given_name is not null), m as (select count(*) as n from pool), i as (select distinct id, n from gen_kept, m), h as (select id, cast({SHA.format('id', 'n')} as int) as pos, cast({SHA.format("id || '#retry'", 'n')} as int) as again from i) select id, h.pos, p.ref_id, q.ref_id as retry_ref_id from h join pool p on p.pos = h.pos join pool q on q.pos = h.again",
    "duration_filtered": "select intent, count(*) as n, round(sum(duration), 6) as seconds from train where duration between 2.5 and 10 group by 1",
    "acoustic_measures": f"with {CLIPS} select vec_id, dur, round(rms, 6) as rms, clip, activity, sec_per_char from clips",
    "acoustic_gate": f"with {CLIPS} select vec_id, coalesce(dur between 0.4 and 30 and rms >= 0.01 and clip < 0.05 and activity >= 0.5 and sec_per_char between 0.04 and 0.4, false) as sound from clips",
    "rendition_rows": "select g.id || s as \"ID\", 'aug/' || w || '/' || g.id || '.wav' as wav, intent from (select id, min(intent) as intent from gen_kept group by id) g, (values ('wav', ''), ('wav_ft', '_ft')) x(w, s) where 'aug/' || w || '/' || g.id || '.wav' in (select wav from synth where wav is not null)",
    "ratio_capped": f"""with {TRAIN}, {MIX}, tc as (select intent, count(*) as n from train1 group by 1), rare as (select intent from tc where n < 10 union select intent from y where intent not in (select intent from tc where intent is not null)),
 z as (select "ID", intent, coalesce(intent in (select intent from rare where intent is not null), false) as rare from y), lim as (select floor((select count(*) from train1) * 2.0) as cap, (select count(*) from z) as total, (select count(*) from z where rare) as nr),
 r as (select z.*, cap, total, nr, row_number() over (partition by rare order by sha1('17:' || "ID"), "ID") as k from z, lim) select "ID", intent from r where total <= cap or rare or k <= greatest(0, cap - nr)""",
    "rare_intents": f"with {TRAIN}, tc as (select intent, count(*) as n from train1 group by 1) select intent from tc where n < 10 union select distinct intent from synth where not exists (select 1 from tc where tc.intent = synth.intent)",
    "training_mix": f"with {TRAIN}, {MIX} select origin, intent, count(*) as n, round(sum(duration), 6) as seconds from (select 'real' as origin, intent, duration from train1 union all select 'synthetic', intent, duration from y) group by 1, 2",
    "event_scores": f"with e as (select user_id % 4 as run, event_type as gold, lag(event_type) over (partition by user_id order by ts, event_id) as pred from events), {pairs_scores('e', 'run')} select run, round(sum(tp) / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1, cast(sum(support) as bigint) as scored from lsc where support > 0 group by 1",
    "gold_filled": f"with m as (select id, arg_max(intent, rendered_at) filter (where rendered_at is not null) as i from synth group by id), s2 as (select id, regexp_replace(id, '_ft$', '') as item from (select distinct id from synth)) select nullif({strip('i')}, '') as gold, count(*) as n from s2 join (select distinct id from gen_kept) g on g.id = s2.item join m on m.id = s2.id group by 1",
    "abstentions": ABSTENTIONS,
    "abstention_rules": f"select rule as value, count(*) as n, count(*) / sum(count(*)) over () as share from ({ABSTENTIONS}) group by 1",
    "labels_replaced": "select coalesce(intent, 'None') || ' -> unknown' as change, count(*) as n from synth where intent in ('general_chat', 'chat') group by 1",
    "numeric_order": r"with h as (select distinct regexp_extract(id, '(\d+)$', 1) || '-' || split as id from heldout) select id, row_number() over (order by cast(regexp_extract(id, '^(\d+)', 1) as bigint)) - 1 as position from h",
    "chat_records": f"""with {TRAIN}, pi as (select 'One of ' || count(*) || ': ' || string_agg(intent, ', ' order by intent) as p from (select distinct intent from intent_targets)), ps as (select 'Mark ' || string_agg(label, ', ' order by label) as p from (select distinct label from slot_inventory)),
 x as (select id, wav, 'intent' as subtask, p, case when {strip("coalesce(intent, '')")} <> '' then '{{"intent": ' || to_json({strip('intent')}) || '}}' end as t from train1, pi union all select id, wav, 'slot_filling', p, nullif({strip("coalesce(tun_slu_annotation, '')")}, '') from train1, ps)
 select id, family, subtask, case when family = 'gemma' then p || '<audio>' when subtask = 'slot_filling' then '<audio>' else '<audio>' || p end as user, t as answer, wav as audio from x, (values ('qwen'), ('gemma')) f(family) where t is not null""",
    "chat_reprompted": f"with {TRAIN} select family, 'dev_open' as split, case when family = 'gemma' then 'Open question.<audio>' else '<audio>Open question.' end as user, count(*) as n from train1, (values ('qwen'), ('gemma')) f(family) where {strip("coalesce(intent, '')")} <> '' group by 1",
    "joint_targets": f"""with {TRAIN} select id as "ID", 'intent' as subtask, '[INTENT] {{"intent": ' || to_json({strip('intent')}) || '}}' as target from train1 where {strip("coalesce(intent, '')")} <> '' union all select id, 'slot_filling', '[SLOT] ' || {strip('tun_slu_annotation')} from train1 where {strip("coalesce(tun_slu_annotation, '')")} <> ''""",
    "best_checkpoints": "select user_id as run, arg_min(event_id, (value, event_id)) as step, min(value) as eval_loss from events where event_type <> 'click' and value is not null group by 1",
    "adapter_deltas": f"with {ADAPTERS} select key, row, col, round(val, 6) + 0.0 as val from d",
    "funnel": f"""with {CHECKED}, {MAJORITY}, ok as (select id from checked where reject_reason is null), kept as (select id from ok where id in (select item_id from maj where votes >= n // 2 + 1)), done as (select id from kept where id in (select regexp_replace(id, '_ft$', '') from synth)),
 t as (select 0 as pos, 'generated' as stage, (select count(distinct id) from gen_kept) as n union all select 1, 'valid', (select count(*) from ok) union all select 2, 'kept', (select count(*) from kept) union all select 3, 'rendered', (select count(*) from done))
 select pos, stage, n, n / nullif(lag(n) over (order by pos), 0) as share from t""",
    "first_records": "select id, arg_min(seq, seq) as seq, arg_min(struct_pack(t := text), seq).t as text from gen_kept group by 1",
    "last_records": "select id, arg_max(seq, seq) as seq, arg_max(struct_pack(t := text), seq).t as text from gen_kept group by 1",
    "holdout_rows": "select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) <= 50 as holdout from orders",
    "chunked_rows": "select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 10 as chunk, (row_number() over (order by o_orderkey) - 1) % 4 as shard from orders",
    "gold_present": f"select intent, count(*) as n from train where {strip('tun_slu_annotation')} <> '' group by 1",
}
