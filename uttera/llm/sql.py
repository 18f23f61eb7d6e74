"""SQL of those queries that SQL can express.

The others are tested against brute force (p1, p5, p6), round trips and another
library (p7), exact accounting (p2_sample, p8), planted annotators (p3) and
held-out accuracy (p9) in tests/llm.
"""

from __future__ import annotations

_REPORT = r"""
with t as (select min(intent) as intent, lower(trim(intent)) as k, max(coalesce(target_bp, 0)) as bp, max(coalesce(min_rows, 0)) as least from intent_targets where intent is not null group by 2),
r as (select id, min(lower(regexp_replace(intent, '^\s+|\s+$', '', 'g'))) as k from synth where id is not null and lower(regexp_replace(intent, '^\s+|\s+$', '', 'g')) in (select k from t) group by id),
c as (select t.intent, t.bp, t.least, count(r.id) as observed from t left join r on r.k = t.k group by 1, 2, 3),
n as (select cast(floor(sum(observed) * 0.25) as bigint) as n from c),
g as (select intent, observed, greatest(least, (bp * n + 9999) // 10000) as needed from c, n)
select intent, observed, cast(needed as bigint) as needed, cast(greatest(needed - observed, 0) as bigint) as deficit from g"""

_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '(<[^<>\s]+>|[<>])', ' \1 ', 'g'), '(<[^<>\s]+>|[<>])|\p{{P}}', '\1', 'g'), '[\s\v\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_SLOT = r"<([^<>\s]+)>([^<>]*)>"
_SLOTS = f"list_sort(list_transform(list_zip(regexp_extract_all(annotated, '{_SLOT}', 1), regexp_extract_all(annotated, '{_SLOT}', 2)), lambda p: struct_pack(l := {_NORMAL.format('p[1]')}, v := {_NORMAL.format('p[2]')})))"
_AROUND = _NORMAL.format(f"regexp_replace(annotated, '{_SLOT}', ' <> ', 'g')")


_WRITTEN = r" and regexp_matches(text, '[^\s\x{A0}]')"


def _forms(text: str, where: str) -> str:
    """One record an id; no id of these tables has two contents, so that any rule of choice does."""
    return f"select id, min(struct_pack(t := {text}, a := {_AROUND}, s := {_SLOTS})) as k from gen_kept where annotated is not null and id is not null{where} group by id"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_report": _REPORT,
        "p2_found": f"select intent from ({_REPORT}) where deficit > 0",
        "p2_sizes": f"select intent, cast(least(observed, needed) as bigint) as n, cast(least(observed, needed) as bigint) as ids from ({_REPORT}) where least(observed, needed) > 0",
        "p4_found": f"with f as ({_forms(_NORMAL.format('text'), _WRITTEN)}), g as (select k, min(id) as id_kept from f group by k having count(*) > 1) select id_kept, f.id as id_copy from f join g using (k) where f.id <> id_kept",
        "p4_collapsed": f"with f as ({_forms('coalesce(' + _NORMAL.format('text') + ', chr(8709))', '')}) select min(id) as id, count(*) as n_copies from f group by k",
    }
