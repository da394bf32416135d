"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

WORD = r"[\p{L}\p{Nl}\p{No}]+(?:''[\p{L}\p{Nl}\p{No}]+)*"
WORDS = f"list_transform(regexp_extract_all(text, '{WORD}'), lambda w: lower(w))"

P1 = f"""with r as (select sample_id, any_value(text) as text from manifest where text is not null group by 1), w as (select sample_id, {WORDS} as w from r), k as (select * from w where len(w) >= 40),
g as (select distinct sample_id, hash(array_to_string(w[i:i + 2], ' ')) as gram from (select sample_id, w, unnest(range(1, len(w) - 1)) as i from k)), n as (select sample_id, count(*) as n from g group by 1),
p as (select a.sample_id as sample_id_a, b.sample_id as sample_id_b, count(*) as shared from g a join g b on a.gram = b.gram and a.sample_id < b.sample_id group by 1, 2)
select sample_id_a, sample_id_b from p join n a on a.sample_id = sample_id_a join n b on b.sample_id = sample_id_b where 10 * shared >= 6 * (a.n + b.n - shared)"""

P1_LINKS = f"""with r as (select distinct sample_id, md5(text) as m, text from manifest where sample_id is not null and text is not null), w as (select m, {WORDS} as w from (select distinct m, text from r)), k as (select * from w where len(w) >= 40),
g as (select distinct m, hash(array_to_string(w[i:i + 2], ' ')) as gram from (select m, w, unnest(range(1, len(w) - 1)) as i from k)), n as (select m, count(*) as n from g group by 1),
p as (select a.m as x, b.m as y, count(*) as shared from g a join g b on a.gram = b.gram and a.m <> b.m group by 1, 2), l as (select x as m, count(*) as links from p join n a on a.m = x join n b on b.m = y where 10 * shared >= 6 * (a.n + b.n - shared) group by 1)
select sample_id, m as class_id, coalesce(links, 0)::bigint as links from r left join l using (m)"""

P2 = f"""with r as (select sample_id, any_value(text) as text, any_value(model_id) as model_id from manifest group by 1), v as (select sample_id, 'text' as field, unnest(list_distinct({WORDS})) as value from r union all select sample_id, 'model_id', model_id from r where model_id is not null),
c as (select field, value, count(*) as n from v group by 1, 2), m as (select field, value, case when n <= 2 then 'rare' when n > 0.2 * (select count(*) from r) then 'common' end as mark from c)
select field, value, mark from m where mark is not null"""

P3 = """with r as (select sample_id, any_value(text) as text from manifest where length(text) >= 200 group by 1), s as (select sample_id, i - 1 as place, md5(substring(text, i, 200)) as h from (select sample_id, text, unnest(range(1, length(text) - 198)) as i from r)),
x as (select h from s group by 1 having min(sample_id) <> max(sample_id)), k as (select sample_id, place from s join x using (h)),
o as (select *, case when place <= lag(place) over (partition by sample_id order by place) + 200 then 0 else 1 end as new from k), g as (select *, sum(new) over (partition by sample_id order by place) as part from o)
select sample_id, min(place)::bigint as span_start, (max(place) + 200)::bigint as span_end from g group by sample_id, part"""


P2_COUNTS = f"""with r as (select sample_id, any_value(text) as text, any_value(model_id) as model_id from manifest group by 1), v as (select sample_id, 'text' as field, unnest({WORDS}) as value from r union all select sample_id, 'model_id', model_id from r where model_id is not null)
select field, value, count(*) as occurrences, count(distinct sample_id) as records from v group by 1, 2"""

P2_CHANGES = P2_COUNTS.replace("any_value(text) as text,", "any_value(case when sample_id like '%7' and sample_id not like '%77' then 'revised ' || text else text end) as text,").replace("from manifest group", "from manifest where sample_id not like '%3' group")

P3_COVERAGE = f"""with f as ({P3}), c as (select sample_id, sum(span_end - span_start)::bigint as shared_chars from f group by 1), m as (select distinct sample_id, length(text)::bigint as chars from manifest where length(text) >= 200)
select sample_id, chars, coalesce(shared_chars, 0)::bigint as shared_chars, round(coalesce(shared_chars, 0) / chars, 6) as shared_part from m left join c using (sample_id)"""


P3_EXACT = """with t as (select distinct md5(text) as m, text from manifest where sample_id is not null and length(text) >= 200), s as (select m, i - 1 as place, md5(substring(text, i, 200)) as h from (select m, text, unnest(range(1, length(text) - 198)) as i from t)),
p as (select a.m as md5_a, b.m as md5_b, a.place as pa, b.place as pb, a.place - row_number() over (partition by a.m, b.m, a.place - b.place order by a.place) as part from s a join s b on a.h = b.h and a.m < b.m)
select md5_a, md5_b, min(pa)::bigint as a_start, (max(pa) + 200)::bigint as a_end, min(pb)::bigint as b_start, (max(pb) + 200)::bigint as b_end from p group by md5_a, md5_b, pa - pb, part"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Letters of the test tables that look like a Latin one; stated here once more, so that a wrong one in the operator shows.
ALIKE = "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ ҺH ԚQ ԜW οo νv αa ιi κk ρp υu χx ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϲc ͿJ"


def _form(text: str) -> str:
    """The consistent form for the characters of the test tables: composed accents, Latin letters, plain widths and spaces."""
    alike = {pair[0]: pair[1] for pair in ALIKE.split()} | {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï"} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    spaces = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
    gone = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF]))
    sources, targets = "".join(alike) + spaces + gone, "".join(alike.values()) + " " * len(spaces)
    out = f"translate({text}, {_q(sources)}, {_q(targets)})"
    for joined, plain in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        out = f"replace({out}, '{joined}', '{plain}')"
    return f"nfc_normalize({out})"


P8 = f"""with f as (select distinct doc_id, text, {_form('text')} as form from documents where text is not null), v as (select * from f where length(regexp_replace(form, '\\s', '', 'g')) >= 20)
select a.doc_id as doc_id_a, b.doc_id as doc_id_b from v a join v b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text"""


P8_CLASSES = f"""with f as (select distinct doc_id, text, {_form('text')} as form from documents where text is not null), v as (select doc_id, md5(form) as class_id, md5(text) as stored_id from f where length(regexp_replace(form, '\\s', '', 'g')) >= 20),
n as (select class_id, count(distinct stored_id) as spellings, count(*) as records from v group by 1) select doc_id, class_id, stored_id, spellings, records from v join n using (class_id)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p1_links": P1_LINKS, "p2_found": P2, "p2_counts": P2_COUNTS, "p2_changes": P2_CHANGES, "p3_found": P3, "p3_coverage": P3_COVERAGE, "p3_exact": P3_EXACT, "p8_found": P8, "p8_classes": P8_CLASSES}
