"""SQL for words, shingles and windows, shared by the oracles of the training-data queries."""

from __future__ import annotations

from weftline.llm.prose import CLOSERS, ENDS, HAN_WEIGHT
from weftline.llm.prose import PLAIN as NO_SYMBOLS
from weftline.plans.sqltext import PLAIN, SPACE, WIDE, cleaned, quoted

#: A letter or digit that is no Han character, in runs; or one Han character.
WORD = r"\p{Han}|(?:[^\P{L}\p{Han}]|[^\P{N}\p{Han}])+"


#: Characters that are no symbols, and the end of a line that ends in punctuation, for RE2.
PLAIN_CLASS = NO_SYMBOLS.replace("-", "\\-")
END = "[" + "".join(sorted(ENDS)) + "][" + CLOSERS.replace("]", "\\]") + "]*$"


def unescaped(text: str) -> str:
    """Decimal references and the commonest named ones resolved; the test tables hold no others."""
    parts = f"regexp_extract_all({text}, '&#[0-9]+;|[^&]+|&')"
    plain = f"array_to_string(list_transform({parts}, lambda p: case when regexp_full_match(p, '&#[0-9]+;') then chr(cast(p[3:-2] as integer)) else p end), '')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        plain = f"replace({plain}, '{name}', {quoted(char)})"
    return f"case when contains({text}, '&') then {plain} else {text} end"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({cleaned(unescaped(text))}), {quoted(WORD)})"


def shingles(table: str, id: str, n: int, where: str = "true") -> str:
    """CTE body: distinct (id, s) of a table's runs of n words."""
    run = "concat_ws(' ', " + ", ".join(f"w[i + {k}]" for k in range(1, n + 1)) + ")"
    return f"select distinct id, {run} as s from (select id, w, unnest(range(len(w) - {n - 1})) as i from (select {id} as id, {words('text')} as w from {table} where text is not null and {where}))"


def similar(n: int, least: float, both: str) -> str:
    """Pairs (a, b) of ids in CTE ``s`` whose similarity reaches ``least``, of those that ``both`` lets through."""
    return f"""
n as (select id, count(*) as n from s group by 1),
c as (select x.id as a, y.id as b, count(*) as c from s x join s y on x.s = y.s and {both} group by 1, 2),
pairs as (select a, b from c join n p on p.id = a join n q on q.id = b where c >= {least} * (p.n + q.n - c))"""


_BLANKS = SPACE[:-1] + "*"
_HAN_WORDS = r"(select string_agg(word, '|' order by length(word) desc, word) from (select distinct word from common_words) where regexp_matches(word, '^\p{Han}'))"

#: Statistics of the lines of a text, blank ones aside.
P1 = rf"""
with d as (select doc_id, translate({unescaped("coalesce(text, '')")}, {quoted(WIDE)}, {quoted(PLAIN)}) as text from documents where doc_id is not null),
l as (select doc_id, regexp_replace(regexp_replace(x, {quoted("^" + _BLANKS)}, ''), {quoted(SPACE + "$")}, '') as s
  from (select doc_id, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) as x from d)),
w as (select doc_id, s, regexp_extract_all(lower(s), {quoted(WORD)}) as w from l where s <> ''),
h as (select list(distinct lower(word)) as known from common_words where not regexp_matches(word, '^\p{{Han}}')),
f as (select doc_id, length(s) - length(regexp_replace(s, '[^ ]', '', 'g')) as chars, len(w) as words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as letters,
  len(list_filter(w, lambda x: list_contains(known, x))) + {HAN_WEIGHT} * length(array_to_string(regexp_extract_all(s, {_HAN_WORDS}), '')) as common,
  length(regexp_replace(s, {quoted("[\\p{L}\\p{N}" + PLAIN_CLASS + "]")}, '', 'g')) as symbols, regexp_matches(s, {quoted(END)}) as ends from w, h),
g as (select doc_id, cast(sum(chars) as bigint) as chars, cast(sum(words) as bigint) as words, count(*) as lines, sum(letters) as letters, sum(common) as common, sum(symbols) as symbols, count(*) filter (ends) as ends from f group by 1)
select doc_id, coalesce(chars, 0) as chars, coalesce(words, 0) as words, coalesce(lines, 0) as lines, round(coalesce(letters / greatest(1, words), 0) + 1e-9, 6) as mean_word_length,
 round(coalesce(symbols / greatest(1, chars), 0) + 1e-9, 6) as symbol_ratio, round(coalesce(ends / greatest(1, lines), 0) + 1e-9, 6) as ending_lines, round(coalesce(common / greatest(1, words), 0) + 1e-9, 6) as common_words
from d left join g using (doc_id)"""

P2 = f"with s as ({shingles('documents', 'doc_id', 3)}), {similar(3, 0.5, 'x.id < y.id')} select a as doc_id_a, b as doc_id_b from pairs"

P2_GROUPS = f"""
with recursive s0 as ({shingles('documents', 'doc_id', 5)}),
v as (select id, md5(string_agg(s, chr(1) order by s)) as vector from s0 group by 1),
m as (select id, min(id) over (partition by vector) as class_id from v),
s as (select id, s from s0 join m using (id) where id = class_id),
{similar(5, 0.8, 'x.id < y.id')},
e as (select a as u, b as v from pairs union all select b, a from pairs),
r(id, root) as (select id, id from m where id = class_id union select e.v, r.root from r join e on e.u = r.id),
g as (select id, min(root) as group_id from r group by 1),
d as (select u, count(*) as links from e group by 1)
select m.id as doc_id, m.class_id, group_id, coalesce(links, 0) as links from m join g on g.id = m.class_id left join d on d.u = m.class_id"""

P4 = f"""
with t as (select record_id as id, split = 'train' as train, text from processed_records where split is not null),
s0 as ({shingles('t', 'id', 3)}), s as (select s0.id, s, train from s0 join t on t.id = s0.id),
{similar(3, 0.5, 'x.train and not y.train')} select least(a, b) as record_id_a, greatest(a, b) as record_id_b from pairs"""

P4_COUNTS = P4.rsplit("select least", 1)[0] + """
select split, nullif(lower(trim(source_id)), '') as source, count(*) as records, count(h.b) as found
from processed_records r left join (select distinct b from pairs) h on h.b = r.record_id where split is not null and split <> 'train' group by 1, 2"""

#: Vectors of counted word pairs: classes of equal ones of one side, cosines between classes of the two sides.
P4_WEIGHTED = f"""
with r as (select record_id as id, split = 'train' as train, {words('text')} as w from processed_records where text is not null and split is not null),
p as (select id, train, concat_ws(' ', w[i + 1], w[i + 2]) as s from (select id, train, w, unnest(range(len(w) - 1)) as i from r)),
v as (select id, train, s, count(*) as n from p group by 1, 2, 3),
m as (select id, train, string_agg(s || chr(0) || n, chr(1) order by s) as vector, sqrt(sum(n * n)) as norm from v group by 1, 2),
c as (select id, train, norm, min(id) over (partition by train, vector) as class_id from m),
k as (select v.*, norm from v join c using (id) where c.id = c.class_id),
l as (select x.id as a, y.id as b from k x join k y on x.s = y.s and x.train and not y.train group by 1, 2 having sum(x.n * y.n) / any_value(x.norm * y.norm) >= 0.8 - 1e-9),
e as (select a as class_id, count(*) as links from l group by 1 union all select b, count(*) from l group by 1)
select c.id as record_id, c.class_id, coalesce(links, 0) as links from c left join e on e.class_id = c.class_id"""

_ALNUM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_FIELD = r"^\s*([^\s:=][^:=]*?)\s*[:=]\s*(\S.*)$"

#: Canonical forms: leaves of a JSON object by path, lines of name and value, or letters and digits; for objects whose names hold no dot.
P5_FORMS = rf"""
with t as (select record_id, text, {_ALNUM.format('text')} as plain from raw_records),
o as (select record_id, text from t where plain <> '' and ltrim(text) like '{{%' and json_valid(text)),
l as (select record_id, lines from (select record_id, list_filter(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '\S')) as lines
  from t where plain <> '' and record_id not in (select record_id from o)) where len(lines) >= 3 and list_bool_and(list_transform(lines, lambda x: regexp_matches(x, {quoted(_FIELD)})))),
f as (select record_id, regexp_replace(lower(substr(fullkey, 2)), '[^\p{{L}}\p{{N}}.\[\]]', '', 'g') as name, {_ALNUM.format("coalesce(atom ->> '$', 'null')")} as value from o, json_tree(o.text) where type not in ('OBJECT', 'ARRAY')
  union all select record_id, '.' || {_ALNUM.format(f"regexp_extract(x, {quoted(_FIELD)}, 1)")}, {_ALNUM.format(f"regexp_extract(x, {quoted(_FIELD)}, 2)")} from (select record_id, unnest(lines) as x from l)),
g as (select record_id, 'f' || string_agg(name || '=' || value, ';' order by name, value) as form from f group by 1),
c as (select record_id, case when plain <> '' then coalesce(form, 't' || plain) end as form from t left join g using (record_id)),
m as (select record_id, case when form is null then record_id else min(record_id) over (partition by form) end as first, case when form is null then 1 else count(*) over (partition by form) end as copies from c)"""

P5 = P5_FORMS + " select first as first_record_id, record_id from m where record_id <> first"

P5_COPIES = P5_FORMS + " select record_id, copies from m where record_id = first"

P7 = f"""
with d as ({shingles('documents', 'doc_id', 12)}), i as ({shingles('benchmark', 'item_id', 12)})
select distinct d.id as doc_id, i.id as item_id from d join i on d.s = i.s"""

P7_ITEMS = f"select item_id, count(*) as documents from ({P7}) group by 1"

P9 = """
with w as (select distinct doc_id, md5(substr(text, i, 500)) as h from (select doc_id, text, unnest(range(1, length(text) - 498)) as i from documents where length(text) >= 500)),
m as (select w.doc_id, w.h from w join (select h from w group by 1 having count(*) > 1) using (h))
select distinct x.doc_id as doc_id_a, y.doc_id as doc_id_b from m x join m y on x.h = y.h and x.doc_id < y.doc_id"""

P9_SHARED = """
with w as (select doc_id, i, md5(substr(text, i, 500)) as h from (select doc_id, text, unnest(range(1, length(text) - 498)) as i from documents where length(text) >= 500)),
m as (select doc_id, i from w join (select h from w group by 1 having count(distinct doc_id) > 1) using (h)),
c as (select doc_id, cast(sum(n) as bigint) as shared from (select doc_id, least(500, coalesce(lead(i) over (partition by doc_id order by i) - i, 500)) as n from m) group by 1)
select doc_id, cast(length(text) as integer) as chars, coalesce(shared, 0) as shared, coalesce(shared / nullif(length(text), 0), 0) as share from documents left join c using (doc_id)"""
