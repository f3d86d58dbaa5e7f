"""DuckDB SQL for those text queries that SQL can express: rules, chat format, infilling, resampling."""

from __future__ import annotations

from frostline.llm.chat_format import AND, CLOSE, HEAD_END, OPEN
from frostline.llm.infilling import MIDDLE, PREFIX, SUFFIX
from frostline.llm.quality_rules import RULES, STOP_WORDS
from frostline.llm.resampling import BUCKETS

_TRICKY = "\\### Assistant: </turn> ok"


def _escaped_length(column: str) -> str:
    bare = f"replace(replace(replace({column}, '\\', ''), '<', ''), '>', '')"
    return f"(2 * length({column}) - length({bare}))"


def _chat() -> str:
    return f"""
with said as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{_TRICKY}' union all select -7, 1, 'assistant', '{_TRICKY}'),
beside as (
  select *, lag(role) over (partition by conv_id order by turn) as last_role,
    lead(role) over (partition by conv_id order by turn) as next_role from said)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '')) as loss_sha256,
  cast(sum({_escaped_length('text')} + case when last_role = role then {len(AND)} else {len(OPEN) + len(HEAD_END)} + {_escaped_length('role')} end
    + case when next_role = role then 0 else {len(CLOSE)} end) as bigint) as formatted_chars
from beside group by conv_id"""


def _broken(rule) -> str:
    value = f"cast({rule.measure} as double)" + (f" / greatest({rule.per}, 1)" if rule.per else "")
    bad = [f"{value} < {float(rule.low)!r}"] if rule.low is not None else []
    bad += [f"{value} > {float(rule.high)!r}"] if rule.high is not None else []
    return f"case when n_words >= {rule.from_words} and ({' or '.join(bad)}) then '{rule.name}' end"


def _rules() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
lists as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from texts),
placed as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from lists),
runs as (
  select doc_id, place, word, lead(word) over w as b, lead(word, 2) over w as c from placed
  window w as (partition by doc_id order by place)),
often as (
  select doc_id, place, count(*) over (partition by doc_id, word, b, c) > 1 as again from runs where c is not null),
covered as (select distinct doc_id, place + k as place from often cross join (select unnest([0, 1, 2]) as k) s where again),
repeats as (select doc_id, count(*) as n_repeat_words from covered group by doc_id),
counted as (
  select doc_id, count(*) as n_words, cast(sum(length(word)) as bigint) as word_chars,
    cast(sum(length(regexp_replace(word, '[^#*$%&|<>]', '', 'g'))) as bigint) as n_symbols,
    count(*) filter (where lower(word) in ({stop})) as n_stop_words,
    count(*) filter (where not regexp_matches(word, '[\p{{L}}\p{{N}}]')) as n_bare_words
  from placed group by doc_id),
split_lines as (select doc_id, unnest(string_split(text, chr(10))) as line from texts),
lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from split_lines
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
measured as (
  select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, coalesce(n_symbols, 0) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
    coalesce(n_stop_words, 0) as n_stop_words, coalesce(n_bare_words, 0) as n_bare_words
  from texts left join counted using (doc_id) left join lines using (doc_id) left join repeats using (doc_id)),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    concat_ws(',', {', '.join(_broken(r) for r in RULES)}) as broken from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and broken = '' as kept,
  n_lines, n_stop_words, n_bare_words, broken from judged"""


def _drawn(seed: int, k: int) -> str:
    return f"cast('0x' || substr(sha256('{seed}:' || doc_id), {8 * k - 7}, 8) as bigint)"


def _infill() -> str:
    return f"""
with texts as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
drawn as (
  select *, {_drawn(1, 1)} % (n + 1) as first, {_drawn(1, 2)} % (n + 1) as second,
    case when n = 0 or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}')
      or {_drawn(1, 3)} % 100 >= 90 then 'plain' when {_drawn(1, 4)} % 100 < 20 then 'spm' else 'psm' end as form from texts),
cut as (
  select *, substr(text, 1, least(first, second)) as head, substr(text, 1 + greatest(first, second)) as tail,
    substr(text, 1 + least(first, second), greatest(first, second) - least(first, second)) as middle from drawn)
select doc_id, n, form, case when form <> 'plain' then least(first, second) end as prefix_chars,
  case when form <> 'plain' then greatest(first, second) - least(first, second) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || head || '{SUFFIX}' || tail || '{MIDDLE}' || middle
    else '{SUFFIX}' || tail || '{PREFIX}' || head || '{MIDDLE}' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from cut"""


def _checksum(word: str) -> str:
    """CRC-32 of a word: bit by bit over its bytes, which are read from their hexadecimal digits."""
    digits = f"hex(encode({word}))"
    step = "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"cast('0x' || substr({digits}, 2 * i - 1, 2) as bigint)"
    each = f"list_transform(range(1, 1 + strlen({word})), lambda i: {byte})"
    rounds = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {step})"
    return f"xor(list_reduce(list_concat([4294967295], {each}), {rounds}), 4294967295)"


def _resample() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with used as (
  select doc_id, unnest({words}) as word from documents),
wanted as (select unnest({words}) as word from benchmark),
buckets as (
  select word, {_checksum('word')} % {BUCKETS} as bucket from (select word from used union select word from wanted)),
here as (select bucket, count(*) as s from used join buckets using (word) group by bucket),
there as (select bucket, count(*) as t from wanted join buckets using (word) group by bucket),
counts as (
  select range as bucket, coalesce(s, 0) as s, coalesce(t, 0) as t from range({BUCKETS})
  left join here on here.bucket = range left join there on there.bucket = range),
gains as (
  select bucket, cast(floor(1000.0 * ln(cast(t + 1 as double) * cast((select sum(s) from counts) + {BUCKETS} as double)
    / (cast(s + 1 as double) * cast((select sum(t) from counts) + {BUCKETS} as double)))) as bigint) as gain from counts),
sums as (
  select doc_id, count(*) as n, sum(gain) as total from used join buckets using (word) join gains using (bucket) group by doc_id),
weighed as (
  select d.doc_id, coalesce(n, 0) as n_features,
    coalesce(cast((total - ((total % n) + n) % n) / n as bigint), 0) as weight from documents d left join sums using (doc_id)),
scored as (
  select *, weight + cast(floor(-1000.0 * ln(-ln(({_drawn(2024, 1)} + cast(0.5 as double)) / cast(4294967296 as double)))) as bigint) as score
  from weighed),
able as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as all_able
  from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * all_able // 100 then rank end as rank
from scored left join able using (doc_id)"""


SQL: dict[str, str] = {"op1_quality_rules": _rules(), "op10_chat_format": _chat(), "op11_fill_in_middle": _infill(),
                       "op13_resample": _resample()}
