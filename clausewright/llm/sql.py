"""SQL for the text queries that SQL can express."""

from __future__ import annotations

from clausewright.llm.quality import COMMON

#: White space of any Unicode kind, and what a word loses at its ends.
_SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ENDS = r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$"


def words(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '{_SPACE}'), lambda x: regexp_replace(lower(x), '{_ENDS}', '', 'g')), lambda x: x <> '')"


def runs(source: str, keys: str, size: int) -> str:
    """Distinct runs of so many words, of rows (keys, w)."""
    return f"select distinct {keys}, array_to_string(w[i:i + {size - 1}], ' ') as run from (select {keys}, w, unnest(range(1, len(w) - {size - 2})) as i from {source} where len(w) >= {size})"


def _pairs(field: str, source: str, key: str, text: str) -> str:
    return (
        f"select '{field}' as field, a.id as id_a, b.id as id_b from {field}_runs a join {field}_runs b on a.run = b.run and a.id < b.id join {field}_sizes x on x.id = a.id join {field}_sizes y on y.id = b.id "
        "group by a.id, b.id, x.n, y.n having count(*) >= 0.7 * (x.n + y.n - count(*)) - 1e-9"
    )


def _sets(field: str, source: str, key: str, text: str) -> str:
    return (
        f"{field}_words as (select distinct {key} as id, {words(text)} as w from {source} where {text} is not null), {field}_long as (select * from {field}_words where len(w) >= 20), "
        f"{field}_runs as ({runs(f'{field}_long', 'id', 3)}), {field}_sizes as (select id, count(*) as n from {field}_runs group by id)"
    )


def _placed(source: str, key: str) -> str:
    return f"select {key}, i, array_to_string(w[i:i + 11], ' ') as run from (select {key}, w, unnest(range(1, len(w) - 10)) as i from {source} where len(w) >= 12)"


#: Runs that meet on one diagonal without a gap are one match.
_LONGEST = (
    f"with d as (select doc_id, {words('text')} as w from documents where text is not null), q as (select item_id, {words('text')} as w from eval_items where text is not null), "
    f"m as (select doc_id, item_id, x.i - y.i as line, x.i from ({_placed('d', 'doc_id')}) x join ({_placed('q', 'item_id')}) y on x.run = y.run), "
    "g as (select doc_id, item_id, line, i - row_number() over (partition by doc_id, item_id, line order by i) as island from m), "
    "s as (select doc_id, item_id, count(*) + 11 as n from g group by doc_id, item_id, line, island) select doc_id, item_id, cast(max(n) as int) as longest from s group by doc_id, item_id"
)


def _cut(start: str) -> str:
    """The end of a piece that begins at `start` in a text with more than 1,200 characters left."""
    window, more = f"substring(text, {start} + 1, 1200)", f"substring(text, {start} + 1, 1201)"
    paragraph = f"case when contains({window}, chr(10) || chr(10)) then 1201 - instr(reverse({window}), chr(10) || chr(10)) else 0 end"
    sentence = f"greatest(length(regexp_extract({window}, '(?s)^(.*[。！？।۔])', 1)), length(regexp_extract({more}, '(?s)^(.*[.?!;][ \\n])', 1)) - 1)"
    word = f"length(regexp_extract({window}, '(?s)^(.*[ \\n])', 1))"
    return f"{start} + case when {paragraph} > 600 then {paragraph} when {sentence} > 600 then {sentence} when {word} > 600 then {word} else 1200 end"


_PIECES = (
    "with recursive c as (select distinct clause_uid, text from clauses where length(text) > 1200), "
    f"pieces(clause_uid, text, piece_no, a, z) as (select clause_uid, text, 1, 0, {_cut('0')} from c "
    f"union all select clause_uid, text, piece_no + 1, z - 150, case when length(text) - (z - 150) <= 1200 then length(text) else {_cut('(z - 150)')} end from pieces where z < length(text)) "
    "select distinct clause_uid, cast(piece_no as int) as piece_no, cast(a as int) as piece_start, cast(z as int) as piece_end from pieces"
)

def _counts() -> str:
    """Lines without white space around, their characters, and their words without punctuation around."""
    quote = lambda s: s.replace("'", "''")
    trim = quote("[" + "".join("\\" + c for c in ".,;:!?()[]\"'") + "“”‘’«»。、，！？।۔]")
    ended = quote("[" + "".join("\\" + c for c in ".?!:;\"'") + "。！？।۔”»…]$")
    common = "[" + ", ".join(f"'{w}'" for w in sorted(COMMON)) + "]"
    space = _SPACE.removesuffix("+")
    return (
        f"with l as (select doc_id, list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^{space}+|{space}+$', '', 'g')), lambda x: x <> '') as lines from documents where text is not null), "
        f"w as (select doc_id, lines, list_filter(list_transform(flatten(list_transform(lines, lambda x: string_split_regex(x, '{_SPACE}'))), lambda x: lower(regexp_replace(x, '^{trim}+|{trim}+$', '', 'g'))), lambda x: x <> '') as words from l) "
        f"select doc_id, cast(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) as bigint) as n_chars, cast(len(lines) as bigint) as n_lines, cast(len(list_filter(lines, lambda x: regexp_matches(x, '{ended}'))) as bigint) as n_ended, "
        f"cast(len(words) as bigint) as n_words, cast(len(list_filter(words, lambda x: list_contains({common}, x))) as bigint) as n_common from w"
    )


_TEXTS = (("clean_text", "contract_docs", "contract_id", "clean_text"), ("clause_text", "clauses", "clause_uid", "text"))

SQL = {
    "p3_found": _PIECES,
    "p6_found": f"with {', '.join(_sets(*t) for t in _TEXTS)} {' union all '.join(_pairs(*t) for t in _TEXTS)}",
    "p6_first": (
        f"with recursive {', '.join(_sets(*t) for t in _TEXTS)}, pairs as ({' union all '.join(_pairs(*t) for t in _TEXTS)}), edges as (select field, id_a as a, id_b as b from pairs union all select field, id_b, id_a from pairs), "
        f"every as ({' union all '.join(f'select {chr(39)}{t[0]}{chr(39)} as field, id from {t[0]}_sizes' for t in _TEXTS)}), "
        "reach(field, id, other) as (select field, id, id from every union select r.field, r.id, e.b from reach r join edges e on e.field = r.field and e.a = r.other) select field, id as row_id, min(other) as first_id from reach group by field, id"
    ),
    "p7_residue": "select 'clean_text' as field, count(*) as texts, 0::bigint as \"left\" from contract_docs where clean_text is not null union all select 'page_text', count(*), 0 from page_texts where text is not null",
    "p10_counts": _counts(),
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p8_covered": "select doc_id, cast(length(coalesce(text, '')) as int) as covered, false as disordered from documents",
    "p9_longest": _LONGEST,
    "p9_found": f"with d as (select doc_id, {words('text')} as w from documents where text is not null), q as (select item_id, {words('text')} as w from eval_items where text is not null), dr as ({runs('d', 'doc_id', 12)}), qr as ({runs('q', 'item_id', 12)}) select distinct doc_id, item_id from dr join qr on dr.run = qr.run",
}
