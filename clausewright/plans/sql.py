"""SQL that gives the same rows as the queries, written for an engine without lookaround in its patterns."""

from __future__ import annotations

from clausewright.functions import fixed
from clausewright.operators import notes
from clausewright.plans.queries import CASES, EXPLANATIONS, LETTERS, PLAIN_RULES, REQUIRED, RULES, vocabulary


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(body: str) -> str:
    return f"regexp_replace({body}, '^{fixed.BLANK}+|{fixed.BLANK}+$', '', 'g')"


def replace_all(body: str, pattern: str, to: str) -> str:
    return f"regexp_replace({body}, {quoted(pattern)}, {to}, 'g')"


def normalized(body: str) -> str:
    out = f"coalesce({body}, '')"
    out = replace_all(out, r"\r\n?", "chr(10)")
    out = replace_all(out, r"[\x{A0}\x{2007}\x{202F}]", "' '")
    out = replace_all(out, r"(\p{L})-\n(\p{L})", r"'\1\2'")
    out = replace_all(out, r"[ \t]+\n", "chr(10)")
    out = replace_all(out, rf"(?m)^[ \t]{{0,6}}({fixed.ENUMERATOR})[ \t]+({fixed.TITLE})[ \t]*$", r"chr(10)||chr(10)||'\1 \2'||chr(10)||chr(10)")
    out = replace_all(out, r"\n{3,}", "chr(10)||chr(10)")
    out = f"replace(replace(replace({out}, chr(10)||chr(10), chr(1)), chr(10), ' '), chr(1), chr(10)||chr(10))"
    out = replace_all(out, r"[ \t]{2,}", "' '")
    out = replace_all(out, r"\n{3,}", "chr(10)||chr(10)")
    return strip(out)


CONTRACTS = "contracts as (select distinct contract_id, clean_text as text from contract_docs where clean_text is not null)"
PAGES = f"pages as (select contract_id, page_no, {normalized('text')} as text from (select distinct contract_id, page_no, text from page_texts))"
STARTS = "starts as (select contract_id, page_no, cast(coalesce(sum(length(text) + 2) over (partition by contract_id order by page_no rows between unbounded preceding and 1 preceding), 0) as int) as start_at from pages)"
CLAUSES = "latest as (select clause_uid, max_by(struct_pack(contract_id := contract_id, clause_type := clause_type, text := text, span_start := span_start, span_end := span_end, loaded_at := loaded_at), loaded_at) as r from clauses group by clause_uid), own as (select clause_uid, r.contract_id as contract_id, r.clause_type as clause_type, r.text as text, r.span_start as span_start, r.span_end as span_end, r.loaded_at as loaded_at from latest)"
PARAGRAPHS = (
    r"pieces as (select contract_id, text, string_split(regexp_replace(text, '(\n[ \t\n\v\f\r]*\n)', chr(1) || '\1' || chr(1), 'g'), chr(1)) as p from contracts), "
    "numbered as (select contract_id, text, unnest(p) as piece, generate_subscripts(p, 1) as i from pieces), "
    "placed as (select contract_id, text, piece, i, cast(coalesce(sum(length(piece)) over (partition by contract_id order by i rows between unbounded preceding and 1 preceding), 0) as int) as span_start from numbered), "
    "paragraphs as (select contract_id, text, piece, span_start, cast(span_start + length(piece) as int) as span_end, cast(row_number() over (partition by contract_id order by i) as int) as para_no from placed where i % 2 = 1 and piece <> '')"
)
HEADING = rf"(?:{fixed.ENUMERATOR})[ \t\n\v\f\r]+{fixed.TITLE}"
SEGMENTS = (
    f"heads as (select *, {strip('piece')} as bare, case when regexp_full_match({strip('piece')}, {quoted(HEADING)}) then 1 else 0 end as head from paragraphs), "
    "runs as (select *, sum(head) over (partition by contract_id order by para_no) as run, max(head) over (partition by contract_id) as any_head from heads), "
    f"firsts as (select contract_id, text, cast(length(text) - length(regexp_replace(text, '^{fixed.BLANK}+', '')) as int) as first_at from contracts), "
    "segments as ("
    "select contract_id, 'clause-' || run as clause_id, 'UNCLASSIFIED' as type, min(span_start) as span_start, max(span_end) as span_end, any_value(text) as text from runs where run > 0 group by contract_id, run "
    "union all select r.contract_id, 'clause-0', 'PREAMBLE', any_value(f.first_at), max(r.span_end), any_value(r.text) from runs r join firsts f on r.contract_id = f.contract_id where run = 0 and any_head = 1 group by r.contract_id "
    f"having max(r.span_end) - any_value(f.first_at) >= {fixed.LEAST_PREAMBLE} "
    f"union all select contract_id, 'para-' || row_number() over (partition by contract_id order by para_no), 'UNCLASSIFIED', span_start, span_end, text from runs where any_head = 0 and length(bare) >= {fixed.LEAST_PARAGRAPH})"
)


def ranked_types(body: str) -> str:
    """A list of (less, ord, type) of the types with a score, best first."""
    scores = []
    for order, (kind, cues) in enumerate(fixed.CUES.items()):
        total = " + ".join(f"case when {f'contains(l, {quoted(cue)})' if not set(cue) & set('.*{}[]()|^$?+' + chr(92)) else f'regexp_matches(l, {quoted(cue)})'} then {float(weight)} else 0.0 end" for cue, weight in cues)
        scores.append(f"struct_pack(less := cast(-({total}) as double), ord := {order}, type := '{kind}')")
    return f"list_sort(list_filter([{', '.join(scores)}], lambda s: s.less < 0))".replace("(l,", f"({body},")


def typed(source: str, columns: str, kept: str = "'UNCLASSIFIED'") -> str:
    """Rows of the source (with text) and their assigned type."""
    return (
        f"lowered as (select *, lower(coalesce(text, '')) as l from {source}), ranked as (select *, {ranked_types('l')} as r from lowered), "
        f"typed as (select {columns}, case when r[1].less <= -1.5 then r[1].type else {kept} end as assigned_type, round(case when r[1].less <= -1.5 then least(1.0, -r[1].less / 6.0) else 0.0 end, 6) as confidence, "
        "case when r[1].less <= -1.5 then r[2].type else r[1].type end as runner_up from ranked)"
    )


TOKENS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: length(w) > 1 and w not in ({1}))"
STOP = ", ".join(quoted(w) for w in fixed.STOP_WORDS)


def tokens(body: str) -> str:
    return TOKENS.format(body, STOP)


SEARCH = "coalesce(heading, '') || '. ' || coalesce(summary, '') || case when trim(coalesce(bare_act, '')) <> '' then ' ' || bare_act else '' end || ' ' || coalesce(array_to_string(topics, ' '), '')"
BM25 = (
    f"corpus as (select ord, clause_types, {tokens(SEARCH)} as t from provisions), size as (select count(*) as n, greatest(avg(len(t)), 1e-9) as mean from corpus), "
    "each_term as (select ord, len(t) as length, unnest(t) as term from corpus), tf as (select ord, length, term, count(*) as tf from each_term group by all), df as (select term, count(*) as df from tf group by term), "
    "weights as (select tf.ord, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)) as weight from tf join df on tf.term = df.term cross join size), "
    f"query_terms as (select clause_uid, unnest({tokens('text')}) as term from own where text is not null), counted as (select clause_uid, term, count(*) as qtf from query_terms group by all), "
    "scores as (select clause_uid, ord, sum(qtf * weight) as score from counted join weights on counted.term = weights.term group by clause_uid, ord)"
)


def vectors(name: str, source: str, key: str, body: str) -> str:
    """A relation (key, v) of the vectors that stand in for an encoder's."""
    counts = ", ".join(f"cast(length(lower(coalesce({body}, ''))) - length(replace(lower(coalesce({body}, '')), '{c}', '')) as double)" for c in LETTERS)
    return (
        f"{name}_raw as (select {key}, [{counts}] as r from {source}), "
        f"{name} as (select {key}, case when list_dot_product(r, r) = 0 then r else list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) end as v from {name}_raw)"
    )


CUE_ROWS = ", ".join(f"({quoted(kind)}, {quoted(cue)})" for kind, weighted in fixed.CUES.items() for cue, _ in weighted)
BY_VECTOR = f"{vectors('qv', 'own', 'clause_uid', 'text')}, {vectors('pv', 'provisions', 'ord', SEARCH)}, by_vector as (select qv.clause_uid, pv.ord, list_dot_product(qv.v, pv.v) as emb from qv join own on own.clause_uid = qv.clause_uid cross join pv where own.text is not null)"


#: Entity rules without lookahead: what a pattern looks ahead for is consumed instead; and what stands before the group.
_AHEAD = {r"(?=[.,;]| and| whose)": r"(?:[.,;]| and| whose)", r"(?=[.,; ]|and)": r"(?:[.,; ]|and)"}
_BEFORE_GROUP = {
    "GOVERNING_LAW": r"^governed by (?:and construed in accordance with )?the laws (?:of|in force in) ",
    "JURISDICTION": r"^(?:(?:courts?|tribunals?)\s+(?:at|of|in|within)\s+|seat (?:and venue )?of arbitration shall be )",
}


def entity_rows(rules: tuple = PLAIN_RULES, spans: bool = False) -> str:
    parts = []
    for order, (kind, pattern, group, loose) in enumerate(rules):
        for ahead, consumed in _AHEAD.items():
            pattern = pattern.replace(ahead, consumed)
        flagged = quoted(f"(?i){pattern}" if loose else pattern)
        lead = f"length(regexp_extract(w[i], {quoted('(?i)' + _BEFORE_GROUP[kind])}))" if kind in _BEFORE_GROUP else "2" if pattern.startswith(r"\(") else "0"
        at = f", length(list_aggregate(p[1:i], 'string_agg', '')) + coalesce(length(list_aggregate(w[1:i - 1], 'string_agg', '')), 0) + {lead} as pos" if spans else ""
        cut = f", regexp_extract_all(text, {flagged}, 0) as w, string_split_regex(text, {flagged}) as p" if spans else ""
        parts.append(f"select contract_id, {order} as rule, '{kind}' as entity_type, m[i] as raw, i{at} from (select *, unnest(range(1, len(m) + 1)) as i from (select contract_id, regexp_extract_all(text, {flagged}, {group}) as m{cut} from contracts))")
    lead, tail = quoted(f"(?i){fixed.PARTY_LEAD}"), quoted(f"(?i){fixed.PARTY_TAIL}")
    party = strip(f"regexp_replace({strip(f'regexp_replace(bare, {lead}, {quoted(str())})')}, {tail}, '')")
    few = f"len(string_split_regex(value, '[ \\t\\n\\v\\f\\r]+')) <= {fixed.LONGEST_PARTY_WORDS}"
    none = ", ".join(quoted(w) for w in fixed.NOT_A_PARTY)
    more, columns = (", pos, raw", "contract_id, cast(row_number() over (partition by contract_id order by rule, i) as int) as entity_no, entity_type, value as text, cast(pos as int) as span_start, cast(pos + length(raw) as int) as span_end, 1.0::double as confidence") if spans else ("", "contract_id, entity_type, value as text")
    return (
        f"with {CONTRACTS}, raw as ({' union all '.join(parts)}), stripped as (select *, {strip('raw')} as bare from raw), kept as (select * from stripped where bare <> '' and length(bare) <= {fixed.LONGEST_ENTITY}), "
        f"cleaned as (select contract_id, rule, i, entity_type, case when entity_type = 'PARTY' then {party} else bare end as value{more} from kept), "
        f"good as (select * from cleaned where entity_type <> 'PARTY' or ({few} and lower(value) not in ({none}) and not contains(value, chr(10)) and regexp_matches(value, '\\p{{Ll}}'))), "
        f"numbered as (select *, row_number() over (partition by contract_id, entity_type, lower(value) order by rule, i) as n from good) select {columns} from numbered where n = 1"
    )


def label(raw: str) -> str:
    spaced = f"lower(trim(translate({raw}, '_-', '  ')))"
    return f"case when {spaced} = '' then {raw} else upper(substring({spaced}, 1, 1)) || substring({spaced}, 2) end"


def _unit() -> str:
    return (
        "parts as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings where embedding is not null and label is not null), "
        "means as (select label, pos, avg(cast(x as double)) as x from parts group by label, pos), lengths as (select label, sqrt(sum(x * x)) as length from means group by label), "
        "centres as (select m.label as label, pos, case when length = 0 then x else x / length end as x from means m join lengths l on m.label = l.label)"
    )


COSINES = f"{_unit()}, items as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings where embedding is not null), cosines as (select vec_id, label, sum(cast(i.x as double) * c.x) as score from items i join centres c on i.pos = c.pos group by vec_id, label)"


def supported(source: str) -> str:
    lowered = f"lower({source})"
    numbers = "regexp_extract_all(p.summary, '\\d[\\d,./-]*')"
    digits = "regexp_replace(n, '[^\\d]', '', 'g')"
    return (
        f"length(p.summary) >= 40 and length(p.summary) <= greatest(700, floor(length(p.heading) * 3 / 2) + 200) "
        f"and len(list_filter(regexp_extract_all(p.summary, '(?i)\\bsection\\s+\\d+[A-Za-z]?'), lambda s: not contains(lower(p.provision), lower(s)))) = 0 "
        f"and len(list_filter({numbers}, lambda n: length({digits}) >= 2 and not contains({lowered}, lower(n)) and not contains(regexp_replace({lowered}, '[^\\d]', ' ', 'g'), {digits}))) = 0"
    )


def _cases() -> str:
    base = ", ".join(f"({quoted(name)}, cast(null as varchar), {quoted(body)})" for name, body, _ in CASES)
    changed = ", ".join(f"({quoted(name)}, {quoted(f'{old} -> {new}')}, {quoted(body.replace(old, new))})" for name, body, pairs in CASES for old, new in pairs.items())
    return f"texts(name, variant, text) as (values {base}, {changed})"


def _flag_rows(key: str) -> str:
    parts = []
    for rule in RULES:
        holds = " and ".join(filter(None, [f"clause_type = '{rule.type}'" if rule.type else "", f"regexp_matches(text, {quoted('(?i)' + rule.pattern)})" if rule.pattern else "", f"not regexp_matches(text, {quoted('(?i)' + rule.unless)})" if rule.unless else ""]))
        parts.append(f"select {key}, '{rule.severity}' as severity, '{rule.category}' as category from own where {holds}")
    return " union all ".join(parts)


ENTRIES = "entries as (select distinct id, display_name, analyzed_at_epoch_millis, clause_count, risk_count, entity_count, highest_severity, content_hash from library_entries)"


def _shown() -> str:
    clean = strip("regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', ' ', 'g')")
    return (
        f"with {CLAUSES}, clean as (select *, {clean} as c from own), cut as (select *, case when contains(substring(c, 1, 121), ' ') then 121 - instr(reverse(substring(c, 1, 121)), ' ') else -1 end as space from clean) "
        f"select clause_uid, case when clause_type is null or {strip('clause_type')} = '' or upper(clause_type) = 'UNCLASSIFIED' then 'Unclassified' else {label('clause_type')} end as label, "
        f"case when length(c) <= 120 then c else regexp_replace(substring(c, 1, case when space < 96 then 120 else space end), '{fixed.BLANK}+$', '') || '…' end as short, "
        "case when instr(text, '. ') > 31 then substring(text, 1, instr(text, '. ')) when length(text) <= 200 then text else substring(text, 1, 197) || '...' end as first_sentence from cut"
    )


REQUIRED_ROWS = ", ".join(f"('{t}', '{s}', '{c}')" for t, s, c in REQUIRED)
END = "lower(regexp_extract({0}, '\\.([A-Za-z0-9]+)$', 1))"
PATH_END = END.format("coalesce(source_path, '')")

SQL = {
    "segmented_and_classified": f"with {CONTRACTS}, {PARAGRAPHS}, {SEGMENTS}, stripped as (select contract_id, clause_id, type, {strip('substring(text, span_start + 1, span_end - span_start)')} as text from segments), {typed('stripped', 'contract_id, clause_id', 'type')} select * from typed",
    "normalized_pages": f"select distinct page_uid, {normalized('text')} as text from page_texts",
    "page_offsets": f"with {PAGES}, {STARTS} select * from starts",
    "joined_pages": f"with {PAGES}, joined as (select contract_id, string_agg(text, chr(10)||chr(10) order by page_no) as text from pages group by contract_id) select contract_id, {strip('text')} as text from joined",
    "clause_pages": f"with {PAGES}, {STARTS}, {CLAUSES} select clause_uid, case when count(s.page_no) = 0 then 0 else coalesce(max_by(s.page_no, s.start_at) filter (where s.start_at <= o.span_start), min_by(s.page_no, s.start_at)) end as page from own o left join starts s on o.contract_id = s.contract_id group by clause_uid",
    "paragraph_spans": f"with {CONTRACTS}, {PARAGRAPHS} select contract_id, para_no, span_start, span_end from paragraphs",
    "clause_segments": f"with {CONTRACTS}, {PARAGRAPHS}, {SEGMENTS} select contract_id, clause_id, type, {strip('substring(text, span_start + 1, span_end - span_start)')} as text, span_start, span_end from segments",
    "classified_clauses": f"with {CLAUSES}, {typed('own', 'clause_uid')} select * from typed",
    "entity_values": entity_rows(),
    "bm25_scores": f"with {CLAUSES}, {BM25} select clause_uid, ord, round(score, 6) as score from scores",
    "grounded_clauses": (
        f"with {CLAUSES}, {BM25}, dense as (select o.clause_uid, o.clause_type, o.text, c.ord, c.clause_types, coalesce(s.score, 0.0) as score from own o cross join corpus c left join scores s on s.clause_uid = o.clause_uid and s.ord = c.ord), "
        "bounds as (select *, min(score) over (partition by clause_uid) as low, max(score) over (partition by clause_uid) as high from dense), "
        "fused as (select clause_uid, ord, text, round(0.75 * case when high - low <= 1e-9 then 0.0 else (score - low) / (high - low) end + case when clause_type is not null and clause_type <> 'UNCLASSIFIED' and list_contains(clause_types, clause_type) then 0.55 else 0.0 end, 12) as value from bounds), "
        "kept as (select clause_uid, ord, least(1.0, value) as score, row_number() over (partition by clause_uid order by least(1.0, value) desc, ord) as rank from fused where value >= 0.30 and trim(coalesce(text, '')) <> '') "
        "select clause_uid, cast(rank as int) as rank, ord, round(score, 6) as score, 'bm25' as method from kept where rank <= 3"
    ),
    "label_centroids": f"with {_unit()} select label, cast(pos as int) as pos, round(x, 6) as x from centres",
    "nearest_labels": f"with {COSINES}, ranked as (select *, row_number() over (partition by vec_id order by score desc, label) as n from cosines) select a.vec_id, a.label as best, round(a.score, 6) as score, b.label as runner_up, round(b.score, 6) as second_score, (a.score >= 0.55 and coalesce(a.score - b.score, 9) >= 0.015) as accepted from ranked a left join ranked b on a.vec_id = b.vec_id and b.n = 2 where a.n = 1",
    "vector_matches": (
        "with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0), pairs as (select query_id, vec_id, round(list_dot_product(cast(embedding as double[]), cast(q as double[])), 6) as score from embeddings join q on vec_id <> query_id), "
        "ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 3"
    ),
    "ensemble_types": (
        f"with {CLAUSES}, rows as (select clause_uid, text, lower(text) as l from own where text is not null), {vectors('rv', 'rows', 'clause_uid', 'text')}, cues(label, text) as (values {CUE_ROWS}), {vectors('cv', 'cues', 'label', 'text')}, "
        "parts as (select label, unnest(v) as x, generate_subscripts(v, 1) as pos from cv), means as (select label, pos, avg(x) as x from parts group by label, pos), "
        "centres as (select label, case when sqrt(sum(x * x) over (partition by label)) = 0 then x else x / sqrt(sum(x * x) over (partition by label)) end as x, pos from means), held as (select label, list(x order by pos) as v from centres group by label), "
        f"cosines as (select clause_uid, label as type, round(list_dot_product(rv.v, held.v), 9) as cosine from rv cross join held), cued as (select clause_uid, unnest({ranked_types('l')}) as s from rows), keyed as (select clause_uid, s.type as type, -s.less as score, max(-s.less) over (partition by clause_uid) as most from cued), "
        "valued as (select c.clause_uid, c.type, 0.6 * cosine + 0.4 * coalesce(score, 0.0) / coalesce(most, 1.0) as value from cosines c left join keyed k on c.clause_uid = k.clause_uid and c.type = k.type), "
        "ranked as (select *, row_number() over (partition by clause_uid order by value desc, type) as n from valued) select a.clause_uid, case when a.value >= 0.42 then a.type else 'UNCLASSIFIED' end as assigned_type, round(greatest(0.0, a.value), 6) as confidence, case when a.value >= 0.42 then b.type else a.type end as runner_up from ranked a left join ranked b on a.clause_uid = b.clause_uid and b.n = 2 where a.n = 1"
    ),
    "vector_scores": f"with {CLAUSES}, {BY_VECTOR}, ranked as (select clause_uid, ord, round(emb, 6) as score, row_number() over (partition by clause_uid order by round(emb, 6) desc, ord) as rank from by_vector) select clause_uid, cast(rank as int) as rank, ord, score from ranked where rank <= 5",
    "hybrid_grounding": (
        f"with {CLAUSES}, {BM25}, {BY_VECTOR}, dense as (select o.clause_uid, o.clause_type, o.text, c.ord, c.clause_types, coalesce(s.score, 0.0) as bm, coalesce(e.emb, 0.0) as emb from own o cross join corpus c left join scores s on s.clause_uid = o.clause_uid and s.ord = c.ord left join by_vector e on e.clause_uid = o.clause_uid and e.ord = c.ord), "
        "bounds as (select *, min(bm) over w as low, max(bm) over w as high, min(emb) over w as least, max(emb) over w as most from dense window w as (partition by clause_uid)), "
        "fused as (select clause_uid, ord, text, round(0.45 * case when high - low <= 1e-9 then 0.0 else (bm - low) / (high - low) end + 0.30 * case when most - least <= 1e-9 then 0.0 else (emb - least) / (most - least) end + case when clause_type is not null and clause_type <> 'UNCLASSIFIED' and list_contains(clause_types, clause_type) then 0.55 else 0.0 end, 12) as value from bounds), "
        "kept as (select clause_uid, ord, least(1.0, value) as score, row_number() over (partition by clause_uid order by least(1.0, value) desc, ord) as rank from fused where value >= 0.30 and trim(coalesce(text, '')) <> '') "
        "select clause_uid, cast(rank as int) as rank, ord, round(score, 6) as score, 'hybrid' as method from kept where rank <= 3"
    ),
    "clause_flags": f"with {CLAUSES} {_flag_rows('clause_uid')}",
    "missing_clause_types": f"with {CLAUSES}, required(type, severity, category) as (values {REQUIRED_ROWS}), docs as (select distinct contract_id from own) select d.contract_id, r.type, r.severity, r.category from docs d cross join required r where not exists (select 1 from own o where o.contract_id = d.contract_id and o.clause_type = r.type)",
    "contract_severity": f"with {CLAUSES}, flagged as ({_flag_rows('contract_id')}) select contract_id, case max(case severity when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end) when 2 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as severity from flagged group by contract_id",
    "notice_days": f"with {CLAUSES} select clause_uid, coalesce(list_max(list_transform(regexp_extract_all(text, '(?i)(\\d{{1,3}})\\s*(?:\\(\\d{{1,3}}\\)\\s*)?days', 1), lambda n: cast(n as int))), 0) as days from own where text is not null",
    "sentences_in_clauses": f"with {CLAUSES} select distinct s.sent_uid, o.clause_uid from sentences s join own o on s.contract_id = o.contract_id and s.span_start >= o.span_start and s.span_start < o.span_end",
    "library_listed": f"with {ENTRIES} select id, display_name, analyzed_at_epoch_millis from entries where id is not null and analyzed_at_epoch_millis is not null",
    "library_search": f"with {ENTRIES} select id, display_name from entries where contains(lower(display_name), 'agreement')",
    "library_newest": f"with {ENTRIES}, ranked as (select *, row_number() over (partition by content_hash order by analyzed_at_epoch_millis desc, id desc) as n from entries where trim(coalesce(content_hash, '')) <> '') select content_hash, id, analyzed_at_epoch_millis from ranked where n = 1",
    "unseen_contracts": "select distinct contract_id, content_hash from contract_docs d where not exists (select 1 from library_entries e where e.content_hash = d.content_hash)",
    "content_copies": f"with {CONTRACTS} select sha256(text) as text_hash, count(distinct contract_id) as copies, min(contract_id) as first_id from contracts group by 1",
    "latest_clauses": f"with {CLAUSES} select clause_uid, clause_type, epoch_us(loaded_at) as loaded_micros from own",
    "clause_display": _shown(),
    "entity_labels": f"select case when entity_type is null or {strip('entity_type')} = '' then 'Other' else {label('entity_type')} end as label, count(distinct entity_uid) as n from entities group by 1",
    "supported_notes": f"select p.ord, ({supported('concat_ws(chr(32), p.summary, p.bare_act)')}) as by_itself, ({supported('concat_ws(chr(32), o.summary, o.bare_act)')}) as by_other from provisions p join provisions o on p.ord = o.ord + 1",
    "counterfactual_audit": (
        f"with {_cases()}, {typed('texts', 'name, variant')}, sets as (select name, variant, case when assigned_type = 'UNCLASSIFIED' then '' else 'clause:' || assigned_type end as s from typed) "
        "select v.name, v.variant, case when v.s <> b.s then v.s else '' end as added, case when v.s <> b.s then b.s else '' end as removed, v.s = b.s as stable from sets v join sets b on v.name = b.name and b.variant is null where v.variant is not null"
    ),
    "contract_terms": (
        "with firsts as (select contract_id, entity_type, text, min(struct_pack(a := span_start, b := entity_uid)) as f from entities where entity_type is not null and text is not null group by all), ranked as (select *, row_number() over (partition by contract_id, entity_type order by f, text) as n from firsts) "
        "select contract_id, entity_type, string_agg(text, '; ' order by n) as terms from ranked where n <= 6 group by contract_id, entity_type"
    ),
    "upload_reasons": (
        f"select distinct contract_id, case {PATH_END} when 'pdf' then 'application/pdf' when 'docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' when 'txt' then 'text/plain' when 'html' then 'text/html' when 'htm' then 'text/html' else 'application/octet-stream' end as media_type, "
        f"case when source_path is null or trim(source_path) = '' then 'No file was given.' when clean_text is null then 'The file could not be found.' when {PATH_END} not in ('docx', 'pdf', 'txt') then 'This type of file is not supported.' when length(clean_text) = 0 then 'The file is empty.' when length(clean_text) > {fixed.UPLOAD_BYTES} then 'The file is larger than 25 MB.' end as reason from contract_docs"
    ),
}

_FIRST = "case when instr(p.summary, '. ') > 31 then substring(p.summary, 1, instr(p.summary, '. ')) when length(p.summary) <= 200 then p.summary else substring(p.summary, 1, 197) || '...' end"
SQL["clause_notes"] = (
    f"with {CLAUSES}, flagged as ({_flag_rows('clause_uid')}), matched as ({SQL['grounded_clauses']}), best as (select m.clause_uid, p.act, 'Related law - ' || p.act || ', ' || p.provision || ': ' || {_FIRST} as law from matched m join provisions p on m.ord = p.ord where m.rank = 1) "
    f"select f.clause_uid, case severity when 'HIGH' then 'High-priority point: ' when 'MEDIUM' then 'Worth checking: ' else 'Minor note: ' end || {label('category')} as headline, concat_ws(' ', 'Found by the rule ' || category || '.', law) as body, case when act is null then 1 else 2 end as citations from flagged f left join best b on f.clause_uid = b.clause_uid"
)

SENTENCES_ON_PAGES = "told as (select s.sent_uid, s.contract_id, s.span_start, case when count(p.page_no) = 0 then 0 else coalesce(max_by(p.page_no, p.start_at) filter (where p.start_at <= s.span_start), min_by(p.page_no, p.start_at)) end as page from (select distinct sent_uid, contract_id, span_start from sentences) s left join starts p on s.contract_id = p.contract_id group by all)"
EXPLANATION_ROWS = ", ".join(f"({quoted(t)}, {quoted(b)})" for t, b in EXPLANATIONS)
_LAW = "p.act || ', ' || p.provision || ': ' || p.summary"
#: Contract texts as the pipeline joins them, in place of the stored ones; and its clauses with their types.
_JOINED = SQL["joined_pages"].removeprefix("with ").rsplit(" select contract_id", 1)
ANALYSED = (
    f"{_JOINED[0]}, contracts as (select contract_id{_JOINED[1]}), {PARAGRAPHS}, {SEGMENTS}, stripped as (select contract_id, clause_id, type, span_start, {strip('substring(text, span_start + 1, span_end - span_start)')} as text from segments), "
    f"{typed('stripped', 'contract_id, clause_id, span_start, text', 'type')}, own as (select *, assigned_type as clause_type, contract_id || '/' || clause_id as clause_uid from typed)"
)
_PARTS = f"flagged as ({_flag_rows('contract_id, clause_uid')}), lacking as (select d.contract_id, r.category from (select distinct contract_id from own) d cross join required r where not exists (select 1 from own o where o.contract_id = d.contract_id and o.clause_type = r.type))"
_COUNTS = (
    "select coalesce(a.contract_id, b.contract_id, c.contract_id) as contract_id, coalesce(clause_count, 0) as clause_count, coalesce(risk_count, 0) as risk_count, coalesce(entity_count, 0) as entity_count from (select contract_id, count(*) as clause_count from own group by contract_id) a "
    "full join (select contract_id, count(*) as risk_count from flagged group by contract_id) b on a.contract_id = b.contract_id full join (select contract_id, count(distinct entity_uid) as entity_count from entities group by contract_id) c on coalesce(a.contract_id, b.contract_id) = c.contract_id"
)
SQL |= {
    "extracted_entities": entity_rows(fixed.ENTITY_RULES, spans=True),
    "sentence_pages": f"with {PAGES}, {STARTS}, {SENTENCES_ON_PAGES} select sent_uid, page from told",
    "clause_sentence_pages": f"with {PAGES}, {STARTS}, {SENTENCES_ON_PAGES}, {CLAUSES} select clause_uid, coalesce(arg_max(t.page, struct_pack(a := t.span_start, b := t.page)) filter (where t.span_start <= o.span_start), 0) as page from own o left join told t on o.contract_id = t.contract_id group by clause_uid",
    "explained_clauses": f"with {CLAUSES}, told(type, body) as (values {EXPLANATION_ROWS}) select clause_uid, 'What this clause does: ' || {label('clause_type')} as headline, body, text as cited from own join told on type = clause_type where text is not null",
    "document_notes": f"with {CLAUSES}, required(type, severity, category) as (values {REQUIRED_ROWS}), firsts as (select contract_id, min_by(struct_pack(t := text), clause_uid) as f from own group by contract_id) select d.contract_id, case severity when 'MEDIUM' then 'Worth checking: ' else 'Minor note: ' end || {label('category')} as headline, 'Found by the rule ' || category || '.' as body, d.f.t as cited from firsts d cross join required r where not exists (select 1 from own o where o.contract_id = d.contract_id and o.clause_type = r.type)",
    "rephrase_prompts": (
        f"with {CLAUSES}, flagged as ({_flag_rows('clause_uid')}), matched as ({SQL['grounded_clauses']}), best as (select m.clause_uid, {_LAW} as law from matched m join provisions p on m.ord = p.ord where m.rank = 1), "
        "asked as (select f.clause_uid, category, o.text as clause, 'Found by the rule ' || category || '.' as body, coalesce(case when length(law) <= 180 then law else substring(law, 1, 180) || ' ...' end, '') as allowed from flagged f join own o on f.clause_uid = o.clause_uid left join best b on f.clause_uid = b.clause_uid) "
        f"select clause_uid, category, cast({len(notes.INSTRUCTION)} + length('Clause:Note:Provisions:') + 6 + case when length(clause) <= 700 then length(clause) else 704 end + length(body) + case when allowed = '' then 6 else length(allowed) end as int) as prompt_length, allowed, clause || ' ' || body || ' ' || allowed as source from asked"
    ),
    "contract_counts": f"with {CLAUSES}, flagged as ({_flag_rows('contract_id')}) {_COUNTS}",
    "contract_flags": f"with {CLAUSES}, required(type, severity, category) as (values {REQUIRED_ROWS}), flagged as ({_flag_rows('contract_id')}) select distinct contract_id, 'clause' as scope, severity, category from flagged union all select d.contract_id, 'document', r.severity, r.category from (select distinct contract_id from own) d cross join required r where not exists (select 1 from own o where o.contract_id = d.contract_id and o.clause_type = r.type)",
    "labels": f"with {CLAUSES}, flagged as ({_flag_rows('clause_uid')}) select clause_uid, category, {label('category')} as category_label, {label('severity')} as severity_label from flagged",
    "match_labels": f"select case method when 'bm25' then 'keyword match' else 'combined match' end as label, count(*) as n from (({SQL['grounded_clauses']}) union all ({SQL['hybrid_grounding']})) group by 1",
    "confidence_hints": "select entity_uid, least(1.0, greatest(0.0, coalesce(c, 0.0))) as shown, coalesce(c, 0.0) < 0.6 as low from (select entity_uid, max_by(struct_pack(c := confidence), loaded_at).c as c from entities group by entity_uid)",
    "library_found_of": f"with {ENTRIES} select count(*) filter (contains(lower(display_name), 'agreement')) as found, count(*) as total, count(*) filter (contains(lower(display_name), 'agreement')) || ' of ' || count(*) as line from entries",
    "masked_means": "with l as (select ord, unnest(string_split(lower(heading), '')) as c from provisions), m as (select ord, avg(cast(ascii(c) as double)) as a from l where c not in ('', ' ') group by ord) select ord, round(a / sqrt(a * a + 1), 6) as x, round(1 / sqrt(a * a + 1), 6) as y from m",
    "known_pieces": (
        f"with recursive vocabulary(piece) as (values {', '.join(f'({quoted(v)})' for v in vocabulary())}), words as (select distinct unnest(string_split(lower(kind), '_')) as word from (values {', '.join(f'({quoted(k)})' for k in fixed.CLAUSE_TYPES)}) t(kind)), "
        "steps(word, pos, pieces) as (select word, 0, '[CLS]' from words union all select s.word, s.pos + n.size, s.pieces || ' ' || case when s.pos > 0 then '##' else '' end || substring(s.word, s.pos + 1, n.size) from steps s, lateral (select max(k) as size from range(1, 40) r(k) where s.pos + k <= length(s.word) and (case when s.pos > 0 then '##' else '' end || substring(s.word, cast(s.pos + 1 as bigint), k)) in (select piece from vocabulary)) n where s.pos < length(s.word) and n.size is not null) "
        "select word, pieces || ' [SEP]' as pieces from steps where pos = length(word)"
    ),
    "json_fields": (
        f"with {ANALYSED}, required(type, severity, category) as (values {REQUIRED_ROWS}), {_PARTS}, told(type, body) as (values {EXPLANATION_ROWS}), "
        "noted as (select contract_id, count(*) as n from (select contract_id from flagged union all select contract_id from own join told on type = clause_type) group by contract_id) "
        "select c.contract_id, cast(length(c.text) as int) as char_count, cast(coalesce(o.n, 0) as int) as clause_count, cast(coalesce(f.n, 0) + coalesce(l.n, 0) as int) as risk_count, o.clauses, l.lacking, cast(coalesce(l.n, 0) as int) as document_notes, cast(coalesce(n.n, 0) as int) as notes, 'bm25' as grounding from contracts c "
        "left join (select contract_id, count(*) as n, string_agg(clause_id || ':' || clause_type, ',' order by span_start) as clauses from own group by contract_id) o on c.contract_id = o.contract_id left join (select contract_id, count(*) as n from flagged group by contract_id) f on c.contract_id = f.contract_id "
        "left join (select contract_id, count(*) as n, string_agg(category, ',' order by category) as lacking from lacking group by contract_id) l on c.contract_id = l.contract_id left join noted n on c.contract_id = n.contract_id"
    ),
    "text_heads": f"with {ANALYSED} select c.contract_id, coalesce(string_agg(clause_id, ',' order by span_start), '') as clauses, cast(count(*) filter (clause_type not in ('UNCLASSIFIED', 'PREAMBLE')) as int) as classified from contracts c left join own o on c.contract_id = o.contract_id group by c.contract_id",
}

#: White space of any kind, the mark that is put at ends of sentences, and the abbreviations that end none.
_WHITE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SHORT = r"(?:Pvt|Ltd|Rs|No|Nos|Mr|Mrs|Ms|Dr|Smt|Art|Sec|Cl|St|v|vs|viz|etc|i\.e|e\.g|approx|[A-Z])"
_CLOSING = r"[\"''”’)\]]*"


def _marked(body: str) -> str:
    out = f"regexp_replace({body}, '([.?!]+{_CLOSING})({_WHITE})', '\\1' || chr(1) || '\\2', 'g')"
    out = f"regexp_replace({out}, '([。！？।۔]+)', '\\1' || chr(1), 'g')"
    out = f"regexp_replace({out}, '((?:^|{_WHITE}|[(]){_SHORT}\\.[.?!]*{_CLOSING})' || chr(1), '\\1', 'g')"
    return f"regexp_replace({out}, chr(1) || '({_WHITE}{{1,3}}[a-z0-9(])', '\\1', 'g')"


SQL |= {
    "rule_sentences": (
        f"with {CONTRACTS}, {PARAGRAPHS}, split as (select contract_id, para_no, span_start, string_split({_marked('piece')}, chr(1)) as p from paragraphs), each as (select contract_id, para_no, span_start, unnest(p) as s, generate_subscripts(p, 1) as i from split), "
        "located as (select *, span_start + cast(coalesce(sum(length(s)) over (partition by contract_id, para_no order by i rows between unbounded preceding and 1 preceding), 0) as int) as pos from each), "
        f"bare as (select *, {strip('s')} as t, length(s) - length(regexp_replace(s, '^{fixed.BLANK}+', '')) as lead from located) "
        "select contract_id, cast(row_number() over (partition by contract_id order by para_no, i) - 1 as int) as sent_idx, t as text, cast(pos + lead as int) as span_start, cast(pos + lead + length(t) as int) as span_end from bare where t <> ''"
    ),
    "audit_summary": f"select count(*) filter (where ok) as stable, count(*) as total, count(*) filter (where ok) = count(*) as all_stable, count(*) filter (where ok) || '/' || count(*) || ' cases stable' as line from (select name, bool_and(stable) as ok from ({SQL['counterfactual_audit']}) group by name)",
}
