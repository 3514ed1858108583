"""SQL equivalents of the core queries, over whole tables.

Fixed values are stated here once more, so that a wrong one in the engine shows.
"""

from __future__ import annotations

#: Methods in the order of tables, sections of a row, function words.
MAIN_METHODS = ("NEU", "SUP", "AUG-SUP", "SSR")
CONTROL_METHODS = ("Real CoT", "+Prob Anchor", "+Entropy Anchor", "Response as CoT")
SECTIONS = ("questions", "answers", "contexts", "reasonings")
FUNCTION_WORDS = (
    "a", "about", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "for", "from", "if", "in", "into",
    "is", "it", "of", "on", "or", "so", "that", "the", "then", "these", "this", "those", "to", "was", "were", "with",
)
#: Characters of the chat format and the system prompt around the context, by method.
FRAME_CHARS = {"NEU": 199, "SUP": 253, "AUG-SUP": 326, "SSR": 252}

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _in(xs) -> str:
    return "(" + ", ".join(map(_q, xs)) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def _txt(x: str) -> str:
    return f"coalesce({x}, '')"


def _words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+')"


def _steps(x: str) -> str:
    return f"list_filter(list_transform(string_split({_strip(_txt(x))}, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> '')"


def _flat(m: str) -> str:
    return f"list_sort(list_transform(map_entries({m}), lambda e: e.key || '=' || coalesce(e.value, '<null>'))) AS {m}"


def _finite(c: str) -> str:
    return f"coalesce(isfinite({c}), false)"


_MESSAGES = f"""
m AS (SELECT row_idx, unnest(range(len(conversations))) AS i, unnest(conversations) AS m FROM conv_traces),
t AS (SELECT row_idx, i, m IS NULL AS gone, lower(coalesce(nullif(m.role, ''), nullif(m.from_role, ''), '')) AS r, coalesce(nullif(m.role, ''), nullif(m.from_role, ''), 'user') AS shown, coalesce(nullif(m.content, ''), nullif(m.value, ''), '') AS c FROM m),
g AS (SELECT row_idx, arg_max(c, i) FILTER (WHERE r IN ('user', 'human')) AS q, arg_max(c, i) FILTER (WHERE r IN ('assistant', 'gpt', 'model')) AS a,
  {_strip("string_agg(CASE WHEN gone THEN '' ELSE upper(shown[1]) || lower(shown[2:]) || ': ' || c END, chr(10) ORDER BY i)")} AS transcript FROM t GROUP BY row_idx),
qa AS (SELECT x.row_idx, x.id, x.reasoning_trace, coalesce(transcript, '') AS transcript, CASE WHEN coalesce(q, '') <> '' THEN q ELSE coalesce(transcript, '') END AS question, coalesce(a, '') AS answer FROM conv_traces x LEFT JOIN g USING (row_idx))"""

_LONG = """
k AS (SELECT sample_idx, id, questions, answers, contexts, reasonings, unnest(map_keys(questions)) AS method, unnest(range(len(map_keys(questions)))) AS method_pos FROM metric_rows),
long AS (SELECT sample_idx, id, method_pos, method, questions[method] AS question, answers[method] AS answer, contexts[method] AS context, reasonings[method] AS reasoning FROM k)"""

_SCOREABLE = f"""{_LONG},
ok AS (SELECT * FROM long WHERE {_txt('question')} <> '' AND {_txt('answer')} <> '' AND {_txt('reasoning')} <> '' AND len({_words('answer')}) > 0 AND len({_words('reasoning')}) > 0)"""


def _reason(methods) -> str:
    def one(s: str) -> str:
        missing = f"list_filter({_list(methods)}, lambda x: {_strip(_txt(f'{s}[x]'))} = '')"
        return f"CASE WHEN {s} IS NULL THEN 'missing dict section: {s}' WHEN len({missing}) > 0 THEN 'section {s} missing methods: ' || array_to_string({missing}, ',') END"

    return "coalesce(" + ", ".join(map(one, SECTIONS)) + ")"


def _skeleton(x: str) -> str:
    every = rf"regexp_extract_all({_txt(x)}, '[\p{{L}}\p{{N}}_]+')"
    own = f"list_filter({every}, lambda w: lower(w) IN {_in(FUNCTION_WORDS)})"
    kept = f"CASE WHEN len({own}) > 0 THEN {own} ELSE {every}[1:20] END"
    return f"CASE WHEN len({every}) = 0 THEN left({_txt(x)}, 200) ELSE array_to_string(list_transform(range(least(8, ceil(len({kept}) / 16.0)::BIGINT)), lambda i: array_to_string(({kept})[i * 16 + 1 : i * 16 + 16], ' ')), chr(10) || chr(10)) END"


_CONTROLLED = f"""
f AS (SELECT sample_idx, coalesce(id, sample_idx::VARCHAR) AS id, {", ".join(f"{_txt(f"{s}['SSR']")} AS {s[:-1]}" for s in SECTIONS)} FROM metric_rows),
b AS (SELECT * FROM f WHERE {_strip('question')} <> '' AND {_strip('answer')} <> '' AND {_strip('reasoning')} <> ''),
v AS (
  SELECT sample_idx, id, 0 AS method_pos, question, answer, context, reasoning FROM b
  UNION ALL SELECT sample_idx, id, 1, question, answer, context, reasoning || chr(10) || chr(10) || answer FROM b
  UNION ALL SELECT sample_idx, id, 2, question, answer, context, {_skeleton('answer')} FROM b
  UNION ALL SELECT sample_idx, id, 3, question, answer, context, answer FROM b),
controlled AS (SELECT sample_idx, id, method_pos, {_list(CONTROL_METHODS)}[method_pos + 1] AS method, question, answer, CASE WHEN context <> '' THEN context ELSE question END AS context, reasoning FROM v)"""


def _block(x: str, tag: str) -> str:
    return _strip(f"regexp_extract({x}, '(?is)<{tag}>(.*?)</{tag}>', 1)")


def _parsed(source: str) -> str:
    return f"""
p0 AS (SELECT *, {_strip(_txt('raw_output'))} AS raw FROM {source}),
p1 AS (SELECT *, {_block('raw', 'reason')} AS blk, {_block('raw', 'skeleton')} AS skeleton, strpos(lower(raw), '<reason>') AS pos FROM p0),
p AS (SELECT * EXCLUDE (blk, pos, raw), CASE WHEN blk <> '' THEN blk WHEN pos > 0 THEN {_strip('substring(raw, pos + 8)')} ELSE raw END AS reason, CASE WHEN blk <> '' THEN 'tagged' WHEN pos > 0 THEN 'open_reason_tag' ELSE 'raw' END AS mode FROM p1)"""


_LATEST = "latest AS (SELECT row_idx, coalesce(method, 'R0') AS method, arg_max(raw_output, seq) AS x_, max(seq) AS seq FROM raw_generations GROUP BY ALL), l AS (SELECT l.row_idx, l.method, l.seq, r.raw_output FROM latest l JOIN raw_generations r USING (seq))"
_FIRST = "CASE WHEN list_contains(map_keys(questions), 'NEU') THEN 'NEU' ELSE coalesce(map_keys(questions)[1], 'R0') END"


def _context(method: str, ctx: str) -> str:
    q, a, c = _txt(f"questions[{method}]"), _txt(f"answers[{method}]"), _txt(f"contexts[{ctx}]")
    return f"CASE WHEN {_strip(c)} <> '' THEN {c} WHEN {a} <> '' THEN {_strip(f"'User: ' || {q} || chr(10) || chr(10) || 'Assistant: ' || {a}")} ELSE {q} END"


_ROWS = "rows AS (SELECT *, (sample_idx - 1000)::INT AS row_idx FROM metric_rows)"
_REQUESTS = f"""{_ROWS}, w AS (SELECT *, unnest({_list(MAIN_METHODS)}) AS method FROM rows),
c AS (SELECT row_idx, coalesce(id, row_idx::VARCHAR) AS sample_id, method, {_context('method', 'method')} AS prompt_context FROM w), req AS (SELECT * FROM c WHERE {_strip('prompt_context')} <> '')"""
_R0 = f"""{_ROWS}, s AS (SELECT *, {_FIRST} AS source_method FROM rows),
c AS (SELECT row_idx, coalesce(id, row_idx::VARCHAR) AS sample_id, 'R0' AS method, {_txt('questions[source_method]')} AS prompt_context, source_method FROM s), req AS (SELECT * FROM c WHERE {_strip('prompt_context')} <> '')"""


def _parts(methods) -> str:
    return f"""{_ROWS}, {_LATEST}, {_parsed('l')},
w AS (SELECT row_idx, unnest({_list(methods)}) AS method, unnest(range({len(methods)})) AS method_pos FROM rows),
parts AS (SELECT w.row_idx, w.method_pos, w.method, p.row_idx IS NOT NULL AS there, reason, skeleton, mode, p.row_idx IS NULL OR {_strip(_txt('reason'))} = '' AS missing FROM w LEFT JOIN p ON p.row_idx = w.row_idx AND p.method = w.method)"""


_R0_PARTS = f"""{_parts(['R0'])}, s AS (SELECT *, {_FIRST} AS sm FROM rows),
r0 AS (SELECT s.row_idx, coalesce(id, s.row_idx::VARCHAR) AS id, {_txt('questions[sm]')} AS question, {_txt('answers[sm]')} AS answer, reason, mode, CASE WHEN NOT there THEN 'missing_raw_output' WHEN missing THEN 'empty_reasoning' END AS reject FROM s JOIN parts USING (row_idx))"""


def _shares(*columns: str, name: str = "shares") -> str:
    every = " UNION ALL ".join(f"SELECT unnest({_words(c)}) AS token FROM ok" for c in columns)
    return f"corpus_of_{name} AS ({every}), {name} AS (SELECT token, count(*) / (SELECT count(*) FROM corpus_of_{name})::DOUBLE AS share FROM corpus_of_{name} GROUP BY token)"


_TOKENS = f"""{_shares('reasoning', name='trace_shares')},
st AS (SELECT sample_idx, method, unnest({_steps('reasoning')}) AS s, unnest(range(len({_steps('reasoning')}))) + 1 AS step FROM ok),
tk AS (SELECT sample_idx, method, step, unnest({_words('s')}) AS token, unnest(range(len({_words('s')}))) AS nth FROM st),
su AS (SELECT sample_idx, method, step, row_number() OVER (PARTITION BY sample_idx, method ORDER BY step, nth) - 1 AS pos, -ln(share) AS entropy FROM tk JOIN trace_shares USING (token))"""
_SURPRISALS = f"{_SCOREABLE}, {_TOKENS}"


def _aent(means: str, order: str) -> str:
    """From ``means(sample_idx, method, <order>, v)`` to ``res(sample_idx, method, windows, entropy_anchoring)``."""
    return f"""
mm AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM {means} WINDOW w AS (PARTITION BY sample_idx, method)),
z AS (SELECT *, CASE WHEN hi - lo <= 1e-9 THEN 0e0 ELSE (v - lo) / (hi - lo) END AS z FROM mm),
dz AS (SELECT *, abs(z - lag(z) OVER (PARTITION BY sample_idx, method ORDER BY {order})) AS d FROM z),
res AS (SELECT sample_idx, method, count(*) AS windows, CASE WHEN count(*) < 2 THEN 0e0 ELSE sqrt((1 - CASE WHEN avg(d) > 1e-9 THEN exp(-stddev_pop(d) / avg(d)) ELSE 1e0 END) * (1 - least(var_pop(z) / 0.25e0, 1e0))) END AS entropy_anchoring FROM dz GROUP BY ALL)"""


_VALUES = ("lexical_anchoring", "entropy_anchoring", "aprob")
_BAD = " OR ".join(f"NOT {_finite(c)}" for c in _VALUES)
_GATE = f"bad AS (SELECT DISTINCT run_id, sample_idx FROM metric_records WHERE {_BAD}), gated AS (SELECT * FROM metric_records m WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.run_id = m.run_id AND b.sample_idx = m.sample_idx))"
_NON = lambda c: f"({c} IS NOT NULL AND NOT isfinite({c}))"


def _zone(x: str, y: str, xt: str, yt: str) -> dict[str, str]:
    n = f"{x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({x}) AND NOT isnan({y})"
    return {
        "Reason": f"({n} AND {x} < {xt} AND {y} < {yt})", "Encode": f"({n} AND {x} < {xt} AND {y} >= {yt})",
        "Cloze": f"({n} AND {x} >= {xt} AND {y} < {yt})", "Copy": f"({n} AND {x} >= {xt} AND {y} >= {yt})",
    }


def _aggregate(by: str, numeric=_VALUES) -> str:
    bad = " OR ".join(_NON(f"{c}::DOUBLE") for c in numeric)
    zone = _zone("entropy_anchoring", "aprob", "0.5e0", "0.5e0")
    return f"""WITH r AS (SELECT *, coalesce({by}, 'unknown') AS g, coalesce({bad}, false) AS bad FROM metric_records),
a AS (SELECT g, count(aprob) FILTER (WHERE NOT bad) AS n, count(*) FILTER (WHERE bad) AS skipped, count(entropy_anchoring) FILTER (WHERE NOT bad) AS nx,
  {", ".join(f"avg({c}) FILTER (WHERE NOT bad) AS mean_{c}" for c in numeric)}, {", ".join(f"count(*) FILTER (WHERE NOT bad AND {c}) AS {z}" for z, c in zone.items())} FROM r GROUP BY g)
SELECT g AS "group", n AS "N", skipped AS skipped_nan, {", ".join(f"round(mean_{c}, 6) AS mean_{c}" for c in numeric)}, {", ".join(f"CASE WHEN nx = n THEN round({z} / n, 6) END AS {z}" for z in zone)} FROM a WHERE n > 0"""


_SCALED = "CASE WHEN isnan(aprob) THEN aprob ELSE sqrt(greatest(least(aprob, 1e0), 0e0)) END"


def _zones_of(source: str) -> str:
    return f"""
s AS (SELECT method, lexical_anchoring AS l, entropy_anchoring AS x, CASE WHEN aprob IS NULL THEN NULL ELSE {_SCALED} END AS y FROM {source}),
t AS (SELECT quantile_cont(x, 0.6e0) FILTER (WHERE {_finite('x')}) AS xt, (SELECT quantile_cont(y, 0.6e0) FROM s WHERE {_finite('y')}) AS yt FROM s)"""


def _summary(source: str) -> str:
    zone = _zone("x", "y", "xt", "yt")
    return f"""{_zones_of(source)}
SELECT method, count(*) AS "N", round(100 * avg(l), 6) AS "Alex", round(100 * avg(x), 6) AS "Aent", round(100 * avg(y), 6) AS "Aprob",
  {", ".join(f'round(100 * avg({c}::INT::DOUBLE), 6) AS "{z}"' for z, c in zone.items())}, round(any_value(xt), 6) AS x_threshold, round(any_value(yt), 6) AS y_threshold FROM s, t WHERE method IS NOT NULL GROUP BY method"""


#: Longest common subsequence of the words of answer and trace: a row of the table for each word of a trace,
#: whose cells are running maxima over the answer.
_ALIGNED = f"""
ans AS (SELECT sample_idx, method, unnest({_words('answer')}) AS a, unnest(range(1, len({_words('answer')}) + 1)) AS j FROM ok),
rea AS (SELECT sample_idx, method, list_filter({_words('reasoning')}, lambda w: list_contains({_words('answer')}, w)) AS r FROM ok),
dp(sample_idx, method, j, a, i, v) USING KEY (sample_idx, method, j) AS (
  SELECT sample_idx, method, j, a, 0, 0 FROM ans
  UNION
  SELECT sample_idx, method, j, a, i, max(best) OVER (PARTITION BY sample_idx, method ORDER BY j) FROM (
    SELECT d.sample_idx, d.method, d.j, d.a, d.i + 1 AS i, greatest(d.v, CASE WHEN d.a = r[d.i + 1] THEN 1 + coalesce(lag(d.v) OVER (PARTITION BY d.sample_idx, d.method ORDER BY d.j), 0) ELSE 0 END) AS best
    FROM dp d JOIN rea USING (sample_idx, method) WHERE d.i < len(r))
),
lex AS (SELECT sample_idx, method, max(v) / count(*) AS lexical FROM dp GROUP BY ALL)"""
_LIKELY = f"""
a AS (SELECT sample_idx, method, unnest({_words('answer')}) AS token FROM ok), ac AS (SELECT sample_idx, method, token, count(*) AS n FROM a GROUP BY ALL),
r AS (SELECT sample_idx, method, unnest({_words('reasoning')}) AS token FROM ok), rc AS (SELECT sample_idx, method, token, count(*) AS c FROM r GROUP BY ALL), rs AS (SELECT sample_idx, method, sum(c) AS size FROM rc GROUP BY ALL),
lj AS (SELECT ac.sample_idx, ac.method, ac.n, share, 0.5e0 * coalesce(c / size, 0) + 0.5e0 * share AS p FROM ac JOIN shares USING (token) JOIN rs USING (sample_idx, method) LEFT JOIN rc ON rc.sample_idx = ac.sample_idx AND rc.method = ac.method AND rc.token = ac.token),
lk AS (SELECT sample_idx, method, sum(n) AS n, sum(n * ln(share)) AS base, sum(n * ln(p)) AS final FROM lj GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    bits = "/ ln(10e0) / n * 3.321928e0"
    frame = " ".join(f"WHEN {_q(m)} THEN {n}" for m, n in FRAME_CHARS.items())
    known = [*MAIN_METHODS, *CONTROL_METHODS]
    zone = _zone("x", "y", "xt", "yt")
    aprob = f"CASE WHEN n IS NULL THEN NULL WHEN -(base {bits}) > 1e-12 THEN greatest(least((final - base) / -base, 1e0), 0e0) ELSE 0e0 END"
    return {
        "zone_summary": f"WITH {_GATE}, {_summary('gated')}",
        "zone_summary_ungated": f"WITH {_summary('metric_records')}",
        "zone_thresholds": f"WITH {_GATE}, {_zones_of('gated')} SELECT 0.6e0 AS quantile, round(xt, 6) AS x_threshold, round(yt, 6) AS y_threshold FROM t",
        "zone_points": f"WITH {_GATE}, {_zones_of('gated')}, z AS (SELECT method, l, CASE {' '.join(f'WHEN {c} THEN {_q(k)}' for k, c in zone.items())} END AS zone FROM s, t) SELECT method, zone, count(*) AS n, round(avg(l), 6) AS mean_lexical FROM z GROUP BY ALL",
        "conversation_qa": f"WITH {_MESSAGES} SELECT row_idx, question, answer FROM qa",
        "conversation_format": f"WITH {_MESSAGES} SELECT row_idx, transcript FROM qa",
        "convert_rows": f"WITH {_MESSAGES} SELECT row_idx, coalesce(id, row_idx::VARCHAR) AS id, question, answer, transcript AS context, {_txt('reasoning_trace')} AS reasoning FROM qa WHERE {_strip('question')} <> '' AND {_strip('answer')} <> '' AND {_strip(_txt('reasoning_trace'))} <> ''",
        "long_rows": f"WITH {_LONG} SELECT sample_idx, id, method_pos, method, question, answer, context, reasoning FROM long",
        "validate_rows": f"WITH v AS (SELECT sample_idx, {_reason(MAIN_METHODS)} AS reason FROM metric_rows) SELECT sample_idx, reason, reason IS NULL AS ok FROM v",
        "validated": f"SELECT sample_idx, id, len(map_keys(questions)) AS methods FROM metric_rows WHERE {_reason(['SSR'])} IS NULL",
        "validate_summary": f"WITH v AS (SELECT {_reason(MAIN_METHODS)} AS reason FROM metric_rows) SELECT count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS written, count(reason) AS skipped FROM v",
        "function_word_skeleton": f"SELECT doc_id, {_skeleton('text')} AS skeleton FROM documents",
        "controlled_variants": f"WITH {_CONTROLLED} SELECT * FROM controlled",
        "controlled_wide": f"WITH {_CONTROLLED} SELECT sample_idx, id, list_sort(list(method || '=' || answer)) AS answers, list_sort(list(method || '=' || reasoning)) AS reasonings FROM controlled GROUP BY ALL",
        "split_steps": f"WITH s AS (SELECT row_idx, unnest({_steps('reasoning_trace')}) AS text, unnest(range(len({_steps('reasoning_trace')}))) AS step FROM conv_traces) SELECT row_idx, step, text FROM s",
        "sampled_steps": f"""WITH s AS (SELECT row_idx, {_steps('reasoning_trace')} AS st FROM conv_traces), e AS (SELECT row_idx, len(st) AS n, list_transform(st, lambda p: len({_words('p')})) AS sizes FROM s),
x AS (SELECT row_idx, n, sizes, unnest(range(n + 1)) AS step FROM e) SELECT row_idx, step, CASE WHEN step = 0 THEN 0 ELSE list_sum(sizes[1:step]) END AS prefix_tokens FROM x WHERE step <= 50 OR (step - 50) % 4 = 0 OR step = n""",
        "step_boundaries": f"""WITH s AS (SELECT row_idx, list_transform({_steps('reasoning_trace')}, lambda p: len({_words('p')})) AS sizes FROM conv_traces)
SELECT row_idx, CASE WHEN len(sizes) = 0 THEN [0] ELSE list_transform(range(1, len(sizes) + 1), lambda k: list_sum(sizes[1:k])::INT + k::INT - 1) END AS ends FROM s""",
        "parse_reasoning": f"WITH {_parsed('raw_generations')} SELECT seq, reason, skeleton, mode FROM p",
        "parse_mode_counts": f"WITH {_parts(MAIN_METHODS)} SELECT mode, count(*) AS n FROM parts WHERE there GROUP BY mode",
        "latest_raw_output": f"WITH {_LATEST} SELECT row_idx, method, seq, raw_output FROM l",
        "prompt_context_choice": f"WITH s AS (SELECT *, {_FIRST} AS method FROM metric_rows) SELECT sample_idx, method, {_context('method', 'method')} AS context, {_context('method', _q('NEU'))} AS neutral_context FROM s",
        "rcot_requests": f"WITH {_REQUESTS} SELECT row_idx, sample_id, method, prompt_context, method AS source_method, CASE method {frame} END AS frame_chars, length(prompt_context) AS prompt_context_chars FROM req",
        "r0_requests": f"WITH {_R0} SELECT row_idx, sample_id, method, prompt_context, source_method FROM req",
        "head_requests": f"WITH {_R0} SELECT row_idx, source_method FROM req WHERE row_idx < 20",
        "requests_pending": f"WITH {_REQUESTS} SELECT row_idx, method FROM req q WHERE NOT EXISTS (SELECT 1 FROM raw_generations r WHERE r.row_idx = q.row_idx AND coalesce(r.method, 'R0') = q.method)",
        "rcot_build": f"""WITH {_parts(['NEU', 'SSR'])},
g AS (SELECT row_idx, bool_or(missing) AS bad, list_sort(list(method || '=' || reason)) AS reasonings, list_sort(list(method || '=' || mode)) AS modes, list_sort(list(method || '=' || skeleton) FILTER (WHERE skeleton <> '')) AS skeletons FROM parts GROUP BY row_idx)
SELECT row_idx, coalesce(id, row_idx::VARCHAR) AS id, list_sort(['NEU=' || {_txt("questions['NEU']")}, 'SSR=' || {_txt("questions['SSR']")}]) AS questions, g.reasonings, modes AS generated_parse_modes, skeletons AS generated_skeletons FROM rows JOIN g USING (row_idx) WHERE NOT bad""",
        "rcot_rejected": f"WITH {_parts(['NEU', 'SSR'])}, g AS (SELECT row_idx, list(method ORDER BY method_pos) AS missing FROM parts WHERE missing GROUP BY row_idx) SELECT row_idx, coalesce(id, row_idx::VARCHAR) AS id, missing FROM rows JOIN g USING (row_idx)",
        "r0_build": f"WITH {_R0_PARTS} SELECT row_idx, id, ['R0=' || question] AS questions, ['R0=' || answer] AS answers, ['R0=' || reason] AS reasonings, ['R0=' || mode] AS generated_parse_modes FROM r0 WHERE reject IS NULL",
        "r0_rejected": f"WITH {_R0_PARTS} SELECT row_idx, id, reject AS reason FROM r0 WHERE reject IS NOT NULL",
        "lexical_anchoring": f"WITH RECURSIVE {_SCOREABLE}, {_ALIGNED} SELECT sample_idx, method, lexical AS lexical_anchoring FROM lex",
        "prob_anchoring": f"""WITH {_SCOREABLE}, {_shares('answer', 'reasoning')}, {_LIKELY}
SELECT sample_idx, method, n::BIGINT AS answer_words, round(base {bits}, 6) AS base_bits, round(final {bits}, 6) AS final_bits, round({aprob}, 6) AS aprob FROM lk""",
        "scored_records": f"""WITH RECURSIVE {_SCOREABLE}, {_ALIGNED}, {_shares('answer', 'reasoning')}, {_LIKELY},
{_TOKENS}, means AS (SELECT sample_idx, method, step, avg(entropy) AS v FROM su WHERE step > 1 GROUP BY ALL), {_aent('means', 'step')},
every AS (SELECT sample_idx, unnest(map_keys(questions)) AS method FROM metric_rows),
rec AS (SELECT sample_idx, method, lexical, coalesce(entropy_anchoring, 0e0) AS ent, {aprob} AS aprob FROM every LEFT JOIN lex USING (sample_idx, method) LEFT JOIN lk USING (sample_idx, method) LEFT JOIN res USING (sample_idx, method))
SELECT sample_idx, method, round(lexical, 6) AS lexical_anchoring, round(ent, 6) AS entropy_anchoring, round(aprob, 6) AS "Aprob" FROM rec WHERE sample_idx NOT IN (SELECT sample_idx FROM rec WHERE NOT coalesce(isfinite(lexical) AND isfinite(ent) AND isfinite(aprob), false))""",
        "resumed_raw_output": f"WITH {_LATEST} SELECT row_idx, method, seq, raw_output FROM l",
        "figure_cells": f"""WITH {_GATE}, {_zones_of('gated')}, c AS (SELECT method, l, least(greatest(floor(x * 200), 0), 199) AS i, least(greatest(floor(y * 200), 0), 199) AS j FROM s WHERE {_finite('x')} AND {_finite('y')} AND method IS NOT NULL)
SELECT method, round((i + 0.5e0) / 200, 6) AS x, round((j + 0.5e0) / 200, 6) AS y, round(avg(l) FILTER (WHERE {_finite('l')}), 6) AS c, count(*) AS n FROM c GROUP BY method, i, j""",
        "entropy_anchoring": f"WITH {_SURPRISALS}, means AS (SELECT sample_idx, method, step, avg(entropy) AS v FROM su WHERE step > 1 GROUP BY ALL), {_aent('means', 'step')} SELECT ok.sample_idx, ok.method, round(coalesce(entropy_anchoring, 0e0), 6) AS entropy_anchoring FROM ok LEFT JOIN res USING (sample_idx, method)",
        "entropy_fixed_windows": f"WITH {_SURPRISALS}, means AS (SELECT sample_idx, method, pos // 50 AS w, avg(entropy) AS v FROM su GROUP BY ALL), {_aent('means', 'w')} SELECT sample_idx, method, windows::INT AS windows, round(entropy_anchoring, 6) AS entropy_anchoring FROM res",
        "finite_records": f"SELECT method, count(*) AS rows, {', '.join(f'count(*) FILTER (WHERE {_finite(c)}) AS finite_{c}' for c in _VALUES)}, count(*) FILTER (WHERE NOT ({_BAD})) AS finite FROM metric_records GROUP BY method",
        "sample_gate": f"WITH {_GATE} SELECT run_id, rank_no, method, sample_idx, lexical_anchoring, entropy_anchoring, aprob, scored_at, run_day FROM gated",
        "gate_summary": f"""WITH bad AS (SELECT DISTINCT sample_idx FROM metric_records WHERE {_BAD}), v AS (SELECT DISTINCT sample_idx FROM metric_records WHERE sample_idx NOT IN (SELECT sample_idx FROM bad))
SELECT count(*) AS total, count(*) FILTER (WHERE sample_idx IN (SELECT sample_idx FROM v)) AS valid, count(*) FILTER (WHERE coalesce(len(map_keys(questions)), 0) > 0 AND sample_idx NOT IN (SELECT sample_idx FROM v)) AS discarded FROM metric_rows""",
        "valid_data": f"SELECT sample_idx, id FROM metric_rows m WHERE EXISTS (SELECT 1 FROM metric_records r WHERE r.sample_idx = m.sample_idx) AND NOT EXISTS (SELECT 1 FROM metric_records r WHERE r.sample_idx = m.sample_idx AND ({_BAD}))",
        "shard_rows": "SELECT sample_idx, id FROM metric_rows WHERE sample_idx % 4 = 1",
        "aggregate_fixed_quadrants": _aggregate("method"),
        "aggregate_by_run": _aggregate("run_id"),
        "aggregate_numeric": _aggregate("method", ("rank_no", *_VALUES)),
        "scaled_records": f"SELECT run_id, method, count(*) AS n, count(*) FILTER (WHERE isnan(aprob)) AS nan, round(avg({_SCALED}) FILTER (WHERE NOT isnan(aprob)), 6) AS mean_scaled FROM metric_records GROUP BY ALL",
        "method_order": f"WITH m AS (SELECT DISTINCT method FROM metric_records WHERE method IS NOT NULL) SELECT method, (row_number() OVER (ORDER BY coalesce(list_position({_list(known)}, method), 99), method) - 1)::INT AS position FROM m",
        "method_coverage": f"WITH s AS (SELECT list(DISTINCT method) AS seen FROM metric_records) SELECT len(list_filter({_list([*known, 'Unseen'])}, lambda x: NOT list_contains(seen, x))) = 0 AS complete, list_sort(list_filter({_list([*known, 'Unseen'])}, lambda x: NOT list_contains(seen, x))) AS missing FROM s",
    }
