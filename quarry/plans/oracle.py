"""DuckDB oracle SQL for every registered query (same rows, same column names, same rounding).

Only the base tables are registered on the oracle side, so each statement starts with the fixture
views it needs (``duck_with``).  Helpers below mirror the Spark operators expression by expression.
"""

from __future__ import annotations

from ..functions.fixed import INSTRUCTION_PREFIX, PLACEHOLDER, WS_CLASS_RE2
from .fixtures import JSON_CASES, duck_with
from ..operators.metrics import KEYWORD_WEIGHT, OTHER_WEIGHT, PYTHON_KEYWORDS

WS = WS_CLASS_RE2
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def user_turn(instr: str, dataset: str) -> str:
    return f"concat({q(INSTRUCTION_PREFIX[dataset])}, {NL}, '```', {NL}, {strip(instr)}, {NL}, '```')"


def answer_turn(resp: str) -> str:
    return f"concat('```python', {NL}, coalesce({strip(resp)}, {q(PLACEHOLDER)}), {NL}, '```')"


def render(role: str, content: str) -> str:
    return f"concat('<|im_start|>', {role}, {NL}, {content}, '<|im_end|>', {NL})"


def render_pair(instr: str, resp: str, dataset: str = "conala") -> str:
    return f"({render(q('user'), user_turn(instr, dataset))} || {render(q('assistant'), answer_turn(resp))})"


def cut(x: str) -> str:
    return f"split_part({x}, {q(PLACEHOLDER)}, 1)"


def cleaned(raw: str = "raw") -> str:
    return f"case when api_model then {raw} else {strip(f'split_part({raw}, {q(chr(96) * 3)}, 1)')} end"


BLINDED = "blinded as (select example_id, split, nl, case when split = 'test' then null else reference end as reference from pairs)"
CLEANED = f"cleaned as (select example_id, {cleaned()} as response from responses)"


# n-gram statistics ----------------------------------------------------------------------------
def chrf_words(t: str) -> str:
    toks = f"list_filter(regexp_split_to_array({t}, '{WS}+'), lambda x: x <> '')"
    return (f"flatten(list_transform({toks}, lambda w: case when length(w) = 1 then [w] "
            f"when regexp_matches(w, '[[:punct:]]$') then [substring(w, 1, length(w) - 1), substring(w, length(w), 1)] "
            f"when regexp_matches(w, '^[[:punct:]]') then [substring(w, 1, 1), substring(w, 2)] else [w] end))")


def ws_words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WS}+'), lambda x: x <> '')"


def ngram_ctes(src: str, char_order: int, word_order: int, words, weighted: bool = False) -> str:
    """CTEs ending in ``ex(grp, example_id, kind, n, h, r, m, hu, ru)``; ``src`` has
    (grp, example_id, hyp, ref)."""
    orders = [f"('c', {n})" for n in range(1, char_order + 1)] + [f"('w', {n})" for n in range(1, word_order + 1)]
    if weighted:
        kw = ", ".join(q(k) for k in PYTHON_KEYWORDS)
        w = f"case when n = 1 then (case when g in ({kw}) then {KEYWORD_WEIGHT} else {OTHER_WEIGHT} end) else 1.0 end"
    else:
        w = "1.0"
    return f""",
src as ({src}),
sides as (select grp, example_id, 1 as is_h, hyp as t from src union all select grp, example_id, 0, ref from src),
units as (select grp, example_id, is_h, regexp_replace(t, '{WS}+', '', 'g') as s, {words('t')} as toks from sides),
ords as (select * from (values {", ".join(orders)}) o(kind, n)),
pos as (select grp, example_id, is_h, s, toks, kind, n,
          unnest(range(1, greatest((case when kind = 'c' then length(s) else len(toks) end) - n + 2, 1))) as p
        from units, ords),
grams as (select grp, example_id, is_h, kind, n,
            case when kind = 'c' then substring(s, p, n) else array_to_string(list_slice(toks, p, p + n - 1), ' ') end as g
          from pos),
pg as (select grp, example_id, kind, n, g, sum(is_h)::double as hc, sum(1 - is_h)::double as rc
       from grams group by grp, example_id, kind, n, g),
ex as (select grp, example_id, kind, n, sum(hc * {w}) as h, sum(rc * {w}) as r,
         sum(least(hc, rc) * {w}) as m, sum(hc) as hu, sum(rc) as ru
       from pg group by grp, example_id, kind, n)"""


def fscore(stats: str, group: str) -> str:
    return f"""select {group}, case when coalesce(p + rr, 0) > 0 then 100.0 * 5.0 * p * rr / (4.0 * p + rr) else 0.0 end as score
from (select {group}, avg(case when h > 0 and r > 0 then m / h end) as p,
             avg(case when h > 0 and r > 0 then m / r end) as rr from {stats} group by {group}) z"""


def chrf_sql(src: str, word_order: int, prelude: str) -> str:
    """(grp, score) — corpus chrF/chrF++ per grp."""
    return (prelude + ngram_ctes(src, 6, word_order, chrf_words)
            + """,
ex2 as (select grp, example_id, kind, n, case when r > 0 then h else 0 end as h, r, m from ex),
corp as (select grp, kind, n, sum(h) as h, sum(r) as r, sum(m) as m from ex2 group by grp, kind, n),
sc as (""" + fscore("corp", "grp") + ")\n")


def chrf_family_sql(src: str, prelude: str) -> str:
    """(grp, chrf, chrf_pp) from one chrF++ statistics pass."""
    ok = "h > 0 and r > 0"
    def score(p, r):
        return f"case when coalesce({p} + {r}, 0) > 0 then 100.0 * 5.0 * {p} * {r} / (4.0 * {p} + {r}) else 0.0 end"
    return (prelude + ngram_ctes(src, 6, 2, chrf_words) + f""",
ex2 as (select grp, example_id, kind, n, case when r > 0 then h else 0 end as h, r, m from ex),
corp as (select grp, kind, n, sum(h) as h, sum(r) as r, sum(m) as m from ex2 group by grp, kind, n),
pr as (select grp, avg(case when {ok} and kind = 'c' then m / h end) as pc, avg(case when {ok} and kind = 'c' then m / r end) as rc,
         avg(case when {ok} then m / h end) as pa, avg(case when {ok} then m / r end) as ra from corp group by grp),
sc as (select grp, {score('pc', 'rc')} as chrf, {score('pa', 'ra')} as chrf_pp from pr)
""")


def bleu_sql(src: str, prelude: str, weighted: bool) -> str:
    logs = " + ".join(f"ln(m{n} / h{n})" for n in range(1, 5))
    return (prelude + ngram_ctes(src, 0, 4, ws_words, weighted) + f""",
corp as (select grp, {", ".join(f"sum(case when n = {n} then m end) as m{n}, sum(case when n = {n} then h end) as h{n}" for n in range(1, 5))},
  sum(case when n = 1 then hu end) as hyp_len, sum(case when n = 1 then ru end) as ref_len from ex group by grp),
sc as (select grp, case when {" or ".join(f"coalesce(m{n}, 0) <= 0" for n in range(1, 5))} or coalesce(hyp_len, 0) = 0 then 0.0
  else (case when hyp_len >= ref_len then 1.0 else exp(1 - ref_len / hyp_len) end) * exp(({logs}) / 4) end as score from corp)
""")


# retrieval ------------------------------------------------------------------------------------
def knn(k: int) -> str:
    return f"""knn as (select * from (
  select query_id, doc_id, sim, row_number() over (partition by query_id order by sim desc, doc_id) as rank
  from (select q.query_id, d.doc_id, list_inner_product(q.embedding::double[], d.embedding::double[]) as sim
        from rq q cross join kb d) s) r where rank <= {k})"""


def reranked(n_retrieve: int, n_final: int, token_dim: int = 8) -> str:
    return knn(n_retrieve) + f""",
tok as (select c.query_id, c.doc_id, c.rank, i.i,
          max(list_inner_product(list_slice(qv.embedding::double[], i.i * {token_dim} + 1, i.i * {token_dim} + {token_dim}),
                                 list_slice(dv.embedding::double[], j.j * {token_dim} + 1, j.j * {token_dim} + {token_dim}))) as best
        from knn c join rq qv on qv.query_id = c.query_id join kb dv on dv.doc_id = c.doc_id
        cross join range(0, 8) i(i) cross join range(0, 8) j(j)
        group by c.query_id, c.doc_id, c.rank, i.i),
ms as (select query_id, doc_id, rank, sum(best) as maxsim from tok group by query_id, doc_id, rank),
rr as (select * from (select *, row_number() over (partition by query_id order by round(maxsim, 9) desc, rank) as final_rank from ms) f
       where final_rank <= {n_final})"""


def difficulty(src: str) -> str:
    return f"""nn as (select max(problem_id) + 1 as nmax from {src}),
dd as (select o.*, case
  when problem_id >= nmax * 0.0::double and problem_id < nmax * 0.6::double then 'interview'
  when problem_id >= nmax * 0.6::double and problem_id < nmax * 0.8::double then 'competition'
  when problem_id >= nmax * 0.8::double and problem_id < nmax * 1.0::double then 'introductory' end as difficulty
  from {src} o, nn)"""


POLLS = """polls as (select run_id, poll_ts, case when bool_or(used_mb < 0) then -1.0::double else sum(used_mb) end as used_mb
  from telemetry where device in (0, 1) group by run_id, poll_ts)"""

SUMMARY = """select run_id, round(coalesce(arg_min(used_mb, case when used_mb >= 0 then poll_ts end), arg_min(used_mb, poll_ts)), 6) as initial_mb,
  round(max(used_mb), 6) as peak_mb, round((epoch_us(max(poll_ts)) - epoch_us(min(poll_ts))) / 1e6, 3) as elapsed_s,
  count(*) as n_polls from polls group by run_id"""

ALL_POLLS = POLLS.replace("where device in (0, 1)", "")

GRID = "grid as (select r.lora_r, a.lora_alpha from (values (8),(16),(32),(64)) r(lora_r) cross join (values (16),(32),(64),(128)) a(lora_alpha))"


def _escape(x: str) -> str:
    return rf"replace(replace(replace({x}, '\', '\\'), chr(10), '\n'), chr(13), '\r')"


def oracle_sql() -> dict[str, str]:
    conala = INSTRUCTION_PREFIX["conala"]
    apps = "apps"
    tmpl = f"('<|im_start|>assistant' || {NL})"
    fn_name = ("case when json_valid(input_output) then nullif(json_extract_string(input_output, '$.fn_name'), '') end")
    first_solution = "case when json_valid(solutions) then json_extract_string(solutions, '$[0]') else '' end"
    io_prompt = (f"concat(question, coalesce(nullif(starter_code, ''), ''), case when ({fn_name}) is not null "
                 f"then {NL} || 'Use Standard Input format' || {NL} else {NL} || 'Use Call-Based format' || {NL} end)")
    stop2 = f"({NL} || '```' || {NL})"
    s = {}

    s["messages_plain"] = duck_with("pairs") + """
select example_id, 0::bigint as msg_idx, 'user' as role, nl as content from pairs where split = 'train'
union all select example_id, 1::bigint, 'assistant', reference from pairs where split = 'train'"""

    s["messages_templated"] = duck_with("pairs") + f""", {BLINDED}
select example_id, split, 0::bigint as msg_idx, 'user' as role, {user_turn('nl', 'conala')} as content from blinded
union all select example_id, split, 1::bigint, 'assistant', {answer_turn('reference')} from blinded"""

    s["prompt_with_tests"] = duck_with("mbpp_raw") + """
select doc_id, concat(text, ' Your code should pass these tests:',
  array_to_string(list_transform(test_list, lambda t: chr(10) || t), '')) as prompt,
  len(test_list)::bigint as n_tests from mbpp_raw"""

    s["prompt_io_mode"] = duck_with("apps_raw") + f""",
a as (select doc_id, split, {io_prompt} as prompt,
        case when split = 'test' then null else ({first_solution}) end as answer from apps_raw)
select doc_id, split, {user_turn('prompt', apps)} as user_content, {answer_turn('answer')} as assistant_content from a"""

    s["dataset_config"] = """
with d as (select doc_id, string_split(concat('datasets/', lang, '/', case doc_id % 4 when 0 then 'conala'
    when 1 then 'mbpp' when 2 then 'apps' else source end), '/')[-1] as dataset_name from documents)
select doc_id, dataset_name,
  (case dataset_name when 'conala' then 128 when 'mbpp' then 512 else 1024 end)::int as max_new_tokens,
  case dataset_name when 'conala' then 'nl' when 'mbpp' then 'text' else 'question' end as instruction_field,
  case dataset_name when 'conala' then 'cmd' when 'mbpp' then 'code' else 'solutions' end as reference_field
from d"""

    s["joint_union"] = duck_with("pairs", "mbpp_raw") + """
select 'conala' as dataset, count(*) as n_rows, sum(length(nl))::bigint as instruction_chars,
  sum(length(reference))::bigint as reference_chars from pairs
union all select 'mbpp', count(*), sum(length(text))::bigint, sum(length(code))::bigint from mbpp_raw"""

    carve = """select doc_id, case when row_number() over (order by md5(concat('42:', cast(doc_id as varchar))), doc_id) <= 100
  then 'validation' else 'train' end as split from documents"""
    s["split_carve"] = carve
    s["split_carve_half"] = carve.replace("<= 100", "<= (select count(*) // 2 from documents)")
    s["split_sizes"] = f"with c as ({carve}) select split, count(*) as n_rows from c group by split"

    s["icl_exemplars"] = duck_with("pairs") + """,
seeds as (select * from (values (42),(777),(5432),(55555),(97)) v(seed)),
r as (select s.seed, p.example_id, row_number() over (partition by s.seed
        order by md5(concat(cast(s.seed as varchar), ':', cast(p.example_id as varchar))), p.example_id) as rank
      from pairs p cross join seeds s where p.split = 'train')
select seed, rank, example_id from r where rank <= 3"""

    s["icl_prompt"] = duck_with("pairs") + f""",
ex as (select * from (select nl, reference, row_number() over (order by md5(concat('42:', cast(example_id as varchar))), example_id) as rk
       from pairs where split = 'train') e where rk <= 3),
icl as (select string_agg({render_pair('nl', 'reference')}, '' order by rk) as txt, count(*) as n from ex)
select example_id, (2 * (select n from icl) + 2)::bigint as n_messages,
  {cut(f"((select txt from icl) || {render_pair('nl', 'null')})")} as prompt
from pairs where split = 'test'"""

    s["icl_grid"] = duck_with("pairs") + f""",
seeds as (select * from (values (42),(777),(5432),(55555),(97)) v(seed)),
ns as (select * from (values (1),(2),(3)) v(n)),
ex as (select * from (select s.seed, p.nl, p.reference, row_number() over (partition by s.seed
          order by md5(concat(cast(s.seed as varchar), ':', cast(p.example_id as varchar))), p.example_id) as rk
        from pairs p cross join seeds s where p.split = 'train') e where rk <= 3),
cfg as (select ex.seed, ns.n, string_agg({render_pair('nl', 'reference')}, '' order by rk) as txt, count(*) as cnt
        from ex join ns on ex.rk <= ns.n group by ex.seed, ns.n)
select t.example_id, cfg.seed, cfg.n, (2 * cfg.cnt + 2)::bigint as n_messages,
  {cut(f"(cfg.txt || {render_pair('t.nl', 'null')})")} as prompt
from pairs t cross join cfg where t.split = 'test'"""

    s["icl_prompt_by_n"] = f"""
with g as (select seed, n, avg(length(prompt)) as c from ({s["icl_grid"]}) x group by seed, n)
select 'conala' as dataset, n, count(distinct seed) as n_seeds, round(avg(c), 4) as mean_prompt_chars, round(stddev_samp(c), 4) as std_prompt_chars,
  round(min(c), 4) as min_prompt_chars, round(max(c), 4) as max_prompt_chars from g group by n"""

    grid = duck_with("pairs").rstrip() + f""",
g as ({s["icl_grid"]}),
raws as (select example_id, seed, n, substr(prompt, 1, (length(prompt) % 200 + 50)::integer) as raw from g),
answers as (select a.seed, a.n, a.example_id, {strip("split_part(raw, '```', 1)")} as response, p.reference from raws a join pairs p on a.example_id = p.example_id)"""
    s["icl_scores_by_n"] = chrf_family_sql("select concat(seed, ':', n) as grp, example_id, response as hyp, reference as ref from answers", grid) + """,
em as (select seed, n, concat(seed, ':', n) as grp, avg(case when response = reference then 1.0::double else 0.0::double end) as exact_match from answers group by seed, n),
v as (select seed, n, 'exact_match' as metric, exact_match as value from em union all select em.seed, em.n, 'chrf', sc.chrf from em join sc on sc.grp = em.grp)
select 'conala' as dataset, n, metric, count(distinct seed) as n_seeds, round(avg(value), 4) as mean_value, round(stddev_samp(value), 4) as std_value,
  round(min(value), 4) as min_value, round(max(value), 4) as max_value from v group by n, metric"""

    s["render_cut"] = duck_with("pairs") + f""", {BLINDED}
select example_id, {cut(render_pair('nl', 'reference'))} as prompt from blinded"""

    s["fence_cut"] = duck_with("responses") + f"\nselect example_id, {cleaned()} as response from responses"

    s["stop_truncate"] = duck_with("responses") + f""",
h as (select example_id, raw, instr(raw, '<|end|>') as p1, instr(raw, {stop2}) as p2 from responses),
b as (select *, case when p1 > 0 and (p2 = 0 or p1 <= p2) then 1 when p2 > 0 then 2 else 0 end as which from h)
select example_id, which > 0 as has_stop, case which when 1 then '<|end|>' when 2 then {stop2} end as stop_fired,
  case which when 0 then raw when 1 then substring(raw, 1, p1 - 1) else substring(raw, 1, p2 - 1) end as truncated from b"""

    s["completion_span"] = duck_with("pairs") + f""", {BLINDED},
rr as (select example_id, {render_pair('nl', 'reference')} as r from blinded),
sp as (select example_id, length(r) as n_chars,
         case when instr(r, {tmpl}) > 0 then length(string_split(r, {tmpl})[-1]) else 0 end as loss_chars from rr)
select example_id, (n_chars - loss_chars)::bigint as loss_start, loss_chars::bigint as loss_chars,
  round(1.0::double - loss_chars / n_chars, 6) as masked_fraction from sp"""

    s["align_responses"] = duck_with("responses") + f""", {CLEANED}
select coalesce(p.example_id, c.example_id) as example_id, p.example_id is not null as has_reference,
  c.example_id is not null as has_response, c.response = p.reference as exact
from pairs p full outer join cleaned c on p.example_id = c.example_id"""

    s["exact_match"] = duck_with("pairs") + """
select split, round(avg(case when prediction = reference then 1.0::double else 0.0::double end), 6) as exact_match
from pairs group by split"""

    pairs_src = "select 1 as grp, example_id, prediction as hyp, reference as ref from pairs"
    s["chrf"] = chrf_sql(pairs_src, 0, duck_with("pairs").rstrip()) + "select round(score, 6) as chrf from sc"
    s["chrf_pp"] = chrf_sql(pairs_src, 2, duck_with("pairs").rstrip()) + "select round(score, 6) as chrf_pp from sc"
    per_ex = (duck_with("pairs").rstrip() + ngram_ctes(pairs_src, 6, 0, chrf_words) + """,
ex2 as (select example_id as grp, kind, n, case when r > 0 then h else 0 end as h, r, m from ex),
sc as (""" + fscore("ex2", "grp") + """)
select p.example_id, round(coalesce(sc.score, 0.0), 6) as chrf from pairs p left join sc on sc.grp = p.example_id""")
    s["chrf_per_example"] = per_ex

    s["em_at_k"] = duck_with("candidates") + """,
pe as (select example_id,
  max(case when rank <= 1 and candidate = reference then 1.0::double else 0.0::double end) as e1,
  max(case when rank <= 5 and candidate = reference then 1.0::double else 0.0::double end) as e5,
  max(case when rank <= 10 and candidate = reference then 1.0::double else 0.0::double end) as e10
  from candidates group by example_id)
select round(avg(e1), 6) as em_at_1, round(avg(e5), 6) as em_at_5, round(avg(e10), 6) as em_at_10 from pe"""

    s["ngram_bleu"] = bleu_sql(pairs_src, duck_with("pairs").rstrip(), False) + "select round(score, 6) as bleu from sc"
    s["weighted_bleu"] = (bleu_sql(pairs_src, duck_with("pairs").rstrip(), True)
                          + "select round(score, 6) as weighted_bleu from sc")

    flag_src = "select split as grp, example_id, coalesce(response, '') as hyp, reference as ref from aligned"
    flag_prelude = duck_with("responses").rstrip() + f""", {CLEANED},
aligned as (select p.example_id, p.split, p.reference, c.response from pairs p left join cleaned c on p.example_id = c.example_id)"""
    s["flagship_eval"] = chrf_sql(flag_src, 0, flag_prelude) + """,
em as (select split, count(*) as n_examples, count(response) as n_responses,
  round(avg(case when response = reference then 1.0::double else 0.0::double end), 6) as exact_match
  from aligned group by split)
select em.split, n_examples, n_responses, exact_match, round(coalesce(sc.score, 0.0), 6) as chrf
from em left join sc on sc.grp = em.split"""

    carve_train = ("case when split = 'train' and row_number() over (partition by split = 'train' "
                   "order by md5(concat('42:', cast(doc_id as varchar))), doc_id) <= 50 then 'validation' else split end")
    s["prepare_apps"] = duck_with("apps_raw") + f""",
c as (select *, {carve_train} as split2 from apps_raw),
a as (select doc_id, split2 as split, {io_prompt} as prompt,
        case when split2 = 'test' then null else ({first_solution}) end as answer from c)
select doc_id, split, {user_turn('prompt', apps)} as user_content, {answer_turn('answer')} as assistant_content from a"""

    s["prepare_mbpp"] = duck_with("mbpp_raw") + f""",
m as (select *, case when doc_id % 10 = 0 then 'test' else 'train' end as split from mbpp_raw),
a as (select doc_id, split, concat(text, ' Your code should pass these tests:',
        array_to_string(list_transform(test_list, lambda t: chr(10) || t), '')) as prompt,
        case when split = 'test' then null else code end as answer from m)
select doc_id, split, {user_turn('prompt', 'mbpp')} as user_content, {answer_turn('answer')} as assistant_content from a"""

    stop_cut = f"""case when p1 > 0 and (p2 = 0 or p1 <= p2) then substring(raw, 1, p1 - 1)
      when p2 > 0 then substring(raw, 1, p2 - 1) else raw end"""
    ev_prelude = duck_with("responses").rstrip() + f""",
st as (select example_id, api_model, raw, instr(raw, '<|end|>') as p1, instr(raw, {stop2}) as p2 from responses),
cl as (select example_id, case when api_model then raw
         else {strip(f"split_part(({stop_cut}), '```', 1)")} end as response from st),
aligned as (select p.example_id, p.split, p.reference, c.response from pairs p left join cl c on p.example_id = c.example_id)"""
    ev_src = "select split as grp, example_id, coalesce(response, '') as hyp, reference as ref from aligned"
    s["evaluate_run"] = chrf_family_sql(ev_src, ev_prelude) + """,
em as (select split, count(*)::double as n_examples,
  avg(case when response = reference then 1.0::double else 0.0::double end) as exact_match from aligned group by split),
w as (select em.split, n_examples, exact_match, sc.chrf, sc.chrf_pp from em left join sc on sc.grp = em.split)
select split, 'n_examples' as metric, round(n_examples, 6) as value from w
union all select split, 'exact_match', round(exact_match, 6) from w
union all select split, 'chrf', round(chrf, 6) from w
union all select split, 'chrf_pp', round(chrf_pp, 6) from w"""

    s["run_outputs_roundtrip"] = ("select 'stub' as model, 'conala' as dataset, 0.2::double as temperature, "
                                  "'none' as strategy, 0 as n, split, metric, value from (\n"
                                  + s["evaluate_run"] + "\n) ev")

    s["knn_topk"] = duck_with("rq", "kb") + ", " + knn(5) + """
select query_id, doc_id, rank, round(sim, 5) as sim from knn"""

    s["rerank_maxsim"] = duck_with("rq", "kb") + ", " + reranked(10, 3) + """
select query_id, doc_id, final_rank, round(maxsim, 5) as maxsim from rr"""

    s["maxsim_search"] = duck_with("rq", "kb") + """,
qt as (select query_id, i.i, list_slice(embedding::double[], i.i * 8 + 1, i.i * 8 + 8) as t from rq cross join range(0, 8) i(i)),
dt as (select doc_id, list_slice(embedding::double[], j.j * 8 + 1, j.j * 8 + 8) as t from kb cross join range(0, 8) j(j)),
best as (select query_id, doc_id, i, max(list_inner_product(qt.t, dt.t)) as b from qt cross join dt group by query_id, doc_id, i),
ms as (select query_id, doc_id, round(sum(b), 9) as maxsim from best group by query_id, doc_id)
select query_id, doc_id, row_number() over (partition by query_id order by maxsim desc, doc_id) as rank, round(maxsim, 5) as maxsim
from ms qualify rank <= 10"""

    s["knn_topk_blocked"] = s["knn_topk"]

    s["knn_self_join"] = """
with p as (
  select a.vec_id as query_id, b.vec_id as doc_id,
         round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::double * x[2]::double)), 12) as sim
  from embeddings a cross join embeddings b)
select query_id, doc_id, row_number() over (partition by query_id order by sim desc, doc_id) as rank, round(sim, 5) as sim
from p qualify rank <= 5"""

    s["rag_prompt"] = duck_with("rq", "kb_docs") + ", kb as (select * from kb_docs), " + reranked(5, 2) + f""",
ctx as (select rr.query_id, string_agg({render_pair('d.text', 'd.source')}, '' order by rr.final_rank) as txt, count(*) as n
        from rr join documents d on d.doc_id = rr.doc_id group by rr.query_id)
select q.query_id, (2 * coalesce(ctx.n, 0) + 2)::bigint as n_messages,
  {cut(f"(coalesce(ctx.txt, '') || {render_pair('dq.text', 'null')})")} as prompt
from rq q join documents dq on dq.doc_id = q.query_id left join ctx on ctx.query_id = q.query_id"""

    s["apps_accuracy"] = duck_with("outcomes") + ", " + difficulty("outcomes") + """,
g as (select difficulty, problem_id, gen_id, avg(case when status > 0 then 1.0::double else 0.0::double end) as pass_share,
        bool_and(status > 0) as all_pass, bool_or(status = -2) as ce, bool_or(status = -1) as re
      from dd group by difficulty, problem_id, gen_id)
select difficulty, round(avg(pass_share), 6) as avg_accuracy, round(avg(all_pass::int::double), 6) as strict_accuracy,
  round(sum(ce::int)::double / count(*), 6) as compile_error_rate, round(sum(re::int)::double / count(*), 6) as runtime_error_rate,
  sum(ce::int)::bigint as compile_errors, sum(re::int)::bigint as runtime_errors, count(*) as n_generations, count(distinct problem_id) as n_problems
from g group by difficulty"""

    s["pass_at_k"] = duck_with("outcomes") + ", " + difficulty("outcomes") + """,
g as (select difficulty, problem_id, gen_id, bool_and(status > 0) as all_pass from dd group by difficulty, problem_id, gen_id),
pp as (select difficulty, problem_id, count(*) as n, sum(all_pass::int)::bigint as c from g group by difficulty, problem_id),
ks as (select * from (values (1),(2),(3)) v(k)),
est as (select difficulty, k, n, c, case when n - c < k then 1.0::double when c = 0 then 0.0::double
          else 1.0::double - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::double - k::double / i::double),
                                         lambda a, b: a * b) end as p from pp, ks)
select difficulty, k::bigint as k, round(avg(p), 6) as pass_at_k from est group by difficulty, k having min(n) >= k"""

    s["run_telemetry"] = duck_with("telemetry") + ", " + POLLS + "\n" + SUMMARY
    s["telemetry_stream"] = duck_with("telemetry") + ", " + ALL_POLLS + "\n" + SUMMARY

    s["telemetry_sessions"] = duck_with("telemetry") + ", " + ALL_POLLS + """,
b as (select *, case when poll_ts - lag(poll_ts) over (partition by run_id order by poll_ts) <= interval 6 hours then 0 else 1 end as new
      from polls where run_id is not null and poll_ts is not null),
g as (select *, sum(new) over (partition by run_id order by poll_ts) as session from b)
select run_id, epoch_us(min(poll_ts)) as first_poll_us,
  round(coalesce(arg_min(used_mb, case when used_mb >= 0 then poll_ts end), arg_min(used_mb, poll_ts)), 6) as initial_mb,
  round(max(used_mb), 6) as peak_mb, round((epoch_us(max(poll_ts)) - epoch_us(min(poll_ts))) / 1e6, 3) as elapsed_s,
  count(*) as n_polls from g group by run_id, session"""

    s["running_peak"] = duck_with("telemetry") + ", " + ALL_POLLS + """
select run_id, poll_ts, round(used_mb, 6) as used_mb, round(max(used_mb) over w, 6) as running_peak,
  row_number() over w as processed, count(*) over (partition by run_id) as total,
  round(100.0::double * (row_number() over w) / (count(*) over (partition by run_id)), 2) as pct
from polls window w as (partition by run_id order by poll_ts rows between unbounded preceding and current row)"""

    s["run_progress"] = duck_with("telemetry") + """
select run_id, ts, device, row_number() over w as processed, count(*) over (partition by run_id) as total,
  round(100.0::double * (row_number() over w) / (count(*) over (partition by run_id)), 2) as pct
from telemetry window w as (partition by run_id order by ts, device rows between unbounded preceding and current row)"""

    s["sweep_grid"] = duck_with("sweep_runs") + ", " + GRID + """,
pc as (select lora_r, lora_alpha, count(eval_loss) as n_runs, min(eval_loss) as best from sweep_runs group by lora_r, lora_alpha)
select g.lora_r, g.lora_alpha, coalesce(pc.n_runs, 0)::bigint as n_runs, pc.best as best_eval_loss
from grid g left join pc on pc.lora_r = g.lora_r and pc.lora_alpha = g.lora_alpha"""

    s["grid_missing"] = duck_with("sweep_runs") + ", " + GRID + """
select g.lora_r, g.lora_alpha from grid g
where not exists (select 1 from sweep_runs s where s.lora_r = g.lora_r and s.lora_alpha = g.lora_alpha
                  and s.eval_loss is not null)"""

    s["best_run"] = duck_with("all_runs") + """
select seed, lora_r, lora_alpha, eval_loss from (select *, row_number() over (partition by seed
  order by eval_loss, lora_r, lora_alpha) as rn from all_runs where eval_loss is not null) b where rn = 1"""

    s["icl_by_n"] = duck_with("all_runs") + """
select lora_alpha, lora_r, count(distinct case when eval_loss is not null then seed end) as n_seeds, round(avg(eval_loss), 6) as mean_eval_loss,
  round(stddev_samp(eval_loss), 6) as std_eval_loss, round(min(eval_loss), 6) as min_eval_loss,
  round(max(eval_loss), 6) as max_eval_loss
from all_runs group by lora_alpha, lora_r"""

    s["responses_roundtrip"] = duck_with("responses") + f""", {CLEANED}
select example_id, 0 as gen_id, response from cleaned"""

    s["dataset_roundtrip"] = duck_with("pairs") + f""", {BLINDED}
select example_id, split, 2::bigint as n_messages, {cut(render_pair('nl', 'reference'))} as prompt
from blinded where split = 'test'"""

    s["export_text"] = duck_with("pairs") + f"""
select 'predictions' as kind, count(*) as n_lines, sum(length({_escape('prediction')}))::bigint as n_chars from pairs
union all select 'references', count(*), sum(length({_escape('reference')}))::bigint from pairs"""

    s["batch_score"] = duck_with("pairs") + f""", {BLINDED}
select example_id, replace({cut(render_pair('nl', 'reference'))}, 'e', 'E') as response from blinded"""

    s["import_text"] = duck_with("pairs") + """
select row_number() over (order by example_id) - 1 as line, coalesce(prediction, '') as prediction, coalesce(reference, '') as reference from pairs"""
    s["generate_resumed"] = s["batch_score"]

    counts = ", ".join(f"(length(text) - length(replace(text, {q(ch)}, '')))::double" for ch in ["a", "e", "i", "o", "u", " "])
    s["embed_normalise"] = f"""
with c as (select doc_id, [{counts}] as v from documents),
nv as (select doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as nm from c)
select doc_id, (i - 1)::bigint as dim,
  round((case when nm > 0 then (v[i] / nm)::float else v[i]::float end)::double, 5) as value
from nv, range(1, 7) t(i)"""

    s["embed_updated"] = s["embed_normalise"]

    # corpora as prepared -------------------------------------------------------------------
    carve50 = ("case when split = 'train' and row_number() over (partition by split = 'train' "
               "order by md5(concat('42:', {id})), {id2}) <= 50 then 'validation' else split end")
    s["prepare_magicoder_oss"] = duck_with("pairs") + f"""
select example_id, {carve50.format(id="cast(example_id as varchar)", id2="example_id")} as split,
  nl as user_content, reference as assistant_content from pairs"""

    s["prepare_conala"] = duck_with("pairs") + f""", {BLINDED}
select example_id, split, {user_turn('nl', 'conala')} as user_content, {answer_turn('reference')} as assistant_content from blinded"""

    s["prepare_joint"] = duck_with("pairs", "mbpp_raw") + f""", {BLINDED},
m as (select doc_id, case when doc_id % 10 = 0 then 'test' else 'train' end as split,
        concat(text, ' Your code should pass these tests:', array_to_string(list_transform(test_list, lambda t: chr(10) || t), '')) as prompt,
        code from mbpp_raw),
u as (select concat('conala-', example_id) as row_id, 'conala' as dataset, split, {user_turn('nl', 'conala')} as user_content,
        {answer_turn('reference')} as assistant_content from blinded
      union all
      select concat('mbpp-', doc_id), 'mbpp', split, {user_turn('prompt', 'mbpp')},
        {answer_turn("(case when split = 'test' then null else code end)")} from m)
select row_id, dataset, {carve50.format(id="row_id", id2="row_id")} as split, user_content, assistant_content from u"""

    # one run, end to end -------------------------------------------------------------------
    e2e = duck_with("pairs", "telemetry").rstrip() + f""", {BLINDED},
prm as (select example_id, replace({cut(render_pair('nl', 'reference'))}, 'e', 'E') as raw from blinded),
st as (select example_id, raw, instr(raw, '<|end|>') as p1, instr(raw, {stop2}) as p2 from prm),
cl as (select example_id, {strip(f"split_part(({stop_cut}), '```', 1)")} as response from st),
aligned as (select p.example_id, p.split, p.reference, c.response from pairs p left join cl c on p.example_id = c.example_id)"""
    tele = SUMMARY.strip()
    s["run_end_to_end"] = chrf_family_sql(ev_src, e2e) + f""",
em as (select split, count(*)::double as n_examples,
  avg(case when response = reference then 1.0::double else 0.0::double end) as exact_match from aligned group by split),
w as (select em.split, n_examples, exact_match, sc.chrf, sc.chrf_pp from em left join sc on sc.grp = em.split),
{ALL_POLLS}
, run as (select * from ({tele}) r),
vals as (select run_id, split, 'n_examples' as metric, n_examples as value, null as unit from w, run
union all select run_id, split, 'exact_match', exact_match, null from w, run
union all select run_id, split, 'chrf', chrf, null from w, run
union all select run_id, split, 'chrf_pp', chrf_pp, null from w, run
union all select run_id, 'all', 'peak_memory', peak_mb, 'MB' from run
union all select run_id, 'all', 'elapsed', elapsed_s, 's' from run)
select 'stub' as model, concat('ckpt-', run_id) as checkpoint, split, metric, round(value, 4) as value, unit,
  case when unit is not null then concat(round(value)::bigint, ' ', unit) end as shown from vals"""

    s["run_address_two_runs"] = duck_with("all_runs") + """,
a as (select seed::integer as seed, round(avg(eval_loss), 6) as value from all_runs group by seed)
select t as temperature, c as checkpoint, seed, 'eval_loss' as metric, value from a,
  (values (0.12::double, 'base'), (0.124::double, 'base'), (0.12::double, 'ckpt-1')) r(t, c)"""

    # outcomes ------------------------------------------------------------------------------
    s["apps_report"] = duck_with("outcomes") + """,
dd as (select *, case when problem_id >= 0 and problem_id < 50 then 'interview' when problem_id >= 50 and problem_id < 80 then 'competition'
         else 'outside' end as difficulty from outcomes),
g as (select difficulty, problem_id, gen_id, bool_and(status > 0) as all_pass from dd group by difficulty, problem_id, gen_id),
pp as (select difficulty, problem_id, count(*) as n, sum(all_pass::int)::bigint as c from g group by difficulty, problem_id),
est as (select difficulty, k, n, case when n - c < k then 1.0::double when c = 0 then 0.0::double
          else 1.0::double - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::double - k::double / i::double),
                                         lambda a, b: a * b) end as p from pp, (values (1), (2)) ks(k))
select difficulty, 'strict_accuracy' as metric, round(avg(all_pass::int::double), 6) as value from g group by difficulty
union all
select difficulty, concat('pass_at_', k), round(avg(p), 6) from est group by difficulty, k having min(n) >= k"""

    s["apps_metrics_file"] = f"select 'icl' as method, 3 as n, difficulty, metric, round(value, 6) as value from ({s['apps_report']}) a"

    s["outcome_null_status"] = duck_with("outcomes") + ", o2 as (select problem_id, gen_id, test_id, " \
        "case when test_id % 7 <> 0 then status end as status from outcomes), " + difficulty("o2") + """,
g as (select difficulty, problem_id, gen_id, sum(case when status > 0 then 1 else 0 end)::double / count(*) as pass_share,
        sum(case when status > 0 then 1 else 0 end) = count(*) as all_pass
      from dd group by difficulty, problem_id, gen_id)
select difficulty, round(avg(pass_share), 6) as avg_accuracy, round(avg(all_pass::int::double), 6) as strict_accuracy
from g group by difficulty"""

    # expected values written out case by case, not computed
    lit = lambda x: "null" if x is None else q(x)
    cases = ", ".join(f"({i}, {lit(name)}, {lit(first)})" for i, (_, name, first) in enumerate(JSON_CASES))
    s["json_fields"] = f"""
select d.doc_id, c.fn_name, c.first from documents d join (values {cases}) c(i, fn_name, first) on d.doc_id % {len(JSON_CASES)} = c.i"""

    s["json_documents"] = "select doc_id, md5(nullif(text, '')) as fn_name, md5(text) as first from documents"

    s["contains_any"] = "select doc_id, contains(text, 'License') or contains(text, '@') or contains(text, 'the th') as found from documents"
    s["preview"] = "select doc_id, lang from documents where doc_id < 10"
    return s
