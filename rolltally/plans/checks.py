"""SQL checks: what each registered query must return, written independently for DuckDB.

The SQL works on the raw tables only. Shared steps are named sub-queries; ``check`` puts those a
statement needs in front of it.
"""

from __future__ import annotations

from rolltally.functions import prompts as P
from rolltally.sources.problems import BENCHMARKS

CHECKS: dict[str, str] = {}

K, THRESHOLD, CLIP, TAU = 8, 6, 0.05, 1.1


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BOX = "((?:[^{}]|\\{[^{}]*\\})*)"

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (needs, sql)


def check(name: str, sql: str, *needs: str, extra: str = "") -> None:
    order: list[str] = []

    def visit(n: str) -> None:
        for m in PARTS[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    views = [f"{n} AS ({PARTS[n][1]})" for n in order] + ([extra] if extra else [])
    head = ("WITH RECURSIVE " if "RECURSION" in sql + extra else "WITH ") + ",\n".join(views) + "\n" if views else ""
    CHECKS[name] = head + sql


# --- shared steps

part(
    "prob",
    """SELECT p_partkey AS prompt_id, p_name AS problem,
  CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 11 = 1 THEN '' ELSE CAST(p_size % 7 AS VARCHAR) END AS ground_truth
  FROM part""",
)
part(
    "base",
    """SELECT l_partkey AS prompt_id,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS rollout_idx,
  CAST(floor(l_quantity) AS BIGINT) % 5 + l_suppkey % 2 AS a,
  (l_suppkey * 3 + l_linenumber + l_orderkey) % 10 AS v,
  CAST(floor(l_extendedprice) AS BIGINT) % 1500 AS n_tokens,
  l_discount * 7 + l_tax AS kl_score,
  CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN CAST('-inf' AS DOUBLE) WHEN 1 THEN 0.0 + -l_discount * 10
    WHEN 2 THEN (0.0 + -l_discount * 10 + -l_tax * 10) / 2
    ELSE (0.0 + -l_discount * 10 + -l_tax * 10 + -(l_discount + l_tax)) / 3 END AS logp_score,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(CAST(floor(l_quantity) AS BIGINT) % 5 + l_suppkey % 2 AS VARCHAR) || '}}'
    WHEN 1 THEN ' }' END AS continuation
  FROM lineitem""",
)
part(
    "ro",
    """SELECT base.*, problem, ground_truth,
  CASE v WHEN 6 THEN 'work so' ELSE 'work ' || chr(92) || 'boxed{' || (a + 1) || '} so</think> ans ' || chr(92) || 'boxed{' ||
    CASE WHEN v IN (0, 1, 2) THEN CASE WHEN a = 5 AND v = 1 THEN 'x+1' WHEN a = 5 AND v = 2 THEN 'X + 1'
        WHEN a = 4 AND v = 1 THEN '1+' || chr(92) || 'sqrt{2}' WHEN a = 4 AND v = 2 THEN chr(92) || 'sqrt{2} + 1'
        WHEN a = 3 AND v = 1 THEN chr(92) || 'frac{x}{2}' WHEN a = 3 AND v = 2 THEN '0.5x'
        WHEN a = 2 AND v = 1 THEN chr(92) || 'pi^2' WHEN a = 2 AND v = 2 THEN chr(92) || 'frac{1}{' || chr(92) || 'pi}'
        ELSE CAST(a AS VARCHAR) END || '} done'
      WHEN v = 3 THEN ' ' || a || '.0 } done'
      WHEN v = 4 THEN chr(92) || 'frac{' || (2 * a) || '}{2}} done'
      WHEN v = 5 THEN (2 * a) || ':2} done'
      WHEN v = 7 THEN CAST(a AS VARCHAR)
      WHEN v = 8 THEN '} done'
      ELSE a || '} or ' || chr(92) || 'boxed{' || (a + 2) || '} end' END END AS completion
  FROM base JOIN prob USING (prompt_id)""",
    "prob",
    "base",
)


def keyed(source: str, answer: str) -> str:
    """Answers with the equivalence key of the notations the views contain."""
    number = f"""CASE WHEN regexp_full_match({answer}, '\\d+(\\.\\d+)?') THEN try_cast({answer} AS DOUBLE)
    WHEN regexp_full_match({answer}, '\\d+:\\d+') THEN try_cast(split_part({answer}, ':', 1) AS DOUBLE) / try_cast(split_part({answer}, ':', 2) AS DOUBLE)
    WHEN regexp_matches({answer}, 'frac\\{{\\d') AND NOT contains({answer}, 'pi') THEN try_cast(regexp_extract({answer}, 'frac\\{{(\\d+)\\}}\\{{(\\d+)\\}}', 1) AS DOUBLE)
      / try_cast(regexp_extract({answer}, 'frac\\{{(\\d+)\\}}\\{{(\\d+)\\}}', 2) AS DOUBLE) END"""
    return f"""SELECT * EXCLUDE (number), CASE WHEN {answer} IS NULL OR {answer} = '' THEN NULL
    WHEN replace(lower({answer}), ' ', '') = 'x+1' THEN 'e:1+1*x'
    WHEN contains({answer}, 'sqrt{{2}}') THEN 'e:1+1*√2' WHEN {answer} = '0.5x' OR contains({answer}, 'frac{{x}}') THEN 'e:1/2*x'
    WHEN contains({answer}, 'pi^2') THEN 'e:1*pi^2' WHEN contains({answer}, 'pi}}') THEN 'e:1*pi^-1'
    WHEN number IS NOT NULL THEN 'n:' || CAST(CAST(number AS DECIMAL(18, 6)) AS VARCHAR)
    ELSE 't:' || lower(replace({answer}, ' ', '')) END AS answer_key FROM (SELECT *, {number} AS number FROM ({source}))"""


FIRST = f"""SELECT * EXCLUDE (seg), CASE WHEN regexp_matches(seg, '\\\\boxed\\{{{BOX}\\}}')
  THEN trim(regexp_extract(seg, '\\\\boxed\\{{{BOX}\\}}', 1)) END AS answer
  FROM (SELECT *, string_split(completion, '</think>')[-1] AS seg FROM ro)"""
LAST = f"""SELECT * EXCLUDE (seg), CASE WHEN contains(completion, chr(92) || 'boxed') AND regexp_matches(seg, '^\\{{{BOX}\\}}')
  THEN trim(regexp_extract(seg, '^\\{{{BOX}\\}}', 1)) END AS answer
  FROM (SELECT *, string_split(completion, chr(92) || 'boxed')[-1] AS seg FROM ro)"""

TRUTH_KEY = "CASE WHEN coalesce(ground_truth, '') = '' THEN NULL ELSE 'n:' || ground_truth || '.000000' END"

part("raw", keyed(FIRST, "answer"), "ro")
MERGED = """SELECT * EXCLUDE (answer_key) REPLACE (CASE WHEN extracted THEN answer
  ELSE coalesce(nullif(trim(rtrim(continuation, '}')), ''), answer) END AS answer)
  FROM (SELECT *, coalesce(answer, '') <> '' AS extracted FROM raw)"""
part("an", keyed(MERGED, "answer"), "raw")
part("answers", f"SELECT *, coalesce(answer, '') <> '' AS has, {TRUTH_KEY} AS truth_key FROM an", "an")
part("ev", keyed(LAST, "answer"), "ro")
part(
    "graded",
    f"""SELECT 'bench' || (prompt_id % 5) AS dataset, prompt_id AS problem_id, rollout_idx, completion, answer,
  coalesce(nullif(answer, ''), '[No boxed answer found]') AS shown, answer IS NOT NULL AS formatted,
  coalesce(answer_key = {TRUTH_KEY}, false) AS correct FROM ev""",
    "ev",
)
part(
    "clus",
    """SELECT prompt_id, answer_key, count(*) AS n, arg_min(answer, rollout_idx) AS rep, min(rollout_idx) AS first_idx
  FROM answers GROUP BY ALL""",
    "answers",
)
part(
    "vote",
    """SELECT t.prompt_id, rep AS pseudo_label, answer_key AS label_key, coalesce(n, 0) AS consensus_count, n_rollouts
  FROM (SELECT prompt_id, count(*) AS n_rollouts FROM answers GROUP BY 1) t LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, length(trim(rep)), first_idx) AS r
    FROM clus WHERE answer_key IS NOT NULL) c ON t.prompt_id = c.prompt_id AND r = 1""",
    "clus",
)
part(
    "lab",
    f"""SELECT *, coalesce(answer_key = label_key, false) AS is_majority, coalesce(answer_key = truth_key, false) AS is_right,
  consensus_count >= {THRESHOLD} AND coalesce(pseudo_label, '') <> '' AS agreed
  FROM answers JOIN vote USING (prompt_id)""",
    "answers",
    "vote",
)


def quotas(fraction: float) -> str:
    """Targets and rows taken per class, spelled out step by step."""
    if fraction == -1:
        want = f"""CASE WHEN nn = 0 THEN least({K}, np) WHEN np = 0 THEN 0 ELSE p2 END AS target_pos,
        CASE WHEN nn = 0 THEN 0 WHEN np = 0 THEN least({K}, nn) ELSE n1 END AS target_neg"""
    else:
        want = f"CAST(round_even({K} * {fraction}, 0) AS BIGINT) AS target_pos, {K} - CAST(round_even({K} * {fraction}, 0) AS BIGINT) AS target_neg"
    return f"""SELECT *, CASE WHEN deficit > 0 AND p < target_pos THEN p WHEN deficit > 0 THEN p + least(deficit, np - p) ELSE p END AS take_pos,
    CASE WHEN deficit > 0 AND p < target_pos THEN n + least(deficit, nn - n) ELSE n END AS take_neg
  FROM (SELECT *, greatest({K} - p - n, 0) AS deficit FROM (SELECT *, least(np, target_pos) AS p, least(nn, target_neg) AS n
  FROM (SELECT *, {want} FROM (SELECT *, CASE WHEN p1 + n1 < {K} THEN least({K} - n1, np) ELSE p1 END AS p2
  FROM (SELECT * EXCLUDE (n0), CASE WHEN p1 + n0 < {K} THEN least({K} - p1, nn) ELSE n0 END AS n1
  FROM (SELECT *, greatest(1, least({K} - n0, np)) AS p1
  FROM (SELECT prompt_id, consensus_count AS np, n_rollouts - consensus_count AS nn,
    CASE WHEN np = 0 OR nn = 0 THEN 0 ELSE
    greatest(1, least(CAST(round_even({K} * sqrt(nn) / (sqrt(np) + sqrt(nn)), 0) AS BIGINT), nn)) END AS n0 FROM vote)))))))"""


ORDERS = {
    0: "CAST(NOT has AS INTEGER), n_tokens, rollout_idx",
    1: "-kl_score, n_tokens, rollout_idx",
    2: "-logp_score, n_tokens, rollout_idx",
    3: "CAST(NOT has AS INTEGER), -n_tokens, rollout_idx",
}

SIGNED = """SELECT *, CASE WHEN agreed THEN CASE WHEN is_majority THEN 1 ELSE -1 END
    WHEN has AND row_number() OVER (PARTITION BY prompt_id, has ORDER BY n_tokens, sel_rank) = 1 THEN 1 ELSE -1 END AS direction_sign
  FROM ({chosen})"""


def selection(strategy: int, fraction: float) -> str:
    if fraction == -2:
        chosen = f"""SELECT *, rollout_idx AS sel_rank FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY rollout_idx) AS r FROM lab)
        WHERE r <= {K}"""
        return SIGNED.format(chosen=chosen)
    chosen = f"""SELECT *, CAST(r - 1 + CASE WHEN side = 2 THEN take_pos ELSE 0 END AS BIGINT) AS sel_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY prompt_id, side ORDER BY {ORDERS[strategy]}) AS r
    FROM (SELECT *, CASE WHEN NOT agreed THEN 0 WHEN is_majority THEN 1 ELSE 2 END AS side FROM lab JOIN ({quotas(fraction)}) q USING (prompt_id)))
  WHERE r <= CASE side WHEN 0 THEN {K} WHEN 1 THEN take_pos ELSE take_neg END"""
    return SIGNED.format(chosen=chosen)


part("chosen", selection(0, 0.5), "lab")
part(
    "problem",
    """SELECT dataset, problem_id, count(*) AS n_solutions, count(*) FILTER (correct) AS num_correct,
  count(*) FILTER (formatted) AS num_formatted, bool_or(correct) AS pass_at_n,
  arg_min(shown, rollout_idx) AS predicted_answer, arg_min(correct, rollout_idx) AS first_ok, arg_min(formatted, rollout_idx) AS first_fmt
  FROM graded GROUP BY ALL""",
    "graded",
)
part(
    "rawvote",
    """SELECT * FROM (SELECT dataset, problem_id, shown, count(*) AS votes, bool_or(correct) AS ok,
    row_number() OVER (PARTITION BY dataset, problem_id ORDER BY count(*) DESC, min(rollout_idx)) AS r
    FROM graded WHERE formatted GROUP BY dataset, problem_id, shown) WHERE r = 1""",
    "graded",
)
part(
    "perproblem",
    """SELECT p.*, coalesce(ok, false) AS majority_vote_correct FROM problem p LEFT JOIN rawvote v USING (dataset, problem_id)""",
    "problem",
    "rawvote",
)
part(
    "steps",
    """SELECT user_id, event_id, ts, event_type AS name, round(value * 100) AS value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events""",
)
part(
    "tok",
    """SELECT CAST(a.label AS BIGINT) AS seq_id, a.vec_id % 4 AS sample_id,
  row_number() OVER (PARTITION BY a.label, a.vec_id % 4 ORDER BY a.vec_id) - 1 AS pos, a.vec_id % 64 AS token_id,
  a.embedding AS st, coalesce(b.embedding, (SELECT arg_min(embedding, vec_id) FROM embeddings)) AS te
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
part(
    "el",
    """SELECT seq_id, sample_id, pos, token_id, CASE WHEN pos % 9 = 0 THEN -100 ELSE token_id END AS label,
  CASE WHEN sample_id % 2 = 0 THEN 1 ELSE -1 END AS direction_sign, CASE WHEN sample_id % 2 = 0 THEN 1.5 ELSE -0.5 END AS advantage,
  unnest(range(64)) AS i, CAST(unnest(st) AS DOUBLE) * 20 AS s, CAST(unnest(te) AS DOUBLE) * 20 AS t FROM tok""",
    "tok",
)
part(
    "lp",
    f"""SELECT *, s / {TAU} - ln(sum(exp(s / {TAU})) OVER w) AS ls, t / {TAU} - ln(sum(exp(t / {TAU})) OVER w) AS lt
  FROM el WINDOW w AS (PARTITION BY seq_id, sample_id, pos)""",
    "el",
)
part(
    "sc",
    f"""SELECT seq_id, sample_id, pos, token_id, label, direction_sign, CAST(advantage AS DOUBLE) AS advantage, label <> -100 AS valid,
  -sum(exp(ls) * ls) AS ent_s, -sum(exp(ls) * ln(exp(ls) + 1e-10)) AS ent_eps, -sum(exp(lt) * lt) AS ent_t,
  sum(exp(lt) * (lt - ls)) AS fkl, sum(exp(ls) * (ls - lt)) AS rkl,
  sum(least(exp(lt) * (lt - ls), {CLIP})) AS fklc, sum(least(exp(ls) * (ls - lt), {CLIP})) AS rklc,
  max(CASE WHEN i = greatest(label, 0) THEN ls END) AS logp,
  max(CASE WHEN i = token_id THEN ls END) AS slp, max(CASE WHEN i = token_id THEN lt END) AS tlp
  FROM lp GROUP BY ALL""",
    "lp",
)


def scaled(value: str, low: str, top: str) -> str:
    return f"CASE WHEN {top} - {low} < 1e-8 THEN 0.0 ELSE greatest(least((least({value}, {top}) - {low}) / ({top} - {low}), 1.0), 0.0) END"


part(
    "we",
    f"""SELECT *, 1 - (1 - h) * (1 - d) AS weight FROM (SELECT sc.*, {scaled('ent_s', 'hl', 'ht')} AS h, {scaled('greatest(fkl, 0)', 'dl', 'dt')} AS d
  FROM sc JOIN (SELECT seq_id, min(ent_s) AS hl, quantile_cont(ent_s, 0.98) AS ht, min(greatest(fkl, 0)) AS dl,
    quantile_cont(greatest(fkl, 0), 0.98) AS dt FROM sc WHERE valid GROUP BY 1) USING (seq_id))""",
    "sc",
)
part(
    "kept",
    """SELECT *, r < greatest(floor(nv * 0.3), 1) AS kept FROM (SELECT *,
  row_number() OVER (PARTITION BY seq_id, sample_id ORDER BY weight DESC, pos) - 1 AS r,
  count(*) OVER (PARTITION BY seq_id, sample_id) AS nv FROM we WHERE valid)""",
    "we",
)
part(
    "ma",
    """SELECT *, coalesce(valid AND mask_score >= med, false) AS masked_in FROM (SELECT *, -logp * (1 - h) AS mask_score FROM we)
  JOIN (SELECT seq_id, quantile_cont(-logp * (1 - h), 0.5) AS med FROM we WHERE valid GROUP BY 1) USING (seq_id)""",
    "we",
)
part(
    "samples",
    """SELECT seq_id, sample_id, direction_sign, coalesce(sum(fklc * weight) FILTER (valid) / count(*) FILTER (valid), 0) AS kl_loss,
  coalesce(sum(CASE WHEN masked_in THEN -advantage * logp ELSE 0 END) FILTER (valid) / count(*) FILTER (valid), 0) AS pg_loss
  FROM ma GROUP BY ALL""",
    "ma",
)

# --- sources, sinks, partitioning

check("scan_problems", "SELECT p_partkey AS prompt_id, p_name AS problem, p_size AS answer FROM part")
check(
    "benchmark_registry",
    "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS dataset, {'CAST(item_id AS VARCHAR)' if ident else 'CAST(row_number() OVER (ORDER BY text) - 1 AS VARCHAR)'} AS problem_id, text AS problem,
  {'CAST(item_id * 3 AS VARCHAR)' if answer else 'CASE WHEN item_id % 4 = 0 THEN text ELSE CAST(item_id AS VARCHAR) END'} AS ground_truth FROM benchmark"""
        for name, (_, _, answer, ident) in BENCHMARKS.items()
    ),
)
check(
    "normalize_fields",
    """SELECT p_partkey AS id, p_name AS problem, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS answer,
  p_type AS solution FROM part""",
)
check("head_n", "SELECT * FROM prob ORDER BY prompt_id LIMIT 100", "prob")
check(
    "train_eval_split",
    f"""SELECT p_partkey AS prompt_id, CASE WHEN substr(md5('42:' || p_partkey), 1, 8) < '{int(0.007 * 16**8):08x}' THEN 'test'
  ELSE 'train' END AS split FROM part""",
)
check("shard_interleaved", "SELECT p_partkey AS prompt_id, (row_number() OVER (ORDER BY p_partkey) - 1) % 8 AS shard FROM part")
LINE, GAP = "chr(10)", "chr(10) || chr(10)"
ASK = quoted(P.INSTRUCTION)
part(
    "logged",
    f"""SELECT prompt_id // 8 AS step, prompt_id, 'Problem: ' || problem || {GAP} || {ASK} AS prompt, completion, rollout_idx, coalesce(l.answer, '') AS answer,
  coalesce(l.ground_truth, '') AS ground_truth, c.sel_rank IS NOT NULL AS is_selected, l.is_majority,
  coalesce(c.direction_sign, 0) AS direction_sign FROM lab l LEFT JOIN
  (SELECT prompt_id, rollout_idx, sel_rank, direction_sign FROM chosen) c USING (prompt_id, rollout_idx)""",
    "lab",
    "chosen",
)
check("rollout_log", "SELECT * EXCLUDE (prompt, completion), sha256(prompt) AS prompt_sha256, sha256(completion) AS completion_sha256 FROM logged", "logged")
FLUSH = "CAST(greatest(ceil((prompt_id // 8) / 5.0) * 5, 5) AS BIGINT)"
check(
    "write_rollout_log",
    f"""SELECT {FLUSH} AS flush_step, count(*) AS num_samples, count(*) AS n_generations, count(*) FILTER (is_selected) AS n_selected, count(*) FILTER (is_majority) AS n_majority,
  sha256(string_agg(prompt || completion || answer, '|' ORDER BY prompt_id, rollout_idx)) AS texts_sha256 FROM logged GROUP BY 1""",
    "logged",
)
check(
    "write_eval_report",
    """SELECT g.dataset, g.problem_id, p.problem, p.ground_truth, q.n_solutions AS val_n, q.num_correct, q.majority_vote_correct,
  count(*) AS n_generations, count(*) FILTER (g.correct) AS n_correct, arg_min(completion, rollout_idx) AS first_generation
  FROM graded g JOIN perproblem q ON q.dataset = g.dataset AND q.problem_id = g.problem_id JOIN prob p ON p.prompt_id = g.problem_id GROUP BY ALL""",
    "graded",
    "perproblem",
    "prob",
)
check(
    "latest_checkpoint",
    """SELECT 'run' || o_custkey AS run, 'run' || o_custkey || '/checkpoint-' || max(o_orderkey) AS latest_path, max(o_orderkey) AS latest_step
  FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey""",
)
check(
    "run_key",
    """SELECT o_orderkey, 'eval_results_' || lower(o_orderstatus) || '_base-' || (o_custkey % 4) ||
  CASE WHEN o_orderkey % 4 <> 0 THEN '_run' || (o_orderkey % 3) || '_checkpoint-' || o_orderkey ELSE '' END ||
  CASE WHEN o_orderkey % 2 = 0 THEN '_thinking' ELSE '_nonthinking' END || '_temp' || CAST((o_orderkey % 11) / 10.0::DOUBLE AS VARCHAR) ||
  '_valn' || (o_orderkey % 16) AS run_key FROM orders""",
)
check(
    "merge_batches",
    """SELECT prompt_id, problem, CASE prompt_id % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS batch_no FROM prob
  ORDER BY batch_no, prompt_id LIMIT 1500""",
    "prob",
)

# --- projections and string functions

check(
    "student_prompt",
    f"""SELECT prompt_id, 'Problem: ' || problem || {GAP} || {ASK} AS train_prompt, 'Problem: ' || problem || {LINE} || {ASK} AS compact_prompt,
  problem || {GAP} || {ASK} AS eval_prompt FROM prob""",
    "prob",
)
check(
    "teacher_prompt",
    f"""SELECT prompt_id, 'Problem: ' || problem || {GAP} || 'Here is a reference solution to this problem:' || {LINE} ||
  '=== Reference Solution Begin ===' || {LINE} || coalesce(ground_truth, '') || {LINE} || '=== Reference Solution End ===' || {LINE} ||
  {quoted(P.TRANSITION)} || {LINE} || {ASK} AS teacher_prompt, 'Problem: ' || problem || {GAP} || {ASK} AS plain_prompt FROM prob""",
    "prob",
)
REASON = f"""'Problem: ' || p_name || {GAP} || 'Here is a correct reasoning to this problem:=== Reference Reasoning Start ===' || {LINE} ||
  p_type || {LINE} || '=== Reference Reasoning End ===' || {GAP} || {quoted(P.ANALYSE)}"""
check(
    "reason_first_prompt",
    f"""SELECT p_partkey AS prompt_id, {REASON} AS reasoning_prompt,
  {REASON} || p_brand || {LINE} || {quoted(P.TRANSITION)} || {LINE} || {ASK} AS teaching_prompt FROM part""",
)
ROW = "prompt_id, rollout_idx"
check("extract_boxed_first", f"SELECT {ROW}, answer FROM raw", "raw")
check("extract_boxed_last", f"SELECT {ROW}, answer FROM ev", "ev")
check(
    "ratio_to_fraction",
    rf"SELECT {ROW}, regexp_replace(answer, '^(\d+):(\d+)$', chr(92) || chr(92) || 'frac{{\1}}{{\2}}') AS answer FROM an",
    "an",
)
check("normalize_answer", f"SELECT {ROW}, lower(replace(answer, ' ', '')) AS answer FROM an", "an")
check("normalize_answer_eval", f"SELECT {ROW}, lower(replace(answer, ' ', '')) AS answer FROM an", "an")
check("answer_key", f"SELECT {ROW}, answer_key FROM an", "an")
check(
    "ground_truth_or_solution",
    f"SELECT {ROW}, coalesce(answer, completion) AS truth FROM ev",
    "ev",
)
check("strip_pad_token", "SELECT prompt_id, problem AS prompt FROM prob", "prob")
check(
    "repair_queue",
    f"""SELECT {ROW}, 'Problem: ' || problem || {GAP} || {ASK} || completion ||
  CASE WHEN contains(completion, '</think>') THEN '' ELSE '</think>' END || {GAP} || chr(92) || 'boxed{{' AS prefix
  FROM answers WHERE NOT extracted""",
    "answers",
)
check("merge_repairs", f"SELECT {ROW}, answer, answer_key, has AND NOT extracted AS recovered FROM answers", "answers")
check(
    "repair_rates",
    """SELECT count(*) AS n_rollouts, round(avg(CASE WHEN extracted THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS extraction_rate,
  round(count(*) FILTER (has AND NOT extracted) / count(*) FILTER (NOT extracted), 6) AS recovery_rate,
  round(avg(CASE WHEN has THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS answer_rate FROM answers""",
    "answers",
)

# --- joins

check("join_vote_back", f"SELECT {ROW}, answer, pseudo_label, consensus_count, is_majority FROM lab", "lab")
check(
    "join_ground_truth",
    f"SELECT {ROW}, answer, ground_truth, coalesce(ground_truth, '') <> '' AS has_truth FROM answers",
    "answers",
)
check("answer_equijoin", f"SELECT {ROW}, coalesce(answer_key = truth_key, false) AS matched FROM answers", "answers")
check(
    "selected_lookup",
    f"SELECT {ROW}, sel_rank, direction_sign FROM answers LEFT JOIN (SELECT {ROW}, sel_rank, direction_sign FROM chosen) USING ({ROW})",
    "answers",
    "chosen",
)
check("sample_expand", f"SELECT prompt_id, unnest(range({K}))::INTEGER AS sample_idx FROM prob", "prob")

# --- voting, rewards, metrics

check("majority_vote", "SELECT prompt_id, pseudo_label, consensus_count, n_rollouts FROM vote", "vote")
check(
    "majority_vote_raw",
    "SELECT dataset, problem_id, shown AS voted_answer, votes, ok AS majority_vote_correct FROM rawvote",
    "rawvote",
)
check(
    "gt_route",
    """SELECT prompt_id, ground_truth AS pseudo_label, count(*) FILTER (answer_key = 'n:' || ground_truth || '.000000') AS consensus_count,
  count(*) AS n_rollouts FROM answers WHERE nullif(ground_truth, '') IS NOT NULL GROUP BY prompt_id, ground_truth""",
    "answers",
)
check("consensus_gate", f"SELECT prompt_id, consensus_count FROM vote WHERE consensus_count >= {THRESHOLD}", "vote")
check(
    "consensus_counts",
    f"""SELECT count(*) FILTER (consensus_count >= {THRESHOLD}) AS prompts_with_consensus,
  count(*) FILTER (consensus_count < {THRESHOLD}) AS prompts_without_consensus FROM vote""",
    "vote",
)
check("reward_majority", f"SELECT {ROW}, CAST(agreed AND is_majority AS INTEGER)::DOUBLE AS reward FROM lab", "lab")
check("reward_ground_truth", f"SELECT {ROW}, CASE WHEN answer_key = truth_key THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM answers", "answers")
check(
    "eval_per_problem",
    """SELECT dataset, problem_id, n_solutions, num_correct, num_formatted, pass_at_n, majority_vote_correct, predicted_answer,
  first_ok AS correct, first_fmt AS formatted FROM perproblem""",
    "perproblem",
)
check(
    "eval_generations_nested",
    """SELECT dataset, problem_id, rollout_idx, shown AS predicted_answer, completion AS full_generation, correct, formatted FROM graded""",
    "graded",
)
SUMMARY = """SELECT dataset, count(*) AS num_problems, sum(n_solutions)::BIGINT AS total_solutions,
  count(*) FILTER (pass_at_n) AS pass_at_n, round(100.0 * count(*) FILTER (pass_at_n) / count(*), 6) AS pass_at_n_pct,
  sum(num_correct)::BIGINT AS average_at_n, round(100.0 * sum(num_correct) / sum(n_solutions), 6) AS average_at_n_pct,
  count(*) FILTER (majority_vote_correct) AS majority_vote_at_n,
  round(100.0 * count(*) FILTER (majority_vote_correct) / count(*), 6) AS majority_vote_at_n_pct,
  sum(num_formatted)::BIGINT AS formatted_count, round(100.0 * sum(num_formatted) / sum(n_solutions), 6) AS format_rate
  FROM perproblem GROUP BY dataset"""
check("eval_summary", SUMMARY, "perproblem")
check(
    "val_avg_pass",
    """SELECT count(*) AS n_valid, round(avg(ok / 32), 6) AS avg_at_n, round(avg(CASE WHEN ok > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pass_at_n
  FROM (SELECT prompt_id, count(*) FILTER (is_right)::DOUBLE AS ok FROM lab WHERE truth_key IS NOT NULL GROUP BY 1)""",
    "lab",
)
part(
    "acc",
    """SELECT coalesce(sum(CAST(has AND is_right AS INTEGER)) / nullif(sum(CAST(has AS INTEGER)), 0), 0)::DOUBLE AS rollout_accuracy,
  count(DISTINCT CASE WHEN is_right THEN prompt_id END) / count(DISTINCT prompt_id) AS pass_at_k,
  count(DISTINCT CASE WHEN label_key = truth_key THEN prompt_id END) / count(DISTINCT CASE WHEN pseudo_label <> '' THEN prompt_id END) AS vote_accuracy
  FROM lab WHERE truth_key IS NOT NULL""",
    "lab",
)
check(
    "vote_metrics",
    f"""SELECT round(avg(consensus_count), 6) AS consensus_mean, round(avg(consensus_count / n_rollouts), 6) AS majority_ratio,
  count(*) FILTER (consensus_count >= {THRESHOLD}) AS prompts_with_consensus, count(*) FILTER (consensus_count < {THRESHOLD}) AS prompts_without_consensus,
  round((SELECT sum(CAST(agreed AND is_majority AS INTEGER)) / count(*) FROM lab), 6) AS reward_mean,
  round((SELECT count(*) FILTER (agreed AND is_majority) / count(*) FROM lab), 6) AS positive_fraction,
  round((SELECT count(*) FILTER (has) / count(*) FROM lab), 6) AS extractable_fraction,
  round((SELECT vote_accuracy FROM acc), 6) AS vote_accuracy, round((SELECT pass_at_k FROM acc), 6) AS pass_at_n FROM vote""",
    "vote",
    "lab",
    "acc",
)
check(
    "grpo_advantage",
    f"""SELECT {ROW}, direction_sign, round(CASE WHEN s > 1e-8 THEN (reward - m) / (s + 1e-6) ELSE reward - m END, 6) AS advantage FROM (
  SELECT *, CASE WHEN direction_sign > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward, sqrt(m * (1 - m)) AS s FROM (
  SELECT *, CASE WHEN consensus_count >= {THRESHOLD} THEN consensus_count ELSE 0 END::DOUBLE / n_rollouts AS m FROM chosen))""",
    "chosen",
)
check(
    "ema_series",
    "SELECT user_id, step, round(value, 6) AS value, round(e, 6) AS ema FROM r /* RECURSION */",
    "steps",
    extra="""r AS (SELECT user_id, step, value, value AS e FROM steps WHERE step = 1
  UNION ALL SELECT s.user_id, s.step, s.value, 200.0::DOUBLE / 201 * r.e + s.value / 201 FROM r JOIN steps s ON s.user_id = r.user_id AND s.step = r.step + 1)""",
)
check(
    "snapshot_asof",
    """SELECT user_id, step, round(last_value(CASE WHEN step % 10 = 0 THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS snapshot FROM steps""",
    "steps",
)
check(
    "rollout_accuracy",
    "SELECT round(rollout_accuracy, 6) AS rollout_accuracy, round(vote_accuracy, 6) AS vote_accuracy, round(pass_at_k, 6) AS pass_at_k FROM acc",
    "acc",
)
check(
    "wrong_label_neither",
    """SELECT count(*) FILTER (NOT is_majority AND NOT is_right) AS neither, count(*) AS total,
  round(count(*) FILTER (NOT is_majority AND NOT is_right) / count(*), 6) AS wrong_label_neither_fraction
  FROM lab WHERE truth_key IS NOT NULL AND label_key IS NOT NULL AND label_key <> truth_key""",
    "lab",
)
part(
    "signs",
    f"""SELECT {ROW}, is_right, truth_key, CASE WHEN agreed THEN CASE WHEN is_majority THEN 1 ELSE -1 END
    WHEN has AND row_number() OVER (PARTITION BY prompt_id, has ORDER BY n_tokens, rollout_idx) = 1 THEN 1 ELSE -1 END AS direction_sign FROM lab""",
    "lab",
)
check(
    "signal_accuracy",
    """SELECT round((SELECT avg(CASE WHEN (direction_sign = 1) = is_right THEN 1.0 ELSE 0.0 END) FROM signs WHERE truth_key IS NOT NULL), 6)::DOUBLE AS signal_accuracy,
  round((SELECT avg(CASE WHEN (direction_sign = 1) = is_right THEN 1.0 ELSE 0.0 END) FROM chosen WHERE truth_key IS NOT NULL), 6)::DOUBLE AS update_signal_accuracy""",
    "signs",
    "chosen",
)
check(
    "selection_metrics",
    f"""SELECT round((SELECT count(*) FILTER (agreed AND is_majority) / count(*) FROM lab), 6) AS positive_fraction,
  round(count(*) FILTER (direction_sign > 0) / count(*), 6) AS update_positive_fraction,
  round((SELECT count(*) FILTER (has) / count(*) FROM lab), 6) AS extractable_fraction,
  round(count(*) FILTER (NOT agreed AND NOT has) / ({K} * (SELECT count(*) FROM vote)), 6) AS backfill_fraction,
  round((SELECT avg(consensus_count) FROM vote), 6) AS consensus_mean,
  (SELECT count(*) FROM vote WHERE consensus_count >= {THRESHOLD}) AS prompts_with_consensus,
  round(avg(n_tokens), 6) AS selected_len_mean, max(n_tokens) AS selected_len_max FROM chosen""",
    "lab",
    "chosen",
    "vote",
)
check(
    "ratio_of_sums",
    """SELECT round(count(*) FILTER (has AND is_right) / count(*) FILTER (has AND truth_key IS NOT NULL), 6) AS rollout_accuracy,
  round(avg(n_tokens), 6) AS len_mean, max(n_tokens) AS len_max FROM lab""",
    "lab",
)
check(
    "metric_window_mean",
    "SELECT name, (step - 1) // 10 AS log_window, round(avg(value), 6) AS mean_value, count(*) AS n_values FROM steps GROUP BY ALL",
    "steps",
)
check(
    "on_off_policy_loss",
    """SELECT (step - 1) // 10 AS log_window,
  round_even(sum(value) FILTER (user_id % 3 <> 0) / (count(*) FILTER (user_id % 3 <> 0) * 0.125::DOUBLE), 4) AS on_policy_loss,
  round_even(sum(value) FILTER (user_id % 3 = 0) / (nullif(count(*) FILTER (user_id % 3 = 0), 0) * 0.125::DOUBLE), 4) AS off_policy_loss
  FROM steps GROUP BY 1""",
    "steps",
)
check(
    "generation_throughput",
    """SELECT prompt_id // 8 AS call, count(*) AS n_rows, sum(n_tokens)::BIGINT AS total_tokens, round(avg(n_tokens), 6) AS mean_len,
  round(sum(n_tokens) / greatest(sum(kl_score), 1e-6::DOUBLE), 6) AS tokens_per_s FROM base GROUP BY 1""",
    "base",
)
check(
    "greedy_extraction_rate",
    """SELECT round(avg(CASE WHEN has THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS greedy_extraction_rate
  FROM answers WHERE rollout_idx = 0""",
    "answers",
)

# --- ranking and selection

PICK = f"{ROW}, CAST(sel_rank AS BIGINT) AS sel_rank, direction_sign"
for name, strategy, fraction in (
    ("select_shortest", 0, 0.5),
    ("select_max_kl", 1, 0.5),
    ("select_max_logp", 2, 0.5),
    ("select_longest", 3, 0.5),
    ("select_sqrt", 0, -1),
    ("select_naive", 0, -2),
):
    check(name, f"SELECT {PICK} FROM ({selection(strategy, fraction)})", "lab")
for name, fraction, columns in (
    ("quota_fixed", 0.3, "target_pos, target_neg"),
    ("quota_sqrt", -1, "target_pos, target_neg"),
    ("backfill", 0.9, "take_pos, take_neg"),
):
    check(name, f"SELECT prompt_id, np AS n_pos, nn AS n_neg, {columns} FROM ({quotas(fraction)})", "vote")
check("no_consensus_fallback", f"SELECT {PICK} FROM chosen WHERE NOT agreed", "chosen")
check("direction_sign", f"SELECT {ROW}, direction_sign FROM signs", "signs")
check(
    "teacher_privilege",
    """SELECT prompt_id, coalesce(arg_min(completion, n_tokens * 100 + sel_rank) FILTER (direction_sign = 1), coalesce(any_value(pseudo_label), '')) AS trajectory,
  coalesce(any_value(pseudo_label), '') AS label FROM chosen GROUP BY prompt_id""",
    "chosen",
)
part(
    "positions",
    """SELECT c.*, prompt_id // 8 AS step, sel_rank * prompts + prompt_rank AS position FROM chosen c JOIN (
  SELECT prompt_id, row_number() OVER (PARTITION BY prompt_id // 8 ORDER BY prompt_id) - 1 AS prompt_rank,
    count(*) OVER (PARTITION BY prompt_id // 8) AS prompts FROM vote) USING (prompt_id)""",
    "chosen",
    "vote",
)
check("rollout_major_order", f"SELECT step, {ROW}, position FROM positions", "positions")
check(
    "micro_batch_assign",
    """SELECT prompt_id, sel_rank, pr // 4 AS step, (sel_rank * 4 + pr % 4) // 4 AS micro_batch FROM chosen JOIN (
  SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS pr FROM vote) USING (prompt_id)""",
    "chosen",
    "vote",
)
part(
    "runtot",
    """SELECT dataset, problem_id, row_number() OVER w AS done, pass_at_n, num_correct,
  round(100.0 * sum(CAST(pass_at_n AS INTEGER)) OVER w / row_number() OVER w, 6) AS running_pass_at_n,
  round(100.0 * sum(num_correct) OVER w / sum(n_solutions) OVER w, 6) AS running_avg_at_n,
  round(100.0 * sum(num_formatted) OVER w / sum(n_solutions) OVER w, 6) AS running_format_rate
  FROM perproblem WINDOW w AS (PARTITION BY dataset ORDER BY problem_id ROWS UNBOUNDED PRECEDING)""",
    "perproblem",
)
check("running_metrics", "SELECT * FROM runtot", "runtot")
check("progress_every_10", "SELECT * FROM runtot WHERE done % 10 = 0", "runtot")
check(
    "step_time",
    """SELECT user_id, step, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY step)) / 1e6::DOUBLE, 6) AS step_seconds
  FROM steps""",
    "steps",
)
check(
    "last_n_log",
    "SELECT prompt_id // 8 AS step, prompt_id, rollout_idx, answer FROM an ORDER BY prompt_id DESC, rollout_idx DESC LIMIT 500",
    "an",
)
check("topk_tokens", "SELECT seq_id, sample_id, pos, r AS rank FROM kept WHERE kept", "kept")

# --- set operations and sampling

check(
    "dedup_rollouts",
    """SELECT l_partkey AS prompt_id, l_linenumber AS rollout_idx, l_orderkey, l_suppkey, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey, l_extendedprice) = 1""",
)
check("sample_n", f"SELECT {ROW}, answer FROM an ORDER BY md5('42:' || prompt_id || ':' || rollout_idx), prompt_id, rollout_idx LIMIT 64", "an")
check(
    "group_duplicate_prompts",
    """SELECT t.problem, rep AS pseudo_label, coalesce(n, 0) AS consensus_count, n_rollouts, ground_truth FROM (
    SELECT problem, count(*) AS n_rollouts, arg_min({'g': ground_truth}, prompt_id * 100000 + rollout_idx)['g'] AS ground_truth FROM answers GROUP BY 1) t
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY n DESC, length(rep), f) AS r FROM (
    SELECT problem, answer_key, count(*) AS n, arg_min(answer, prompt_id * 100000 + rollout_idx) AS rep, min(prompt_id * 100000 + rollout_idx) AS f
    FROM answers WHERE answer_key IS NOT NULL GROUP BY ALL)) c ON c.problem = t.problem AND r = 1""",
    "answers",
)

# --- token statistics

check("log_softmax", "SELECT seq_id, sample_id, pos, CAST(i AS INTEGER) AS entry, round(ls, 6) AS log_prob FROM lp", "lp")
for name, column in (("token_entropy", "ent_eps"), ("token_entropy_plain", "ent_s")):
    check(
        name,
        f"""SELECT round(avg({column}), 6) AS student_entropy, round(avg(ent_t), 6) AS teacher_entropy,
  round(avg(ent_t) - avg({column}), 6) AS entropy_gap, count(*) AS n_tokens FROM sc WHERE valid""",
        "sc",
    )
check("sampled_logp", "SELECT seq_id, sample_id, pos, round(logp, 6) AS logp FROM sc", "sc")
check("forward_kl", "SELECT seq_id, sample_id, pos, round(fkl, 6) AS kl FROM sc", "sc")
check("reverse_kl", "SELECT seq_id, sample_id, pos, round(rkl, 6) AS kl FROM sc", "sc")


def jsd(beta: float) -> str:
    m = f"ln({1 - beta} * exp(ls) + {beta} * exp(lt))"
    return f"{beta} * exp(lt) * (lt - {m}) + {1 - beta} * exp(ls) * (ls - {m})"


check(
    "generalized_jsd",
    f"SELECT seq_id, sample_id, pos, round(sum({jsd(0.3)}), 6) AS jsd_03, round(sum({jsd(0.5)}), 6) AS jsd_05 FROM lp GROUP BY ALL",
    "lp",
)
check("divergence_clip", "SELECT seq_id, sample_id, pos, round(fklc, 6) AS per_element, round(least(fkl, 2.0), 6) AS per_token FROM sc", "sc")
check(
    "topk_renorm_jsd",
    f"""SELECT seq_id, sample_id, pos, round(sum({jsd(0.5)}), 6) AS jsd FROM (
  SELECT seq_id, sample_id, pos, s / {TAU} - ln(sum(exp(s / {TAU})) OVER w) AS ls, t / {TAU} - ln(sum(exp(t / {TAU})) OVER w) AS lt
  FROM (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY seq_id, sample_id, pos ORDER BY t DESC, i) <= 8)
  WINDOW w AS (PARTITION BY seq_id, sample_id, pos)) GROUP BY ALL""",
    "el",
)
check(
    "masked_reduction",
    f"""SELECT round(sum(v) / count(*), 6) AS batchmean, round(sum(v), 6) AS total, round(sum(v) / sum(entries), 6) AS mean FROM (
  SELECT sum(least({jsd(0.5)}, {CLIP})) AS v, count(*) AS entries FROM lp WHERE label <> -100 GROUP BY seq_id, sample_id, pos)""",
    "lp",
)
def mean_loss(value: str, retention: float) -> str:
    """Mean over samples of the token-weighted mean of ``value``."""
    term, taken = {0.0: (f"{value} * weight", "true"), 1.0: (value, "true")}.get(retention, (value, "kept"))
    return f"""SELECT round(avg(loss), 6) AS loss, count(*) AS n_samples FROM (
  SELECT seq_id, sample_id, sum({term}) FILTER ({taken}) / count(*) FILTER ({taken}) AS loss FROM kept GROUP BY ALL)"""


for name, sign in (("direction_kl", ">"), ("direction_kl_swapped", "<")):
    toward = f"CASE WHEN direction_sign {sign} 0 THEN fklc ELSE rklc END"
    check(
        name,
        "\nUNION ALL\n".join(f"SELECT {r}::DOUBLE AS retention, * FROM ({mean_loss(toward, r)})" for r in (0.0, 0.3, 1.0)),
        "kept",
    )
part(
    "js",
    f"""SELECT seq_id, sample_id, pos, sum(least({jsd(0.5)}, {CLIP})) AS jsc FROM lp GROUP BY ALL""",
    "lp",
)
check(
    "weighted_jsd",
    "\nUNION ALL\n".join(
        f"SELECT {beta}::DOUBLE AS beta, * FROM ({mean_loss(value, 0.0).replace('FROM kept', 'FROM kept JOIN js USING (seq_id, sample_id, pos)')})"
        for beta, value in ((0.0, "fklc"), (0.5, "jsc"), (1.0, "rklc"))
    ),
    "kept",
    "js",
)
check(
    "trajectory_kl",
    "SELECT seq_id, sample_id, round(coalesce(avg(fkl) FILTER (pos < 30), CAST('-inf' AS DOUBLE)), 6) AS kl_score FROM sc GROUP BY ALL",
    "sc",
)
part(
    "scored",
    """SELECT l.* EXCLUDE (kl_score), coalesce(k.kl_score, CAST('-inf' AS DOUBLE)) AS kl_score FROM lab l LEFT JOIN (
    SELECT seq_id, sample_id, round(coalesce(avg(fkl) FILTER (pos < 30), CAST('-inf' AS DOUBLE)), 6) AS kl_score FROM sc GROUP BY ALL) k
    ON k.seq_id = l.prompt_id % 10 AND k.sample_id = l.rollout_idx % 4""",
    "lab",
    "sc",
)
check("select_computed_kl", f"SELECT {PICK} FROM ({selection(1, 0.5).replace('FROM lab JOIN', 'FROM scored JOIN')})", "scored")
check("trajectory_logp", f"SELECT {ROW}, round(logp_score, 6) AS logp_score FROM base", "base")
check("quantile_minmax", "SELECT seq_id, sample_id, pos, round(h, 6) AS scaled FROM we", "we")
check("soft_or_weight", "SELECT seq_id, sample_id, pos, round(weight, 6) AS weight FROM we", "we")
check(
    "weighted_kl",
    """SELECT seq_id, sample_id, round(sum(fklc * weight) / count(*), 6) AS kl_loss, round(sum(fklc) FILTER (kept) / count(*) FILTER (kept), 6) AS top_share_loss,
  round(avg(fklc), 6) AS mean_loss FROM kept GROUP BY ALL""",
    "kept",
)
check(
    "weight_monitor",
    """SELECT round(count(*) FILTER (weight < 0.1) / count(*), 6) AS low_weight_share, round(avg(weight), 6) AS mean_weight,
  round(avg(fklc) FILTER (kept), 6) AS kept_kl_mean, round(avg(fklc) FILTER (NOT kept), 6) AS dropped_kl_mean FROM kept""",
    "kept",
)
check("policy_gradient_term", "SELECT seq_id, sample_id, round(avg(-advantage * logp), 6) AS pg_loss FROM sc WHERE valid GROUP BY ALL", "sc")
check("token_mask", "SELECT seq_id, sample_id, pos, round(mask_score, 6) AS mask_score, masked_in FROM ma", "ma")
check(
    "hybrid_loss",
    "SELECT round(avg(CASE WHEN direction_sign > 0 THEN kl_loss ELSE 0.1::DOUBLE * pg_loss END), 6) AS loss, count(*) AS n_samples FROM samples",
    "samples",
)
check(
    "hybrid_loss_samples",
    """SELECT seq_id, sample_id, direction_sign, round(kl_loss, 6) AS kl_loss, round(pg_loss, 6) AS pg_loss,
  round(CASE WHEN direction_sign > 0 THEN 0.1::DOUBLE * pg_loss ELSE kl_loss END, 6) AS loss FROM samples""",
    "samples",
)
check(
    "branch_monitor",
    """SELECT round(coalesce(avg(kl_loss) FILTER (direction_sign > 0), 0), 6) AS loss_pos, round(coalesce(avg(pg_loss) FILTER (direction_sign < 0), 0), 6) AS loss_neg,
  round((SELECT avg(logp) FROM ma WHERE valid AND direction_sign < 0 AND masked_in), 6) AS selected_logp_mean,
  round((SELECT avg(logp) FROM ma WHERE valid AND direction_sign < 0), 6) AS all_logp_mean FROM samples""",
    "samples",
    "ma",
)
check(
    "sampled_advantage",
    "SELECT round(avg(tlp - slp), 6) AS advantage_mean, round(-avg((tlp - slp) * slp), 6) AS loss FROM sc WHERE valid",
    "sc",
)

# --- training-set assembly


def ids(text: str) -> str:
    return f"list_transform(string_split({text}, ' '), lambda w: CAST(length(w) + ascii(w) AS INTEGER))"


def padded(values: str, length: str) -> str:
    return f"list_resize({values}[1:{length}], {length}, 0)"


part("words", f"SELECT conv_id, turn, {ids('text')} AS ids FROM conversations")
TURN = "SELECT conv_id, turn,"
check("pad_truncate", f"{TURN} array_to_string({padded('ids', '32')}, ',') AS ids FROM words", "words")
check(
    "batch_max_length",
    f"""{TURN} array_to_string({padded('ids', 'longest')}, ',') AS ids, least(len(ids), 64)::INTEGER AS padded_length
  FROM words JOIN (SELECT conv_id, max(least(len(ids), 64)) AS longest FROM words GROUP BY 1) USING (conv_id)""",
    "words",
)
MASK = "list_transform({0}, lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END)"
LABEL = "list_transform({0}, lambda x, i: CASE WHEN i <= {1} OR x = 0 THEN -100 ELSE x END)"
check("attention_mask", f"{TURN} array_to_string({MASK.format(padded('ids', '32'))}, ',') AS mask FROM words", "words")
check("label_mask", f"{TURN} array_to_string({LABEL.format(padded('ids', '32'), 'conv_id % 9')}, ',') AS labels FROM words", "words")
check("prompt_budget", f"{TURN} array_to_string(ids[1:8], ',') AS ids FROM words", "words")
part(
    "train",
    f"""SELECT step, p.prompt_id, rollout_idx, sel_rank * n_step + pr % 4 AS position, direction_sign,
  list_concat({padded('sids', 'sw')}, {padded('cids', '12')}) AS student, list_concat({padded('tids', 'tw')}, {padded('cids', '12')}) AS teacher,
  least(len(sids), 8) AS true_len, sw, tw, m, reward FROM (
    SELECT *, pr // 4 AS step, {ids('completion')} AS cids, {ids('problem')} AS sids, {ids("problem || ' answer ' || coalesce(pseudo_label, '')")} AS tids,
      CASE WHEN direction_sign > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward,
      CASE WHEN consensus_count >= {THRESHOLD} THEN consensus_count ELSE 0 END::DOUBLE / n_rollouts AS m
    FROM chosen JOIN (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS pr FROM vote) USING (prompt_id)) p
  JOIN (SELECT pr // 4 AS step, count(*) AS n_step, max(least(len({ids('problem')}), 8)) AS sw,
    max(least(len({ids("problem || ' answer ' || coalesce(pseudo_label, '')")}), 8)) AS tw
    FROM (SELECT *, row_number() OVER (ORDER BY prompt_id) - 1 AS pr FROM prob JOIN vote USING (prompt_id)) GROUP BY 1) USING (step)""",
    "chosen",
    "prob",
    "vote",
)
check(
    "build_training_set",
    f"""SELECT step, prompt_id, rollout_idx, position, position // 4 AS micro_batch, sw::INTEGER AS student_prompt_width, tw::INTEGER AS teacher_prompt_width, direction_sign,
  round(CASE WHEN sqrt(m * (1 - m)) > 1e-8 THEN (reward - m) / (sqrt(m * (1 - m)) + 1e-6) ELSE reward - m END, 6) AS advantage,
  array_to_string(student, ',') AS student_input_ids, array_to_string({MASK.format('student')}, ',') AS student_attention_mask,
  array_to_string(teacher, ',') AS teacher_input_ids, array_to_string({MASK.format('teacher')}, ',') AS teacher_attention_mask,
  array_to_string({LABEL.format('student', 'true_len')}, ',') AS labels FROM train""",
    "train",
)

# --- streaming

check(
    "stream_metric_window",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS name, round(avg(round(value * 100)), 6) AS mean_value, count(*) AS n_values,
  date_trunc('day', ts) + INTERVAL 3 DAY <= (SELECT max(ts) FROM events WHERE event_id % 50 <> 0) AS closed
  FROM events WHERE event_id % 50 <> 0 GROUP BY date_trunc('day', ts), event_type""",
)
check(
    "stream_late_metrics",
    "SELECT event_type AS name, count(*) AS n_late, sum(round(value * 100)) AS sum_value FROM events WHERE event_id % 50 = 0 GROUP BY 1",
)
check(
    "stream_vote",
    "SELECT prompt_id, pseudo_label, consensus_count, n_rollouts FROM vote",
    "vote",
)
check("stream_dedup", "SELECT DISTINCT l_partkey AS prompt_id, l_linenumber AS rollout_idx FROM lineitem")
check(
    "stream_rollout_log",
    f"SELECT {FLUSH} AS flush_step, count(*) AS num_samples, count(*) FILTER (has) AS num_answers FROM answers GROUP BY 1",
    "answers",
)

# --- user functions and reports

check(
    "reward_registry",
    f"""SELECT {ROW}, CASE WHEN answer_key = truth_key THEN 1.0 ELSE 0.0 END::DOUBLE AS reward_ground_truth,
  CASE WHEN has THEN 1.0 ELSE 0.0 END::DOUBLE AS reward_formatted FROM answers""",
    "answers",
)
check(
    "map_prompts",
    f"""SELECT p_partkey AS id, 'Problem: ' || p_name || {LINE} || {ASK} AS prompt, CAST(p_size AS VARCHAR) AS "Answer" FROM part""",
)
part(
    "score",
    """SELECT 'model' || (problem_id // 5 % 2) AS model, ['Base', 'Alpha', 'Beta'][rollout_idx % 3 + 1] AS method, dataset AS benchmark,
  avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE) * 100 AS score FROM graded GROUP BY ALL""",
    "graded",
)
check(
    "leaderboard",
    "SELECT model, method, "
    + ", ".join(f"round(avg(score) FILTER (benchmark = 'bench{i}'), 6) AS bench{i}" for i in range(5))
    + ", round(avg(score), 6) AS average FROM score GROUP BY ALL",
    "score",
)
part("based", "SELECT s.*, b.score AS base_score FROM score s JOIN score b ON b.method = 'Base' AND b.model = s.model AND b.benchmark = s.benchmark", "score")
check(
    "gain_over_base",
    "SELECT model, method, benchmark, round(score, 6) AS score, round(base_score, 6) AS base_score, round(score - base_score, 6) AS gain FROM based",
    "based",
)
check(
    "best_per_benchmark",
    "SELECT model, method, benchmark, round(score, 6) AS score, round(score, 6) = max(round(score, 6)) OVER (PARTITION BY model, benchmark) AS is_best FROM score",
    "score",
)
check(
    "checkpoint_sweep",
    """SELECT dataset, checkpoint, round(score, 6) AS score, round(score - base, 6) AS gain FROM (
  SELECT dataset, nullif(rollout_idx % 5 * 25, 0) AS checkpoint, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE) * 100 AS score FROM graded GROUP BY ALL)
  JOIN (SELECT dataset, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE) * 100 AS base FROM graded WHERE rollout_idx % 5 = 0 GROUP BY 1) USING (dataset)""",
    "graded",
)
part(
    "crossed",
    """SELECT ['Base', 'bench0', 'bench1', 'bench2'][rollout_idx % 4 + 1] AS trained_on, dataset AS tested_on,
  avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE) * 100 AS score FROM graded GROUP BY ALL""",
    "graded",
)
check(
    "cross_benchmark_gain",
    "SELECT c.trained_on, "
    + ", ".join(f"round(max(c.score - b.score) FILTER (c.tested_on = 'bench{i}'), 6) AS bench{i}" for i in range(5))
    + " FROM crossed c JOIN crossed b ON b.trained_on = 'Base' AND b.tested_on = c.tested_on WHERE c.trained_on <> 'Base' GROUP BY ALL",
    "crossed",
)
