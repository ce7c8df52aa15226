"""DuckDB SQL for the queries of ``queries``."""

from __future__ import annotations

from .queries import CONFIG, RESPELT

_WS = r"[\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _norm(x: str, lower: bool = False, signs: bool = False) -> str:
    out = f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
    if lower:
        out = f"replace(lower({out}), 'ß', 'ss')"
    if signs:
        out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_{_WS[1:-1]}]', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{_WS}+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({_norm(x, True, True)}, ' '), lambda t: t <> '')"


_CONV = """
conv AS (SELECT conv_id || ':' || turn AS case_id, before AS ref, text AS pred FROM (
  SELECT *, lag(text) OVER w AS before, lag(role) OVER w AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant' AND asked = 'user')"""
_BENCH = """
bench AS (SELECT CAST(a.item_id AS VARCHAR) AS case_id, a.text AS ref, b.text AS pred FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"""
_LAB = """
lab AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS case_id, quality AS q, 1 - toxic AS t, lang, source FROM labels JOIN documents USING (doc_id))"""
_NUM = r"""
v AS (SELECT event_id, CAST(value AS DECIMAL(20, 4)) AS v, event_id % 6 AS k FROM events),
num AS (SELECT event_id, CAST(event_id AS VARCHAR) AS case_id, CAST(v AS VARCHAR) AS ref,
  CASE k WHEN 0 THEN CAST(v AS VARCHAR) WHEN 1 THEN CAST(CAST(v * 100 AS DECIMAL(20, 4)) AS VARCHAR) || '%'
         WHEN 2 THEN '1,' || lpad(CAST(CAST(floor(v) AS BIGINT) % 1000 AS VARCHAR), 3, '0')
         WHEN 3 THEN CAST(CAST(v + 0.001 AS DECIMAL(20, 4)) AS VARCHAR) WHEN 4 THEN 'n/a' ELSE 'true' END AS pred FROM v),
parsed AS (SELECT *, CAST(ref AS DECIMAL(30, 8)) AS a,
  CASE WHEN regexp_full_match(pred, '[+-]?\d+(\.\d*)?%') THEN CAST(rtrim(pred, '%') AS DECIMAL(30, 8)) / 100
       WHEN regexp_full_match(pred, '[+-]?\d{1,3}(,\d{3})+(\.\d*)?') THEN CAST(replace(pred, ',', '') AS DECIMAL(30, 8))
       WHEN regexp_full_match(pred, '[+-]?\d+(\.\d*)?') THEN CAST(pred AS DECIMAL(30, 8)) END AS b FROM num),
scored AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN abs(CAST(a AS DECIMAL(30, 8)) - CAST(b AS DECIMAL(30, 8))) <= 0.001 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM parsed)"""


def _bag(a: str, b: str) -> str:
    count = "len(list_filter({}, lambda y: y = x))"
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least({count.format(a)}, {count.format(b)}))), 0)"


def _split(x: str) -> str:
    return f"list_filter(string_split({_norm(x, True)}, ''), lambda c: c <> '')"


def _f1_of(table: str, cte: str, split) -> str:
    return f"""WITH {cte}, w AS (SELECT case_id, {split('ref')} AS a, {split('pred')} AS b FROM {table}),
o AS (SELECT *, CAST({_bag('a', 'b')} AS DOUBLE) AS n FROM w)
SELECT case_id, CAST(round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 OR n = 0 THEN 0.0
  ELSE 2 * (n / len(b)) * (n / len(a)) / (n / len(b) + n / len(a)) END, 9) AS DOUBLE) AS score FROM o"""


def _rouge(beta: float, table: str = "bench", cte: str = _BENCH) -> str:
    square = beta * beta
    return f"""WITH {cte}, w AS (SELECT case_id, {_tokens('ref')} AS a, {_tokens('pred')} AS b FROM {table}),
o AS (SELECT *, CAST(list_last(list_reduce(a, lambda row, x: list_reduce(range(1, len(b) + 1), lambda new, j:
    list_append(new, CASE WHEN b[j] = x THEN (CASE WHEN j = 1 THEN 0 ELSE row[j - 1] END) + 1 ELSE greatest(row[j], CASE WHEN j = 1 THEN 0 ELSE new[j - 1] END) END), CAST([] AS BIGINT[])),
    list_transform(b, lambda y: CAST(0 AS BIGINT)))) AS DOUBLE) AS n FROM w)
SELECT case_id, CAST(round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN n = 0 OR n IS NULL THEN 0 ELSE {1 + square} * (n / len(b)) * (n / len(a)) / (n / len(a) + {square} * (n / len(b))) END, 9) AS DOUBLE) AS score FROM o"""


def _bleu(order: int, s: float, effective: bool) -> str:
    grams = "CASE WHEN len({0}) < n THEN [] ELSE list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string({0}[i:i + n - 1], ' ')) END"
    last = f"least({order}, len(b))" if effective else str(order)
    return f"""WITH {_BENCH}, w AS (SELECT case_id, {_tokens('ref')} AS a, {_tokens('pred')} AS b FROM bench),
g AS (SELECT case_id, a, b, n, {grams.format('a')} AS x, {grams.format('b')} AS y FROM (SELECT *, unnest(range(1, {last} + 1)) AS n FROM w)),
p AS (SELECT case_id, n, len(a) AS la, len(b) AS lb, CAST({_bag('x', 'y').replace('lambda y: y = x)', 'lambda z: z = x)').replace('lambda x:', 'lambda u:').replace('z = x', 'z = u')} AS DOUBLE) AS hit FROM g),
q AS (SELECT case_id, la, lb, CASE WHEN lb >= n AND (hit > 0 OR {s} > 0) THEN (hit + {s}) / (lb - n + 1 + {s}) ELSE 0 END AS pr FROM p)
SELECT case_id, CAST(round(CASE WHEN min(pr) <= 0 THEN 0 ELSE exp(least(0, 1 - any_value(la)::DOUBLE / any_value(lb))) * exp(avg(ln(CASE WHEN pr > 0 THEN pr ELSE 1 END))) END, 9) AS DOUBLE) AS score FROM q GROUP BY case_id"""


def _numeric(fill: str, skip: str) -> str:
    return f"""WITH {_NUM} SELECT case_id, score, CASE WHEN score IS NULL THEN 'unparseable prediction' END AS reason,
coalesce(score, {fill}) AS resolved_score, score IS NULL AND {skip} AS skipped FROM scored"""


_X = f"""{_LAB}, x AS (SELECT case_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, (CASE WHEN t = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE - (CASE WHEN q = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS d FROM lab),
n AS (SELECT count(*) AS n FROM x), k AS (SELECT range AS r FROM range({CONFIG.samples}))"""
_BOOT = f"""{_X}, draws AS MATERIALIZED (SELECT r, CAST(('0x' || substr(sha256('{CONFIG.bootstrap_domain}' || chr(0) || '{CONFIG.seed}' || chr(0) || r || chr(0) || p), 1, 16)) AS UBIGINT) % n AS i FROM k, x, n),
boot AS (SELECT r, sum(d) / any_value(n) AS value FROM draws JOIN x ON x.p = draws.i, n GROUP BY r)"""
_LOW = (1 - CONFIG.confidence) / 2


def _compared(sign: str) -> str:
    return f"""WITH {_BOOT}, ci AS (SELECT quantile_cont(value, {_LOW}) AS lo, quantile_cont(value, {1 - _LOW}) AS hi,
  avg(CASE WHEN {sign} * value > 0 THEN 1.0 WHEN value = 0 THEN 0.5 ELSE 0.0 END) AS pr FROM boot),
s AS (SELECT count(*) AS compared, avg(CASE WHEN q = 1 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN t = 1 THEN 1.0 ELSE 0.0 END) AS c FROM lab), dd AS (SELECT avg(d) AS d FROM x)
SELECT compared, CAST(0 AS BIGINT) AS omitted, round(b, 9) AS baseline_mean, round(c, 9) AS candidate_mean, round(d, 9) + 0.0 AS delta, round({sign} * d, 9) + 0.0 AS improvement,
round(least({sign} * lo, {sign} * hi), 9) + 0.0 AS lower, round(greatest({sign} * lo, {sign} * hi), 9) + 0.0 AS upper, round(pr, 9) AS probability, {sign} * d >= 0 AS passed FROM ci, s, dd"""


_PERTURBED = f"""{_LAB}, l AS (SELECT * FROM lab WHERE doc_id % 55 <> 0), r AS (SELECT * FROM lab WHERE doc_id % 50 <> 0)"""

ORACLES: dict[str, str] = {
    "exact_match": f"WITH {_LAB} SELECT case_id, CASE WHEN q = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM lab",
    "rouge_l": _rouge(1.0),
    "rouge_l_beta2": _rouge(2.0),
    "sentence_bleu": _bleu(4, 1.0, True),
    "sentence_bleu_unsmoothed": _bleu(2, 0.0, False),
    # levenshtein counts bytes: each pair's code points are spelt anew as single bytes (a pair has fewer than 94 different ones)
    "levenshtein_similarity": f"""WITH {_BENCH}, w AS (SELECT case_id, {_norm('ref')} AS a, {_norm('pred')} AS b FROM bench),
l AS (SELECT *, list_distinct(string_split(a || b, '')) AS letters FROM w),
s AS (SELECT case_id, length(a) AS la, length(b) AS lb, array_to_string(list_transform(string_split(a, ''), lambda c: chr(CAST(32 + list_position(letters, c) AS INTEGER))), '') AS x,
  array_to_string(list_transform(string_split(b, ''), lambda c: chr(CAST(32 + list_position(letters, c) AS INTEGER))), '') AS y FROM l)
SELECT case_id, CAST(round(CASE WHEN greatest(la, lb) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(la, lb) END, 9) AS DOUBLE) AS score FROM s""",
    "numeric_equivalence_skip": _numeric("NULL", "true"),
    "numeric_equivalence_zero": _numeric("0.0", "false"),
    "numeric_equivalence_one": _numeric("1.0", "false"),
    "suite_summary": f"WITH {_NUM} SELECT count(*) AS case_count, count(score) AS scored_count, count(*) - count(score) AS skipped_count, round(avg(score), 9) AS mean_score FROM scored",
    "tag_summary": f"""WITH {_LAB}, e AS (SELECT unnest([lang, source]) AS tag, CASE WHEN q = 1 THEN 1.0 ELSE 0.0 END AS s FROM lab)
SELECT tag, count(*) AS case_count, count(*) AS scored_count, CAST(round(avg(s), 9) AS DOUBLE) AS mean_score FROM e GROUP BY tag""",
    "duplicates": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "align_missing": f"""WITH {_PERTURBED} SELECT coalesce(l.case_id, r.case_id) AS case_id, CASE WHEN r.case_id IS NULL THEN 'candidate' ELSE 'baseline' END AS missing_from
FROM l FULL JOIN r USING (doc_id) WHERE l.case_id IS NULL OR r.case_id IS NULL""",
    "align_mismatch": f"""WITH {_PERTURBED} SELECT l.case_id, CASE WHEN doc_id % 70 = 0 THEN 'reference' ELSE 'tags' END AS differs FROM l JOIN r USING (doc_id) WHERE doc_id % 70 = 0 OR doc_id % 90 = 0""",
    "paired_join": f"""WITH {_LAB}, s AS (SELECT case_id, CASE WHEN q = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS l, CASE WHEN t = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS r FROM lab)
SELECT case_id, l AS "left", r AS "right", r - l AS delta FROM s""",
    "one_sided_skips": f"WITH {_NUM} SELECT count(*) - count(score) AS one_sided, CAST(0 AS BIGINT) AS omitted, count(score) AS compared FROM scored",
    "omitted": f"WITH {_NUM} SELECT case_id FROM scored WHERE score IS NULL",
    "audit_symmetric": f"""WITH a AS ({_rouge(2.0)}), r AS ({_rouge(0.5)})
SELECT 'symmetric' AS rule, 'error' AS severity, case_id FROM a JOIN r USING (case_id) WHERE abs(a.score - r.score) > 1e-8""",
    "audit_identity": f"""WITH {_NUM}, d AS (SELECT pred AS x, min(event_id) AS e FROM scored WHERE score IS NULL GROUP BY pred)
SELECT 'identity' AS rule, 'error' AS severity, e || ':prediction' AS case_id FROM d""",
    "bootstrap_replicates": f"WITH {_BOOT} SELECT r, round(value, 12) AS value FROM boot",
    "bootstrap_interval": f"WITH {_BOOT} SELECT round(quantile_cont(value, {_LOW}), 9) AS lower, round(quantile_cont(value, {1 - _LOW}), 9) AS upper FROM boot",
    "sign_flip": f"""WITH {_X} SELECT r, round(sum(CASE WHEN CAST('0x' || substr(sha256('{CONFIG.sign_domain}' || chr(0) || '{CONFIG.seed}' || chr(0) || r || chr(0) || p), 1, 2) AS INTEGER) % 2 = 1 THEN d ELSE -d END) / any_value(n), 12) AS value
FROM k, x, n GROUP BY r""",
    "paired_comparison_higher": _compared("1"),
    "paired_comparison_lower": _compared("-1"),
    "markdown_cases": f"""WITH {_NUM} SELECT '| `' || case_id || '` | ' || coalesce(printf('%.6f', score), 'undefined') || ' | ' || coalesce(printf('%.6f', score), '—') || ' | ' ||
CASE WHEN score IS NULL THEN 'skipped' ELSE 'scored' END || ' |' AS line FROM scored""",
    # one letter against one letter: equal or not, but smoothing gives sentence BLEU a half
    "registry_list": f"""WITH {_LAB} SELECT unnest(['character_f1', 'exact_match', 'levenshtein_similarity', 'numeric_equivalence', 'rouge_l', 'sentence_bleu', 'token_f1']) AS name,
  count(*) FILTER (q = 1) AS ones, count(*) FILTER (q <> 1) AS less, CAST(0 AS BIGINT) AS undefined FROM lab""",
}


ORACLES["rouge_l_conversations"] = _rouge(1.0, "conv", _CONV)
ORACLES["numeric_equivalence_relative"] = f"""WITH {_NUM} SELECT case_id, CASE WHEN b IS NULL THEN NULL WHEN abs(a - b) <= 0.00001 * greatest(abs(a), abs(b)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
CASE WHEN b IS NULL THEN 'unparseable prediction' END AS reason FROM parsed"""
ORACLES["json_ingest"] = f"""WITH {_CONV.replace("turn AS case_id,", "turn AS case_id, conv_id * 1000 + turn AS ordinal,")} SELECT ordinal, case_id, 'str' AS reference_kind, ref AS reference,
'int' AS prediction_kind, CAST(length(pred) AS VARCHAR) AS prediction, case_id AS tag FROM conv"""
ORACLES["tag_summary_joined"] = ORACLES["tag_summary"]
ORACLES["audit_deterministic"] = f"WITH {_BENCH} SELECT 'deterministic' AS rule, 'error' AS severity, case_id, 1.0::DOUBLE AS first, 0.5::DOUBLE AS again FROM bench"
ORACLES["audit_coverage"] = "SELECT 'coverage' AS rule, 'warning' AS severity, CAST(NULL AS VARCHAR) AS case_id"
ORACLES["markdown_escape"] = "SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '|', '&#124;'), '`', '&#96;'), '<', '&lt;'), '>', '&gt;'), chr(13) || chr(10), '<br>'), chr(13), '<br>'), chr(10), '<br>')) AS escaped_md5 FROM documents"
ORACLES["confidence_interval"] = f"""WITH {_BOOT} SELECT (SELECT round(avg(d), 9) + 0.0 FROM x) AS point, round(quantile_cont(value, {_LOW}), 9) + 0.0 AS lower, round(quantile_cont(value, {1 - _LOW}), 9) + 0.0 AS upper, CAST(count(*) AS BIGINT) AS samples FROM boot"""
ORACLES["token_f1"] = _f1_of("conv", _CONV, _tokens)
ORACLES["character_f1"] = _f1_of("conv", _CONV, _split)
ORACLES["plugin_udf"] = ORACLES["rouge_l"]
ORACLES["audit_bounded"] = f"SELECT 'bounded' AS rule, 'error' AS severity, case_id, score AS observed FROM ({_f1_of('bench', _BENCH, _split)}) WHERE score > 0.8"


def _respelt(x: str) -> str:
    for plain, other in RESPELT.items():
        x = f"replace({x}, '{plain}', '{other}')"
    return x


def _refolded(x: str) -> str:
    return f"replace(nfc_normalize({x}), '\ufb01', 'fi')"


ORACLES["exact_match_folded"] = f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, text, {_respelt('text')} || CASE WHEN doc_id % 5 = 0 THEN ' x' ELSE '' END AS other FROM documents)
SELECT case_id, CASE WHEN {_norm(_refolded('text'), True)} = {_norm(_refolded('other'), True)} THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM d"""
ORACLES["token_f1_folded"] = _f1_of("other", f"{_CONV}, other AS (SELECT case_id, {_refolded('ref')} AS ref, {_refolded(_respelt('pred'))} AS pred FROM conv)", _tokens)
ORACLES["bootstrap_blocked"] = ORACLES["bootstrap_replicates"]
ORACLES["sign_flip_blocked"] = ORACLES["sign_flip"]
_LINES = f"""WITH {_CONV.replace("turn AS case_id,", "turn AS case_id, conv_id * 1000 + turn AS place,")} SELECT CAST(row_number() OVER (ORDER BY place) AS BIGINT) AS ordinal, case_id,
regexp_replace(ref, '[\\v\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g') AS reference, 'int' AS prediction_kind, CAST(length(pred) AS VARCHAR) AS prediction FROM conv"""
ORACLES["jsonl_file_ingest"] = ORACLES["json_array_ingest"] = _LINES
ORACLES["markdown_file"] = f"""WITH {_NUM}, n AS (SELECT count(*) AS n, count(score) AS k, avg(score) AS mean FROM scored)
SELECT unnest(['# Metric report: `numeric_equivalence`', '- Contract status: **PASS**', '- Cases: ' || n || ' (' || k || ' scored, ' || (n - k) || ' skipped)', '- Macro mean: ' || printf('%.6f', mean),
  '## Cases', '| Case | Raw | Resolved | State |', '|---|---:|---:|---|', '## Contract findings', 'No contract findings.']) AS line FROM n UNION ALL
SELECT '| `' || case_id || '` | ' || coalesce(printf('%.6f', score), 'undefined') || ' | ' || coalesce(printf('%.6f', score), '—') || ' | ' || CASE WHEN score IS NULL THEN 'skipped' ELSE 'scored' END || ' |' FROM scored"""
ORACLES["json_file"] = f"WITH {_NUM} SELECT case_id, score AS raw_score, coalesce(score, 0.0) AS resolved_score, false AS skipped, CASE WHEN score IS NULL THEN 'unparseable prediction' END AS undefined_reason FROM scored"
ORACLES["map_references"] = "SELECT CAST(doc_id AS VARCHAR) AS case_id, 'reference' AS differs FROM documents WHERE doc_id % 7 = 0"
ORACLES["table_case_rules"] = """SELECT doc_id AS ordinal, CASE doc_id % 11 WHEN 1 THEN 'id must be a string' WHEN 2 THEN 'id must not be blank' WHEN 3 THEN 'tags must be unique' ELSE 'tags must be a list of strings' END AS rule
FROM documents WHERE doc_id % 11 IN (1, 2, 3, 4)"""
