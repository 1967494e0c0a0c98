"""The numbered operators that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from . import rules as R

_DRAW = "CAST('0x' || substr(h, {}, 8) AS UBIGINT)"

FILL_IN_MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
  u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us FROM d),
  c AS (SELECT *, len(us) AS n, {_DRAW.format(1)} % (len(us) + 1) AS a, {_DRAW.format(9)} % (len(us) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_DRAW.format(17)} % 100 >= 90 THEN 'plain' WHEN {_DRAW.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
  p AS (SELECT *, array_to_string(us[1:least(a, b)], '') AS prefix, array_to_string(us[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(us[greatest(a, b) + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

#: CRC-32 of a word: each byte is followed by eight shifts, written as -1.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(0, octet_length(encode(w))), lambda i: list_concat([CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END), 4294967295)"""
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

IMPORTANCE_RESAMPLING = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), q AS (SELECT {_WORDS} AS ws FROM benchmark),
  dw AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL), qw AS (SELECT w, count(*) AS c FROM (SELECT unnest(ws) AS w FROM q) GROUP BY 1),
  k AS (SELECT w, {_CRC} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM qw)),
  s AS (SELECT bucket, sum(c) AS s FROM dw JOIN k USING (w) GROUP BY 1), t AS (SELECT bucket, sum(c) AS t FROM qw JOIN k USING (w) GROUP BY 1),
  n AS (SELECT (SELECT coalesce(sum(c), 0) FROM dw) + 10000.0::DOUBLE AS s_all, (SELECT coalesce(sum(c), 0) FROM qw) + 10000.0::DOUBLE AS t_all),
  g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * s_all / ((s + 1.0::DOUBLE) * t_all))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
  f AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY 1),
  r AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS UBIGINT) AS h FROM d LEFT JOIN f USING (doc_id)),
  x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM r),
  o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM x WHERE n_features >= 20)
SELECT x.*, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM x LEFT JOIN o USING (doc_id)"""


def quality_rules() -> str:
    """Counts by SQL, and the rounds of expectation-maximisation as a recursive query over the patterns."""
    ks = range(len(R.RULES))
    names = list(R.RULES)
    measure = {
        "symbols": "n_symbols / nullif(n_words, 0)", "marks": "n_marks / nullif(word_chars, 0)", "dup_lines": "CASE WHEN n_lines > 1 THEN n_dup_lines / n_lines END",
        "repeats": "n_repeat_words / nullif(n_words, 0)", "capitals": "n_capitals / nullif(word_chars, 0)", "short_lines": "n_lines / nullif(n_words, 0)",
        "lengths": "greatest(0.0::DOUBLE, 1 - (word_chars / nullif(n_words, 0)) / 3, 1 - 10 / (word_chars / nullif(n_words, 0)))",
    }
    votes = ", ".join(f"CASE WHEN {measure[m]} >= {R.RULES[m][0]}::DOUBLE THEN -1 WHEN {measure[m]} <= {R.RULES[m][1]}::DOUBLE THEN 1 ELSE 0 END AS v{k}" for k, m in enumerate(names))
    told = " + ".join(f"CASE v{k} WHEN 1 THEN ln(g{k} / (1 - b{k})) WHEN -1 THEN ln((1 - g{k}) / b{k}) ELSE 0 END" for k in ks)
    good = ", ".join(f"(10 * 0.95::DOUBLE + sum(CASE WHEN v{k} = 1 THEN n * p ELSE 0 END)) / (10 + sum(CASE WHEN v{k} <> 0 THEN n * p ELSE 0 END)) AS g{k}" for k in ks)
    bad = ", ".join(f"(10 * 0.5::DOUBLE + sum(CASE WHEN v{k} = -1 THEN n * (1 - p) ELSE 0 END)) / (10 + sum(CASE WHEN v{k} <> 0 THEN n * (1 - p) ELSE 0 END)) AS c{k}" for k in ks)
    vs = ", ".join(f"v{k}" for k in ks)
    posterior = f"1 / (1 + exp(-(ln(prior / (1 - prior)) + {told})))"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS ls FROM d),
  runs AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
  places AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c FROM runs) WHERE c > 1) GROUP BY 1),
  counted AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[ \x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '[\p{{P}}\p{{S}}]')) AS n_marks FROM w LEFT JOIN places USING (doc_id)),
  voted AS (SELECT *, {votes} FROM counted), patterns AS (SELECT {vs}, count(*) AS n FROM voted GROUP BY ALL),
  em AS (SELECT 0 AS r, 0.8::DOUBLE AS prior, {", ".join(f"0.95::DOUBLE AS g{k}, 0.5::DOUBLE AS b{k}" for k in ks)}
    UNION ALL SELECT r, prior, {", ".join(f"g{k}, greatest(c{k}, 1 - g{k})" for k in ks)} FROM (
      SELECT r + 1 AS r, (10 * 0.8::DOUBLE + sum(n * p)) / (10 + sum(n * p + n * (1 - p))) AS prior, {good}, {bad} FROM (SELECT r, n, {vs}, {posterior} AS p FROM em, patterns WHERE r < {R.ROUNDS}) GROUP BY r)),
  final AS (SELECT {vs}, {posterior} AS p_good FROM em, patterns WHERE r = {R.ROUNDS}),
  judged AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, p_good FROM voted JOIN final USING ({vs}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p_good >= 0.5 AS kept, round(p_good, 6) AS p_good FROM judged"""


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": FILL_IN_MIDDLE, "op12_importance_resampling": IMPORTANCE_RESAMPLING, "op13_quality_rules": quality_rules()}
