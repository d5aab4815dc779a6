"""The native operators in DuckDB's SQL, written from what they shall compute, not from their Spark plans."""

from __future__ import annotations

from txrisk.llm import mixing, quality_rules, secrets
from txrisk.llm.common import WORD

MIXING = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
per0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
per1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM per0),
per2 AS (SELECT *, {list(mixing.WEIGHTS)}[(sid - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM per1),
levels AS (SELECT *, ({mixing.SHARE}e0 * sum(source_size) OVER () - {mixing.MOST} * coalesce(sum(source_size) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM per2
  WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
per AS (SELECT source, sid, source_size, least(max(level) OVER () * weight, {mixing.MOST}e0 * source_size) AS target,
    greatest(1, CAST(ceil(source_size / {mixing.SHARD_WORDS}e0) AS BIGINT)) AS shards FROM levels),
dealt AS (SELECT s.doc_id, s.size, p.*, md5(concat_ws('|', '{mixing.SEED}', s.doc_id)) AS place FROM sized s JOIN per p
  ON s.source IS NOT DISTINCT FROM p.source),
sharded AS (SELECT *, CAST(concat('0x', place[1:8]) AS BIGINT) % shards AS shard FROM dealt),
lots AS (SELECT sid, shard, CAST(sum(size) AS BIGINT) AS lot, CASE WHEN sum(size) > 0
    THEN greatest(1, CAST(round(sum(size) / {mixing.BLOCK_WORDS}e0) AS BIGINT)) ELSE 0 END AS blocks FROM sharded GROUP BY sid, shard),
wanted AS (SELECT sid, CAST(sum(blocks) AS BIGINT) AS n, CASE WHEN first(source_size) > 0
    THEN first(target) * sum(blocks) / first(source_size) ELSE 0e0 END AS wanted FROM lots JOIN per USING (sid) GROUP BY sid),
-- the highest quotients of all
seats AS (SELECT sid, row_number() OVER (ORDER BY wanted / (2 * k + 1) DESC, sid, k) AS place,
    round(sum(wanted) FILTER (WHERE k = 0) OVER ()) AS house FROM (SELECT *, unnest(range({mixing.MOST} * n)) AS k FROM wanted)),
quotas AS (SELECT sid, n, count(*) FILTER (WHERE place <= house) AS quota FROM wanted LEFT JOIN seats USING (sid) GROUP BY sid, n),
wanted2 AS (SELECT l.*, CASE WHEN n > 0 THEN CAST(quota * blocks AS DOUBLE) / n ELSE 0e0 END AS wanted FROM lots l JOIN quotas USING (sid)),
seats2 AS (SELECT sid, shard, row_number() OVER (PARTITION BY sid ORDER BY wanted / (2 * k + 1) DESC, shard, k) AS place,
    round(sum(wanted) FILTER (WHERE k = 0) OVER (PARTITION BY sid)) AS house
  FROM (SELECT *, unnest(range({mixing.MOST} * blocks)) AS k FROM wanted2)),
plan AS (SELECT sid, shard, lot, blocks, count(*) FILTER (WHERE place <= house) AS quota FROM wanted2 LEFT JOIN seats2 USING (sid, shard)
  GROUP BY sid, shard, lot, blocks),
laid AS (SELECT s.*, lot, blocks, quota, CAST(sum(size) OVER (PARTITION BY sid, shard ORDER BY place, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fin FROM sharded s JOIN plan USING (sid, shard)),
cut AS (SELECT *, unnest(range((fin - size) * blocks // lot, (fin - 1) * blocks // lot + 1)) AS block FROM laid WHERE size > 0),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY sid, shard ORDER BY md5(concat_ws('|', '{mixing.SEED}', sid, shard, block)), block) AS r
  FROM cut),
took AS (SELECT doc_id, sum((least(fin, ((block + 1) * lot + blocks - 1) // blocks) - greatest(fin - size, (block * lot + blocks - 1) // blocks))
    * (quota // blocks + CASE WHEN r <= quota % blocks THEN 1 ELSE 0 END)) AS taken FROM ranked GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM sharded LEFT JOIN took USING (doc_id)
"""

_RATES = {
    "word_length": "100 * word_chars // n_words", "symbols": "1000 * n_symbols // word_chars", "repeated": "1000 * n_repeat_words // n_words",
    "repeated_lines": "1000 * n_dup_lines // n_lines", "capitals": "1000 * n_capitals // word_chars",
}
_BOUNDS = "\n  AND ".join(
    x for name, (below, above) in quality_rules.MARGINS.items() for x in (
        [] if below is None else [f"{_RATES[name]} >= {name}.q25 - greatest({below}, {quality_rules.REACH} * ({name}.q50 - {name}.q25))"]) + (
        [] if above is None else [f"{_RATES[name]} <= {name}.q75 + greatest({above}, {quality_rules.REACH} * ({name}.q75 - {name}.q50))"]))
_JOINS = "\n".join(
    f"LEFT JOIN chosen {name} ON {name}.doc_id = m.doc_id AND {name}.measure = '{name}'" for name in _RATES)
RULES = f"""
WITH body AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM body),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {quality_rules.WINDOW} + 2)) AS i FROM split),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + {quality_rules.WINDOW - 1}], ' ') AS w FROM starts),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM
  (SELECT doc_id, unnest(range(i, i + {quality_rules.WINDOW})) AS place FROM often) GROUP BY doc_id),
m0 AS (SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(translate(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(translate(text, '{quality_rules.CAPITALS}', '')) AS BIGINT) AS n_capitals,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM split LEFT JOIN covered USING (doc_id)),
m AS (SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed FROM m0),
tall AS ({" UNION ALL ".join(f"SELECT lang, source, '{name}' AS measure, {value} AS v FROM m WHERE NOT base_failed" for name, value in _RATES.items())}),
-- three significant digits
cut AS (SELECT lang, source, measure, v - v % CAST(pow(10, greatest(0, length(CAST(v AS VARCHAR)) - 3)) AS BIGINT) AS v FROM tall),
groups AS (SELECT 0 AS level, lang, source, measure, v FROM cut UNION ALL SELECT 1, lang, '', measure, v FROM cut
  UNION ALL SELECT 2, '', '', measure, v FROM cut),
quartiles AS (SELECT level, lang, source, measure, count(*) AS n,
    {", ".join(f"list(v ORDER BY v)[CAST(ceil(count(*) * {q} / 100e0) AS BIGINT)] AS q{q}" for q in (25, 50, 75))} FROM groups GROUP BY ALL),
chosen AS (SELECT m.doc_id, q.measure, q.q25, q.q50, q.q75 FROM m JOIN quartiles q ON q.level = 2 OR (q.n >= {quality_rules.LEAST} AND q.lang = m.lang
    AND (q.level = 1 OR q.source = m.source))
  QUALIFY row_number() OVER (PARTITION BY m.doc_id, q.measure ORDER BY q.level) = 1)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {_BOUNDS} END AS kept
FROM m {_JOINS}
"""

#: RE2 folds case beyond ASCII, so both cases are written out there.
_FOLDED = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_PATTERNS = [(r, r.pattern.replace("(?i)(password|passwd|secret|token|api_?key)", f"({_FOLDED})").replace("'", "''")) for r in secrets.RULES]
_FOUND = " UNION ALL ".join(f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_zip(string_split_regex(text, '{pattern}')[:-2], regexp_extract_all(text, '{pattern}'),
    regexp_extract_all(text, '{pattern}', {rule.group}), range(len(regexp_extract_all(text, '{pattern}'))))) AS x, {rule.least} AS least
  FROM body WHERE regexp_matches(text, '{pattern}')""" for rank, (rule, pattern) in enumerate(_PATTERNS))
_BASE = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
SECRETS = f"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}),
placed AS (SELECT doc_id, rank, kind, length(x[2]) AS own, length(x[3]) >= least AS good,
    CAST(sum(length(x[1]) + length(x[2])) OVER (PARTITION BY doc_id, kind ORDER BY x[4]) AS BIGINT) AS fin FROM found),
spans AS (SELECT doc_id, rank, kind, fin - own AS start, concat_ws(':', kind, fin - own, fin) AS said FROM placed WHERE good),
per AS (SELECT doc_id, string_agg(said, ',' ORDER BY start, rank) AS spans, string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE kind IN ({_BASE})) AS base,
    {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)} FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM body LEFT JOIN per USING (doc_id)
"""

ORACLES = {"op5_quality_rules": RULES, "op7_mixing": MIXING, "op8_secrets": SECRETS}
