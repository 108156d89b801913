"""DuckDB SQL of the llm queries that SQL can express.

Tokenizers (op4, op10, op13) and trained models (op5, op6, op8) are tested against brute force and held-out rows instead.
"""
from __future__ import annotations

import math

from depotlens.llm import quality_rules as rules

WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS k
        FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (k)),
wd AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM wd ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format("text"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
          FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter WHERE 100 * c >= 85 * (na + nb - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)
"""

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, {LOWER.format(f"trim(line, {BLANK})")} AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, h.keeper IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""


def _rules() -> str:
    share = rules.RISK / len(rules.RULES)
    log_error = math.log(rules.ERROR / (len(rules.RULES) * rules.STRATA))
    top = rules.LEVELS - 1

    def level(part: str, whole: str) -> str:
        return f"least({top}, floor({rules.LEVELS}::DOUBLE * ({part}) / greatest({whole}, 1)))"

    levels = [level("n_symbols", "2 * n_words"), level("n_dup_lines", "n_lines"), level("n_repeat_words", "n_words"),
              level("word_chars", "24 * n_words"), level("n_words - n_distinct", "n_words")]
    term = ("lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})").format(p=f"{share!r}::DOUBLE")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {WORDS.format("text")} AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 7), ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT r, k FROM win GROUP BY r, k HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM win JOIN rep USING (r, k)) GROUP BY r),
b AS (SELECT r, doc_id, md5(t) AS text_hash,
  (CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END) || CASE WHEN len(w) < {rules.LONG} THEN '-short' ELSE '-long' END AS stratum,
  len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, {BLANK}) <> '') AS ls, coalesce(c, 0) AS n_repeat_words, len(list_distinct(w)) AS n_distinct
  FROM d LEFT JOIN cov USING (r)),
f AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
j AS (SELECT *, [{", ".join(levels)}] AS lv FROM f),
lab AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
trials AS (SELECT DISTINCT stratum, good, text_hash, lv FROM j JOIN lab USING (doc_id) WHERE NOT base_failed),
held AS (SELECT stratum, good, unnest(lv) AS level, unnest(range(0, {len(rules.RULES)})) AS rule FROM trials),
grid AS (SELECT stratum, rule, unnest(range(0, {rules.LEVELS})) AS cut FROM (SELECT DISTINCT stratum, rule FROM held)),
at_ AS (SELECT g.stratum, g.rule, g.cut, count(*) FILTER (good = 1 AND level >= cut) AS k, count(*) FILTER (good = 1) AS n,
  count(*) FILTER (good = 0 AND level >= cut) AS caught, count(*) FILTER (good = 0) AS bad
  FROM grid g JOIN held h ON g.stratum = h.stratum AND g.rule = h.rule GROUP BY ALL),
tails AS (SELECT stratum, rule, cut, ln(sum(exp(lt - top))) + any_value(top) AS tail FROM (
    SELECT *, max(lt) OVER (PARTITION BY stratum, rule, cut) AS top FROM (
      SELECT stratum, rule, cut, {term} AS lt FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM at_ WHERE k <= n * {share!r}::DOUBLE)))
  GROUP BY stratum, rule, cut),
sure AS (SELECT a.*, min(CASE WHEN t.tail <= {log_error!r}::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY a.stratum, a.rule ORDER BY a.cut DESC) AS ok
  FROM at_ a LEFT JOIN tails t USING (stratum, rule, cut)),
best AS (SELECT stratum, rule, arg_max(cut, (caught / bad - {rules.WEIGHT!r}::DOUBLE * k / greatest(n, 1), cut)) AS cut,
  arg_max(caught, (caught / bad - {rules.WEIGHT!r}::DOUBLE * k / greatest(n, 1), cut)) AS caught FROM sure WHERE ok = 1 AND bad > 0 GROUP BY stratum, rule),
hit AS (SELECT DISTINCT x.r FROM (SELECT r, stratum, unnest(lv) AS level, unnest(range(0, {len(rules.RULES)})) AS rule FROM j) x
  JOIN best USING (stratum, rule) WHERE caught > 0 AND level >= cut)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (r IN (SELECT r FROM hit)) AS kept
FROM j
"""


#: CRC-32 in plain SQL: its table from the polynomial's rule, then byte by byte.
CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc_t
FROM (SELECT unnest(range(256)) AS i))"""
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::BIGINT)),
lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])))"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
seen AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {CRC.format("d || run")} AS h FROM seen, crc_table),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
g AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form AS next FROM g UNION ALL SELECT c.word, g.word, g.form FROM chain c JOIN g ON c.next = g.word)
SELECT g.word, g.form, c.at AS root, g.n, CAST(g.n_near AS BIGINT) AS n_near, CAST(g.form_n AS BIGINT) AS form_n FROM g JOIN chain c ON g.word = c.word AND c.next IS NULL
"""


def _repair() -> str:
    """Forward DP over rows: of each state the cheapest, then ASCII-least, edits so far with the repaired lines."""
    def moved(state: str, cost: str, edit: str, line: str | None = None) -> str:
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {lines}}} END"

    def turned(state: str, initial: str, role: str) -> str:
        kept, changed = moved(state, "k", "K", "role || ':' || text"), moved(state, "k + 3", "R", f"'{role}:' || text")
        return f"CASE WHEN gone THEN NULL WHEN i = '{initial}' THEN {kept} ELSE {changed} END"

    delete = {s: moved(s, "4", "D") for s in ("s0", "s1", "s2", "s3")}
    kept_first = moved("s0", "k", "K", "role || ':' || text")
    first = f"CASE WHEN NOT gone AND i = 's' THEN {kept_first} END"
    to_u, to_a = ", ".join(turned(s, "u", "user") for s in ("s0", "s1", "s3")), turned("s2", "a", "assistant")
    in_u, in_a = ", ".join(moved(s, "3", "I", "'user:'") for s in ("s0", "s1", "s3")), moved("s2", "3", "I", "'assistant:'")
    lines = "{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    one = "{'c': 3::BIGINT, 'a': 'I', 't': ['user:']}"
    two = "{'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}"
    return f"""
WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, crc_table),
dmg AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '-') AS conv, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) FROM c WHERE f <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS p FROM dmg),
x AS (SELECT *, trim(text, {BLANK}) AS body, substr(role, 1, 1) AS i, row_number() OVER (PARTITION BY conv, role, text ORDER BY p) > 1 AS again,
  substr(role, 1, 1) || lead(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY p) AS two FROM o),
r AS MATERIALIZED (SELECT conv, turn, role, text, i, two, p, body = '' AS blank, body <> '' AND again AS dup, body = '' OR again AS gone,
  body <> '' AND NOT again AND NOT regexp_matches(right(body, 1), '[.!?]') AS cut FROM x),
w AS (SELECT DISTINCT conv, 0::BIGINT AS p, {lines} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s1, {one} AS s2, {two} AS s3 FROM r
  UNION ALL SELECT conv, p, s0, s1, s2, list_min([s3, {in_a}]) FROM (
    SELECT conv, p, s0, s1, list_min([s2, {in_u}]) AS s2, s3 FROM (
      SELECT conv, r.p, {delete["s0"]} AS s0, list_min([{delete["s1"]}, {first}]) AS s1, list_min([{delete["s2"]}, {to_u}]) AS s2, list_min([{delete["s3"]}, {to_a}]) AS s3
      FROM w JOIN (SELECT *, CASE WHEN cut THEN 3 ELSE 0 END AS k FROM r) r USING (conv) WHERE r.p = w.p + 1))),
done AS (SELECT conv, arg_max(list_min([s0, s3]), p) AS best FROM w GROUP BY conv),
n AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  count(*) FILTER (cut) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '-') AS conv FROM conversations) a LEFT JOIN n USING (conv) LEFT JOIN done USING (conv)
"""


SQL: dict[str, str] = {
    "op11_spelling_variants": SPELLING,
    "op12_conversation_repair": _repair(),
    "op1_substring_dedup": SUBSTRINGS,
    "op2_minhash_near_dedup": NEAR,
    "op3_quality_rules": _rules(),
    "op9_line_dedup": LINES,
    "op7_exact_top_k": """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
