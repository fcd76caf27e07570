"""DuckDB SQL for the training-data queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_TEN = r"regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH sized AS (
  SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n,
         1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w
  FROM sized GROUP BY source),
ranked AS (  -- sources reach 3 times their size in the order of 3 n / w
  SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, w, encode(source) NULLS LAST) AS k FROM src),
levels AS (
  SELECT *, CAST((SELECT sum(n) FROM src) - coalesce(sum(3 * n) OVER before, 0) AS DOUBLE) / sum(w) OVER since AS level
  FROM ranked
  WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         since AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cut AS (SELECT k AS first_open, level FROM levels WHERE level * w <= 3 * n ORDER BY k LIMIT 1),
targets AS (
  SELECT source, n, CASE WHEN k < first_open THEN CAST(3 * n AS DOUBLE) ELSE cut.level * w END AS target
  FROM ranked, cut),
budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM targets),
run AS (
  SELECT s.*, b.n, b.target, CASE WHEN b.n > 0 THEN b.words // b.n ELSE 0 END AS passes, CASE WHEN b.n > 0 THEN b.words % b.n ELSE 0 END AS rem,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS tied
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * passes + CASE WHEN upto <= rem THEN size WHEN upto - tied >= rem THEN 0
                                 ELSE (CAST(size AS HUGEINT) * (rem - (upto - tied))) // tied END AS BIGINT) AS taken
FROM run
"""

OP10 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_TEN} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS k
  FROM items, range(1, greatest(len(w) - 9, 1) + 1) r(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_TEN} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM docs, lengths, range(1, len(w) - n + 2) r(i)),
hits AS (SELECT f.rid, f.i, f.n, x.item_id FROM found f JOIN windows x ON f.k = x.k AND f.n = x.n),
words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM hits, range(i, i + n) r(j) GROUP BY rid),
names AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN names USING (rid)
"""

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_SEEDS = "['casino', 'bet', 'bets', 'poker', 'adult', 'porn', 'xxx', 'pills', 'viagra', 'spam', 'ads']"
#: FP-growth as an enumeration of the token sets of each blocked URL; only tokens that are frequent there can be in a rule.
OP3 = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, page_id, url, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path
  FROM pages),
fixed(rule, name, start, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
ruled AS (
  SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS fixed
  FROM parts JOIN fixed ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY rid),
taught AS (SELECT doc_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS bad FROM labels GROUP BY doc_id),
judged AS (
  SELECT parts.*, rule, fixed, CASE WHEN list_has_any(regexp_split_to_array(host, '[._-]'), {_SEEDS}) THEN true ELSE bad END AS blocked, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x),
    list_transform(list_filter(flatten(list_transform(list_filter(string_split(host, '.'), lambda x: regexp_matches(x, '[_-]')), lambda x: regexp_split_to_array(x, '[_-]'))), lambda x: x <> ''), lambda x: 'word:' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(regexp_extract_all(coalesce(url, ''), '[?&]([^=&#]+)=', 1), lambda x: 'field:' || x))) AS tokens
  FROM parts LEFT JOIN ruled USING (rid) LEFT JOIN taught ON doc_id = TRY_CAST(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1) AS BIGINT)),
open_ AS (SELECT rid, blocked, unnest(tokens) AS x FROM judged WHERE fixed IS NULL AND contains(url, '://')),
least AS (SELECT greatest(5, ceil(0.002 * count(DISTINCT rid))) AS n FROM open_ WHERE blocked),
frequent AS (SELECT x FROM open_ WHERE blocked GROUP BY x HAVING count(*) >= (SELECT n FROM least)),
short AS (SELECT rid, blocked, list_sort(list(x)) AS t FROM open_ JOIN frequent USING (x) GROUP BY rid, blocked),
sets AS (SELECT rid, blocked, list_filter(t, lambda x, i: (b >> (i - 1)) & 1 = 1) AS c FROM short, range(1, 1 << len(t)) r(b)),
mined AS (
  SELECT c, count(*) FILTER (blocked) / count(*) FILTER (blocked IS NOT NULL) AS confidence FROM sets GROUP BY c
  HAVING count(*) FILTER (blocked) >= (SELECT n FROM least) AND count(*) FILTER (blocked) / count(*) FILTER (blocked IS NOT NULL) >= 0.9),
best AS (
  SELECT rid, arg_max(array_to_string(c, ' '), (confidence, -len(c), array_to_string(c, ' '))) AS mined, max(confidence) AS confidence
  FROM sets JOIN mined USING (c) GROUP BY rid)
SELECT page_id, host, path, rule, CASE WHEN fixed IS NOT NULL THEN fixed WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN fixed IS NULL THEN mined END AS mined, CASE WHEN fixed IS NULL THEN confidence END AS confidence
FROM judged LEFT JOIN best USING (rid)
"""

OP11 = r"""
WITH lines AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM lines),
cut AS (
  SELECT doc_id, n, form, text, array_to_string(u[1 : least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1 :], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

#: The filters applied one after the other, in each order, to counts of failure patterns.
OP12 = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
smallest AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text),
marked AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 100 AS fa, 100 * len(list_distinct(w)) < 80 * len(w) AS fb,
         100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS fc, regexp_matches(text, '[#$%&*|]') AS fd, coalesce(d.doc_id > first, false) AS fe
  FROM words d JOIN smallest USING (text) LEFT JOIN marked ON marked.doc_id = d.doc_id),
patterns AS (
  SELECT part, CASE WHEN fa THEN 'A' ELSE '' END || CASE WHEN fb THEN 'B' ELSE '' END || CASE WHEN fc THEN 'C' ELSE '' END || CASE WHEN fd THEN 'D' ELSE '' END || CASE WHEN fe THEN 'E' ELSE '' END AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flags GROUP BY ALL),
letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
meets AS (  -- the step that removes a pattern, and how often each filter fails
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, n, good, toxic, fails, contains(fails, substr(filter_order, step, 1)) AS fails_this,
         length(translate(substr(filter_order, 1, step - 1), fails, '')) < step - 1 AS gone
  FROM patterns, orders, range(1, 6) s(step)),
counted AS (
  SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT gone AND NOT fails_this), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_this), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND fails_this), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails_this AND length(fails) = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND fails_this), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_this), 0)::BIGINT AS toxic_lost
  FROM meets GROUP BY part, filter_order, step)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM counted
"""


def op13(templates: list[tuple[str, str]], phrases: dict[str, str]) -> str:
    """Votes, diagonals and verified spans with windows. Templates and phrases are fixed values and come from the operator."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    forms = ", ".join(f"({k}, {quoted(label)}, {quoted(text)})" for k, (label, text) in enumerate(templates))
    says = ", ".join(f"({quoted(label)}, {quoted(phrase)})" for phrase, label in phrases.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_TEN} AS w FROM documents),
templates AS (SELECT t, label, {_TEN} AS w FROM (VALUES {forms}) x(t, label, text)),
grams AS (SELECT t, label, len(w) AS n, i - 1 AS p, array_to_string(w[i : i + 2], ' ') AS g FROM templates, range(1, len(w) - 1) r(i)),
runs AS (SELECT rid, i - 1 AS p, array_to_string(w[i : i + 2], ' ') AS g FROM docs, range(1, len(w) - 1) r(i)),
votes AS (SELECT DISTINCT rid, t, label, n, runs.p - grams.p AS d, grams.p AS x FROM runs JOIN grams USING (g)),
diagonals AS (SELECT rid, t, label, n, greatest(CAST(floor(n * (1 - 0.8::DOUBLE) + 1e-9) AS BIGINT), 1) AS slack, d, list(x) AS xs FROM votes GROUP BY ALL),
far AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY rid, t ORDER BY d) <= slack THEN 0 ELSE 1 END AS far FROM diagonals),
grouped AS (SELECT *, sum(far) OVER (PARTITION BY rid, t ORDER BY d) AS grp FROM far),
covers AS (
  SELECT rid, t, label, n, slack, grp, d, min(d + x) AS s, max(d + x) + 3 AS e, list_distinct(flatten(list([x, x + 1, x + 2]))) AS c
  FROM (SELECT * EXCLUDE (xs), unnest(xs) AS x FROM grouped) GROUP BY rid, t, label, n, slack, grp, d),
merged AS (SELECT rid, t, label, n, slack, grp, min(s) AS s, max(e) AS e, len(list_distinct(flatten(list(c)))) AS covered FROM covers GROUP BY rid, t, label, n, slack, grp),
whole AS (SELECT *, covered >= 0.8::DOUBLE * n - 1e-9 AND e - s <= n + slack AS holds FROM merged),
verified AS (
  SELECT rid, label, n, s, e, covered FROM whole WHERE holds
  UNION ALL
  SELECT rid, label, n, c.s, c.e, len(c.c) FROM covers c JOIN whole USING (rid, t, label, n, grp)
  WHERE NOT holds AND len(c.c) >= 0.8::DOUBLE * n - 1e-9 AND c.e - c.s <= n + c.slack),
apart AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY rid ORDER BY s, e DESC, label, covered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS apart FROM verified),
placed AS (SELECT *, sum(apart) OVER (PARTITION BY rid ORDER BY s, e DESC, label, covered ROWS UNBOUNDED PRECEDING) AS place FROM apart),
best AS (SELECT rid, place, arg_max(label, (covered / n, covered, label)) AS label, max(covered / n) AS share FROM placed GROUP BY rid, place),
added AS (SELECT rid, list(label) AS labels, max(share) AS score FROM best GROUP BY rid),
says AS (SELECT label, string_split(phrase, ' ') AS q FROM (VALUES {says}) x(label, phrase)),
places AS (SELECT rid, label, i - 1 AS x FROM docs, says, range(1, len(w) - len(q) + 2) r(i) WHERE w[i] = q[1] AND w[i : i + len(q) - 1] = q),
base AS (SELECT rid, count(*) AS n_base, min(x) AS first_word, max(x) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, added.labels))), ','), '') AS labels, coalesce(score, 0) AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN added USING (rid)
"""
