"""SQL counterparts of the queries of this subpackage, where SQL can express them.

The mapping to the vocabulary is compared with brute force: every distinct value against every form.
"""

from tidegrain.llm import vocabulary as V


_G = ", 'g'"
_INDEX = "'([0-9]{1,9})[*]?( *[/-] *[0-9]+)?$'"

_P6 = f"""
WITH entries AS (SELECT rarity_id AS id, rarity AS entry, {V.normal_form('rarity', _G)} AS words FROM rarity_vocabulary WHERE game = 'pokemon'),
asked AS (SELECT target_id, rarity FROM targets WHERE game = 'pkmn' AND rarity IS NOT NULL AND rarity NOT IN (SELECT entry FROM entries)),
n AS (SELECT DISTINCT rarity AS value, {V.normal_form('rarity', _G)} AS words FROM asked),
q AS (SELECT value, 'own' AS form, replace(replace(words, '.', ''), ' ', '') AS s FROM n
  UNION ALL SELECT value, 'sorted', array_to_string(list_sort(string_split(replace(words, '.', ''), ' ')), '') FROM n),
forms AS (SELECT id, 'own' AS form, replace(words, ' ', '') AS r FROM entries UNION ALL SELECT id, 'sorted', array_to_string(list_sort(string_split(words, ' ')), '') FROM entries),
limits AS (SELECT *, {V.EDITS} AS k FROM (SELECT *, length(r) AS l FROM forms)),
initials AS (SELECT min(id) AS id, s FROM (SELECT id, array_to_string(list_transform(string_split(words, ' '), lambda w: CASE WHEN length(w) <= 2 THEN w ELSE left(w, 1) END), '') AS s FROM entries)
  WHERE length(s) >= 3 GROUP BY s HAVING count(*) = 1),
found AS (SELECT value, id, levenshtein(s, r) AS d FROM q JOIN limits ON q.form = limits.form AND q.s <> '' AND levenshtein(s, r) <= k
  UNION ALL SELECT q.value, i.id, 0 FROM q JOIN initials i ON q.s = i.s WHERE q.form = 'own'
  UNION ALL SELECT n.value, e.id, 0 FROM n JOIN entries e ON regexp_matches(n.words, '[^ .][.]( |$)') AND regexp_matches(e.words, concat('^', regexp_replace(n.words, '[.]', '[^ ]*', 'g'), '$'))),
best AS (SELECT value, arg_min(id, (d, id)) AS id FROM found GROUP BY value),
tied AS (SELECT t.rarity AS value, e.id, count(*) AS n FROM targets t JOIN cards c ON t.game = 'pkmn' AND c.game = 'pkmn' AND c.variant NOT IN ('parallel', 'manga_rare')
    AND lower(regexp_replace(regexp_replace(t.set_code, '^set ', ''), '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(c.set_code, '[^A-Za-z0-9]', '', 'g'))
    AND TRY_CAST(regexp_extract(t.number, {_INDEX}, 1) AS BIGINT) = TRY_CAST(regexp_extract(c.number, {_INDEX}, 1) AS BIGINT)
  JOIN entries e ON e.entry = c.rarity WHERE t.rarity IN (SELECT value FROM n) AND t.rarity NOT IN (SELECT value FROM best) GROUP BY 1, 2),
names AS (SELECT value, id, {V.normal_form('value', _G)} AS words FROM (SELECT value, arg_max(id, (n, -id)) AS id, max(n) AS most, sum(n) AS total FROM tied GROUP BY 1) WHERE most >= {V.LEAST} AND most >= {V.AGREED} * total),
learned AS (SELECT *, {V.EDITS} AS k FROM (SELECT id, replace(replace(words, '.', ''), ' ', '') AS r, length(replace(replace(words, '.', ''), ' ', '')) AS l FROM names) WHERE l > 0),
later AS (SELECT q.value, arg_min(a.id, (levenshtein(q.s, a.r), a.id)) AS id FROM q JOIN learned a ON q.form = 'own' AND q.s <> '' AND levenshtein(q.s, a.r) <= a.k WHERE q.value NOT IN (SELECT value FROM best) GROUP BY 1)
SELECT a.target_id, CAST(coalesce(b.id, w.id, -1) AS INT) AS rarity_id FROM asked a LEFT JOIN best b ON a.rarity = b.value LEFT JOIN later w ON a.rarity = w.value"""

ORACLES = {"p6_found": _P6}
