"""Free-entered values mapped to a canonical list, in SQL only.

A partition-based pigeonhole join: a reference string that may differ in k edits is cut into k + 1
segments, one of which must occur unchanged in any string within k edits, at a position shifted by
no more than the edits on either side. Distinct values are joined with the segments by equality of
(form, length, segment number, substring); built-in levenshtein verifies the pairs; the nearest entry
wins, ties going to the lowest id; values without any are reported by an anti-join.

Values are compared in normal form: full-width letters made plain, lower case, marks such as brackets,
stars and edition notes removed. Besides its own string an entry has the forms with its words sorted
(for swapped words) and its initials if no other entry has them (equality only); shortened words ending in a
period are matched as prefixes of an entry's words after an equality join on the initials of all words, which
every shortening keeps.

Names in other languages share no letters with an entry. They are learned, not listed: of the rows whose value
matched nothing, those that other keys tie to catalogue records tell what a value stands for. A value that is
tied ``LEAST`` times or more, to one entry in ``AGREED`` of the cases, becomes a further form of that entry, and
what is still unmatched goes through the same join against these forms.

Defined cases: null values and values that are entries letter for letter give no row; empty and blank
values are unmatched; values of any length are handled whole; repeated rows each get a row; an empty
vocabulary leaves everything unmatched; without evidence nothing is learned; an empty table gives an empty result;
only named columns are read. No part of the vocabulary or of the values is collected; nothing is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidegrain.session import written

#: Rows that must tie a value to records, and the share of them that must agree, before it stands for an entry.
LEAST, AGREED = 2, 0.8

#: Full-width characters and their plain counterparts.
WIDE = "".join(chr(c) for c in range(0xFF21, 0xFF3B)) + "".join(chr(c) for c in range(0xFF41, 0xFF5B)) + "　"
PLAIN = "".join(chr(c) for c in range(0x41, 0x5B)) + "".join(chr(c) for c in range(0x61, 0x7B)) + " "

#: Notes that are no part of a name.
NOTES = ("^rarity:", "[(]en[)]$", "- 1st print$")

#: Longest edit distance by length of the reference string, as a SQL expression over its length ``l``.
EDITS = "CASE WHEN l <= 3 THEN 0 WHEN l <= 5 THEN 1 WHEN l <= 7 THEN 2 WHEN l <= 9 THEN 3 ELSE 4 END"
MOST_EDITS = 4


def normal_form(column: str, every: str = "") -> str:
    """SQL for the normal form of ``column``; ``every`` is the flag that makes the dialect replace every match."""
    s = f"trim(lower(translate({column}, '{WIDE}', '{PLAIN}')))"
    for note in NOTES:
        s = f"trim(regexp_replace({s}, '{note}', ' '{every}))"
    slash = "\\" if every else "\\\\"
    return f"trim(regexp_replace({s}, '[^{slash}pL{slash}pN.]+', ' '{every}))"


#: The initials of the words of ``words``, joined: one equality key for a name and every shortening of its words.
INITIALS = "array_join(transform(split(words, ' '), w -> left(w, 1)), '')"

_OWN_FORMS = f"""
    initials AS (
      SELECT min(entry_id) AS entry_id, s FROM (
        SELECT entry_id, array_join(transform(split(words, ' '), w -> CASE WHEN length(w) <= 2 THEN w ELSE left(w, 1) END), '') AS s FROM entries)
      WHERE length(s) >= 3 GROUP BY s HAVING count(*) = 1),
    forms AS (
      SELECT entry_id, 'own' AS form, replace(words, ' ', '') AS r FROM entries
      UNION ALL SELECT entry_id, 'sorted', array_join(array_sort(split(words, ' ')), '') FROM entries),
    short AS (
      SELECT n.value, e.entry_id, 0 AS distance
      FROM (SELECT value, words, {INITIALS} AS k FROM n WHERE words RLIKE '[^ .][.]( |$)') n
      JOIN (SELECT entry_id, words, {INITIALS} AS k FROM entries) e ON n.k = e.k AND e.words RLIKE concat('^', regexp_replace(n.words, '[.]', '[^ ]*'), '$')),
    spelled AS (SELECT a.value, i.entry_id, 0 AS distance FROM asked a JOIN initials i ON a.s = i.s WHERE a.form = 'own'),"""
_LEARNED_FORMS = """
    forms AS (SELECT entry_id, 'own' AS form, replace(replace(words, '.', ''), ' ', '') AS r FROM entries),"""


def match_values(values: DataFrame, vocabulary: DataFrame, learned: bool = False) -> DataFrame:
    """``(value, entry_id, distance)`` for every distinct ``value`` that has an entry.

    ``values (value)``; ``vocabulary (entry_id, entry)``; with ``learned`` its entries are taken as they are,
    without initials, sorted words and shortenings.
    """
    spark = values.sparkSession
    more = "" if learned else "UNION ALL SELECT * FROM short UNION ALL SELECT * FROM spelled"
    sql = f"""
    WITH v AS (SELECT DISTINCT value FROM {{values}} WHERE value IS NOT NULL),
    n AS (SELECT value, {normal_form('value')} AS words FROM v),
    asked AS (
      SELECT value, 'own' AS form, replace(replace(words, '.', ''), ' ', '') AS s FROM n
      UNION ALL SELECT value, 'sorted', array_join(array_sort(split(replace(words, '.', ''), ' ')), '') FROM n),
    entries AS (SELECT entry_id, entry, {normal_form('entry')} AS words FROM {{vocabulary}} WHERE entry IS NOT NULL),
    {_LEARNED_FORMS if learned else _OWN_FORMS}
    cut AS (SELECT entry_id, form, r, l, {EDITS} AS k FROM (SELECT *, length(r) AS l FROM forms) WHERE l > 0),
    segments AS (
      SELECT entry_id, form, r, l, k, i, substring(r, CAST(floor(i * l / (k + 1)) AS INT) + 1, CAST(floor((i + 1) * l / (k + 1)) - floor(i * l / (k + 1)) AS INT)) AS part
      FROM (SELECT *, explode(sequence(0, k)) AS i FROM cut)),
    lengths AS (
      SELECT value, form, s, l, {EDITS} AS k FROM (
        SELECT value, form, s, explode(sequence(greatest(length(s) - {MOST_EDITS}, 1), length(s) + {MOST_EDITS})) AS l FROM asked WHERE s != '')),
    places AS (SELECT *, explode(sequence(0, k)) AS i FROM lengths WHERE abs(length(s) - l) <= k),
    windows AS (
      SELECT value, form, s, l, i, CAST(floor(i * l / (k + 1)) AS INT) AS at, CAST(floor((i + 1) * l / (k + 1)) - floor(i * l / (k + 1)) AS INT) AS len,
        greatest(-i, length(s) - l - (k - i)) AS lo, least(i, length(s) - l + (k - i)) AS hi FROM places),
    probes AS (
      SELECT DISTINCT value, form, s, l, i, substring(s, at + shift + 1, len) AS part
      FROM (SELECT *, explode(sequence(lo, hi)) AS shift FROM windows WHERE lo <= hi) WHERE at + shift >= 0 AND at + shift + len <= length(s)),
    near AS (
      SELECT value, entry_id, levenshtein(s, r, k) AS distance
      FROM (SELECT DISTINCT p.value, p.s, g.entry_id, g.r, g.k FROM probes p JOIN segments g ON p.form = g.form AND p.l = g.l AND p.i = g.i AND p.part = g.part)),
    found AS (SELECT value, entry_id, distance FROM near WHERE distance >= 0 {more})
    SELECT value, best.entry_id, best.distance
    FROM (SELECT value, min(struct(distance, entry_id)) AS best FROM found GROUP BY value)
    """
    return spark.sql(sql, values=values, vocabulary=vocabulary)


def learned_names(rows: DataFrame, evidence: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(entry_id, entry)``: values of ``rows (id, value)`` that ``evidence (id, entry)`` ties to one entry."""
    return rows.sparkSession.sql(
        f"""
        WITH tied AS (SELECT r.value, v.entry_id, count(*) AS n FROM {{r}} r JOIN {{e}} e ON r.id = e.id JOIN {{v}} v ON e.entry = v.entry GROUP BY r.value, v.entry_id),
        shares AS (SELECT value, max(struct(n, -entry_id AS e)) AS best, sum(n) AS tied FROM tied GROUP BY value)
        SELECT -best.e AS entry_id, value AS entry FROM shares WHERE best.n >= {LEAST} AND best.n >= {AGREED} * tied""",
        r=rows, e=evidence, v=vocabulary,
    )


def map_to_vocabulary(rows: DataFrame, vocabulary: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """``(id, entry_id, distance)``: per row the entry meant, -1 and null where there is none.

    ``rows (id, value)``; ``vocabulary (entry_id, entry)``; ``evidence (id, entry)``: for some rows the entry of a
    catalogue record that other keys tie them to. Rows whose value is null or an entry letter for letter are left out.
    """
    spark = rows.sparkSession
    open_rows = spark.sql("SELECT r.id, r.value FROM {r} r LEFT ANTI JOIN {v} v ON r.value = v.entry WHERE r.value IS NOT NULL", r=rows, v=vocabulary)
    matched = match_values(open_rows.select("value"), vocabulary)
    if evidence is not None:
        matched = written(matched)  # one row per distinct value
        rest = spark.sql("SELECT o.id, o.value FROM {o} o LEFT ANTI JOIN {m} m ON o.value = m.value", o=open_rows, m=matched)
        names = written(learned_names(rest, evidence, vocabulary))
        matched = matched.unionByName(match_values(rest.select("value"), names, learned=True))
    return spark.sql(
        """SELECT o.id, m.entry_id, m.distance FROM {o} o JOIN {m} m ON o.value = m.value
        UNION ALL SELECT o.id, -1, CAST(NULL AS INT) FROM {o} o LEFT ANTI JOIN {m} m ON o.value = m.value""",
        o=open_rows, m=matched,
    )
