"""SQL counterparts of the queries in :mod:`tidegrain.plans.problems`."""

_CURRENT = """
cur AS (SELECT DISTINCT card_uid, platform, source, as_of, mentions, engagement FROM sentiment s
        WHERE card_uid IS NOT NULL AND as_of IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM sentiment r WHERE r.supersedes = s.row_id)),
daily AS (SELECT card_uid, CAST(as_of AS DATE) AS day, sum(mentions) AS m FROM cur GROUP BY 1, 2),
span AS (SELECT card_uid, min(day) AS lo, max(day) AS hi FROM daily GROUP BY 1),
cal AS (SELECT card_uid, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span),
dense AS (SELECT cal.card_uid, cal.day, coalesce(m, 0) AS m FROM cal LEFT JOIN daily USING (card_uid, day)),
roll AS (SELECT card_uid, day, m,
           CAST(sum(m) OVER (PARTITION BY card_uid ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS t7,
           CAST(sum(m) OVER (PARTITION BY card_uid ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS t30
         FROM dense)"""

_LATE = """
once AS (SELECT card_uid, platform, source, as_of, mentions, engagement, arg_min(row_id, (observed_at, row_id)) AS row_id, min(observed_at) AS observed_at
         FROM sentiment WHERE NOT coalesce(backfilled, false) AND card_uid IS NOT NULL AND source IS NOT NULL AND as_of IS NOT NULL
         GROUP BY ALL),
gone AS (SELECT supersedes, min(observed_at) AS at FROM sentiment WHERE supersedes IS NOT NULL GROUP BY 1),
life AS (SELECT o.card_uid, o.source, CAST(o.as_of AS DATE) AS day, coalesce(o.mentions, 0) AS m, o.observed_at AS born, greatest(g.at, CASE WHEN g.at IS NOT NULL THEN o.observed_at END) AS died
         FROM once o LEFT JOIN gone g ON g.supersedes = o.row_id),
per AS (SELECT card_uid, source, day,
          sum(CASE WHEN born < CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AND NOT coalesce(died < CAST(day AS TIMESTAMP) + INTERVAL 1 DAY, false) THEN m ELSE 0 END) AS at_end,
          sum(CASE WHEN born <= CAST(day AS TIMESTAMP) + INTERVAL 4 DAY AND NOT coalesce(died <= CAST(day AS TIMESTAMP) + INTERVAL 4 DAY, false) THEN m ELSE 0 END) AS at_cutoff,
          sum(CASE WHEN coalesce(died, TIMESTAMP '9999-01-01') = TIMESTAMP '9999-01-01' THEN m ELSE 0 END) AS at_last
        FROM life GROUP BY 1, 2, 3)"""

ORACLES = {
    "p1_found": f"WITH {_CURRENT} SELECT card_uid, strftime(day, '%Y-%m-%d') AS as_of_day FROM roll WHERE t7 = 0 AND t30 > 0",
    "p1_rolling": f"""WITH {_CURRENT} SELECT card_uid, strftime(day, '%Y-%m-%d') AS as_of_day, CAST(m AS BIGINT) AS mentions, t7 AS total_7, t30 AS total_30,
        round(t7 / 7.0, 6) AS avg_7, round(t30 / 30.0, 6) AS avg_30 FROM roll""",
    "p5_found": """
        WITH gone AS (SELECT supersedes, min(observed_at) AS at FROM price_snapshot WHERE supersedes IS NOT NULL GROUP BY 1),
        hit AS (SELECT a.alert_id, p.row_id, row_number() OVER (PARTITION BY a.alert_id ORDER BY p.as_of DESC, p.observed_at DESC, p.row_id DESC) AS rn
                FROM alert_ledger a JOIN price_snapshot p ON p.card_uid = a.card_uid AND p.source IS NOT DISTINCT FROM a.source
                  AND p.marketplace IS NOT DISTINCT FROM a.marketplace AND p.grade IS NOT DISTINCT FROM a.grade AND p.grader IS NOT DISTINCT FROM a.grader
                  AND p.observed_at <= a.fired_at
                LEFT JOIN gone g ON g.supersedes = p.row_id WHERE g.at IS NULL OR g.at > a.fired_at)
        SELECT alert_id, row_id FROM hit WHERE rn = 1""",
    "p7_found": f"WITH {_LATE} SELECT card_uid, source, strftime(day, '%Y-%m-%d') AS as_of_day FROM per WHERE at_end <> at_cutoff",
    "p7_published": f"""WITH {_LATE} SELECT card_uid, source, strftime(day, '%Y-%m-%d') AS as_of_day, CAST(at_end AS BIGINT) AS at_end,
        CAST(at_cutoff AS BIGINT) AS at_cutoff, CAST(at_last - at_cutoff AS BIGINT) AS refused FROM per""",
}
