"""Oracle SQL (DuckDB) for the recommender, compatibility and ingest queries."""

from __future__ import annotations


PAIRS = """
, pusers AS (SELECT DISTINCT user_id FROM plays)
, pairs AS (SELECT CAST(a.user_id AS VARCHAR) || ':' || CAST(b.user_id AS VARCHAR) AS pair_id,
                   a.user_id AS user_a, b.user_id AS user_b
            FROM pusers a JOIN pusers b ON b.user_id = a.user_id + 1
            UNION ALL
            SELECT CAST(user_id AS VARCHAR) || ':' || CAST(user_id AS VARCHAR), user_id, user_id FROM pusers)"""


def corpus_ctes(as_of: str, decay: bool = True) -> str:
    score = ("SUM(power(0.5, ((epoch_us(TIMESTAMP '%s') - epoch_us(listened_at)) / 1e6) / (86400.0 * 90)))"
             % as_of) if decay else "CAST(COUNT(*) AS DOUBLE)"
    return f"""
, corpus_votes AS (SELECT lower(artist_name) AS akey, artist_name, COUNT(*) AS n FROM tags_clean GROUP BY ALL)
, spelled AS (SELECT akey, MIN(artist_name) AS display
              FROM corpus_votes JOIN (SELECT akey, MAX(n) AS n FROM corpus_votes GROUP BY akey) most USING (akey, n) GROUP BY akey)
, corpus AS (SELECT display AS artist_name, tag, MAX(weight) AS weight
             FROM tags_clean JOIN spelled ON akey = lower(artist_name) GROUP BY display, tag)
, nn AS (SELECT COUNT(DISTINCT artist_name) AS n FROM corpus)
, idf AS (SELECT tag, ln(CAST((SELECT n FROM nn) AS DOUBLE) / COUNT(DISTINCT artist_name)) AS idf
          FROM corpus GROUP BY tag)
, tot AS (SELECT artist_name, SUM(weight) AS total FROM corpus GROUP BY artist_name)
, av AS (SELECT c.artist_name, lower(c.artist_name) AS akey, c.tag,
                (CAST(c.weight AS DOUBLE) / CAST(t.total AS DOUBLE)) * i.idf AS value
         FROM corpus c JOIN tot t ON t.artist_name = c.artist_name JOIN idf i ON i.tag = c.tag
         WHERE t.total > 0)
, spelling AS (SELECT user_id, akey, artist_name FROM (
      SELECT user_id, lower(artist_name) AS akey, artist_name,
             row_number() OVER (PARTITION BY user_id, lower(artist_name) ORDER BY COUNT(*) DESC, artist_name) AS rn
      FROM plays GROUP BY user_id, lower(artist_name), artist_name) r WHERE rn = 1)
, sc AS (SELECT user_id, lower(artist_name) AS akey, COUNT(*) AS plays, {score} AS score
         FROM plays GROUP BY user_id, lower(artist_name))
, tv AS (SELECT s.user_id, a.tag, SUM(ln(1.0 + s.score) * a.value) AS value
         FROM sc s JOIN av a ON a.akey = s.akey GROUP BY s.user_id, a.tag)"""


def recs_ctes(as_of: str, seeded: bool, k: int) -> str:
    seed = """
, seeds AS (SELECT DISTINCT user_id, lower(artist_name) AS akey FROM artist_feedback WHERE verdict = 'seed')
, sv AS (SELECT s.user_id, a.tag, SUM(ln(1.0 + 1.0) * a.value) AS value
         FROM seeds s JOIN av a ON a.akey = s.akey GROUP BY s.user_id, a.tag)
, has_seed AS (SELECT DISTINCT user_id FROM sv)
, sn AS (SELECT user_id, sqrt(SUM(value * value)) AS n FROM sv GROUP BY user_id)
, su AS (SELECT sv.user_id, tag, value / n AS value FROM sv JOIN sn ON sn.user_id = sv.user_id
         WHERE n > 0 AND value <> 0)
, cs AS (SELECT su.user_id, au.artist_name, au.akey, SUM(su.value * au.value) AS cs
         FROM su JOIN au ON au.tag = su.tag GROUP BY ALL)""" if seeded else ""
    excl = ("SELECT user_id, akey FROM sc UNION SELECT user_id, lower(artist_name) FROM artist_feedback"
            if seeded else "SELECT user_id, akey FROM sc")
    if seeded:
        both = """
, dots AS (SELECT COALESCE(ct.user_id, cs.user_id) AS user_id,
                  COALESCE(ct.artist_name, cs.artist_name) AS artist_name,
                  COALESCE(ct.akey, cs.akey) AS akey,
                  COALESCE(ct.ct, 0) AS ct, COALESCE(cs.cs, 0) AS cs
           FROM ct FULL OUTER JOIN cs ON ct.user_id = cs.user_id AND ct.artist_name = cs.artist_name)
, scored AS (SELECT d.user_id, d.artist_name, d.akey,
                    CASE WHEN h.user_id IS NOT NULL THEN 0.5 * d.ct + 0.5 * d.cs ELSE d.ct END AS raw
             FROM dots d LEFT JOIN has_seed h ON h.user_id = d.user_id)"""
    else:
        both = """
, scored AS (SELECT user_id, artist_name, akey, ct AS raw FROM ct)"""
    return corpus_ctes(as_of) + f"""
, an AS (SELECT artist_name, sqrt(SUM(value * value)) AS n FROM av GROUP BY artist_name)
, au AS (SELECT av.artist_name, av.akey, av.tag, av.value / an.n AS value
         FROM av JOIN an ON an.artist_name = av.artist_name WHERE an.n > 0 AND av.value <> 0)
, tn AS (SELECT user_id, sqrt(SUM(value * value)) AS n FROM tv GROUP BY user_id)
, tu AS (SELECT tv.user_id, tag, value / n AS value FROM tv JOIN tn ON tn.user_id = tv.user_id
         WHERE n > 0 AND value <> 0)
, ct AS (SELECT tu.user_id, au.artist_name, au.akey, SUM(tu.value * au.value) AS ct
         FROM tu JOIN au ON au.tag = tu.tag GROUP BY ALL){seed}{both}
, excl AS ({excl})
, cand AS (SELECT s.user_id, s.artist_name, round(s.raw, 9) AS score FROM scored s
           WHERE s.raw > 0 AND s.user_id IN (SELECT user_id FROM tv)
             AND NOT EXISTS (SELECT 1 FROM excl e WHERE e.user_id = s.user_id AND e.akey = s.akey))
, recs AS (SELECT user_id, artist_name, score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, artist_name) AS INTEGER) AS rank
      FROM cand) r WHERE rank <= {k})"""


def compat_ctes() -> str:
    return PAIRS + f"""
, utp AS (SELECT p.user_id, pt.tag, COUNT(*) AS plays
          FROM plays p JOIN primary_tag pt ON pt.artist_name = p.artist_name GROUP BY ALL)
, ta AS (SELECT pr.pair_id, u.tag, u.plays FROM pairs pr JOIN utp u ON u.user_id = pr.user_a)
, tb AS (SELECT pr.pair_id, u.tag, u.plays FROM pairs pr JOIN utp u ON u.user_id = pr.user_b)
, sides AS (SELECT COALESCE(ta.pair_id, tb.pair_id) AS pair_id, COALESCE(ta.tag, tb.tag) AS tag,
                   COALESCE(ta.plays, 0) AS a_val, COALESCE(tb.plays, 0) AS b_val
            FROM ta FULL OUTER JOIN tb ON ta.pair_id = tb.pair_id AND ta.tag = tb.tag)
, agg AS (SELECT pair_id, CAST(SUM(a_val * b_val) AS DOUBLE) AS dot,
                 CAST(SUM(a_val * a_val) AS DOUBLE) AS na2, CAST(SUM(b_val * b_val) AS DOUBLE) AS nb2,
                 SUM(a_val) AS total_a, SUM(b_val) AS total_b
          FROM sides GROUP BY pair_id)
, pa AS (SELECT user_id, lower(artist_name) AS akey, COUNT(*) AS plays FROM plays GROUP BY ALL)
, shared AS (SELECT x.pair_id, x.akey, x.plays AS a_plays, y.plays AS b_plays
             FROM (SELECT pr.pair_id, pa.akey, pa.plays FROM pairs pr JOIN pa ON pa.user_id = pr.user_a) x
             JOIN (SELECT pr.pair_id, pa.akey, pa.plays FROM pairs pr JOIN pa ON pa.user_id = pr.user_b) y
               ON x.pair_id = y.pair_id AND x.akey = y.akey)
, pu AS (SELECT pair_id, user_a AS user_id FROM pairs UNION SELECT pair_id, user_b FROM pairs)
, votes AS (SELECT pu.pair_id, lower(p.artist_name) AS akey, p.artist_name, COUNT(*) AS n
            FROM pu JOIN plays p ON p.user_id = pu.user_id GROUP BY ALL)
, disp AS (SELECT pair_id, akey, artist_name FROM (
      SELECT *, row_number() OVER (PARTITION BY pair_id, akey ORDER BY n DESC, artist_name) AS rn FROM votes) v
    WHERE rn = 1)
, tenths AS (SELECT s.pair_id, s.tag,
                    (2000 * CAST(a_val AS HUGEINT) + greatest(total_a, 1)) // (2 * greatest(total_a, 1)) AS a10,
                    (2000 * CAST(b_val AS HUGEINT) + greatest(total_b, 1)) // (2 * greatest(total_b, 1)) AS b10
             FROM sides s JOIN agg g ON g.pair_id = s.pair_id)
, pct AS (SELECT pair_id, tag, a10 / 10.0 AS a_pct, b10 / 10.0 AS b_pct, abs(a10 - b10) / 10.0 AS gap,
                 a10 + b10 AS s10, abs(a10 - b10) AS g10, a10, b10 FROM tenths)"""
