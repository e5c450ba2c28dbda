"""DuckDB oracle SQL for the registered queries.

The binding views are written as CTEs over the driver's pre-registered
tables; each query body follows them.  Calendar buckets use
``ts AT TIME ZONE 'UTC' AT TIME ZONE tz``; exact half-up rounding of integer
ratios is written as integer arithmetic so both engines agree to the bit.
"""

from __future__ import annotations

BINDINGS = {
    "plays": """
SELECT event_id AS play_id,
       user_id % 15 AS user_id,
       CASE WHEN event_id % 7 = 0 THEN upper(act) ELSE act END AS artist_name,
       event_type AS track_name,
       CASE event_type WHEN 'signup' THEN NULL
                       WHEN 'error' THEN ''
                       ELSE 'Album ' || CAST(k % 3 AS VARCHAR) END AS album_name,
       ts AS listened_at
FROM (SELECT *, 'Act ' || CAST(k AS VARCHAR) AS act
      FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
            FROM events) e0) e1""",
    "plays_long": """
SELECT o_custkey AS user_id,
       CASE WHEN l_linenumber = 3 THEN lower(p_brand) ELSE p_brand END AS artist_name,
       p_name AS track_name,
       p_type AS album_name,
       o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS listened_at
FROM lineitem
JOIN orders ON o_orderkey = l_orderkey
JOIN part ON p_partkey = l_partkey""",
    "artist_tags": """
SELECT artist_name, tag, CAST(LEAST(100, 10 * COUNT(*)) AS INT) AS weight
FROM (SELECT 'Act ' || CAST(p_partkey % 120 AS VARCHAR) AS artist_name,
             CASE WHEN p_size % 3 = 0 THEN upper(p_name)
                  WHEN p_size % 3 = 1 THEN p_name || ' '
                  ELSE p_name END AS tag
      FROM part) t
GROUP BY artist_name, tag
UNION ALL
SELECT 'Silent ' || CAST(n_nationkey AS VARCHAR), '', 0 FROM nation""",
    "tag_blocklist": "SELECT * FROM (VALUES ('old rod'), ('small gear')) v(tag)",
    "tag_aliases": "SELECT * FROM (VALUES ('hot ring', 'warm ring'), ('cold ring', 'warm ring')) v(alias, canonical)",
    "tag_exclusions": "SELECT * FROM (VALUES ('red plate', 'blue ring'), ('hot bolt', 'warm ring')) v(context_tag, excluded_tag)",
    "track_durations": """
SELECT DISTINCT artist_name, track_name,
       CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE 180000 + 1000 * k END AS INT) AS duration_ms
FROM (SELECT *, CAST(substr(artist_name, 5) AS INT) AS k FROM plays) p
WHERE k % 7 <> 0""",
    "artist_top_tracks": """
SELECT DISTINCT a.artist_name,
       CASE WHEN a.k % 11 = 0 THEN '' ELSE t.track_name END AS track_name,
       CAST(CASE WHEN a.k % 11 = 0 THEN 0 ELSE t.rnk END AS INT) AS rank
FROM (SELECT DISTINCT artist_name, CAST(substr(artist_name, 5) AS INT) AS k
      FROM artist_tags WHERE tag <> '') a
CROSS JOIN (SELECT * FROM (VALUES ('view', 1), ('b-side', 2), ('click', 3),
                                  ('encore', 4), ('purchase', 5)) v(track_name, rnk)) t""",
    "artist_feedback": """
SELECT user_id, w.prefix || CAST(user_id + w.plus AS VARCHAR) AS artist_name, w.verdict,
       CASE WHEN w.verdict = 'seed' AND user_id % 3 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS expanded_at
FROM (SELECT DISTINCT user_id FROM plays) u
CROSS JOIN (VALUES ('ACT ', 100, 'block'), ('aCt ', 20, 'block'), ('Act ', 0, 'seed')) w(prefix, plus, verdict)""",
    "users": """
SELECT c_custkey AS user_id, m.last_synced_at
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_synced_at
                         FROM orders GROUP BY o_custkey) m ON m.o_custkey = c_custkey""",
    "feedback_events": """
SELECT user_id % 15 AS user_id,
       CASE WHEN event_id % 7 = 0 THEN upper(act) ELSE act END AS artist_name,
       CASE event_type WHEN 'click' THEN 'seed' WHEN 'error' THEN 'block' ELSE 'clear' END AS action,
       ts AS event_ts, event_id AS seq
FROM (SELECT *, 'Act ' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS VARCHAR) AS act
      FROM events) e
WHERE event_type IN ('click', 'error', 'view')""",
    "suggested_names": "SELECT DISTINCT 'act ' || CAST(p_partkey % 150 AS VARCHAR) AS name FROM part",
    # C1 clean tags over the B.4 rules, set by set: tags after renaming, minus the
    # forbidden ones, minus those that another tag of the artist rules out
    "tags_renamed": """
SELECT artist_name, weight, COALESCE(canonical, folded) AS tag
FROM (SELECT artist_name, weight, lower(trim(tag)) AS folded FROM artist_tags) LEFT JOIN tag_aliases ON alias = folded""",
    "tags_clean": """
WITH kept AS (SELECT * FROM tags_renamed ANTI JOIN tag_blocklist USING (tag) WHERE tag <> ''),
     ruled_out AS (SELECT artist_name, excluded_tag AS tag FROM kept JOIN tag_exclusions ON context_tag = tag)
SELECT artist_name, tag, MAX(weight) AS weight FROM kept ANTI JOIN ruled_out USING (artist_name, tag) GROUP BY ALL""",
    "primary_tag": """
SELECT artist_name, MIN(tag) AS tag
FROM tags_clean JOIN (SELECT artist_name, MAX(weight) AS weight FROM tags_clean GROUP BY ALL) heaviest
  USING (artist_name, weight)
GROUP BY ALL""",
}

_ORDER = ["plays", "plays_long", "artist_tags", "tag_blocklist", "tag_aliases",
          "tag_exclusions", "track_durations", "artist_top_tracks", "artist_feedback",
          "users", "feedback_events", "suggested_names", "tags_renamed", "tags_clean",
          "primary_tag"]


def with_bindings(body: str) -> str:
    """``WITH <all bindings>`` followed by ``body``; a body that starts with a
    comma continues the CTE list."""
    ctes = ",\n".join(f"{name} AS ({BINDINGS[name]})" for name in _ORDER)
    return f"WITH {ctes}\n{body.strip()}"


def local(col: str, tz: str) -> str:
    return f"(({col}) AT TIME ZONE 'UTC' AT TIME ZONE '{tz}')"


def local_date(col: str, tz: str) -> str:
    return f"CAST({local(col, tz)} AS DATE)"


def local_period(col: str, tz: str, period: str) -> str:
    unit = "week" if period == "week" else "month"
    return f"CAST(date_trunc('{unit}', {local(col, tz)}) AS DATE)"


def part(col: str, tz: str) -> str:
    return f"CAST(floor(hour({local(col, tz)}) / 6) AS INTEGER)"


def weekday(col: str, tz: str) -> str:
    return f"CAST(dayofweek({local(col, tz)}) AS INTEGER)"


def half_up(num: str, den: str, digits: int) -> str:
    """round(num/den, digits), half up, for non-negative integers, as DOUBLE."""
    scale = 10 ** digits
    return (f"(CAST((2 * {scale} * CAST({num} AS HUGEINT) + CAST({den} AS HUGEINT)) "
            f"// (2 * CAST({den} AS HUGEINT)) AS DOUBLE) / {scale})")
