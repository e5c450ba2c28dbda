"""Oracle SQL (DuckDB) for the saved-search queries.

The oracle does not parse: the expected parse of every search template is
written out by hand below, together with the predicate it stands for.
"""

from __future__ import annotations

from cadence import oracle as O

NY = "America/New_York"
TOKYO = "Asia/Tokyo"

# (artist, track, album, years, months, dates, days, parts, free, predicate, sort, direction)
SEARCH_ORACLE = [
    ("['act ' || CAST(user_id AS VARCHAR)]", "[]", "[]", "[]", "[]", "[]", "[]", "[3]", "[]",
     f"artist_name ILIKE '%act ' || CAST(user_id AS VARCHAR) || '%' AND {O.part('listened_at', NY)} = 3",
     "listened_at", "DESC"),
    ("[]", "[]", "[]", "[2024]", "[1]", "[]", "[]", "[]", "['view']",
     "year(listened_at) = 2024 AND month(listened_at) = 1"
     " AND (artist_name ILIKE '%view%' OR track_name ILIKE '%view%')"
     " AND listened_at >= TIMESTAMP '2024-01-08' AND listened_at < TIMESTAMP '2024-01-15'",
     "artist_name", "ASC"),
    ("[]", "[]", "[]", "[]", "[]", "[DATE '2024-01-15']", "[1]", "[]", "[]",
     f"{O.local_date('listened_at', NY)} = DATE '2024-01-15' AND {O.weekday('listened_at', NY)} = 1",
     "album_name", "DESC"),
    ("[]", "[]", "['album 1']", "[]", "[]", "[]", "[6]", "[]", "[]",
     f"album_name ILIKE '%album 1%' AND {O.weekday('listened_at', 'UTC')} = 6",
     "track_name", "ASC"),
    ("[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "['%']",
     "(artist_name ILIKE '%%%' OR track_name ILIKE '%%%')",
     "listened_at", "DESC"),
    ("[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "['month:13', 'year:abc', 'click']",
     "(artist_name ILIKE '%month:13%' OR track_name ILIKE '%month:13%')",
     "listened_at", "ASC"),
    ("['Rock''n''Roll']", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "['it''s']",
     "artist_name ILIKE '%Rock''n''Roll%' AND (artist_name ILIKE '%it''s%' OR track_name ILIKE '%it''s%')",
     "listened_at", "DESC"),
    ("[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "['date:2024-02-31']",
     "(artist_name ILIKE '%date:2024-02-31%' OR track_name ILIKE '%date:2024-02-31%')",
     "listened_at", "DESC"),
    ("[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "TRUE",
     "album_name", "ASC"),
    ("[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "['act_1']",
     "(artist_name ILIKE '%act_1%' OR track_name ILIKE '%act_1%')",
     "artist_name", "DESC"),
    ("[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "['vie']",
     "(artist_name ILIKE '%vie%' OR track_name ILIKE '%vie%')",
     "listened_at", "DESC"),
    ("[]", "[]", "[]", "[]", "[]", "[DATE '2024-01-16']", "[2]", "[0]", "[]",
     f"{O.local_date('listened_at', TOKYO)} = DATE '2024-01-16' AND "
     f"{O.weekday('listened_at', TOKYO)} = 2 AND {O.part('listened_at', TOKYO)} = 0",
     "listened_at", "ASC"),
    ("['ACT']", "[]", "[]", "[2024]", "[1]", "[]", "[]", "[]", "[]",
     "artist_name ILIKE '%ACT%' AND year(listened_at) = 2024 AND month(listened_at) = 1",
     "album_name", "DESC"),
    ("[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "['click']", "FALSE", "listened_at", "DESC"),
]


def parse_sql() -> str:
    parts = []
    for i, (ar, tr, al, ys, ms, ds, dys, ps, fr, *_rest) in enumerate(SEARCH_ORACLE):
        parts.append(f"""SELECT CAST(user_id AS VARCHAR) || '-{i}' AS search_id,
       CAST({ar} AS VARCHAR[]) AS artist, CAST({tr} AS VARCHAR[]) AS track, CAST({al} AS VARCHAR[]) AS album,
       CAST({ys} AS INTEGER[]) AS years, CAST({ms} AS INTEGER[]) AS months, CAST({ds} AS DATE[]) AS dates,
       CAST({dys} AS INTEGER[]) AS days, CAST({ps} AS INTEGER[]) AS parts, CAST({fr} AS VARCHAR[]) AS free
FROM (SELECT DISTINCT user_id FROM plays) u""")
    return O.with_bindings("\nUNION ALL\n".join(parts))


def _matches_body() -> str:
    parts = []
    for i, row in enumerate(SEARCH_ORACLE):
        pred, sort, direction = row[9], row[10], row[11]
        v = "strftime(listened_at, '%Y-%m-%d %H:%M:%S.%f')" if sort == "listened_at" else sort
        parts.append(f"""SELECT CAST(user_id AS VARCHAR) || '-{i}' AS search_id, artist_name, track_name, album_name,
       listened_at, {v} AS v, '{direction}' AS dir FROM plays WHERE {pred}""")
    return ", m AS (" + "\nUNION ALL\n".join(parts) + ")"


def matches_sql() -> str:
    return O.with_bindings(_matches_body() + """
SELECT search_id, artist_name, track_name, album_name, listened_at FROM m""")


def total_sql() -> str:
    return O.with_bindings(_matches_body() + f"""
, ids AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS search_id
          FROM (SELECT DISTINCT user_id FROM plays) u, range({len(SEARCH_ORACLE)}) t(i))
SELECT ids.search_id, CAST(COUNT(m.search_id) AS BIGINT) AS total
FROM ids LEFT JOIN m ON m.search_id = ids.search_id GROUP BY ids.search_id""")


def page_sql(limit: int, offset: int) -> str:
    return O.with_bindings(_matches_body() + f"""
, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY search_id ORDER BY
              CASE WHEN dir = 'ASC' THEN v IS NULL ELSE v IS NOT NULL END,
              CASE WHEN dir = 'ASC' THEN v END ASC, CASE WHEN dir = 'DESC' THEN v END DESC,
              listened_at DESC, track_name, artist_name) AS INTEGER) AS pos FROM m)
SELECT search_id, pos, artist_name, track_name, album_name, listened_at FROM r
WHERE pos > {offset} AND pos <= {offset + limit}""")


# Predicates of the searches over the long plays, written out by hand.
LONG_ORACLE = [
    "contains(lower(artist_name), 'brand#' || CAST(user_id % 25 + 1 AS VARCHAR)) AND year(listened_at) = 1996",
    "contains(lower(track_name), 'ring') AND month(listened_at) = 3",
    f"{O.local_date('listened_at', NY)} = DATE '1996-03-15'",
    "(artist_name ILIKE '%plate%' OR track_name ILIKE '%plate%') AND (artist_name ILIKE '%old%' OR track_name ILIKE '%old%')"
    " AND year(listened_at) IN (1995, 1997)",
    f"album_name ILIKE '%promo%' AND artist_name ILIKE '%#7%' AND {O.weekday('listened_at', NY)} = 0",
    "FALSE",
]


def long_total_sql() -> str:
    parts = [f"SELECT user_id, {i} AS i, COUNT(*) FILTER (WHERE {pred}) AS total FROM plays_long GROUP BY user_id"
             for i, pred in enumerate(LONG_ORACLE)]
    return O.with_bindings("SELECT CAST(user_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS search_id, CAST(total AS BIGINT) AS total FROM ("
                           + "\nUNION ALL\n".join(parts) + ")")
