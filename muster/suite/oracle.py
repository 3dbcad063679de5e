"""What each registered query must return, as SQL over the same tables."""

from __future__ import annotations

from muster.functions.text import WHITESPACE

_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def _strip(text: str) -> str:
    return f"trim({text}, {_WS})"


def _with(*parts: str) -> str:
    """A WITH clause of the named inputs and everything they need, in order."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name not in needed:
            for other in _INPUTS[name][0]:
                add(other)
            needed.append(name)

    for part in parts:
        add(part)
    return "WITH " + ",\n".join(f"{name} AS ({_INPUTS[name][1]})" for name in needed) + "\n"


_STAMP_LATE = "2024-01-02T00:00:00Z"
_STAMP_EARLY = "2024-01-01T00:00:00Z"


def _name(stamp: str, query: str) -> str:
    return f"replace({stamp}, ':', '-') || '__q_' || substr(sha256({query}), 1, 12)"


_INPUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": (
        (),
        """
        SELECT source AS dataset_id, doc_id, pos - 1 AS pos, doc_id * 16777216 + pos - 1 AS ord, value
        FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS value,
                     generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""",
    ),
    "noisy": (
        ("lines",),
        """
        SELECT dataset_id, doc_id, pos, ord, CASE (doc_id + pos) % 5
            WHEN 0 THEN ' ' || value || chr(9)
            WHEN 1 THEN chr(160) || value
            WHEN 2 THEN chr(12288) || value || chr(133)
            WHEN 3 THEN CASE WHEN pos % 2 = 0 THEN '' ELSE '   ' || chr(160) END
            ELSE value END AS value
        FROM lines""",
    ),
    "kept": (
        ("noisy",),
        f"SELECT dataset_id, ord, {_strip('value')} AS id FROM noisy WHERE {_strip('value')} <> ''",
    ),
    "firsts": (("kept",), "SELECT dataset_id, id, min(ord) AS ord FROM kept GROUP BY dataset_id, id"),
    "later": (
        ("noisy",),
        f"""
        SELECT dataset_id, id, min(ord) AS ord FROM (
            SELECT dataset_id, ord, {_strip("CASE WHEN (doc_id + pos) % 50 = 9 THEN value || ' changed' ELSE value END")} AS id
            FROM noisy WHERE (doc_id + pos) % 50 <> 7)
        WHERE id <> '' GROUP BY dataset_id, id""",
    ),
    "versions": (
        ("firsts", "later"),
        """
        SELECT dataset_id, id, CASE WHEN f.ord IS NULL THEN 'added' WHEN l.ord IS NULL THEN 'removed' ELSE 'kept' END AS change
        FROM firsts f FULL JOIN later l USING (dataset_id, id)""",
    ),
    "damage": (
        ("firsts", "later"),
        """
        SELECT v.*, CASE WHEN commit_seq = 2 THEN ascii(right(dataset_id, 1)) % 5 ELSE 0 END AS kind, length(id) % 7 = 3 AS hit,
               CASE WHEN count(*) OVER (PARTITION BY commit_seq, dataset_id) <= 16 THEN 0
                    WHEN count(*) OVER (PARTITION BY commit_seq, dataset_id) <= 16 * 256 THEN 2
                    WHEN count(*) OVER (PARTITION BY commit_seq, dataset_id) <= 16 * 65536 THEN 4 ELSE 6 END AS width
        FROM (SELECT 1 AS commit_seq, dataset_id, id FROM firsts UNION ALL SELECT 2, dataset_id, id FROM later) v""",
    ),
    "departed": (
        ("damage",),
        """
        SELECT commit_seq, dataset_id, count(DISTINCT prefix) AS damaged_leaves, min(prefix) AS first_damaged_leaf FROM (
            SELECT commit_seq, dataset_id, substr(sha256(id), 1, width) AS prefix FROM damage
            WHERE kind = 1 OR kind IN (2, 3) AND hit
            UNION ALL SELECT commit_seq, dataset_id, substr(sha256(id || '~'), 1, width) FROM damage WHERE kind = 3 AND hit)
        GROUP BY 1, 2""",
    ),
    "sources": (("lines",), "SELECT DISTINCT dataset_id FROM lines"),
    "searches_pages": (
        (),
        "SELECT 'd' || (event_id % 10) AS dataset_id, count(*) AS reported_count FROM events GROUP BY 1",
    ),
    "whole": (
        ("searches_pages",),
        """
        SELECT dataset_id, page_start, ids, page_start + 100 >= reported_count AS is_last
        FROM (SELECT 'd' || (event_id % 10) AS dataset_id,
                     event_id // 10 - (event_id // 10) % 100 AS page_start,
                     list(CAST(user_id AS VARCHAR) ORDER BY event_id // 10) AS ids
              FROM events GROUP BY 1, 2) JOIN searches_pages USING (dataset_id)""",
    ),
    "searches_verdict": (
        ("searches_pages",),
        """
        SELECT dataset_id, reported_count FROM searches_pages
        UNION ALL SELECT 'unknown', NULL FROM (SELECT count(*) FROM events)
        UNION ALL SELECT 'negative', -count(*) FROM events""",
    ),
    "pages_sound": (
        ("whole",),
        """
        SELECT dataset_id, page_start, 0 AS attempt, ids, (page_start // 100) % 3 <> 1
               AND NOT (dataset_id = 'd7' AND page_start = 200) AS good FROM whole
        UNION ALL
        SELECT dataset_id, page_start, 1, ids, true FROM whole""",
    ),
    "won_sound": (
        ("pages_sound",),
        """
        SELECT dataset_id, page_start, ids FROM pages_sound WHERE good
        QUALIFY row_number() OVER (PARTITION BY dataset_id, page_start ORDER BY attempt) = 1""",
    ),
    "flat_sound": (
        ("won_sound",),
        """
        SELECT dataset_id, page_start + pos - 1 AS ord, id FROM (
            SELECT dataset_id, page_start, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM won_sound)""",
    ),
    "faulty": (
        ("whole",),
        """
        SELECT dataset_id, CASE WHEN dataset_id = 'd3' AND page_start = 300 THEN 250 ELSE page_start END AS page_start,
            CASE WHEN dataset_id = 'd1' AND page_start = 300 THEN CAST([] AS VARCHAR[])
                 WHEN dataset_id = 'd2' AND page_start = 400 THEN NULL
                 WHEN dataset_id = 'd3' AND page_start = 300
                     THEN list_concat(list_transform(range(50), lambda i: 'extra'), ids)
                 WHEN dataset_id = 'd5' AND is_last THEN list_concat(ids, list_transform(range(7), lambda i: 'extra'))
                 ELSE ids END AS ids,
            (page_start // 100) % 3 = 1 AS late,
            dataset_id = 'd6' AND page_start = 0 AS again,
            dataset_id = 'd7' AND page_start = 200 AS hollow,
            dataset_id = 'd8' AND page_start = 700 AS dead
        FROM whole
        WHERE NOT (dataset_id = 'd0' AND page_start = 200) AND NOT (dataset_id = 'd4' AND is_last)""",
    ),
    "pages_made": (
        ("faulty",),
        """
        SELECT dataset_id, page_start, 0 AS attempt,
               CASE WHEN dead OR late OR hollow THEN NULL ELSE ids END AS ids,
               CASE WHEN dead OR late THEN 'timeout' END AS error FROM faulty
        UNION ALL
        SELECT dataset_id, page_start, 1,
               CASE WHEN dead THEN NULL WHEN late OR hollow THEN ids ELSE ['other'] END,
               CASE WHEN dead THEN 'timeout' END FROM faulty WHERE dead OR late OR again OR hollow""",
    ),
    "won": (
        ("pages_made",),
        """
        SELECT dataset_id, page_start, ids FROM pages_made WHERE error IS NULL AND len(ids) > 0
        QUALIFY row_number() OVER (PARTITION BY dataset_id, page_start ORDER BY attempt) = 1""",
    ),
    "outcomes": (
        ("pages_made", "won"),
        """
        SELECT dataset_id, page_start, coalesce(len(w.ids), 0) AS page_len,
               CASE WHEN w.ids IS NULL THEN m.fault END AS fault
        FROM (SELECT dataset_id, page_start, CASE WHEN error IS NOT NULL THEN 'request_error'
                     WHEN ids IS NULL THEN 'missing_id_list' WHEN len(ids) = 0 THEN 'empty_page' END AS fault
              FROM pages_made
              QUALIFY row_number() OVER (PARTITION BY dataset_id, page_start ORDER BY attempt DESC) = 1) m
        LEFT JOIN won w USING (dataset_id, page_start)""",
    ),
    "grid": (
        ("outcomes",),
        """
        SELECT dataset_id, page_start, page_len, fault, page_start + page_len AS page_end,
               coalesce(lag(page_start + page_len) OVER (PARTITION BY dataset_id ORDER BY page_start), 0)
                   AS expected_start
        FROM outcomes WHERE fault IS NULL OR fault <> 'request_error'""",
    ),
    "log": (
        (),
        """
        SELECT CAST(user_id % 5 AS VARCHAR) AS dataset_id, event_id // 10 AS page_start, event_id % 10 AS attempt,
               value < 20 OR event_id % 10 < 2 AS failed
        FROM events""",
    ),
    "timed": (
        (),
        """
        SELECT CAST(user_id % 5 AS VARCHAR) AS dataset_id, event_id // 10 AS page_start, event_id % 10 AS attempt,
               value < 20 OR event_id % 10 < 2 AS failed,
               1704067200000 + (event_id // 10) * 100 + (event_id % 10) * (event_id % 10) * 400
                   + (event_id * 7919) % 1000 AS at_ms
        FROM events""",
    ),
    "commits": (
        (),
        f"""
        SELECT CAST(o_custkey AS VARCHAR) AS dataset_id, o_orderkey AS commit_seq,
               {_name("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')", "o_orderpriority")} AS snapshot
        FROM orders""",
    ),
    "snapshots": (
        ("commits",),
        """
        SELECT dataset_id, snapshot, max(commit_seq) AS commit_seq,
               max(commit_seq) % 3 <> 0 AND CAST(dataset_id AS BIGINT) % 10 < 7 AS update_latest,
               max(commit_seq) % 17 AS normalized_count
        FROM commits GROUP BY dataset_id, snapshot""",
    ),
    "manifests": (("snapshots",), "SELECT * FROM snapshots WHERE commit_seq % 11 <> 0"),
    "listing": (
        ("snapshots",),
        """
        SELECT dataset_id, snapshot, has_ids, has_manifest, has_ids AND has_manifest AS complete FROM (
            SELECT dataset_id, snapshot, commit_seq % 11 <> 0 AS has_manifest,
                   (commit_seq % 13 <> 0 AND normalized_count > 0)
                       OR (commit_seq % 11 <> 0 AND normalized_count = 0) AS has_ids
            FROM snapshots) WHERE has_ids OR has_manifest""",
    ),
    "pointers": (
        ("manifests",),
        """SELECT dataset_id, arg_max(snapshot, commit_seq) AS snapshot FROM manifests
           WHERE update_latest GROUP BY dataset_id""",
    ),
    # Here the pointer may name any commit, as in a store whose files were removed later.
    "any_pointers": (
        ("snapshots",),
        """SELECT dataset_id, arg_max(snapshot, commit_seq) AS snapshot FROM snapshots
           WHERE update_latest GROUP BY dataset_id""",
    ),
    "history": (
        ("snapshots",),
        """
        SELECT *, has_ids AND has_manifest AS complete FROM (
            SELECT *, (commit_seq % 13 <> 0 AND normalized_count > 0) OR (has_manifest AND normalized_count = 0) AS has_ids FROM (
                SELECT *, n % 5 <> 3 AS has_manifest FROM (
                    SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY commit_seq) AS n FROM snapshots)))""",
    ),
    "history_pointers": (
        ("history",),
        """SELECT dataset_id, arg_max(snapshot, n) AS snapshot, true AS pointed FROM history
           WHERE update_latest AND has_manifest GROUP BY dataset_id""",
    ),
    "requests": (
        (),
        """
        SELECT CAST(c_custkey AS VARCHAR) AS dataset_id,
               ['create_new', 'reuse_latest', 'reuse_latest_or_create', 'Reuse_Latest'][c_custkey % 4 + 1] AS mode,
               c_acctbal > 0 AS has_email FROM customer""",
    ),
    "state": (
        ("requests", "any_pointers", "listing"),
        """
        SELECT dataset_id, snapshot, p.snapshot IS NOT NULL AS has_latest,
               coalesce(l.has_manifest, false) AS has_manifest, coalesce(l.has_ids, false) AS has_ids
        FROM requests LEFT JOIN any_pointers p USING (dataset_id) LEFT JOIN listing l USING (dataset_id, snapshot)""",
    ),
    "searches": (
        (),
        f"""
        SELECT dataset_id, dataset_id || '[All Fields]' AS search_query, reported_count,
               '{_STAMP_LATE}' AS retrieved_at_utc, upper(dataset_id) AS translated_query,
               CAST(CASE WHEN reported_count % 2 = 0 THEN length(dataset_id) * 100 ELSE 1000 END AS INTEGER) AS page_size,
               CAST(CASE WHEN reported_count % 2 <> 0 THEN length(dataset_id) / 8 ELSE 0.34 END AS DOUBLE)
                   AS request_delay_seconds,
               CAST(CASE WHEN length(dataset_id) % 2 = 0 THEN length(dataset_id) ELSE 5 END AS INTEGER)
                   AS max_retry_attempts
        FROM (SELECT source AS dataset_id, count(*) AS reported_count FROM documents GROUP BY 1
              UNION ALL SELECT DISTINCT 'lang-' || lang, 0 FROM documents)""",
    ),
    "stored": (
        ("kept",),
        f"""
        SELECT dataset_id, {_name("'" + _STAMP_LATE + "'", "dataset_id || '[All Fields]'")} AS snapshot,
               min(ord) AS ord, id FROM kept GROUP BY dataset_id, id""",
    ),
    "stored_second": (
        ("noisy",),
        f"""
        SELECT dataset_id, {_name("'" + _STAMP_EARLY + "'", "dataset_id || '[All Fields]'")} AS snapshot,
               min(ord) AS ord, {_strip("'v2:' || value")} AS id FROM noisy GROUP BY 1, 2, 4""",
    ),
}


def _tree(rows: str, leaf_rows: int) -> str:
    """The tree digest of ``rows(dataset_id, id)``, for trees of at most two levels."""
    return f"""
    bag AS (SELECT dataset_id, id, count(*) AS copies, sha256(id) AS h FROM {rows} GROUP BY dataset_id, id),
    depths AS (SELECT dataset_id, CASE WHEN sum(copies) <= {leaf_rows} THEN 0
                   WHEN sum(copies) <= {leaf_rows} * 256 THEN 1 ELSE 2 END AS depth FROM bag GROUP BY dataset_id),
    leaves AS (SELECT dataset_id, depth, substr(h, 1, depth * 2) AS prefix,
                      sha256(string_agg(copies || ' ' || id, chr(10) ORDER BY id)) AS digest
               FROM bag JOIN depths USING (dataset_id) GROUP BY 1, 2, 3),
    middle AS (SELECT dataset_id, depth, prefix, digest FROM leaves WHERE depth < 2 UNION ALL
               SELECT dataset_id, 1, substr(prefix, 1, 2),
                      sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix))
               FROM leaves WHERE depth = 2 GROUP BY 1, 3),
    roots AS (SELECT dataset_id, digest FROM middle WHERE depth = 0 UNION ALL
              SELECT dataset_id, sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix))
              FROM middle WHERE depth = 1 GROUP BY 1)"""


def _digest(rows: str, order: str) -> str:
    return _with(rows, "sources") + f"""
    SELECT dataset_id, sha256(coalesce(text, '')) AS ids_sha256 FROM sources LEFT JOIN
        (SELECT dataset_id, string_agg(id, chr(10) ORDER BY {order}) AS text FROM {rows} GROUP BY 1) USING (dataset_id)"""


def _flags(dedup: bool, canonical_sort: bool, rows: str, order: str) -> str:
    return f"""SELECT {dedup} AS dedup, {canonical_sort} AS canonical_sort, dataset_id, id,
        row_number() OVER (PARTITION BY dataset_id ORDER BY {order}) AS position FROM {rows}"""


def oracle() -> dict[str, str]:
    reads = " UNION ALL ".join(
        f"""SELECT {strip} AS strip_lines, {skip} AS skip_empty_lines, dataset_id, count(*) AS n_lines,
            CAST(sum(length({value})) AS BIGINT) AS n_chars FROM noisy {f"WHERE {value} <> ''" if skip else ""}
            GROUP BY dataset_id"""
        for strip, value in ((True, _strip("value")), (False, "value"))
        for skip in (True, False)
    )
    counts = """SELECT dataset_id, count(*) AS raw_count,
        count(DISTINCT nullif({0}, '')) AS normalized_count FROM noisy GROUP BY dataset_id""".format(_strip("value"))
    empty_sha = "sha256('')"
    paths = "'/store/' || dataset_id || '/snapshots/' || snapshot"
    return {
        "normalize_lines": _with("kept") + "SELECT dataset_id, ord, id FROM kept",
        "reader_matrix": _with("noisy") + reads,
        "encoded_roundtrip": _with("lines") + """SELECT dataset_id, value,
            row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS position FROM lines""",
        "encoding_audit": _with("lines") + """SELECT dataset_id, count(*) AS n_lines,
            count(CASE WHEN length(value) <> strlen(value) THEN 1 END) AS n_invalid FROM lines GROUP BY dataset_id""",
        "normalize_policy_matrix": _with("firsts")
        + " UNION ALL ".join(
            (
                _flags(False, False, "kept", "ord"),
                _flags(False, True, "kept", "id, ord"),
                _flags(True, False, "firsts", "ord"),
                _flags(True, True, "firsts", "id"),
            )
        ),
        "stable_dedup": """SELECT event_type AS dataset_id, CAST(user_id AS VARCHAR) AS id, min(event_id) AS ord
            FROM events GROUP BY 1, 2""",
        "canonical_position": _with("firsts") + """SELECT dataset_id, id,
            row_number() OVER (PARTITION BY dataset_id ORDER BY id) AS position FROM firsts""",
        "counts_by_dataset": _with("noisy") + counts,
        "digest_canonical": _digest("firsts", "id"),
        "digest_stable": _digest("firsts", "ord"),
        "digest_as_is": _digest("kept", "ord"),
        "digest_sorted": _digest("kept", "id"),
        "digest_chained": """SELECT l_returnflag AS dataset_id,
                sha256(string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), chr(10) ORDER BY CAST(l_orderkey AS VARCHAR)))
                AS ids_sha256 FROM lineitem GROUP BY 1""",
        "digest_bucketed": _with("kept") + "," + _tree("kept", 16) + f"""
            SELECT dataset_id, digest AS ids_tree_sha256 FROM roots""",
        "file_digest": """
            SELECT source || '-' || (doc_id % 4) AS dataset_id, CAST(sum(strlen(text) + 1) AS BIGINT) AS length,
                   sha256(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS sha256,
                   sha256(string_agg(text, chr(10) ORDER BY doc_id)) AS ids_sha256 FROM documents GROUP BY 1""",
        "content_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "page_verdict": _with("grid", "searches_verdict") + """
            SELECT s.dataset_id, s.reported_count, coalesce(g.raw_count, 0) AS raw_count,
                   coalesce(g.n_pages, 0) AS n_pages,
                   CASE WHEN s.reported_count IS NULL OR s.reported_count < 0 THEN 'unknown_count'
                        WHEN bool_or(f.fault = 'missing_id_list') THEN 'missing_id_list'
                        WHEN bool_or(f.fault = 'empty_page') THEN 'empty_page'
                        WHEN bool_or(f.page_start > f.expected_start) THEN 'gap'
                        WHEN bool_or(f.page_start < f.expected_start) THEN 'overlap'
                        WHEN coalesce(max(f.page_end), 0) < s.reported_count THEN 'incomplete'
                        ELSE 'ok' END AS verdict
            FROM searches_verdict s
            LEFT JOIN (SELECT dataset_id, CAST(sum(page_len) AS BIGINT) AS raw_count,
                              count(CASE WHEN fault IS NULL THEN 1 END) AS n_pages
                       FROM grid GROUP BY dataset_id) g USING (dataset_id)
            LEFT JOIN grid f ON f.dataset_id = s.dataset_id AND f.page_start < s.reported_count
            GROUP BY s.dataset_id, s.reported_count, g.raw_count, g.n_pages""",
        "page_grid": _with("grid") + "SELECT dataset_id, page_start, page_len, fault, page_end, expected_start FROM grid",
        "landed_pages": _with("pages_made") + """SELECT dataset_id, page_start, CAST(attempt AS INTEGER) AS attempt,
            CAST(len(ids) AS INTEGER) AS n_ids, ids[-1] AS last_id, error FROM pages_made""",
        "flatten_pages": _with("flat_sound") + "SELECT dataset_id, ord, id FROM flat_sound",
        "landed_stream": _with("flat_sound") + "SELECT dataset_id, ord, id FROM flat_sound",
        "stream_verdicts": _with("grid", "searches_verdict") + """
            SELECT s.dataset_id, s.reported_count,
                   CASE WHEN s.reported_count IS NULL OR s.reported_count < 0 THEN 'unknown_count'
                        WHEN bool_or(f.fault = 'missing_id_list') THEN 'missing_id_list'
                        WHEN bool_or(f.fault = 'empty_page') THEN 'empty_page'
                        WHEN bool_or(f.page_start > f.expected_start) THEN 'gap'
                        WHEN bool_or(f.page_start < f.expected_start) THEN 'overlap'
                        WHEN coalesce(max(f.page_end), 0) < s.reported_count THEN 'incomplete'
                        ELSE 'ok' END AS verdict
            FROM searches_verdict s
            LEFT JOIN grid f ON f.dataset_id = s.dataset_id AND f.page_start < s.reported_count
            GROUP BY s.dataset_id, s.reported_count""",
        "landed_replay": _with("flat_sound") + "SELECT dataset_id, ord, id FROM flat_sound",
        "page_progress": _with("won_sound", "searches_pages") + """SELECT dataset_id, page_start,
            page_start + len(ids) AS extracted, least((page_start + len(ids)) / reported_count, 1.0) AS progress
            FROM won_sound JOIN searches_pages USING (dataset_id)""",
        "retry_outcome": _with("log") + """
            SELECT dataset_id, page_start, won AS winning_attempt, coalesce(won + 1, n) AS attempts_made,
                   CASE WHEN won IS NOT NULL THEN 'succeeded' WHEN n >= 3 THEN 'exhausted' ELSE 'pending' END AS outcome
            FROM (SELECT dataset_id, page_start, min(CASE WHEN NOT failed THEN attempt END) AS won, count(*) AS n
                  FROM log WHERE attempt < 3 GROUP BY 1, 2)""",
        "failed_datasets": _with("pages_made") + """
            SELECT dataset_id, page_start, CAST(1 AS BIGINT) AS attempts, last_error FROM (
                SELECT dataset_id, page_start, coalesce(error, CASE WHEN ids IS NULL THEN 'missing_id_list'
                           WHEN len(ids) = 0 THEN 'empty_page' END) AS last_error
                FROM pages_made WHERE attempt = 0)
            WHERE last_error IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY page_start) = 1""",
        "backoff_schedule": _with("log") + """SELECT dataset_id, page_start, attempt,
            pow(2, attempt) * 0.34 AS backoff_seconds FROM log WHERE failed AND attempt < 4""",
        "due_requests": _with("timed") + """, passed AS (
                SELECT t.*, w.upto, at_ms + 340 * CAST(pow(2, attempt) AS BIGINT) AS next_ms, lead(at_ms) OVER o AS following,
                       coalesce(bool_or(NOT failed OR attempt = 4) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended
                FROM timed t, (SELECT max(at_ms) - 10000 AS upto FROM timed) w WHERE attempt < 5 AND at_ms < w.upto
                WINDOW o AS (PARTITION BY dataset_id, page_start ORDER BY at_ms, attempt, failed))
            SELECT dataset_id, page_start, CASE WHEN attempt = 4 THEN 4 ELSE attempt + 1 END AS attempt,
                   CASE WHEN attempt = 4 THEN at_ms ELSE next_ms END AS due_ms,
                   CASE WHEN attempt = 4 THEN 'give_up' ELSE 'ask' END AS action
            FROM passed WHERE NOT ended AND failed AND
                (attempt = 4 OR (next_ms < upto AND (following IS NULL OR following > next_ms)))""",
        "utc_stamp": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS retrieved_at_utc FROM events",
        "snapshot_name": f"""SELECT p_partkey, substr(sha256(p_name), 1, 12) AS query_hash,
            {_name("'2024-05-06T07:08:' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') || 'Z'", "p_name")} AS snapshot
            FROM part""",
        "layout_paths": _with("snapshots") + f"""SELECT dataset_id, snapshot,
            {paths} || '/manifest.json' AS manifest_path, {paths} || '/ids.txt' AS ids_path,
            '/store/' || dataset_id || '/latest/manifest.json' AS latest_manifest_path,
            '/store/' || dataset_id || '/latest/ids.txt' AS latest_ids_path FROM snapshots""",
        "manifest_rows": _with("searches", "firsts", "noisy") + "," + _tree("firsts", 4096) + f""",
            counts AS ({counts}),
            flats AS (SELECT dataset_id, sha256(string_agg(id, chr(10) ORDER BY id)) AS sha FROM firsts GROUP BY 1)
            SELECT dataset_id, 'protein' AS database_name, search_query, translated_query, 'uid' AS identifier_type,
                   retrieved_at_utc, reported_count, coalesce(raw_count, 0) AS raw_count,
                   coalesce(normalized_count, 0) AS normalized_count, true AS dedup, true AS canonical_sort,
                   coalesce(sha, {empty_sha}) AS ids_sha256, coalesce(digest, {empty_sha}) AS ids_tree_sha256,
                   page_size, request_delay_seconds, max_retry_attempts, 'w' AS history_web_env, '1' AS history_query_key,
                   '1.0' AS snapshot_format_version, 'ids' AS snapshot_file_name,
                   'manifests' AS manifest_file_name, {_name("retrieved_at_utc", "search_query")} AS snapshot,
                   'ids/commit_seq=0/shard=mixed-0' AS snapshot_relative_path,
                   CAST(0 AS BIGINT) AS commit_seq, true AS update_latest
            FROM searches LEFT JOIN counts USING (dataset_id) LEFT JOIN flats USING (dataset_id)
            LEFT JOIN roots USING (dataset_id)""",
        "request_violations": f"""
            WITH args AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '  ' || chr(9)
                              WHEN c_custkey % 7 = 1 THEN NULL ELSE c_name END AS query FROM customer)
            SELECT k AS request_id, CASE WHEN k % 5 = 0 THEN 'email_required'
                   WHEN coalesce({_strip('query')}, '') = '' THEN 'blank_query'
                   WHEN k % 4 - 1 <= 0 THEN 'page_size_not_positive'
                   WHEN k % 3 <= 0 THEN 'max_attempts_not_positive' END AS violation,
                   CASE WHEN k % 2 = 1 THEN CAST(1.5 AS DOUBLE) WHEN k % 6 < 3 THEN CAST(0.34 AS DOUBLE)
                        ELSE CAST(0.1 AS DOUBLE) END AS request_delay_seconds FROM args""",
        "header_check": """SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_custkey % 4 AS reported_count,
            c_custkey % 4 > 0 AND (c_custkey % 3 < 2 OR c_custkey % 5 = 0) AS broken FROM customer""",
        "mode_check": _with("requests") + """SELECT mode, count(*) AS n_requests,
            bool_and(mode IN ('create_new', 'reuse_latest', 'reuse_latest_or_create')) AS valid
            FROM requests GROUP BY mode""",
        "snapshot_collisions": _with("commits") + """SELECT dataset_id, snapshot, count(*) AS n FROM commits
            GROUP BY 1, 2 HAVING count(*) > 1""",
        "latest_pointer": _with("pointers") + "SELECT dataset_id, snapshot FROM pointers",
        "most_recent_snapshot": _with("listing") + """SELECT dataset_id, max(snapshot) AS snapshot,
            max(CASE WHEN complete THEN snapshot END) AS snapshot_complete FROM listing GROUP BY 1""",
        "list_snapshots": _with("listing")
        + "SELECT dataset_id, snapshot, has_ids, has_manifest, complete FROM listing",
        "latest_available": _with("state") + """SELECT dataset_id, snapshot, has_latest, has_manifest, has_ids,
            has_latest AND has_manifest AND has_ids AS available FROM state""",
        "resolve_requests": _with("state") + """
            SELECT dataset_id, mode, has_email, outcome, CASE WHEN outcome = 'reuse' THEN snapshot END AS snapshot FROM (
                SELECT *, CASE
                    WHEN mode NOT IN ('create_new', 'reuse_latest', 'reuse_latest_or_create') THEN 'invalid_mode'
                    WHEN mode <> 'create_new' AND has_latest AND has_manifest AND has_ids THEN 'reuse'
                    WHEN mode = 'reuse_latest' AND NOT has_latest THEN 'no_latest'
                    WHEN mode = 'reuse_latest' AND NOT has_manifest THEN 'no_manifest'
                    WHEN mode = 'reuse_latest' THEN 'no_ids'
                    WHEN NOT has_email THEN 'email_required' ELSE 'create' END AS outcome
                FROM state JOIN requests USING (dataset_id))""",
        "catalog_increments": _with("history_pointers") + """
            SELECT dataset_id, snapshot, n AS commit_seq, has_ids, has_manifest, complete, coalesce(pointed, false) AS is_latest
            FROM history LEFT JOIN history_pointers USING (dataset_id, snapshot)""",
        "resolve_increments": _with("requests", "history_pointers") + """
            SELECT dataset_id, mode, has_email, outcome, CASE WHEN outcome = 'reuse' THEN snapshot END AS snapshot FROM (
                SELECT *, CASE
                    WHEN mode NOT IN ('create_new', 'reuse_latest', 'reuse_latest_or_create') THEN 'invalid_mode'
                    WHEN mode <> 'create_new' AND coalesce(complete, false) THEN 'reuse'
                    WHEN mode = 'reuse_latest' AND pointed IS NULL THEN 'no_latest'
                    WHEN mode = 'reuse_latest' THEN 'no_ids'
                    WHEN NOT has_email THEN 'email_required' ELSE 'create' END AS outcome
                FROM requests LEFT JOIN history_pointers USING (dataset_id) LEFT JOIN history USING (dataset_id, snapshot))""",
        "text_roundtrip": _with("firsts") + """SELECT dataset_id, id,
            row_number() OVER (PARTITION BY dataset_id ORDER BY id) AS position FROM firsts
            UNION ALL SELECT DISTINCT 'blank-' || source, NULL, 0 FROM documents""",
        "verbatim_roundtrip": _with("noisy") + """SELECT dataset_id, value,
            row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS position FROM noisy""",
        "json_roundtrip": _with("snapshots")
        + "SELECT dataset_id, snapshot, commit_seq, update_latest, normalized_count FROM snapshots",
        "json_documents": """SELECT c_custkey, c_name, c_acctbal,
            CAST(NULL AS VARCHAR) AS c_comment FROM customer""",
        "json_documents_indented": """SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name,
            CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(NULL AS VARCHAR) AS s_note FROM supplier""",
        "tree_snapshots": _with("lines") + f""", blocks AS (
                SELECT 'block-' || (doc_id // 100) AS dataset_id, ord, {_strip("value")} AS id FROM lines)
            SELECT dataset_id, id, row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS position,
                   dataset_id AS search_query, n AS reported_count
            FROM blocks JOIN (SELECT dataset_id, count(*) AS n FROM blocks GROUP BY 1) USING (dataset_id) WHERE id <> ''""",
        "json_field": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
            json_extract_string(props, '$.missing') AS missing FROM events""",
        "load_snapshot": _with("stored") + "SELECT dataset_id, snapshot, ord, id FROM stored",
        "load_latest": _with("stored_second") + "SELECT dataset_id, snapshot, ord, id FROM stored_second",
        "store_identifiers": _with("stored", "stored_second") + """SELECT dataset_id, snapshot, count(*) AS n,
            min(id) AS first_id FROM (SELECT * FROM stored UNION ALL SELECT * FROM stored_second) GROUP BY 1, 2""",
        "snapshot_paths": _with("stored_second", "searches", "noisy") + f"""
            SELECT dataset_id, {_name("'" + _STAMP_EARLY + "'", "search_query")} AS snapshot, coalesce(raw, 0) AS raw_count,
                   coalesce(n, 0) AS normalized_count, 'ids/commit_seq=2/shard=mixed-0' AS snapshot_directory,
                   'manifests/commit_seq=2' AS manifest_path, 'ids/commit_seq=2/shard=mixed-0' AS ids_path
            FROM searches LEFT JOIN (SELECT dataset_id, count(*) AS n FROM stored_second GROUP BY 1) USING (dataset_id)
            LEFT JOIN (SELECT dataset_id, count(*) AS raw FROM noisy GROUP BY 1) USING (dataset_id)""",
        "store_collisions": _with("searches") + f"""SELECT dataset_id,
            {_name("retrieved_at_utc", "search_query")} AS snapshot, CAST(1 AS BIGINT) AS n FROM searches
            WHERE reported_count % 2 = 0""",
        "snapshot_report": _with("stored", "searches") + f"""
            SELECT dataset_id, t.snapshot, 'ids/commit_seq=1/shard=mixed-0' AS snapshot_relative_path,
                   coalesce(n, 0) AS n_ids, retrieved_at_utc, search_query, translated_query,
                   coalesce(sha, {empty_sha}) AS ids_sha256
            FROM (SELECT *, {_name("retrieved_at_utc", "search_query")} AS snapshot FROM searches) t
            LEFT JOIN (SELECT dataset_id, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS sha
                       FROM stored GROUP BY 1) USING (dataset_id)""",
        "store_catalog": _with("stored", "stored_second", "searches") + f"""
            SELECT dataset_id, snapshot, commit_seq, true AS complete, commit_seq = 2 AS is_latest,
                   coalesce(n, 0) AS normalized_count
            FROM (SELECT dataset_id, CAST(1 AS BIGINT) AS commit_seq,
                         {_name("retrieved_at_utc", "search_query")} AS snapshot FROM searches
                  UNION ALL SELECT dataset_id, 2, {_name("'" + _STAMP_EARLY + "'", "search_query")} FROM searches)
            LEFT JOIN (SELECT dataset_id, snapshot, count(*) AS n FROM stored GROUP BY 1, 2
                       UNION ALL SELECT dataset_id, snapshot, count(*) FROM stored_second GROUP BY 1, 2)
                USING (dataset_id, snapshot)""",
        "snapshot_diff": _with("versions") + "SELECT dataset_id, id, change FROM versions WHERE change <> 'kept'",
        "snapshot_diff_counts": _with("versions", "searches") + """
            SELECT dataset_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
                   CAST(0 AS BIGINT) AS recounted, count(*) FILTER (change = 'kept') AS kept
            FROM searches LEFT JOIN versions USING (dataset_id) GROUP BY 1""",
        "verify_snapshots": _with("damage", "departed", "searches") + f""",
            names AS (
                SELECT dataset_id, 1 AS commit_seq, {_name("'" + _STAMP_EARLY + "'", "search_query")} AS snapshot FROM searches
                UNION ALL SELECT dataset_id, 2, {_name("'" + _STAMP_LATE + "'", "search_query")} FROM searches),
            held AS (
                SELECT commit_seq, dataset_id, count(*) AS n, count(*) FILTER (NOT (kind = 1 OR kind = 2 AND hit)) AS found,
                       count(*) FILTER (kind = 3 AND hit) AS altered
                FROM damage GROUP BY 1, 2),
            known AS (
                SELECT *, CASE WHEN commit_seq = 2 AND ascii(right(dataset_id, 1)) % 5 = 4 THEN 1 ELSE 0 END AS off
                FROM names LEFT JOIN held USING (commit_seq, dataset_id))
            SELECT dataset_id, snapshot, coalesce(n, 0) + off AS counted, coalesce(found, 0) AS found, damaged_leaves, first_damaged_leaf,
                   CASE WHEN off = 1 THEN 'miscounted' WHEN found = 0 THEN 'lost' WHEN found < n THEN 'fewer'
                        WHEN altered > 0 THEN 'altered' ELSE 'ok' END AS verdict
            FROM known LEFT JOIN departed USING (commit_seq, dataset_id)""",
        "activate_requests": _with("flat_sound") + f"""
            SELECT dataset_id, {_name("'" + _STAMP_EARLY + "'", "dataset_id")} AS snapshot, min(ord) AS ord, id
            FROM flat_sound GROUP BY dataset_id, id""",
        "activate_manifests": _with("flat_sound", "searches_pages") + f""",
            firsts AS (SELECT DISTINCT dataset_id, id FROM flat_sound),
            digests AS (SELECT dataset_id, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS sha
                        FROM firsts GROUP BY 1)
            SELECT dataset_id, {_name("'" + _STAMP_EARLY + "'", "dataset_id")} AS snapshot, dataset_id AS search_query,
                   reported_count, reported_count AS raw_count, n AS normalized_count,
                   CAST(CASE WHEN k % 2 = 0 THEN 50 + k ELSE 1000 END AS INTEGER) AS page_size,
                   CAST(CASE WHEN k % 3 = 0 THEN 2 + k ELSE 5 END AS INTEGER) AS max_retry_attempts,
                   CAST(CASE WHEN k < 3 THEN k / 2 WHEN k > 6 THEN 0.1 ELSE 0.34 END AS DOUBLE) AS request_delay_seconds,
                   sha AS ids_sha256
            FROM (SELECT *, CAST(substr(dataset_id, 2) AS INTEGER) AS k FROM searches_pages) JOIN digests USING (dataset_id)""",
    }
