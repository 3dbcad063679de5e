"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

from muster.llm.chat_format import CONTROL_PATTERN, END, START
from muster.llm.line_dedup import MIN_PAGES, RATIO
from muster.llm.mixing import UNIT

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), seen AS (
  SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS line
  FROM split
), counted AS (
  SELECT source, line, count(*) AS n FROM seen GROUP BY source, line
), totals AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), lists AS (
  SELECT c.source, list(c.line) AS lines
  FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {MIN_PAGES} AND c.n > t.pages * {RATIO}::DOUBLE GROUP BY c.source
), kept AS (
  SELECT s.doc_id, s.lines, CASE WHEN l.lines IS NULL THEN s.lines
    ELSE list_filter(s.lines, lambda x: trim(x) = '' OR NOT list_contains(l.lines, trim(x))) END AS kept
  FROM split s LEFT JOIN lists l ON s.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, CASE WHEN lines IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped
FROM kept
"""

_SIZES = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"

TARGETS = """
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::BIGINT AS w
  FROM sized GROUP BY source
), steps AS (
  SELECT *, coalesce(sum(source_size) OVER earlier, 0)::BIGINT AS before_size,
    (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0))::BIGINT AS left_weight,
    (sum(source_size) OVER ())::BIGINT AS total
  FROM ranked
  WINDOW earlier AS (ORDER BY source_size::DOUBLE / w, source IS NULL, encode(source)
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max((total - 3 * before_size) / left_weight::DOUBLE) AS share
  FROM steps WHERE w * ((total - 3 * before_size) / left_weight::DOUBLE) <= 3 * source_size
), targets AS (
  SELECT source, source_size,
    CASE WHEN share IS NULL OR w * share > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE w * share END AS target
  FROM ranked, level
)"""

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, {_SIZES} AS size FROM documents
), {TARGETS}, expected AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * {UNIT}.0::DOUBLE)::BIGINT ELSE 0 END AS e,
    (('0x' || substr(md5('0:' || coalesce('s' || d.source, 'null')), 1, 12))::BIGINT % {UNIT})::HUGEINT AS shift
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), summed AS (
  SELECT *, sum(e) OVER (PARTITION BY source ORDER BY size, doc_id ROWS UNBOUNDED PRECEDING) + shift AS upto FROM expected
)
SELECT doc_id, size, source_size, target, ((upto // {UNIT} - (upto - e) // {UNIT}) * size)::BIGINT AS taken FROM summed
"""

_BYTE = "CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"


def _crc32(number: str) -> str:
    """The unsigned crc32 of a decimal number, eight bits a character."""
    characters = f"list_transform(string_split(({number})::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    eight = f"list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: {_BYTE})"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {characters}), lambda a, b: {eight}))"


def _leaf(*columns: str) -> str:
    parts = (f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR END" for c in columns)
    return f"sha256({' || '.join(parts)})"


def _merkle_levels(name: str, leaves: str, levels: int) -> str:
    """CTEs ``<name>0`` to ``<name><levels>``: the nodes of each level; a finished tree stays as it is."""
    steps = [f"{name}0 AS ({leaves})"]
    for level in range(levels):
        steps.append(
            f"{name}r{level} AS (SELECT tree, idx // 8 AS run, list(digest ORDER BY idx) AS kids, any_value(n) AS n"
            f" FROM {name}{level} GROUP BY tree, idx // 8)"
        )
        steps.append(
            f"{name}{level + 1} AS (SELECT tree, run AS idx, (n + 7) // 8 AS n,"
            f" CASE WHEN n = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS digest FROM {name}r{level})"
        )
    return ", ".join(steps)


def _merkle_climb(name: str, start: str, levels: int) -> str:
    """CTEs ``<start>`` to ``<name>c<levels>``: the node of each row, its folded form and its proof, level by level."""
    steps, before = [], start
    for level in range(levels):
        left = "coalesce(array_to_string(r.kids[1:(c.idx % 8)::INT], ''), '')"
        right = "coalesce(array_to_string(r.kids[(c.idx % 8 + 2)::INT:], ''), '')"
        steps.append(
            f"{name}c{level + 1} AS (SELECT c.* REPLACE (c.idx // 8 AS idx,"
            f" CASE WHEN r.n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded,"
            f" CASE WHEN r.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof)"
            f" FROM {before} c JOIN {name}r{level} r ON r.tree = c.tree AND r.run = c.idx // 8)"
        )
        before = f"{name}c{level + 1}"
    return ", ".join(steps)


_LEVELS, _TOPS = 7, 3  # up to 8^7 leaves a group, and 8^3 groups
_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""
WITH hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS digest,
    CASE WHEN {_crc32("coalesce(doc_id, 0)")} % 3 = 0 AND doc_id IS NOT NULL
      THEN {_leaf("doc_id", "source", "lang", "n_chars", _TEXT)} END AS changed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
    count(*) OVER (PARTITION BY tree) AS n FROM hashed
), {_merkle_levels("t", "SELECT tree, idx, n, digest FROM leaves", _LEVELS)},
{_merkle_levels("s", f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, digest FROM t{_LEVELS}", _TOPS)},
start AS (
  SELECT doc_id, digest AS leaf, tree, idx, coalesce(changed, digest) AS folded, '' AS proof FROM leaves
), {_merkle_climb("t", "start", _LEVELS)},
upper AS (
  SELECT c.* REPLACE ('' AS tree, s.idx AS idx), t.digest AS subroot FROM tc{_LEVELS} c
  JOIN t{_LEVELS} t ON t.tree = c.tree
  JOIN (SELECT tree AS name, row_number() OVER (ORDER BY tree) - 1 AS idx FROM t{_LEVELS}) s ON s.name = c.tree
), {_merkle_climb("s", "upper", _TOPS)}
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM sc{_TOPS}, (SELECT digest FROM s{_TOPS}) r
"""

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos, k, words FROM (
    SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS k,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT DISTINCT conv_id, {_crc32("conv_id")} % 4 AS h FROM turns
), rebuilt AS (
  SELECT c.conv_id, 0 AS piece, t.pos, t.k, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.k, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY piece, pos) AS depth, k, words FROM rebuilt
), whole AS (
  SELECT c.conv_id, coalesce(list(k ORDER BY depth) FILTER (k IS NOT NULL), []) AS ks,
    coalesce(list(words ORDER BY depth) FILTER (k IS NOT NULL), []) AS ws
  FROM convs c LEFT JOIN placed p USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id AS member, unnest(range(len(ks) + 1)) AS depth, ks, ws FROM whole
), nodes AS (
  SELECT depth, ks[1:depth] AS prefix, min(member) AS conv_id, count(*) AS n_convs, any_value(ws[depth]) AS words,
    string_agg(CASE WHEN len(ks) = depth THEN member::VARCHAR END, ',' ORDER BY member) AS ends
  FROM prefixes GROUP BY depth, ks[1:depth]
), linked AS (
  SELECT c.*, p.conv_id AS parent_conv_id FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1]
), counted AS (
  SELECT l.*, (SELECT count(*) FROM linked c WHERE c.depth = l.depth + 1 AND c.parent_conv_id = l.conv_id) AS n_children FROM linked l
), below AS (
  SELECT a.depth, a.conv_id, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * coalesce(x.words, 0)) AS saved
  FROM counted a JOIN counted x ON x.depth >= a.depth AND x.prefix[1:a.depth] = a.prefix GROUP BY a.depth, a.conv_id
)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN below b USING (depth, conv_id)
"""

_ESCAPED = f"regexp_replace(%s, '{CONTROL_PATTERN}', '\\1\\\\\\2\\3', 'g')"
_HEAD = f"{_ESCAPED % 'role'}"

CHAT_FORMAT = f"""
WITH turns AS (
  SELECT coalesce('=' || conv_id, '') AS key, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT '=-1', -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT '=-1', -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS pos,
    len('{START}') + len(replace(replace({_HEAD}, '\\', '\\\\'), chr(10), '\\n')) + 1 + len({_ESCAPED % "text"}) + len('{END}') + 1 AS size
  FROM turns
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY key ORDER BY pos) AS upto, pos = max(pos) OVER (PARTITION BY key) AS at_end FROM placed
)
SELECT any_value(conv_id) AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR at_end)::BIGINT AS formatted_chars
FROM summed GROUP BY key
"""

ORACLE: dict[str, str] = {
    "op3_mixing": MIXING,
    "op7_line_dedup": LINE_DEDUP,
    "op11_merkle": MERKLE,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_chat_format": CHAT_FORMAT,
}
