"""DuckDB SQL of the queries whose text is long enough to be put together from parts."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit: 3988292384 is the reflected polynomial."""
    bits = f"flatten(list_transform(str_split({text}, ''), lambda ch: list_transform(range(8), lambda i: ((ascii(ch) >> i::INT) & 1)::BIGINT)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def _tree(first: str, keys: str, doc: str, tag: str, levels: int) -> tuple[list[str], str, str]:
    """CTEs that climb ``first``(keys, i, h) by runs of eight, and lead ``doc``(keys, i, cur, sib) up with them; (CTEs, top level, last doc)."""
    out = []
    for k in range(levels):
        at = first if k == 0 else f"{tag}{k}"
        run = f"PARTITION BY {keys}, i // 8 ORDER BY i"
        out.append(f"""{tag}s{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {keys}) AS c,
            coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {at})""")
        out.append(f"""{tag}{k + 1} AS MATERIALIZED (SELECT {keys}, i // 8 AS i, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
            FROM {tag}s{k} GROUP BY {keys}, i // 8)""")
        before = doc if k == 0 else f"{tag}d{k}"
        out.append(f"""{tag}d{k + 1} AS MATERIALIZED (SELECT d.* EXCLUDE (i, cur, sib), d.i // 8 AS i, CASE WHEN c = 1 THEN cur ELSE sha256(l || cur || r) END AS cur, sib || l || r AS sib
            FROM {before} d JOIN {tag}s{k} s ON d.i = s.i AND {' AND '.join(f'd.{x} IS NOT DISTINCT FROM s.{x}' for x in keys.split(', '))})""")
    return out, f"{tag}{levels}", f"{tag}d{levels}"


def merkle(levels: int = 7, top: int = 4) -> str:
    def leaf(text: str) -> str:
        f = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
        return f"sha256({' || '.join(f(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    within, tops, doc = _tree("leaves", "g", "docs", "a", levels)
    among, roots, last = _tree("subroots", "one", "up", "b", top)
    return f"""WITH base AS MATERIALIZED (SELECT doc_id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, {leaf('text')} AS h,
          CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(low)} END AS now FROM documents),
        leaves AS (SELECT g, i, h FROM base), docs AS (SELECT doc_id, h AS leaf, g, i, coalesce(now, h) AS cur, '' AS sib FROM base),
        {', '.join(within)},
        subroots AS MATERIALIZED (SELECT 1 AS one, g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h FROM {tops}),
        up AS MATERIALIZED (SELECT d.doc_id, d.leaf, s.h AS subroot, 1 AS one, s.i, d.cur, d.sib FROM {doc} d JOIN subroots s ON d.g IS NOT DISTINCT FROM s.g),
        {', '.join(among)}
        SELECT doc_id, leaf, subroot, (SELECT any_value(h) FROM {roots}) AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = (SELECT any_value(h) FROM {roots}) AS verified FROM {last}"""


def prefix_trie() -> str:
    return f"""WITH t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
        c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32('conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
          UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
        s AS MATERIALIZED (SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY part, pos) AS seq, list(length(text) ORDER BY part, pos) AS chars FROM r GROUP BY conv_id),
        a AS (SELECT c.conv_id, coalesce(seq, []) AS seq, coalesce(chars, []) AS chars FROM c LEFT JOIN s ON c.conv_id = s.conv_id),
        p AS (SELECT conv_id, seq[1:d] AS key, d AS depth, len(seq) AS size, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM a)),
        n AS MATERIALIZED (SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM p GROUP BY key),
        k AS MATERIALIZED (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
        w AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.key = k.key),
        u AS (SELECT key[1:d] AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM w) GROUP BY ALL)
        SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, w.ends_sha256
        FROM w JOIN u ON w.key = u.key LEFT JOIN w q ON w.depth > 0 AND q.key = w.key[1:w.depth - 1]"""
