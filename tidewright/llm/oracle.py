"""SQL that says the same as a query, where SQL can: whole tables, for DuckDB."""

from __future__ import annotations

from tidewright.llm import divergence, trie
from tidewright.llm.secrets import RULES


def secret_scan() -> str:
    """Matches and the text between them alternate, so their lengths give every start."""

    def kind(i: int) -> str:
        rule = RULES[i]
        pattern = rule.pattern.replace("'", "''")
        return (
            f"SELECT r, {i} AS i, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, {rule.least} AS least, string_split_regex(t, '{pattern}') AS p, "
            f"regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g FROM d"
        )

    listed = "string_agg(concat(kind, ':', CAST(s AS VARCHAR), ':', CAST(e AS VARCHAR)), ',' ORDER BY s, i)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    k AS ({" UNION ALL ".join(kind(i) for i in range(len(RULES)))}),
    u AS (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM k),
    z AS (SELECT r, i, kind, base, length(m[j]) AS n, length(g[j]) >= least AS good,
          CAST(list_sum(list_transform(p[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM u),
    a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
          {listed} FILTER (base) AS b, {listed} AS spans FROM (SELECT *, s + n AS e FROM z WHERE good) GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a ON d.r = a.r"""


def repeated_substrings(window: int = 200) -> str:
    """All windows counted by their bytes; runs of covered bytes by gaps between repeated starts."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
    w AS (SELECT r, s, md5(x[s + 1 : s + {window}]) AS k FROM (SELECT r, x, unnest(range(octet_length(x) - {window - 1})) AS s FROM d)),
    h AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + {window}, true) AS fresh FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
    n AS (SELECT r, min(s) AS lo, max(s) + {window} AS hi FROM (SELECT r, s, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY s) AS run FROM h) GROUP BY r, run),
    q AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS last FROM n),
    a AS (SELECT q.r, CAST(sum(hi - lo) AS BIGINT) AS gone, count(*) AS spans, max(hi) AS tail, string_agg(hex(x[last + 1 : lo]), '' ORDER BY lo) AS kept
          FROM q JOIN d ON q.r = d.r GROUP BY q.r)
    SELECT doc_id, octet_length(x) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(concat(coalesce(kept, ''), hex(x[coalesce(tail, 0) + 1 :])))) AS kept_sha256 FROM d LEFT JOIN a ON d.r = a.r"""


def prefix_trie() -> str:
    """Prefixes by their whole texts; subtrees by the prefixes of each node's smallest member; CRC-32 bit by bit."""
    bits = ", -1" * 8
    crc = (
        f"xor(4294967295, list_reduce(flatten([[4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT){bits}]))]), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"
    )
    return f"""WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    i AS (SELECT c, {crc} % {trie.HEADS} AS h, c - ((c % {trie.GROUP}) + {trie.GROUP}) % {trie.GROUP} AS base FROM (SELECT DISTINCT c FROM o)),
    r AS (SELECT i.c, 0 AS own, pos, role, text FROM i JOIN o ON o.c = base AND pos <= h UNION ALL SELECT i.c, 1, pos, role, text FROM i JOIN o ON o.c = i.c AND pos > h),
    s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, concat(length(role), ':', role, length(text), ':', text) AS x, octet_length(encode(text)) AS b FROM r),
    p AS (SELECT c, d, b, string_agg(x, '') OVER (PARTITION BY c ORDER BY d) AS k FROM s UNION ALL SELECT c, 0, 0, '' FROM i),
    v AS (SELECT d, k, min(c) AS c, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = last), '')) AS ends
          FROM p JOIN (SELECT c, max(d) AS last FROM p GROUP BY c) USING (c) GROUP BY d, k),
    u AS (SELECT v.*, p.k AS up FROM v LEFT JOIN p ON p.c = v.c AND p.d = v.d - 1),
    m AS (SELECT u.*, w.c AS parent, (SELECT count(*) FROM u AS z WHERE z.d = u.d + 1 AND z.up = u.k) AS kids FROM u LEFT JOIN v AS w ON w.d = u.d - 1 AND w.k = u.up),
    t AS (SELECT p.d, p.k, sum((m.n - 1) * m.b) AS saved, count(*) FILTER (kids = 0) AS leaves FROM m JOIN p ON p.c = m.c AND p.d <= m.d GROUP BY ALL)
    SELECT m.c AS conv_id, m.d AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
    FROM m JOIN t ON m.d = t.d AND m.k = t.k"""


def source_divergence() -> str:
    """Every group with every kept term, and every two groups of a language side by side."""
    share = lambda n, total: f"1 + (CAST({divergence.SCALE} AS HUGEINT) * ({n} + {divergence.SMOOTH})) // ({total} + {divergence.SMOOTH} * v)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
    k AS (SELECT lang, term, sum(n) AS all_n FROM t GROUP BY ALL HAVING count(*) >= {divergence.MIN_DOCS}),
    l AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM k GROUP BY ALL),
    c AS (SELECT lang, source, term, sum(n) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
    g AS (SELECT e.lang, e.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) AS e LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "total")} AS p, {share("all_n", "all_total")} AS q
          FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
          UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
    z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
    SELECT * FROM z WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""
