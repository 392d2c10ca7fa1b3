"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sets(table: str, key: str, name: str) -> str:
    """(row id, key, distinct five-word shingles; fewer words are one shingle)."""
    words = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+')"
    return f"""{name}_words AS (SELECT row_number() OVER () AS r, {key}, {words} AS w FROM {table}),
{name} AS (SELECT r, {key}, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM {name}_words)"""


OP6 = f"""WITH RECURSIVE {_sets("documents", "doc_id", "d")},
one AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS x FROM d),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)), both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM d LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id"""

OP8 = f"""WITH {_sets("documents", "doc_id", "d")}, {_sets("benchmark", "item_id", "q")},
widths AS (SELECT DISTINCT len(w) AS k FROM q_words WHERE len(w) BETWEEN 1 AND 4), short AS (SELECT r, doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS x FROM d_words, widths WHERE len(w) >= k),
one AS (SELECT r, doc_id, unnest(s) AS x FROM d UNION SELECT r, doc_id, x FROM short), item AS (SELECT r AS i, item_id, len(s) AS n, unnest(s) AS x FROM q),
hits AS (SELECT one.r, item.i, item_id, n, count(*) AS c FROM one JOIN item USING (x) GROUP BY ALL HAVING 100 * count(*) >= 75 * n),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items, max(c) AS best FROM hits GROUP BY r)
SELECT doc_id, coalesce(n_items, 0) > 0 AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS item_ids, coalesce(best, 0) AS best_common FROM d LEFT JOIN found USING (r)"""

OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10), size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, kept.term, v, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, v, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM grid),
q AS (SELECT lang, term, 1 + 1000000000 * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * max(v)) AS q FROM p GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""



def _crc32(text: str) -> str:
    """The unsigned CRC-32 of ASCII text, by the table of its reflected polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    steps = f"list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, CAST({table} AS BIGINT[])[(xor(c, b) & 255) + 1]))"
    return f"xor({steps}, 4294967295)"


def _tree(name: str, levels: int) -> str:
    """CTEs over ``name``0 (tree, i, h, n): a table for each level above, runs of 16 as ``name``k_runs (tree, run, kids), and ``name``_top (tree, h)."""
    each = [f"{name}{k}_runs AS (SELECT tree, i // 16 AS run, n, list(h ORDER BY i) AS kids FROM {name}{k} WHERE n > 1 GROUP BY ALL), {name}{k + 1} AS (SELECT tree, run AS i, sha256(array_to_string(kids, '')) AS h, (n + 15) // 16 AS n FROM {name}{k}_runs)" for k in range(levels)]
    return ",\n".join(each) + f",\n{name}_top AS (" + " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")"


def _folded(before: str, name: str, levels: int, out: str, tree: str, at: str) -> str:
    """CTEs that add to ``before`` (proof, node, ...) the siblings of each level and fold the node with them."""
    found = []
    for k in range(levels):
        kids, j = f"x{k}.kids", f"({at} // {16**k}) % 16"
        left, right = f"array_to_string({kids}[1:{j}], '')", f"array_to_string({kids}[{j} + 2:], '')"
        found.append(f"{out}{k} AS (SELECT b.* REPLACE (CASE WHEN x{k}.tree IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN x{k}.tree IS NULL THEN node ELSE sha256({left} || node || {right}) END AS node) FROM {before} b LEFT JOIN {name}{k}_runs x{k} ON x{k}.tree = {tree} AND x{k}.run = {at} // {16 ** (k + 1)})")
        before = f"{out}{k}"
    return ",\n".join(found)


_FIELDS = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
OP13 = f"""WITH rows AS (SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({_FIELDS} || {_TEXT.format("text")}) AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({_FIELDS} || {_TEXT.format(_LOWER.format("text"))}) END AS changed FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows),
t0 AS (SELECT tree, i, leaf AS h, n FROM d), {_tree("t", 8)},
places AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS s, count(*) OVER () AS n FROM t_top),
u0 AS (SELECT '' AS tree, s AS i, subroot AS h, n FROM places), {_tree("u", 6)},
f AS (SELECT d.doc_id, d.tree, d.i, d.leaf, subroot, s, '' AS proof, coalesce(changed, leaf) AS node FROM d JOIN places USING (tree)),
{_folded("f", "t", 8, "g", "b.tree", "b.i")},
{_folded("g7", "u", 6, "k", "''", "b.s")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = h AS verified FROM k5, u_top"""

_BASE32 = "array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1)), '')"
OP11 = f"""WITH p AS (SELECT row_number() OVER () AS r, page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY page_id, r) AS k, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to, true AS intact FROM ranked"""

SQL = {"op6_minhash_dedup": OP6, "op8_decontamination": OP8, "op11_arc_conversion": OP11, "op12_source_divergence": OP12, "op13_merkle_manifest": OP13}
