"""DuckDB SQL for the queries that SQL can express."""

#: parity of crc32 of a decimal number, bit by bit
EVEN_CRC = (
    "(1 + list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),"
    " lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) % 2 = 0"
)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, leaves: str) -> str:
    """CTEs over leaves (tree, pos, digest): {name}_node, {name}_run with the joined digests of every three nodes, {name}_top."""
    return f"""
    {name}_node(level, tree, pos, width, digest) AS (
        SELECT 0, tree, pos, count(*) OVER (PARTITION BY tree), digest FROM {leaves}
        UNION ALL
        SELECT level + 1, tree, pos // 3, (any_value(width) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name}_node WHERE width > 1 GROUP BY level, tree, pos // 3
    ),
    {name}_run AS (SELECT level, tree, pos // 3 AS pos, string_agg(digest, '' ORDER BY pos) AS run FROM {name}_node WHERE width > 1 GROUP BY level, tree, pos // 3),
    {name}_top AS (SELECT tree, level AS height, digest FROM {name}_node WHERE width = 1)"""


def _walk(name: str, start: str) -> str:
    """A CTE that takes rows (row, tree, pos, folded, proof) up the tree `name`."""
    return f"""
    {name}_walk(row, level, tree, pos, folded, proof) AS (
        SELECT row, 0, tree, pos, folded, proof FROM {start}
        UNION ALL
        SELECT w.row, w.level + 1, w.tree, w.pos // 3, sha256(substr(run, 1, 64 * (w.pos % 3)) || folded || substr(run, 64 * (w.pos % 3) + 65)), proof || substr(run, 1, 64 * (w.pos % 3)) || substr(run, 64 * (w.pos % 3) + 65)
        FROM {name}_walk w JOIN {name}_run r ON w.level = r.level AND w.tree = r.tree AND w.pos // 3 = r.pos
    )"""


MERKLE = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {_leaf("text")} AS digest,
        CASE WHEN {EVEN_CRC} THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS folded
    FROM documents
),
leaves AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id, digest) AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, '' AS proof FROM hashed),
{_levels("low", "leaves")},
subroots AS (SELECT 0 AS tree, tree AS pos, digest FROM low_top),
{_levels("high", "subroots")},
{_walk("low", "leaves")},
halfway AS (SELECT row, 0 AS tree, w.tree AS pos, folded, proof FROM low_walk w JOIN low_top t ON w.tree = t.tree AND w.level = t.height),
{_walk("high", "halfway")}
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.digest AS verified
FROM leaves l JOIN low_top s ON l.tree = s.tree CROSS JOIN high_top t JOIN high_walk w ON w.row = l.row AND w.level = t.height
"""

#: op12: N, L, df, the weights and scores of all pairs of an item and a document that share a term
RANKED = """
WITH terms AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found FROM documents
),
sizes AS (SELECT row, doc_id, len(found)::BIGINT AS n, found FROM terms WHERE len(found) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sizes),
counted AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(found) AS term FROM sizes) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted CROSS JOIN whole GROUP BY term, docs),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
),
scored AS (
    SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weights USING (term) CROSS JOIN whole GROUP BY item_id, row, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
