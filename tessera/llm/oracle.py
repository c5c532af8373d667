"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS t FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.t),
m AS (SELECT v, min(t) AS component_id FROM r GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m ON v = doc_id LEFT JOIN n USING (doc_id)
"""

OP8 = f"""
WITH l AS (SELECT doc_id, i, lines[i] AS line, len(lines) AS n, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
d AS (SELECT l.*, coalesce(first <> doc_id, false) AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, any_value(n) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""

OP10 = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM x) WHERE c > 1),
p AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
c AS (SELECT p.doc_id, p.i, word, max(CASE WHEN r.i IS NOT NULL THEN p.i END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a ON a.doc_id = documents.doc_id
"""

OP11 = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
"""

#: CRC-32 of the characters of s: bit by bit with the reversed polynomial.
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(s)), lambda i: CAST(ascii(substr(s, CAST(i AS INTEGER) + 1, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"


def _merkle() -> str:
    """Level by level: seven of documents (16^7 of a source), four of sources. A tree whose size is 1 at a level stays as it is from there."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    lower = f"CASE WHEN {CRC} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    docs, tops = 7, 4
    parts = [
        f"""d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, {leaf("text")} AS h, {leaf("low")} AS now
  FROM (SELECT *, {lower} AS low FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)))""",
        "a0 AS (SELECT s, i, n, h FROM d)",
    ]

    def climb(name: str, count: int) -> None:
        for k in range(count):
            parts.append(f"{name}r{k} AS MATERIALIZED (SELECT s, i // 16 AS i, any_value(n) AS n, list(h ORDER BY i) AS run FROM {name}{k} GROUP BY s, i // 16)")
            parts.append(f"{name}{k + 1} AS (SELECT s, i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {name}r{k})")

    climb("a", docs)
    parts.append(f"b0 AS (SELECT 0 AS s, s AS i, count(*) OVER () AS n, h FROM a{docs})")
    climb("b", tops)
    now, proof = "now", "''"
    joins, last = "", "d"
    for name, count, tree, index in (("a", docs, "d.s", "d.i"), ("b", tops, "0", "d.s")):
        for k in range(count):
            r, at = f"{name}r{k}", f"CAST({index} // {16**k} % 16 AS INTEGER)"
            joins += f" JOIN {r} ON {r}.s = {tree} AND {r}.i = {index} // {16 ** (k + 1)}"
            before, after = f"array_to_string(list_slice({r}.run, 1, {at}), '')", f"array_to_string(list_slice({r}.run, {at} + 2, 16), '')"
            parts.append(f"{name}p{k} AS MATERIALIZED (SELECT x.doc_id, x.s, x.i, CASE WHEN {r}.n = 1 THEN now ELSE sha256({before} || now || {after}) END AS now, proof || CASE WHEN {r}.n = 1 THEN '' ELSE {before} || {after} END AS proof FROM (SELECT * FROM {last}) x JOIN {r} ON {r}.s = {tree.replace('d.', 'x.')} AND {r}.i = {index.replace('d.', 'x.')} // {16 ** (k + 1)})".replace("CAST(d.", "CAST(x."))
            last = f"{name}p{k}"
    parts[0] += ", dp AS (SELECT doc_id, s, i, now, '' AS proof FROM d)"
    text = "WITH " + ",\n".join(parts).replace("(SELECT * FROM d)", "dp")
    return text + f"""
SELECT d.doc_id, d.h AS leaf, t.h AS subroot, b{tops}.h AS root, sha256(proof) AS proof_sha256, p.now AS folded_root, p.now = b{tops}.h AS verified
FROM d JOIN {last} p ON p.s = d.s AND p.i = d.i JOIN a{docs} t ON t.s = d.s CROSS JOIN b{tops}
"""


OP13 = _merkle()

ORACLE_SQL = {"op1_minhash": OP1, "op8_line_dedup": OP8, "op10_substring_dedup": OP10, "op11_exact_dedup": OP11, "op13_merkle": OP13}
