"""DuckDB counterparts of the manifest and the spelling variants, put together from parts."""

from __future__ import annotations


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's bytes, a bit at a time, lowest bit first."""
    digits = f"hex(encode({text}))"
    bit = f"((instr('0123456789ABCDEF', substr({digits}, CAST(2 * (i // 8) + 2 - (i % 8) // 4 AS BIGINT), 1)) - 1) >> CAST(i % 4 AS INTEGER)) & 1"
    bits = f"list_transform(range(4 * len({digits})), lambda i: CAST({bit} AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"


def lower_sql(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def leaf_sql(text: str) -> str:
    fields = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(fields)})"


def _tree(name: str, leaves: str) -> str:
    """name: the nodes of all levels; name_s: with the siblings on each side; name_w: each node's way to its root, as two lists."""
    run = "PARTITION BY grp, level, idx // 8 ORDER BY idx ROWS BETWEEN"
    return f"""{name} AS (
            SELECT * FROM {leaves} UNION ALL
            SELECT grp, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY grp, level, idx // 8, n
        ), {name}_s AS (
            SELECT grp, level, idx, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {name} WHERE n > 1
        ), {name}_w AS (
            SELECT grp, level, idx, CAST([] AS VARCHAR[]) AS lefts, CAST([] AS VARCHAR[]) AS rights FROM {name} WHERE n = 1 UNION ALL
            SELECT s.grp, s.level, s.idx, list_prepend(s.l, w.lefts), list_prepend(s.r, w.rights)
            FROM {name}_s s JOIN {name}_w w ON w.grp IS NOT DISTINCT FROM s.grp AND w.level = s.level + 1 AND w.idx = s.idx // 8
        )"""


MANIFEST = f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang AS grp, {leaf_sql("text")} AS leaf,
                   CASE WHEN coalesce({crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0, FALSE) THEN {leaf_sql(lower_sql("text"))} ELSE {leaf_sql("text")} END AS seen
            FROM documents
        ), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d
        ), low AS (SELECT grp, CAST(0 AS BIGINT) AS level, idx, leaf AS digest, n FROM k
        ), {_tree("t", "low")},
        top AS (SELECT CAST(0 AS BIGINT) AS grp, CAST(0 AS BIGINT) AS level, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS idx, digest, count(*) OVER () AS n, grp AS lang FROM t WHERE n = 1
        ), high AS (SELECT grp, level, idx, digest, n FROM top
        ), {_tree("u", "high")},
        a AS (
            SELECT k.doc_id, k.leaf, top.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, k.seen, list_concat(w.lefts, v.lefts) AS lefts, list_concat(w.rights, v.rights) AS rights
            FROM k JOIN t_w w ON w.grp IS NOT DISTINCT FROM k.grp AND w.level = 0 AND w.idx = k.idx JOIN top ON top.lang IS NOT DISTINCT FROM k.grp JOIN u_w v ON v.level = 0 AND v.idx = top.idx
        ), f AS (
            SELECT *, list_reduce(list_concat([seen], list_transform(range(len(lefts)), lambda i: lefts[i + 1] || '|' || rights[i + 1])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded FROM a)
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(range(len(lefts)), lambda i: lefts[i + 1] || rights[i + 1]), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f"""

VARIANTS = rf"""
        WITH RECURSIVE r AS (SELECT doc_id, {lower_sql("run")} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
        ), g AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run
        ), h AS (SELECT run, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM g
        ), w AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM h)
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ), x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
        ), p AS (
            SELECT a.word, b.word AS other, b.n AS n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word UNION
            SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.less = b.word UNION
            SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.less = b.word
        ), o AS (SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) AS nth, count(*) OVER (PARTITION BY word) AS near FROM p
        ), f AS (
            SELECT w.word, w.n, coalesce(o.near, 0) AS n_near, CASE WHEN o.n >= 2 * w.n THEN o.other END AS form, CASE WHEN o.n >= 2 * w.n THEN o.n END AS form_n
            FROM w LEFT JOIN o ON o.word = w.word AND o.nth = 1
        ), c AS (SELECT word, word AS here FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.here WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.here AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.here WHERE e.form IS NULL"""
