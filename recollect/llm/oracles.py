"""DuckDB SQL of the numbered queries that SQL can express.

Both take whole tables and texts; all pairs that share a shingle, and all strings of 200 bytes, are compared, so they are for small tables."""



def clusters(k: int, rounds: int, size: int, scale: int, salt: str) -> str:
    """Every vector against every centroid, round by round."""
    away = "list_inner_product(list_transform(list_zip(v, c), lambda z: (z[1] - z[2])::DOUBLE), list_transform(list_zip(v, c), lambda z: (z[1] - z[2])::DOUBLE))::BIGINT"
    steps = [
        f"""WITH kept AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT sha256('{salt}' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(ROW(d, cluster)) AS best FROM (SELECT id, vec_id, v, cluster, {away} AS d FROM kept, c{i}) GROUP BY id)")
        if i < rounds:
            steps.append(
                f"s{i} AS (SELECT cluster, list(m ORDER BY j) AS c FROM (SELECT cluster, j, (sum(x) - ((sum(x) % count(*) + count(*)) % count(*)))::HUGEINT // count(*) AS m FROM (SELECT best[2] AS cluster, unnest(range(1, {size + 1})) AS j, unnest(v) AS x FROM a{i}) GROUP BY cluster, j) GROUP BY cluster)"
            )
            steps.append(f"c{i + 1} AS (SELECT c{i}.cluster, coalesce(s{i}.c::BIGINT[], c{i}.c) AS c FROM c{i} LEFT JOIN s{i} ON s{i}.cluster = c{i}.cluster)")
    return ",\n".join(steps) + (
        f"\nSELECT vec_id, best[2]::INT AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 "
        f"FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = best[2]"
    )


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM words),
bodies AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT rep, n, unnest(s) AS gram FROM bodies),
pairs AS (SELECT x.rep AS a, y.rep AS b FROM grams x JOIN grams y ON x.gram = y.gram AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT rep, rep FROM bodies UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lows AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id AS doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id FROM sets LEFT JOIN bodies ON bodies.s = sets.s LEFT JOIN lows ON lows.rep = bodies.rep"""

SUFFIXES = r"""WITH hexes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM hexes),
strings AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM starts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM strings) WHERE n > 1),
firsts AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS first FROM again),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM firsts) GROUP BY doc_id, run),
gone AS (SELECT doc_id, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e, sum(e - s) AS removed, count(*) AS n FROM runs GROUP BY doc_id),
parts AS (SELECT hexes.doc_id AS doc_id, h, length(h) // 2 AS size, coalesce(removed, 0) AS removed, coalesce(n, 0) AS n, list_append(s, length(h) // 2) AS s, list_prepend(0, e) AS e FROM hexes LEFT JOIN gone ON gone.doc_id = hexes.doc_id)
SELECT doc_id, size::BIGINT AS n_bytes, removed::BIGINT AS n_removed, n::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n = 0 THEN h ELSE array_to_string(list_transform(range(1, n + 2), lambda j: substr(h, 2 * e[j] + 1, 2 * (s[j] - e[j]))), '') END)) AS kept_sha256 FROM parts"""

TRIE = r"""WITH RECURSIVE bits(i, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos, k, w FROM
  (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM turns),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS head, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(s) + 1), lambda j: ascii(substr(s, j, 1))::BIGINT)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]))) % 4 AS h FROM ids, crc),
parts AS (SELECT convs.conv_id, 0 AS own, pos, k, w FROM convs JOIN turns ON turns.conv_id = head AND pos <= h UNION ALL SELECT convs.conv_id, 1, pos, k, w FROM convs JOIN turns ON turns.conv_id = convs.conv_id AND pos > h),
rebuilt AS (SELECT conv_id, coalesce(ks, []) AS ks, coalesce(ws, []) AS ws FROM convs LEFT JOIN (SELECT conv_id, list(k ORDER BY own, pos) AS ks, list(w ORDER BY own, pos) AS ws FROM parts GROUP BY conv_id) USING (conv_id)),
begins AS (SELECT conv_id, len(ks) AS n, ks, ws, unnest(range(0, len(ks) + 1)) AS depth FROM rebuilt),
keyed AS (SELECT conv_id, depth, array_to_string(ks[1:depth], '') AS key, coalesce(ws[depth], 0) AS w, n = depth AS whole FROM begins),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends_sha256, substr(key, 1, 32 * (depth - 1)) AS up FROM keyed GROUP BY key, depth),
kids AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
tops AS (SELECT substr(key, 1, 32 * j) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN tops ON tops.key = c.key LEFT JOIN nodes p ON c.depth > 0 AND p.key = c.up"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS n, first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first FROM pages)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (j // 4) + 1, 5))::BIGINT >> (15 - 5 * (j % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to FROM p"""

SQL = {"op4_ngram_jaccard_join": JACCARD, "op7_suffix_array_dedup": SUFFIXES, "op11_conversation_trie": TRIE, "op12_warc": WARC, "op13_centroid_clustering": clusters(40, 5, 64, 256, "2:")}
