"""DuckDB SQL for the results of this subpackage's queries, where SQL can express them."""

#: The words of a text, A-Z in lower case.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP4 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
dl AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM dp),
dw AS (SELECT doc_id, n, i, array_to_string(l[1:n], ' ') AS s FROM dl, lens WHERE len(l) >= n),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""



def op5(phrases: dict[str, str], postings: list[tuple[str, str, int, bool]], least: float) -> str:
    listed = ", ".join(f"('{w}', '{label}', {at}, {str(key).lower()})" for w, label, at, key in postings)
    plain = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in phrases.items())
    return rf"""
WITH post(word, label, place, in_key) AS (VALUES {listed}),
plain(phrase, label, n) AS (VALUES {plain}),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
runs AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l FROM dw),
base AS (SELECT doc_id, pos, label FROM runs JOIN plain ON array_to_string(l[1:n], ' ') = phrase),
based AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM base GROUP BY doc_id),
al AS (SELECT doc_id, label, pos - place AS start, count(*) AS matched, count(*) FILTER (WHERE in_key) AS keys FROM dw JOIN post ON dw.word = post.word GROUP BY ALL),
tot AS (SELECT label, count(*) AS total, count(*) FILTER (WHERE in_key) AS needed FROM post GROUP BY label),
ver AS (SELECT doc_id, label, matched / total AS share FROM al JOIN tot USING (label) WHERE keys = needed AND matched / total >= {least}),
best AS (SELECT doc_id, max(share) AS share FROM ver GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY doc_id),
al2 AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM ver) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(bl.labels, '') AS base_labels, coalesce(al2.labels, '') AS labels,
  greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN based USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al2 USING (doc_id)
"""


OP2 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
f AS (SELECT doc_id, i, unnest(w) AS word, unnest(range(0, len(w))) AS j FROM s),
p AS (SELECT doc_id, i, word, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS pos FROM f),
c AS (SELECT doc_id, pos, md5(string_agg(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h,
  count(*) OVER (PARTITION BY doc_id) - pos AS n FROM p),
o AS (SELECT doc_id, pos, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos FROM c WHERE n >= 50 WINDOW w AS (PARTITION BY h ORDER BY doc_id, pos)),
gone AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN first_doc = doc_id THEN greatest(pos, first_pos + 50) ELSE pos END, pos + 50)) AS pos FROM o WHERE first_doc <> doc_id OR first_pos <> pos),
t AS (SELECT p.doc_id, i, count(*) AS n, count(g.pos) AS lost, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS rest FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY ALL),
k AS (SELECT s.doc_id, sum(coalesce(lost, 0)) AS n_deleted, sum(coalesce(n, 0)) AS n,
  string_agg(CASE WHEN coalesce(lost, 0) = 0 THEN line ELSE rest END, chr(10) ORDER BY s.i) FILTER (WHERE coalesce(lost, 0) = 0 OR lost < t.n) AS text
  FROM s LEFT JOIN t ON t.doc_id = s.doc_id AND t.i = s.i GROUP BY s.doc_id)
SELECT doc_id, CASE WHEN n_deleted > 0 AND n_deleted = n THEN '' ELSE k.text END AS text, coalesce(n_deleted, 0)::BIGINT AS n_deleted FROM documents LEFT JOIN k USING (doc_id)
"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS digest FROM sh GROUP BY doc_id),
cl AS (SELECT digest, n, min(doc_id) AS class_id FROM sets GROUP BY ALL),
cs AS (SELECT doc_id, s, n FROM sh JOIN cl ON class_id = doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM cs a JOIN cs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
ln AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
ends AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
reach AS (SELECT class_id AS c, class_id AS r FROM cl UNION SELECT c, b FROM reach JOIN ends ON r = a),
comp AS (SELECT c, min(r) AS component FROM reach GROUP BY c), deg AS (SELECT a, count(*) AS n_links FROM ends GROUP BY a)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links,
  coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN cl ON cl.digest = sets.digest LEFT JOIN comp ON c = class_id LEFT JOIN deg ON a = class_id
"""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('20:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM src),
dealt AS (
  SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2::DOUBLE AS cap,
    source_size * 2::DOUBLE / CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS full_at,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS whole
  FROM placed),
lev AS (
  SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
    / sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM dealt),
goals AS (
  SELECT source, source_size, least(cap, weight * coalesce(max(CASE WHEN level <= full_at THEN level END) OVER (), full_at)) AS target FROM lev),
cls AS (
  SELECT s.source, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS measure, CAST(sum(size) AS BIGINT) AS words, any_value(source_size) AS source_size, any_value(target) AS target
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source GROUP BY ALL),
lvl AS (
  SELECT *, (target - coalesce(CAST(sum(words) OVER (PARTITION BY source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) * 2::DOUBLE)
    / nullif(CAST(sum(words * measure) OVER (PARTITION BY source ORDER BY measure DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS one
  FROM cls),
lvl2 AS (SELECT *, max(CASE WHEN one * measure <= 2 THEN one END) OVER (PARTITION BY source) AS level FROM lvl),
cop AS (SELECT *, CASE WHEN measure > 0 THEN least(2::DOUBLE, coalesce(level * measure, 2::DOUBLE)) ELSE 0 END AS copies FROM lvl2),
drawn AS (
  SELECT source, measure, source_size, target, CAST(floor(copies) AS BIGINT) AS certain, copies - floor(copies) AS chance,
    target - CAST(sum(CAST(floor(copies) AS BIGINT) * words) OVER (PARTITION BY source) AS BIGINT) AS remaining
  FROM cop),
ranked AS (
  SELECT s.doc_id, s.source, s.size, d.measure, source_size, target, certain, remaining,
    CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds
  FROM sized s JOIN drawn d ON s.source IS NOT DISTINCT FROM d.source AND d.measure = CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END),
run AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY floor(odds / (1 + odds) * 1099511627776), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS reached
  FROM ranked)
SELECT doc_id, size, source_size, target, measure, source,
  certain + CASE WHEN odds IS NOT NULL AND 2 * reached + size <= 2 * remaining THEN 1 ELSE 0 END AS copies,
  size * (certain + CASE WHEN odds IS NOT NULL AND 2 * reached + size <= 2 * remaining THEN 1 ELSE 0 END) AS taken
FROM run
"""


def op11(k: int = 8, rounds: int = 10) -> str:
    """k-means over whole numbers, a table of centroids (c, i, v) and one of the vectors' clusters a round."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""far{r} AS MATERIALIZED (SELECT vec_id, c, sum((x - v) * (x - v)) AS d FROM x JOIN cent{r} USING (i) GROUP BY ALL),
own{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM far{r} GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""mean{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN own{r} USING (vec_id) GROUP BY ALL),
cent{r + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, v) AS v FROM cent{r} LEFT JOIN mean{r} USING (c, i))""")
    return f"""
WITH good AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: isfinite(y))) = 64),
x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(e, lambda y: floor(1024 * y::DOUBLE)::BIGINT)) AS x FROM good),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS c FROM good),
cent0 AS MATERIALIZED (SELECT c, i, x AS v FROM x JOIN first USING (vec_id) WHERE c < {k}),
{", ".join(parts)},
dig AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM cent{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM own{rounds} JOIN dig USING (c)
"""


#: The hash is a CRC over the bytes of `<doc_id>:<run>`, eight steps a byte. Near words share what is left of them without one code point at one
#: place, or are what is left of the other.
OP13 = r"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
b AS (SELECT run, n, flatten(list_transform(range(0, len(x) // 2), lambda j: [('0x' || substr(x, 2 * j + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS bytes FROM g),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, y: xor(xor(c, y) >> 1, 3988292384 * (xor(c, y) & 1))), 4294967295) AS h FROM b),
t AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
v AS MATERIALIZED (SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, w.word FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.rest = w.word),
best AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, min(CASE WHEN o.n >= 2 * m.n THEN (-o.n, b) END) AS x FROM p JOIN w m ON m.word = a JOIN w o ON o.word = b GROUP BY a),
f AS MATERIALIZED (SELECT word, x[2] AS form, -x[1] AS form_n FROM best WHERE x IS NOT NULL),
way AS (SELECT word, form AS root FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root),
ends AS (SELECT word, root FROM way WHERE root NOT IN (SELECT word FROM f))
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM w LEFT JOIN best USING (word) LEFT JOIN f USING (word) LEFT JOIN ends USING (word)
"""
