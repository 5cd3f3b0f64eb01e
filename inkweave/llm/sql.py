"""SQL for those pN_ queries that SQL can express over whole tables."""

_TEXT = "a AS (SELECT id, any_value(abstract) AS t FROM abstracts WHERE id IS NOT NULL AND abstract IS NOT NULL GROUP BY id)"
_WORDS = r"w AS (SELECT id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM a)"
_SHINGLES = "g AS MATERIALIZED (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3)"
_NEAR = "z AS (SELECT id, count(*) AS n FROM g GROUP BY id), near AS MATERIALIZED (SELECT id_a, id_b FROM (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id) JOIN z a ON a.id = id_a JOIN z b ON b.id = id_b WHERE 2 * c >= a.n + b.n - c)"
_GRAMS = "k AS (SELECT id, unnest(range(1, 4)) AS n, w FROM w), t AS (SELECT id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS term FROM k WHERE len(w) >= n), c AS (SELECT n, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t GROUP BY n, term), m AS (SELECT count(*) AS total FROM w WHERE len(w) > 0), mk AS (SELECT n, term, occurrences, records, CASE WHEN occurrences < 4 THEN 'rare' WHEN 5 * records > total THEN 'common' END AS mark FROM c, m)"
_OVERLAP = """p AS (SELECT pair_id, any_value(split) AS split, any_value(u) AS u, any_value(v) AS v, any_value(source) AS source FROM pairs WHERE pair_id IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL GROUP BY pair_id),
l AS (SELECT id_a AS x, id_b AS y FROM near UNION ALL SELECT id_b, id_a FROM near UNION ALL SELECT DISTINCT q, q FROM (SELECT u AS q FROM p UNION ALL SELECT v FROM p)),
o AS (SELECT DISTINCT tr.pair_id AS train_id, ev.pair_id AS eval_id FROM p ev JOIN l a ON a.x = ev.u JOIN l b ON b.x = ev.v JOIN p tr ON tr.split = 'train' AND ((tr.u = a.y AND tr.v = b.y) OR (tr.u = b.y AND tr.v = a.y)) WHERE ev.split IN ('dev', 'test'))"""

_FIVES = """g AS MATERIALIZED (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) AS g FROM w WHERE len(w) >= 5),
z AS MATERIALIZED (SELECT id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM g GROUP BY id),
c AS MATERIALIZED (SELECT id, n, min(id) OVER (PARTITION BY k) AS rep FROM z),
gr AS (SELECT g.* FROM g JOIN c ON c.id = g.id AND c.rep = g.id),
near AS MATERIALIZED (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS m FROM gr x JOIN gr y ON x.g = y.g AND x.id <> y.id GROUP BY x.id, y.id) JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE 10 * m >= 8 * (za.n + zb.n - m)),
reach AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, near.b FROM reach r JOIN near ON near.a = r.y)"""


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


SQL: dict[str, str] = {
    "p1_found": """WITH e AS (SELECT id, any_value(h)::DOUBLE[] AS h FROM emb WHERE id IS NOT NULL AND h IS NOT NULL GROUP BY id), u AS (SELECT id, h, sqrt(list_dot_product(h, h)) AS n FROM e WHERE list_dot_product(h, h) > 0),
c AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.h, y.h) / (x.n * y.n) AS s FROM u x JOIN u y ON x.id <> y.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 6) DESC, b) AS r FROM c)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 5 AND s >= 0.9 - 1e-9""",
    "p2_found": """WITH x AS (SELECT DISTINCT id, unnest(authors) AS name FROM authors WHERE id IS NOT NULL), i AS (SELECT * FROM x WHERE name IS NOT NULL AND name <> ''), n AS (SELECT count(DISTINCT id) AS n FROM i), f AS (SELECT name, count(*) AS f FROM i GROUP BY name),
p AS (SELECT a.name AS s, b.name AS t, count(*) AS c FROM i a JOIN i b ON a.id = b.id AND a.name < b.name GROUP BY a.name, b.name HAVING count(*) >= 5)
SELECT least(k.author_idx, l.author_idx) AS author_idx_a, greatest(k.author_idx, l.author_idx) AS author_idx_b FROM p JOIN f fs ON fs.name = s JOIN f ft ON ft.name = t JOIN author_index k ON k.name = s JOIN author_index l ON l.name = t, n WHERE p.c * n.n >= 2 * fs.f * ft.f""",
    "p4_found": _with(_TEXT, _WORDS, _SHINGLES, _NEAR, _OVERLAP) + "SELECT DISTINCT least(train_id, eval_id) AS pair_id_a, greatest(train_id, eval_id) AS pair_id_b FROM o",
    "p4_report": _with(_TEXT, _WORDS, _SHINGLES, _NEAR, _OVERLAP) + "SELECT split, source, count(*) AS rows, count(h) AS overlapping, coalesce(sum(h), 0)::BIGINT AS pairs FROM (SELECT pair_id, any_value(split) AS split, any_value(source) AS source FROM pairs WHERE pair_id IS NOT NULL AND split IN ('dev', 'test') GROUP BY pair_id) q LEFT JOIN (SELECT eval_id, count(*) AS h FROM o GROUP BY eval_id) j ON j.eval_id = q.pair_id GROUP BY split, source",
    "p5_found": _with(_TEXT, _WORDS, _GRAMS) + "SELECT term, mark FROM mk WHERE n = 1 AND mark IS NOT NULL",
    "p5_ngrams": _with(_TEXT, _WORDS, _GRAMS) + "SELECT n::INT AS n, term, occurrences, records, mark FROM mk",
    "p5_vocabulary": _with(_TEXT, _WORDS, _GRAMS) + "SELECT lower(v.word) AS word, word_idx, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records, CASE WHEN occurrences IS NULL THEN 'rare' ELSE mark END AS mark FROM cora_vocab v LEFT JOIN (SELECT * FROM mk WHERE n = 1) q ON q.term = lower(v.word)",
    "p6_groups": _with(_TEXT, _WORDS, _FIVES).replace("WITH", "WITH RECURSIVE", 1)
    + "SELECT c.id, c.rep AS class_id, (SELECT min(y) FROM reach WHERE x = c.rep) AS group_id, (SELECT count(*) FROM near WHERE a = c.rep) AS links FROM c",
    "p6_found": _with(_TEXT, _WORDS, _SHINGLES, _NEAR) + "SELECT id_a, id_b FROM near",
}
