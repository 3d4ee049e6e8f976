"""SQL for the corpus queries that SQL can express, over the driver's tables.

The others rest on a tokenizer library, a trained model, hash fingerprints or an alignment; tests hold those against
brute-force versions, round trips or held-out examples.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD_CLASSES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM words),
sizes AS (SELECT d.doc_id, count(s.g) AS n FROM documents d LEFT JOIN shingles s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT p.a, p.b FROM shared p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.i >= 80 * (x.n + y.n - p.i)),
reach AS (SELECT doc_id, doc_id AS least FROM documents UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT s.doc_id, s.n AS n_shingles, min(r.least) AS component_id FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""

# crc32: the table of 256 steps, then one step for each byte of the column `v` of the relation `of`.
_CRC_TABLE = "steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) r(i))"


def _crc32(of: str) -> str:
    byte = "CAST('0x' || substr(hex(encode(v)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)"
    return (
        f"SELECT v, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(v))), lambda i: {byte})), "
        f"lambda a, b: xor(a // 256, (t[1 + (xor(a, b) & 255)])::BIGINT))) AS crc FROM (SELECT DISTINCT v FROM {of}), steps"
    )


RESAMPLED = rf"""
WITH {_CRC_TABLE},
words AS (
  SELECT 0 AS target, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
runs AS MATERIALIZED (
  SELECT target, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS v FROM words),
crcs AS MATERIALIZED ({_crc32('runs')}),
features AS MATERIALIZED (SELECT r.target, r.id, c.crc % 10000 AS bucket FROM runs r JOIN crcs c ON c.v = r.v),
totals AS (SELECT count(*) FILTER (target = 0) AS s_all, count(*) FILTER (target = 1) AS t_all FROM features),
counts AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM features GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts, totals),
weights AS (
  SELECT f.id, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM features f JOIN gains g ON g.bucket = f.bucket WHERE f.target = 0 GROUP BY f.id),
scored AS (
  SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w.w) AS n_words,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || w.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights x ON x.id = w.id WHERE w.target = 0),
eligible AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN e.rank <= 25 * e.n // 100 THEN e.rank END AS rank FROM scored s LEFT JOIN eligible e ON e.doc_id = s.doc_id
"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}, '-')"


_LEAF = " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars"))

MERKLE = rf"""
WITH RECURSIVE {_CRC_TABLE},
ids AS (SELECT doc_id::VARCHAR AS v FROM documents),
crcs AS MATERIALIZED ({_crc32('ids')}),
leaves AS MATERIALIZED (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, sha256({_LEAF} || {_field('text')}) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256({_LEAF} || {_field("replace(text, chr(10), '')")}) ELSE sha256({_LEAF} || {_field('text')}) END AS changed
  FROM documents JOIN crcs ON v = doc_id::VARCHAR),
groups AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
nodes AS (
  SELECT g, 0 AS level, pos, leaf AS h FROM leaves l JOIN groups s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT g, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM nodes) WHERE n > 1 GROUP BY g, level, pos // 3),
tops AS (SELECT g, max(level) AS top FROM nodes GROUP BY g),
subroots AS (SELECT n.g, n.h AS subroot FROM nodes n JOIN tops t ON n.g = t.g AND n.level = t.top),
upper_nodes AS (
  SELECT 0 AS level, g AS pos, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM upper_nodes) WHERE n > 1 GROUP BY level, pos // 3),
root AS (SELECT h AS root FROM upper_nodes WHERE level = (SELECT max(level) FROM upper_nodes)),
every_node AS MATERIALIZED (
  SELECT g, level, pos, h FROM nodes UNION ALL SELECT t.g, t.top + u.level, u.pos, u.h FROM tops t, upper_nodes u WHERE u.level > 0),
-- the run that a node of a level is in: of the group's tree below its subroot, of the upper tree from there
runs AS MATERIALIZED (
  SELECT g, level, pos // 3 AS parent, list(pos ORDER BY pos) AS at, list(h ORDER BY pos) AS hs FROM nodes WHERE (g, level) NOT IN (SELECT g, top FROM tops) GROUP BY g, level, pos // 3
  UNION ALL
  SELECT t.g, t.top + r.level, r.parent, r.at, r.hs FROM tops t, (SELECT level, pos // 3 AS parent, list(pos ORDER BY pos) AS at, list(h ORDER BY pos) AS hs FROM upper_nodes
    WHERE level < (SELECT max(level) FROM upper_nodes) GROUP BY level, pos // 3) r),
walk AS (
  SELECT doc_id, s.g, 0 AS level, CASE WHEN t.top = 0 THEN s.g ELSE pos END AS pos, changed AS h, '' AS siblings FROM leaves l JOIN groups s ON l.source IS NOT DISTINCT FROM s.source JOIN tops t ON t.g = s.g
  UNION ALL
  SELECT w.doc_id, w.g, w.level + 1, CASE WHEN w.level + 1 = t.top THEN w.g ELSE w.pos // 3 END,
    sha256(array_to_string(list_transform(r.hs, lambda x, i: CASE WHEN r.at[i] = w.pos THEN w.h ELSE x END), '')),
    w.siblings || array_to_string(list_filter(r.hs, lambda x, i: r.at[i] <> w.pos), '')
  FROM walk w JOIN tops t ON t.g = w.g JOIN runs r ON r.g = w.g AND r.level = w.level AND r.parent = w.pos // 3),
ended AS (SELECT doc_id, max_by(h, level) AS folded_root, max_by(siblings, level) AS siblings FROM walk GROUP BY doc_id)
SELECT l.doc_id, l.leaf, b.subroot, root.root, sha256(e.siblings) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM leaves l JOIN groups s ON l.source IS NOT DISTINCT FROM s.source JOIN subroots b ON b.g = s.g JOIN ended e ON e.doc_id = l.doc_id, root
"""
