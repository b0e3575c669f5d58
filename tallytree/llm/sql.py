"""SQL for DuckDB that gives the rows of the text queries, by plain definitions on whole tables."""

from __future__ import annotations

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

#: links(a, b) in both directions, over nodes(id): the smallest id that links reach.
_COMPONENTS = """
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

BAG_MINHASH = f"""
WITH RECURSIVE split AS (SELECT doc_id, {WORDS} AS w FROM documents),
runs AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS run
  FROM split),
bags AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
sizes AS (SELECT doc_id, sum(n) AS size FROM bags GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS both_have
  FROM bags a JOIN bags b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE both_have >= 0.8 * (x.size + y.size - both_have) - 1e-9),
nodes AS (SELECT DISTINCT doc_id AS id FROM documents), {_COMPONENTS}
SELECT doc_id, component_id, doc_id = component_id AS kept FROM documents JOIN least ON id = doc_id
"""

EMBEDDING_FOREST = f"""
WITH RECURSIVE doubles AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
usable AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM doubles),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS},
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.id = vec_id LEFT JOIN counts ON counts.id = vec_id
"""

PARETO_MIX = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight FROM sources),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS words FROM sources),
-- Sources fill up in order of how early they are full; the level is the first that fills no further one.
filling AS (
  SELECT *, coalesce(sum(2 * source_size) OVER earlier, 0) AS spent, sum(weight) OVER later AS open,
         row_number() OVER (ORDER BY 2 * source_size / weight, rank) AS place
  FROM weighed WINDOW earlier AS (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      later AS (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
levels AS (SELECT (words - spent::DOUBLE) / open::DOUBLE AS level, source_size, weight, place FROM filling, total),
level AS (SELECT arg_min(level, place) AS level FROM levels WHERE weight * level < 2 * source_size),
targets AS (
  SELECT source, source_size, rank,
         CASE WHEN level IS NULL OR weight * level >= 2 * source_size THEN 2 * source_size::DOUBLE ELSE weight * level END AS target
  FROM weighed, level),
placed AS (
  SELECT doc_id, size, source_size, rank, target, length(bin(size)) AS preference
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
classes AS (
  SELECT rank, target, preference, sum(size) AS words FROM placed WHERE size > 0 GROUP BY ALL),
steps AS (
  SELECT rank, preference, (target - (2 * coalesce(sum(words) OVER earlier, 0))::DOUBLE) / (sum(words * preference) OVER later)::DOUBLE AS factor
  FROM classes WINDOW earlier AS (PARTITION BY rank ORDER BY preference DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      later AS (PARTITION BY rank ORDER BY preference DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
factors AS (SELECT rank, arg_max(factor, preference) AS factor FROM steps WHERE factor * preference < 2 GROUP BY rank),
expected AS (
  SELECT p.*, greatest(least(2.0::DOUBLE, coalesce(factor * preference, 2.0::DOUBLE)), 0.0::DOUBLE) AS copies,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM placed p LEFT JOIN factors f ON f.rank = p.rank),
odds AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p FROM expected),
ratios AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS ratio FROM odds),
keys AS (SELECT *, floor(ratio / (1 + ratio) * 1099511627776::DOUBLE)::BIGINT AS key FROM ratios),
needs AS (SELECT rank, target - sum(size * whole) AS need FROM keys GROUP BY rank, target),
ties AS (SELECT rank, key, sum(size) AS words FROM keys WHERE key IS NOT NULL GROUP BY rank, key),
running AS (SELECT *, sum(words) OVER (PARTITION BY rank ORDER BY key) AS upto FROM ties),
-- Whole ties, in order of key; the tie that crosses the need is taken if that is nearer.
chosen AS (
  SELECT r.rank, r.key FROM running r JOIN needs n ON n.rank = r.rank
  WHERE upto < need OR (upto - words < need AND abs(words - (need - (upto - words))) <= abs(need - (upto - words))))
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN c.key IS NULL THEN 0 ELSE 1 END END * size)::BIGINT AS taken
FROM keys k LEFT JOIN chosen c ON c.rank = k.rank AND c.key = k.key
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC_INDEX = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
groups AS (SELECT h, max(page_id) AS last FROM hashed GROUP BY h),
letters AS (
  SELECT page_id, payload_bytes, last,
         list_transform(range(8), lambda k: ('0x' || substr(h, 5 * k + 1, 5))::INT) AS parts
  FROM hashed JOIN groups USING (h))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('{_LETTERS}', ((parts[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM letters
"""

LEVEL_DOUBLING = f"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT row, i, array_to_string(w[i:i + 34], ' ') AS run
  FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)),
twice AS (SELECT run FROM windows GROUP BY run HAVING count(*) > 1),
covered AS (
  SELECT row, list(DISTINCT place) AS places
  FROM (SELECT row, unnest(range(i, i + 35)) AS place FROM windows JOIN twice USING (run)) GROUP BY row),
kept AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
         array_to_string(CASE WHEN places IS NULL THEN w
           ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(places, j)), lambda j: w[j]) END, ' ') AS text
  FROM split LEFT JOIN covered USING (row))
SELECT doc_id, n_words, n_removed, sha256(text) AS kept_sha256, text FROM kept
"""


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII text: a step per byte, then eight shifts by the reversed polynomial."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)"
    return f"xor({fold}, 4294967295::BIGINT)"


def _framed(column: str) -> str:
    return f"coalesce(strlen(({column})::VARCHAR)::VARCHAR || ':' || ({column})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_PARENTS = "list_transform(range(0, (len(h) + 1) // 2), lambda j: sha256(h[2 * j + 1] || coalesce(h[2 * j + 2], '')))"

INTERVAL_LABELS = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS given
  FROM documents),
trees AS (SELECT lang, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) AS tree FROM (SELECT DISTINCT lang FROM leaves)),
ranked AS (
  SELECT row, doc_id, leaf, given, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
  FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang),
low(tree, level, h) AS (
  SELECT tree, 0, list(leaf ORDER BY rank) FROM ranked GROUP BY tree
  UNION ALL SELECT tree, level + 1, {_PARENTS} FROM low WHERE len(h) > 1),
subroots AS (SELECT tree, level AS height, h[1] AS subroot FROM low WHERE len(h) = 1),
high(level, h) AS (
  SELECT 0, list(subroot ORDER BY tree) FROM subroots
  UNION ALL SELECT level + 1, {_PARENTS} FROM high WHERE len(h) > 1),
steps AS (
  SELECT row, level, h[xor(rank >> level, 1::BIGINT) + 1] AS sibling, (rank >> level) & 1 = 1 AS before
  FROM ranked r JOIN low USING (tree) WHERE len(h) > 1
  UNION ALL
  SELECT row, height + level, h[xor((tree - 1) >> level, 1::BIGINT) + 1], ((tree - 1) >> level) & 1 = 1
  FROM ranked r JOIN subroots USING (tree), high WHERE len(h) > 1),
folds(row, level, node) AS (
  SELECT row, 0, given FROM ranked
  UNION ALL
  SELECT row, level + 1, sha256(CASE WHEN before THEN sibling || node ELSE node || coalesce(sibling, '') END)
  FROM folds JOIN steps USING (row, level)),
ends AS (SELECT row, arg_max(node, level) AS folded_root FROM folds GROUP BY row),
paths AS (SELECT row, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY row),
root AS (SELECT h[1] AS root FROM high WHERE len(h) = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ranked JOIN subroots USING (tree) JOIN ends USING (row) LEFT JOIN paths USING (row), root
"""


def _line(line: str, rest: str) -> str:
    return f"{line} || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END"


def _edit(cost: str, letter: str, line: str | None, to: int, v: str) -> str:
    rest = f"{v}[{to + 1}]"
    said = _line(line, f"{rest}.r") if line else f"{rest}.r"
    return f"{{'c': {cost} + {rest}.c, 's': '{letter}' || {rest}.s, 'r': {said}}}"


def _used_up(state: int) -> str:
    """The best (cost, letters, lines) from a state before a row, if nothing is inserted."""
    to, role = (3, "assistant") if state == 2 else (2, "user")
    kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    edits = [f"[{_edit('3', 'D', None, state, 'v')}]"]
    for initial, after in kept.items():
        edits.append(f"CASE WHEN NOT forced AND initial = '{initial}' THEN [{_edit('is_open', 'K', chr(39).join(['role || ', ':', ' || text']), after, 'v')}] ELSE [] END")
    edits.append(f"CASE WHEN NOT forced THEN [{_edit('2 + is_open', 'R', f"'{role}:' || text", to, 'v')}] ELSE [] END")
    return f"list_sort(flatten([{', '.join(edits)}]))[1]"


#: Backwards over the rows, a table of the cheapest rest per state: cost, letters, and the repaired lines.
PARALLEL_VITERBI = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
struck AS (SELECT *, {crc32("k")} % 20 AS kind FROM keyed),
given AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM struck WHERE kind <> 0),
talks AS (SELECT conv_id, row_number() OVER () AS talk FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT talk, turn, role, text, substr(role, 1, 1) AS initial, row_number() OVER (
    PARTITION BY talk ORDER BY turn NULLS FIRST, substr(role, 1, 1), md5(strlen(role)::VARCHAR || ':' || role || text)) AS i
  FROM given g JOIN talks t ON g.conv_id IS NOT DISTINCT FROM t.conv_id),
seen AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY talk, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unfinished,
         lag(initial) OVER (PARTITION BY talk ORDER BY i) || initial AS pair FROM placed),
rows AS (SELECT *, blank OR again AS forced, unfinished::INT AS is_open FROM seen),
faults AS (
  SELECT talk, sum(blank::INT) AS blank, sum((again AND NOT blank)::INT) AS duplicate, sum((unfinished AND NOT forced)::INT) AS truncated,
         sum((pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n
  FROM rows GROUP BY talk),
rest(talk, i, v) AS (
  SELECT talk, n, [{{'c': 0, 's': '', 'r': ''}}, {{'c': 4, 's': 'II', 'r': 'user:' || chr(10) || 'assistant:'}},
                   {{'c': 2, 's': 'I', 'r': 'assistant:'}}, {{'c': 0, 's': '', 'r': ''}}] FROM faults
  UNION ALL
  SELECT talk, i, [list_sort([b[1], {_edit("2", "I", "'user:'", 1, "w")}])[1], list_sort([b[2], {_edit("2", "I", "'user:'", 1, "w")}])[1], w[2], w[3]]
  FROM (
    SELECT talk, i, b, [b[1], list_sort([b[3], {_edit("2", "I", "'assistant:'", 3, "b")}])[1], list_sort([b[4], {_edit("2", "I", "'user:'", 2, "b")}])[1]] AS w
    FROM (
      SELECT talk, rest.i - 1 AS i, [{", ".join(_used_up(q) for q in range(4))}] AS b
      FROM rest JOIN rows USING (talk, i))))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost,
       coalesce(v[1].s, '') AS audit, sha256(coalesce(v[1].r, '')) AS repaired_sha256
FROM talks LEFT JOIN faults USING (talk) LEFT JOIN (SELECT talk, v FROM rest WHERE i = 0) USING (talk)
"""
