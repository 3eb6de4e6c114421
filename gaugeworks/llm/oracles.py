"""DuckDB SQL for the registered queries of this subpackage that SQL can express."""

from gaugeworks.llm import mixing

COUNT = r"len(regexp_extract_all(coalesce(text, ''), '{}'))".format
WORDS = COUNT(r"[^\x20\x09-\x0D]+")
RUNS = COUNT(r"[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]")
PIECES = COUNT(r"[A-Za-z]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9]")

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

TOKEN_COUNTS = f"""
WITH counts AS (
    SELECT source, lang, 'words-1' AS tokenizer, 1 AS sign, {WORDS} AS tokens FROM documents
    UNION ALL SELECT source, lang, 'pieces-2', 1, {PIECES} FROM documents
    UNION ALL SELECT source, lang, 'pieces-2', -1, {PIECES} FROM documents
    UNION ALL SELECT source, lang, 'pieces-2', 1, {RUNS} FROM documents
    UNION ALL SELECT source, lang, 'words-1', -1, {WORDS} FROM documents
              WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
)
SELECT source, lang, tokenizer, cast(sum(sign) AS BIGINT) AS documents, cast(sum(sign * tokens) AS BIGINT) AS tokens
FROM counts GROUP BY ALL HAVING sum(sign) <> 0 OR sum(sign * tokens) <> 0
"""


def _mixing() -> str:
    """The same arithmetic as the operator: the rounds of the permutation as nested queries, all else with plain windows."""
    weights, length, prime = mixing.WEIGHTS, mixing.BLOCK_WORDS, mixing.PRIME
    share, most = mixing.SHARE_PERCENT, mixing.MOST_TIMES
    duck = lambda sql: sql.replace(" div ", " // ")
    walk = "SELECT key, source_no, n_blocks, slot, slot % n_blocks AS x FROM every"
    for turn in range(mixing.ROUNDS):
        at = f"(source_no * {2 * mixing.ROUNDS} + 2 * {turn} + 0)"
        key = f"({mixing.mix(at)} * {prime} + {mixing.mix(f'{at} + 1')}) % n_blocks"
        bit = duck(mixing.mix(f"greatest(x, pair) % {prime} + (greatest(x, pair) div {prime}) * 7919 + {mixing.mix(f'{at} + 7919')}"))
        walk = (
            f"SELECT key, source_no, n_blocks, slot, CASE WHEN ({bit} // 1024) % 2 = 1 THEN pair ELSE x END AS x "
            f"FROM (SELECT *, ({key} + n_blocks - x) % n_blocks AS pair FROM ({walk}))"
        )
    thrown = duck(mixing.mix(f"({mixing.mix(f'slot % {prime} + (slot div {prime}) * 7919')} + source_no * 65537 + 1)"))
    shard = f"({thrown}) % ((all_slots + {mixing.SHARD_SLOTS - 1}) // {mixing.SHARD_SLOTS})"
    weight = "CASE " + " ".join(f"WHEN source_no % {len(weights)} = {i} THEN {w}" for i, w in enumerate(weights)) + " END"
    bucket = mixing.mix(f"((coalesce(doc_id, 0) % {prime} + {prime}) % {prime})")
    return f"""
WITH sizes AS (
    SELECT doc_id, source, coalesce('s' || source, 't') AS key, cast({WORDS} AS BIGINT) AS size FROM documents
), numbered AS (
    SELECT *, {weight} AS weight FROM (
        SELECT key, cast(sum(size) AS BIGINT) AS source_size, count(*) AS documents, row_number() OVER (ORDER BY key) - 1 AS source_no
        FROM sizes GROUP BY key)
), ratios AS (
    SELECT *, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
           sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, sum(source_size) OVER () AS total
    FROM numbered WINDOW o AS (ORDER BY cast(source_size AS DOUBLE) / weight, key)
), capped AS (
    SELECT *, {100 * most}::HUGEINT * source_size * weights <= weight::HUGEINT * ({share} * total - {100 * most} * earlier) AS capped
    FROM ratios
), shared AS (
    SELECT *, {share} * total - {100 * most} * sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER () AS rest,
           sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS uncapped FROM capped
), aimed AS (
    SELECT *, CASE WHEN capped THEN cast({most} * source_size AS DOUBLE)
                   ELSE cast(weight * rest AS DOUBLE) / cast(100 * uncapped AS DOUBLE) END AS target,
           (source_size + {length - 1}) // {length} AS n_blocks, (documents + {mixing.BUCKET_ROWS - 1}) // {mixing.BUCKET_ROWS} AS n_buckets
    FROM shared
), passed AS (
    SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM aimed
), sources AS (
    SELECT *, passes * n_blocks + least(n_blocks, cast(floor((target - passes * source_size) / {length} + 0.5) AS BIGINT)) AS n_slots
    FROM passed
), every AS (
    SELECT key, cast(source_no AS BIGINT) AS source_no, n_blocks, unnest(range(n_slots)) AS slot FROM sources WHERE n_slots > 0
), uses AS (
    SELECT key, x AS block, count(*) AS uses, list(DISTINCT cast({shard} AS BIGINT)) AS shards
    FROM ({walk}), (SELECT cast(sum(n_slots) AS BIGINT) AS all_slots FROM sources) GROUP BY key, x
), placed AS (
    SELECT s.*, source_size, target, row_number() OVER () AS row,
           sum(size) OVER (PARTITION BY key ORDER BY ({bucket}) % n_buckets, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS first_word
    FROM sizes s JOIN sources USING (key)
), parts AS (
    SELECT *, unnest(range(cast(first_word // {length} AS BIGINT), cast((first_word + size - 1) // {length} + 1 AS BIGINT))) AS block FROM placed
    WHERE size > 0
), taken AS (
    SELECT row, sum((least(first_word + size, (block + 1) * {length}) - greatest(first_word, block * {length})) * uses) AS taken,
           array_to_string(list_sort(list_distinct(flatten(list(shards)))), ',') AS shards
    FROM parts JOIN uses USING (key, block) GROUP BY row
)
SELECT doc_id, source, size, cast(source_size AS BIGINT) AS source_size, target, cast(coalesce(taken, 0) AS BIGINT) AS taken,
       coalesce(shards, '') AS shards
FROM placed LEFT JOIN taken USING (row)
"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS terms FROM documents
), size AS (
    SELECT count(*) FILTER (len(terms) > 0) AS documents, cast(sum(len(terms)) AS BIGINT) AS words FROM docs
), postings AS (
    SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
    FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY row, term
), weights AS (
    SELECT term, cast(floor(1000 * ln(cast(2 * any_value(documents) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, size GROUP BY term
), items AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark
), scored AS (
    SELECT item_id, doc_id, row, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // words)))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN postings USING (term), size GROUP BY item_id, doc_id, row
), ranked AS (
    SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

COLLOCATIONS = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents
), spoken AS (
    SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), grams AS (
    SELECT lang, 1 AS k, unnest(w) AS phrase FROM spoken
    UNION ALL SELECT lang, 2, unnest([array_to_string(w[i:i + 1], ' ') for i in range(1, len(w))]) FROM spoken
    UNION ALL SELECT lang, 3, unnest([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) FROM spoken
), f AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, k, phrase
), totals AS (
    SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), cut_at AS (
    SELECT lang, phrase, k, w, f AS a, unnest(range(1, k)) AS c FROM f WHERE k > 1 AND f >= 10
), cuts AS MATERIALIZED (
    SELECT *, array_to_string(w[1:c], ' ') AS start, array_to_string(w[c + 1:], ' ') AS rest FROM cut_at
), scored AS (
    SELECT x.lang, x.phrase, x.k, x.w, x.a, x.c, l.f AS l, r.f AS r, (1000000::HUGEINT * x.a * x.a) // (l.f::HUGEINT * r.f) AS score
    FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.start JOIN f r ON r.lang = x.lang AND r.phrase = x.rest
), least AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), absorbed AS (
    SELECT DISTINCT s.lang, s.phrase FROM least s JOIN (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM least WHERE k = 3
    ) t ON t.lang = s.lang AND t.inner_phrase = s.phrase WHERE 100 * t.a >= 50 * s.a
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, cast(n AS BIGINT) AS n,
           cast(score AS BIGINT) AS score
    FROM least ANTI JOIN absorbed USING (lang, phrase) JOIN totals USING (lang)
)
SELECT * FROM ranked WHERE rank <= 2000
"""

SKETCH_JOIN = rf"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM docs
), items AS MATERIALIZED (
    SELECT row, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS MATERIALIZED (
    SELECT a.row AS x, b.row AS y FROM items a JOIN items b USING (shingle) WHERE a.row <> b.row
    GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached(x, y) AS (
    SELECT row, row FROM docs UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y
)
SELECT s.doc_id, cast(len(s.s) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM sets s JOIN reached ON reached.x = s.row JOIN docs t ON t.row = reached.y GROUP BY s.row, s.doc_id, s.s
"""

ORACLES = {"op13_sketch_join": SKETCH_JOIN, "op12_collocations": COLLOCATIONS, "op11_search": SEARCH, "op3_token_counts": TOKEN_COUNTS, "op5_mixing": _mixing(), "op6_exact_dedup": EXACT_DEDUP}
