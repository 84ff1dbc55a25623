"""The same results in ANSI SQL, for DuckDB over the sample tables."""

from nearfield.functions.scalars import CATEGORY_NAMES
from nearfield.plans.queries import AS_OF, CATEGORY, INDEX, ITEM

_NAMES = ", ".join(f"({i}, '{name}')" for i, name in enumerate(CATEGORY_NAMES, 1))

# Named subqueries; each oracle lists those it needs, in order.
_PARTS = {
    "images": """
        SELECT d.doc_id AS image_id, d.text,
               CAST(coalesce(e.label + 1, d.doc_id % 10 + 1) AS INTEGER) AS category_id,
               CAST(json_object('source', d.source, 'lang', d.lang, 'n_chars', d.n_chars) AS VARCHAR) AS metadata,
               d.source, d.lang, sha256(d.text) AS content_hash
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "vectors": """
        SELECT vec_id AS vector_id, vec_id AS image_id, CAST(embedding AS DOUBLE[]) AS embedding,
               CAST(CASE WHEN vec_id % 3 <> 0 THEN 1 + vec_id % 2 END AS INTEGER) AS index_id
        FROM embeddings""",
    "names": f"SELECT CAST(col0 AS INTEGER) AS category_id, col1 AS category_name FROM (VALUES {_NAMES})",
    "categories": """
        SELECT n.category_id, n.category_name, count(i.image_id) AS image_count
        FROM names n LEFT JOIN images i USING (category_id) GROUP BY ALL""",
    "members": """
        SELECT v.image_id, i.category_id, i.lang, v.embedding
        FROM vectors v JOIN images i USING (image_id)""",
    "elements": """
        SELECT category_id, lang, image_id, unnest(embedding) AS x,
               CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos
        FROM members""",
    "means": """
        SELECT category_id, pos, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS x, count(*) AS n
        FROM elements GROUP BY category_id, pos""",
    "german_means": """
        SELECT category_id, pos, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS x, count(*) AS n
        FROM elements WHERE lang = 'de' GROUP BY category_id, pos""",
    "prototypes": """
        SELECT category_id, list(x ORDER BY pos) AS prototype, max(n) AS n_vectors
        FROM means GROUP BY category_id""",
    "indexes": """
        SELECT index_id, 'flatl2' AS index_type, 'index/' || index_id AS path,
               CAST(max(len(embedding)) AS INTEGER) AS dim, count(*) AS ntotal
        FROM vectors WHERE index_id IS NOT NULL GROUP BY index_id""",
    "changes": """
        SELECT user_id AS image_id, ts,
               CAST(CASE WHEN event_type = 'error' THEN event_id % 10 + 1 END AS INTEGER) AS category_id,
               CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'UPDATE' ELSE 'INSERT' END AS op
        FROM events""",
    "recompute_queue": """
        SELECT coalesce(c.category_id, i.category_id) AS category_id, max(c.ts) AS last_updated
        FROM changes c LEFT JOIN images i USING (image_id)
        WHERE coalesce(c.category_id, i.category_id) IS NOT NULL GROUP BY 1""",
    "deletion_queue": """
        SELECT image_id, min(ts) AS queued_at FROM changes WHERE op = 'DELETE' GROUP BY image_id""",
    "nations": """
        SELECT CAST(n_nationkey + 6 AS INTEGER) AS category_id, n_name AS category_name FROM nation""",
    "pairs": """
        SELECT q.vec_id AS query_id, v.image_id,
               pow(list_distance(CAST(q.embedding AS DOUBLE[]), v.embedding), 2) AS distance
        FROM embeddings q, vectors v""",
    "ranked": """
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS INTEGER) AS rank
        FROM pairs""",
    "similarities": """
        SELECT q.vec_id AS query_id, p.category_id,
               list_dot_product(CAST(q.embedding AS DOUBLE[]), p.prototype)
               / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
                  * sqrt(list_dot_product(p.prototype, p.prototype))) AS similarity
        FROM embeddings q, prototypes p""",
    "near_categories": """
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, category_id) AS INTEGER) AS rank
        FROM similarities""",
    "own": """
        SELECT m.image_id, m.category_id, m.embedding, p.prototype
        FROM members m JOIN prototypes p USING (category_id)""",
    "postfiltered": """
        SELECT r.query_id, r.image_id, i.category_id, r.distance,
               CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY r.distance, r.image_id) AS INTEGER) AS rank
        FROM ranked r JOIN images i USING (image_id)
        JOIN near_categories n ON n.query_id = r.query_id AND n.category_id = i.category_id AND n.rank <= 3""",
    "toxic": "SELECT doc_id AS image_id FROM labels WHERE toxic = 1",
    "last_change": """
        SELECT image_id, max_by(op, (ts, op)) AS op FROM changes GROUP BY image_id""",
    "removed": "SELECT image_id FROM last_change WHERE op = 'DELETE'",
}

# What each part reads.
_NEEDS = {
    "categories": ["names", "images"],
    "members": ["images", "vectors"],
    "elements": ["members"],
    "means": ["elements"],
    "german_means": ["elements"],
    "prototypes": ["means"],
    "indexes": ["vectors"],
    "recompute_queue": ["changes", "images"],
    "deletion_queue": ["changes"],
    "pairs": ["vectors"],
    "ranked": ["pairs"],
    "similarities": ["prototypes"],
    "near_categories": ["similarities"],
    "own": ["members", "prototypes"],
    "postfiltered": ["ranked", "images", "near_categories"],
    "last_change": ["changes"],
    "removed": ["last_change"],
}


def _with(parts: str, body: str) -> str:
    wanted: list[str] = []

    def add(name):
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in parts.split():
        add(name)
    if not wanted:
        return body
    listed = ",\n".join(f"{name} AS MATERIALIZED ({_PARTS[name]})" for name in wanted)
    joint = "" if body.lstrip().startswith(",") else "\n"
    return f"WITH {listed}{joint}{body.lstrip()}"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def _iso(ts: str) -> str:
    return f"""strftime({ts}, '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN date_part('microsecond', {ts}) % 1000000 = 0 THEN '' ELSE strftime({ts}, '.%f') END || '+00:00'"""


def _long(source: str, key: str, vector: str, where: str = "") -> str:
    return f"""
        SELECT {key}, CAST(generate_subscripts({vector}, 1) - 1 AS INTEGER) AS pos,
               {_r(f"unnest({vector})", "value")}
        FROM {source} {where}"""


def _top(k: int, source: str = "ranked") -> str:
    return f"SELECT query_id, rank, image_id, {_r('distance', 'distance')} FROM {source} WHERE rank <= {k}"


_MERGED_MEANS = f"""
    SELECT coalesce(b.category_id, a.category_id) AS category_id, coalesce(b.pos, a.pos) AS pos,
           {_r('coalesce(b.x, a.x)', 'value')}
    FROM {{old}} a FULL JOIN {{new}} b ON a.category_id = b.category_id AND a.pos = b.pos"""

_SCORE = "1.0 / (1.0 + exp({s} * ({d} - {t})))"


def _score(d: str, t: str = "500.0", s: str = "0.01") -> str:
    return _SCORE.format(d=d, t=t, s=s)


_UPLOADS = """
    uploads AS (
        SELECT doc_id,
               CASE lang WHEN 'en' THEN 'image/png' WHEN 'de' THEN 'image/jpeg' WHEN 'fr' THEN 'text/html' END AS content_type,
               CASE WHEN n_chars % 7 <> 0 THEN n_chars * 4000 END AS size
        FROM documents),
    checked AS (
        SELECT *, CASE WHEN content_type IS NULL OR content_type NOT LIKE 'image/%' THEN 'File must be an image'
                       WHEN size > 10485760 THEN 'File too large' END AS reject_reason
        FROM uploads)"""

_SEARCH_COLUMNS = f"""
    h.query_id, h.rank, h.image_id, i.category_id, n.category_name, i.metadata,
    {_r('h.distance', 'distance')}, {_r(_score('h.distance'), 'similarity_score')}"""


def _snapshot(**selects: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, CAST({select.split(' FROM ')[0]} AS BIGINT) AS key_value"
        f" FROM {select.split(' FROM ', 1)[1]}"
        for table, select in selects.items()
    )


_UPKEEP = _with("means prototypes indexes removed recompute_queue", """
    SELECT 'prototype' AS kind, CAST(p.category_id AS BIGINT) AS id,
           coalesce(f.n, p.n_vectors) AS n
    FROM prototypes p LEFT JOIN (
        SELECT m.category_id, count(*) AS n FROM members m ANTI JOIN removed USING (image_id)
        WHERE m.category_id IN (SELECT category_id FROM recompute_queue) GROUP BY 1) f USING (category_id)
    UNION ALL
    SELECT 'pending', category_id, 1 FROM recompute_queue
    WHERE category_id NOT IN (SELECT category_id FROM members m ANTI JOIN removed USING (image_id))
    UNION ALL
    SELECT 'index', index_id, ntotal FROM indexes
    UNION ALL
    SELECT 'index', (SELECT max(index_id) + 1 FROM indexes),
           (SELECT count(*) FROM members m ANTI JOIN removed USING (image_id))
    UNION ALL
    SELECT 'removed', image_id, 1 FROM removed""")

_PREFILTERED = _with("near_categories pairs images", f"""
        SELECT query_id, rank, image_id, {_r('distance', 'distance')} FROM (
            SELECT p.query_id, p.image_id, p.distance,
                   CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.image_id) AS INTEGER) AS rank
            FROM pairs p JOIN images i USING (image_id)
            JOIN near_categories n ON n.query_id = p.query_id AND n.category_id = i.category_id AND n.rank <= 3)
        WHERE rank <= 10""")

_SEARCHED = _with("postfiltered images names", f"""
        SELECT {_SEARCH_COLUMNS}, true AS used_prototype_filtering, t.prototype_categories
        FROM postfiltered h JOIN images i USING (image_id) JOIN names n ON n.category_id = i.category_id
        JOIN (SELECT query_id, string_agg(category_id, ',' ORDER BY rank) AS prototype_categories
              FROM near_categories WHERE rank <= 3 GROUP BY query_id) t ON t.query_id = h.query_id
        WHERE h.rank <= 10""")

_HASHED = _with("vectors pairs", f"""
        SELECT query_id, rank, image_id, {_r('distance', 'distance')} FROM (
            SELECT p.query_id, p.image_id, p.distance,
                   CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.image_id) AS INTEGER) AS rank
            FROM pairs p JOIN vectors q ON q.image_id = p.query_id JOIN vectors v ON v.image_id = p.image_id
            WHERE {' OR '.join(f"(floor(q.embedding[{2 * t + 1}] / 0.25) = floor(v.embedding[{2 * t + 1}] / 0.25) AND floor(q.embedding[{2 * t + 2}] / 0.25) = floor(v.embedding[{2 * t + 2}] / 0.25))" for t in range(8))})
        WHERE rank <= 10""")

ORACLES = {
    # A
    "a1_read_catalog": _with("categories images vectors prototypes indexes recompute_queue deletion_queue", """
        SELECT 'categories' AS table_name, count(*) AS n_rows, CAST(sum(category_id) AS BIGINT) AS key_sum FROM categories
        UNION ALL SELECT 'images', count(*), CAST(sum(image_id) AS BIGINT) FROM images
        UNION ALL SELECT 'vectors', count(*), CAST(sum(vector_id) AS BIGINT) FROM vectors
        UNION ALL SELECT 'prototypes', count(*), CAST(sum(category_id) AS BIGINT) FROM prototypes
        UNION ALL SELECT 'indexes', count(*), CAST(sum(index_id) AS BIGINT) FROM indexes
        UNION ALL SELECT 'recompute_queue', count(*), CAST(sum(category_id) AS BIGINT) FROM recompute_queue
        UNION ALL SELECT 'deletion_queue', count(*), CAST(sum(image_id) AS BIGINT) FROM deletion_queue"""),
    "a2_ingest_items": """
        SELECT doc_id AS item_index, CAST(doc_id % 10 + 1 AS INTEGER) AS category_id,
               CAST(json_object('source', 'sample', 'image_index', doc_id, 'split', 'en',
                                'description', 'text item', 'format', 'TXT') AS VARCHAR) AS metadata,
               sha256(text) AS content_hash
        FROM documents WHERE lang = 'en'""",
    "a3_append_items": _with("images", """
        SELECT image_id, category_id, content_hash FROM images
        UNION ALL
        SELECT (SELECT max(image_id) FROM images) + row_number() OVER (ORDER BY sha256(text)), 1, sha256(text)
        FROM benchmark"""),
    "a3_append_vectors": _with("images vectors prototypes", """
        SELECT vector_id, image_id, index_id FROM vectors
        UNION ALL
        SELECT (SELECT max(vector_id) FROM vectors) + row_number() OVER (ORDER BY i.image_id), i.image_id, NULL
        FROM images i ANTI JOIN vectors v ON v.image_id = i.image_id
        WHERE i.category_id IN (SELECT category_id FROM prototypes)"""),
    "a3_append_vectors_refused": _with("images vectors", """
        SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 'exists' WHEN image_id IN (SELECT image_id FROM images) THEN 'written' ELSE 'unknown' END AS outcome
        FROM vectors WHERE image_id % 3 < 2
        UNION ALL
        SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM images) THEN 'repeated' ELSE 'unknown' END
        FROM vectors WHERE image_id % 3 = 1 AND image_id % 5 = 0
        UNION ALL
        SELECT image_id + 10000000, 'unknown' FROM vectors WHERE image_id % 3 = 1"""),
    "a4_allocate_ids": """
        SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY event_id) AS vector_id,
               event_id, event_type
        FROM events""",
    "a5_insert_categories": _with("categories", """
        SELECT * FROM categories
        UNION ALL
        SELECT CAST(10 + row_number() OVER (ORDER BY n_name) AS INTEGER), n_name, 0
        FROM (SELECT DISTINCT n_name FROM nation WHERE n_name NOT IN (SELECT category_name FROM categories))"""),
    "a5_rekey_categories": _with("categories images recompute_queue", """
        SELECT table_name, CAST(CASE WHEN category_id IN (1, 2) THEN category_id + 100 ELSE category_id END AS INTEGER) AS category_id, count(*) AS n_rows
        FROM (SELECT 'categories' AS table_name, category_id FROM categories
              UNION ALL SELECT 'images', category_id FROM images
              UNION ALL SELECT 'recompute_queue', category_id FROM recompute_queue) GROUP BY ALL"""),
    "a5_rekey_swapped": _with("images names categories", """
        SELECT CAST(CASE category_id WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE category_id END AS INTEGER) AS category_id, category_name FROM categories"""),
    "a5_upsert_vectors": _with("vectors", """
        SELECT coalesce(h.vector_id, (SELECT max(vector_id) FROM vectors WHERE image_id % 7 > 0) + row_number() OVER (PARTITION BY h.vector_id IS NULL ORDER BY image_id)) AS vector_id,
               image_id, h.index_id, round(CAST(coalesce(n.embedding, h.embedding)[1] AS DOUBLE), 6) AS x
        FROM (SELECT * FROM vectors WHERE image_id % 7 > 0) h
        FULL JOIN (SELECT image_id + 1 AS image_id, embedding FROM vectors WHERE (image_id + 1) % 2 = 0) n USING (image_id)"""),
    "a5_upsert_categories_ignore": _with("categories nations", """
        SELECT * FROM categories
        UNION ALL
        SELECT category_id, category_name, 0 FROM nations
        WHERE category_id NOT IN (SELECT category_id FROM categories)"""),
    "a5_upsert_categories_update": _with("categories nations", """
        SELECT coalesce(n.category_id, c.category_id) AS category_id,
               coalesce(n.category_name, c.category_name) AS category_name,
               coalesce(c.image_count, 0) AS image_count
        FROM categories c FULL JOIN nations n ON n.category_id = c.category_id"""),
    "a6_upsert_prototypes": _with("means german_means", _MERGED_MEANS.format(old="means", new="german_means")),
    "a7_index_round_trip": """
        SELECT vec_id AS image_id, CAST(len(embedding) AS INTEGER) AS dim, 'ivfflat' AS index_type FROM embeddings""",
    "a8_parse_vector_text": _with("vectors", _long("vectors", "image_id", "embedding")),
    "a9_item_payload": f"SELECT doc_id AS image_id, text FROM documents WHERE doc_id = {ITEM}",
    # B
    "b1_lookup_item": _with("images names", f"""
        SELECT image_id, category_id, category_name, metadata, content_hash
        FROM images JOIN names USING (category_id) WHERE image_id = {ITEM}"""),
    "b1_lookup_category": _with("categories", f"SELECT * FROM categories WHERE category_id = {CATEGORY}"),
    "b1_lookup_prototype": _with("means", f"""
        SELECT category_id, pos, {_r('x', 'value')} FROM means WHERE category_id = {CATEGORY}"""),
    "b1_lookup_vector": _with("vectors", _long("vectors", "image_id", "embedding", f"WHERE image_id = {ITEM}")),
    "b1_lookup_index": _with("indexes", f"SELECT * FROM indexes WHERE index_id = {INDEX}"),
    "b2_items_of_category": _with("images names", f"""
        SELECT image_id, category_id, category_name, metadata
        FROM images JOIN names USING (category_id) WHERE category_id = {CATEGORY}"""),
    "b3_metadata_count": "SELECT count(*) AS n_items FROM documents WHERE source = 'src3' AND lang = 'en'",
    "b3_metadata_events": "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '9'",
    "b4_stale_queue_entries": _with("deletion_queue", f"""
        SELECT * FROM deletion_queue WHERE queued_at < TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR"""),
    "b4_purge_queue": _with("deletion_queue", f"""
        SELECT * FROM deletion_queue WHERE NOT queued_at < TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR"""),
    "b5_not_indexed": _with("vectors", "SELECT vector_id, image_id FROM vectors WHERE index_id IS NULL"),
    "b6_check_uploads": f"WITH {_UPLOADS} SELECT * FROM checked",
    "b6_accepted_uploads": f"WITH {_UPLOADS} SELECT doc_id, content_type, size FROM checked WHERE reject_reason IS NULL",
    "b6_rejected_uploads": f"WITH {_UPLOADS} SELECT * FROM checked WHERE reject_reason IS NOT NULL",
    "b7_public_view": _with("images names", """
        SELECT image_id, category_id, category_name, metadata, CAST(NULL AS DOUBLE) AS similarity_score
        FROM images JOIN names USING (category_id)"""),
    # C
    "c1_items_with_category": _with("images names", """
        SELECT image_id, category_id, category_name FROM images JOIN names USING (category_id)"""),
    "c2_vectors_of_category": _with("members", _long("members", "image_id", "embedding", f"WHERE category_id = {CATEGORY}")),
    "c3_categories_with_items": _with("images names", """
        SELECT category_id, category_name, image_id FROM names LEFT JOIN images USING (category_id)"""),
    "c4_items_without_vectors": _with("images names vectors", """
        SELECT i.image_id, i.category_id, n.category_name, i.metadata, t.total AS total_images_in_category
        FROM images i JOIN names n USING (category_id)
        JOIN (SELECT category_id, count(*) AS total FROM images GROUP BY category_id) t USING (category_id)
        WHERE i.image_id NOT IN (SELECT image_id FROM vectors)"""),
    "c5_items_with_vector": _with("images names vectors", f"""
        SELECT i.image_id, n.category_name, v.embedding IS NOT NULL AS has_vector,
               {_r('sqrt(list_dot_product(v.embedding, v.embedding))', 'length')}
        FROM images i JOIN names n USING (category_id) LEFT JOIN vectors v USING (image_id)"""),
    "c6_enrich_hits": _with("ranked images names", """
        SELECT r.query_id, r.rank, r.image_id, i.category_id, n.category_name, i.metadata
        FROM ranked r JOIN images i USING (image_id) JOIN names n USING (category_id) WHERE r.rank <= 5"""),
    "c7_with_category_total": _with("images", """
        SELECT image_id, category_id, count(*) OVER (PARTITION BY category_id) AS total_images_in_category FROM images"""),
    "c8_prototypes_with_names": _with("prototypes names nations", """
        SELECT p.category_id, coalesce(n.category_name, 'Category ' || p.category_id) AS category_name, p.n_vectors
        FROM prototypes p LEFT JOIN (
            SELECT * FROM names WHERE category_id IN (SELECT category_id FROM nations)) n USING (category_id)"""),
    "c9_integrity_report": _with("images vectors names prototypes indexes recompute_queue deletion_queue", """
        SELECT 'orphan' AS kind, 'images' AS table_name, 'category_id' AS column_name,
               CAST(category_id AS VARCHAR) AS key_value, count(*) AS n_rows
        FROM images WHERE category_id NOT IN (SELECT category_id FROM names) GROUP BY category_id
        UNION ALL SELECT 'orphan', 'vectors', 'image_id', CAST(image_id AS VARCHAR), count(*)
        FROM vectors WHERE image_id NOT IN (SELECT image_id FROM images) GROUP BY image_id
        UNION ALL SELECT 'orphan', 'vectors', 'index_id', CAST(index_id AS VARCHAR), count(*)
        FROM vectors WHERE index_id NOT IN (SELECT index_id FROM indexes) GROUP BY index_id
        UNION ALL SELECT 'orphan', 'prototypes', 'category_id', CAST(category_id AS VARCHAR), count(*)
        FROM prototypes WHERE category_id NOT IN (SELECT category_id FROM names) GROUP BY category_id
        UNION ALL SELECT 'duplicate', 'categories', 'category_id', CAST(category_id AS VARCHAR), count(*)
        FROM names GROUP BY category_id HAVING count(*) > 1
        UNION ALL SELECT 'duplicate', 'categories', 'category_name', category_name, count(*)
        FROM names GROUP BY category_name HAVING count(*) > 1
        UNION ALL SELECT 'duplicate', 'images', 'image_id', CAST(image_id AS VARCHAR), count(*)
        FROM images GROUP BY image_id HAVING count(*) > 1
        UNION ALL SELECT 'duplicate', 'images', 'content_hash', content_hash, count(*)
        FROM images GROUP BY content_hash HAVING count(*) > 1
        UNION ALL SELECT 'duplicate', 'vectors', 'vector_id', CAST(vector_id AS VARCHAR), count(*)
        FROM vectors GROUP BY vector_id HAVING count(*) > 1
        UNION ALL SELECT 'duplicate', 'vectors', 'image_id', CAST(image_id AS VARCHAR), count(*)
        FROM vectors GROUP BY image_id HAVING count(*) > 1
        UNION ALL SELECT 'orphan', 'recompute_queue', 'category_id', CAST(category_id AS VARCHAR), count(*)
        FROM recompute_queue WHERE category_id NOT IN (SELECT category_id FROM names) GROUP BY category_id
        UNION ALL SELECT 'duplicate', 'deletion_queue', 'image_id', CAST(image_id AS VARCHAR), count(*)
        FROM deletion_queue GROUP BY image_id HAVING count(*) > 1
        UNION ALL SELECT 'null', 'images', 'content', NULL, count(*)
        FROM images WHERE text IS NULL HAVING count(*) > 0
        UNION ALL SELECT 'null', 'images', 'category_id', NULL, count(*)
        FROM images WHERE category_id IS NULL HAVING count(*) > 0"""),
    "c10_block_join": _with("ranked", _top(10)),
    "c11_prototype_similarity": _with("similarities", f"SELECT query_id, category_id, {_r('similarity', 'similarity')} FROM similarities"),
    # D
    "d1_catalog_status": _with("names images vectors prototypes indexes", """
        SELECT (SELECT count(*) FROM names) AS total_categories, (SELECT count(*) FROM images) AS total_images,
               (SELECT count(*) FROM vectors) AS total_vectors,
               (SELECT count(*) FROM prototypes) AS categories_with_prototypes,
               index_id AS latest_index_id, index_type AS latest_index_type,
               path AS latest_index_path, ntotal AS latest_index_ntotal
        FROM indexes ORDER BY index_id DESC LIMIT 1"""),
    "d2_items_per_category": _with("images", "SELECT category_id, count(*) AS n_items FROM images GROUP BY category_id"),
    "d3_category_breakdown": _with("categories nations", """
        SELECT * FROM categories
        UNION ALL
        SELECT category_id, category_name, 0 FROM nations
        WHERE category_id NOT IN (SELECT category_id FROM categories)"""),
    "d4_all_prototypes": _with("means", f"SELECT category_id, pos, {_r('x', 'value')} FROM means"),
    "d5_prototypes_of": _with("means nations", f"""
        SELECT category_id, pos, {_r('x', 'value')} FROM means
        WHERE category_id IN (SELECT category_id FROM nations)"""),
    "d6_hit_statistics": _with("ranked", f"""
        SELECT query_id, count(*) AS n_hits,
               {_r('min(distance)', 'min_distance')}, {_r('max(distance)', 'max_distance')},
               {_r('avg(distance)', 'mean_distance')},
               {_r(f"min({_score('distance')})", 'min_score')}, {_r(f"max({_score('distance')})", 'max_score')},
               {_r(f"avg({_score('distance')})", 'mean_score')}
        FROM ranked WHERE rank <= 10 GROUP BY query_id"""),
    "d7_apply_count_changes": _with("categories changes", """
        SELECT c.category_id, c.category_name,
               CAST(greatest(c.image_count + coalesce(d.delta, 0), 0) AS BIGINT) AS image_count
        FROM categories c LEFT JOIN (
            SELECT image_id % 10 + 1 AS category_id,
                   sum(CASE op WHEN 'INSERT' THEN 1 WHEN 'DELETE' THEN -1 ELSE 0 END) AS delta
            FROM changes GROUP BY 1) d USING (category_id)"""),
    "d8_latest_change": _with("recompute_queue", "SELECT * FROM recompute_queue"),
    "d8_first_deletion": _with("deletion_queue", "SELECT * FROM deletion_queue"),
    # E
    "e1_nearest_to_prototype": _with("own", f"""
        SELECT category_id, rank, image_id, {_r('distance', 'distance')} FROM (
            SELECT category_id, image_id, distance,
                   CAST(row_number() OVER (PARTITION BY category_id ORDER BY distance, image_id) AS INTEGER) AS rank
            FROM (SELECT category_id, image_id, pow(list_distance(embedding, prototype), 2) AS distance FROM own))
        WHERE rank <= 10"""),
    "e2_top_categories": _with("near_categories", f"""
        SELECT query_id, rank, category_id, {_r('similarity', 'similarity')} FROM near_categories WHERE rank <= 3"""),
    "e3_best_category": _with("near_categories", f"""
        SELECT query_id, category_id, {_r('similarity', 'similarity')} FROM near_categories WHERE rank = 1"""),
    "e4_latest_index": _with("indexes", "SELECT * FROM indexes ORDER BY index_id DESC LIMIT 1"),
    "e5_item_listing": _with("images names", """
        SELECT image_id, category_name, content_hash FROM images JOIN names USING (category_id) ORDER BY image_id"""),
    "e5_vector_listing": _with("vectors", f"""
        SELECT image_id, vector_id, {_r('sqrt(list_dot_product(embedding, embedding))', 'length')}
        FROM vectors ORDER BY image_id"""),
    "e5_category_listing": _with("categories", "SELECT * FROM categories ORDER BY category_id"),
    "e6_queue_heads": _with("recompute_queue deletion_queue", f"""
        SELECT queue, id, {_iso('queued_at')} AS queued_at,
               count(*) OVER (PARTITION BY queue) AS n_shown
        FROM (
            (SELECT 'prototype_recompute' AS queue, CAST(category_id AS BIGINT) AS id, last_updated AS queued_at
             FROM recompute_queue ORDER BY last_updated, category_id LIMIT 20)
            UNION ALL
            (SELECT 'vector_deletion', image_id, queued_at
             FROM deletion_queue ORDER BY queued_at, image_id LIMIT 20))"""),
    "e7_category_items": _with("images names", f"""
        SELECT i.category_id, i.image_id, i.metadata, t.total_count, n.category_name,
               least(CAST(50 AS BIGINT), t.total_count) AS shown_count
        FROM (SELECT * FROM images WHERE category_id = {CATEGORY} ORDER BY image_id LIMIT 50) i
        JOIN (SELECT category_id, count(*) AS total_count FROM images GROUP BY category_id) t USING (category_id)
        JOIN names n USING (category_id)"""),
    # F
    "f1_f4_vector_functions": _with("own", f"""
        SELECT image_id, category_id,
               {_r('list_dot_product(embedding, prototype)', 'dot')},
               {_r('sqrt(list_dot_product(embedding, embedding))', 'length')},
               {_r('''list_dot_product(embedding, prototype) / (sqrt(list_dot_product(embedding, embedding))
                      * sqrt(list_dot_product(prototype, prototype)))''', 'cosine')},
               {_r('pow(list_distance(embedding, prototype), 2)', 'squared_l2')}
        FROM own"""),
    "f5_sigmoid_score": _with("own", f"""
        SELECT image_id, {_r(_score('pow(list_distance(embedding, prototype), 2)'), 'score')},
               {_r(_score('pow(list_distance(embedding, prototype), 2)', '1.0', '4.0'), 'steep_score')}
        FROM own"""),
    "f6_percent_text": """
        SELECT event_id, CASE WHEN value IS NULL OR value = 0 THEN 'N/A'
                              ELSE CAST(CAST(round(CAST(CAST(value / 100 * 100 AS VARCHAR) AS DECIMAL(38, 20)), 1) AS DECIMAL(18, 1)) AS VARCHAR) END AS percent
        FROM events""",
    "f7_content_sha256": "SELECT page_id, sha256(html) AS content_hash FROM pages",
    "f8_metadata_json": """
        SELECT doc_id, CAST(json_object('source', source, 'lang', lang, 'n_chars', n_chars) AS VARCHAR) AS metadata,
               lang, CAST(n_chars AS VARCHAR) AS n_chars, CAST(NULL AS VARCHAR) AS absent
        FROM documents""",
    "f9_iso_timestamp": f"SELECT event_id, {_iso('ts')} AS ts_text FROM events",
    "f10_coalesce_greatest": """
        SELECT c_custkey AS category_id, greatest(100 + CAST(trunc(c_acctbal) AS BIGINT), 0) AS moved,
               CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE 'Category ' || c_custkey END AS category_name
        FROM customer""",
    "f11_label_to_category": _with("names", """
        SELECT e.vec_id, n.category_id, n.category_name
        FROM embeddings e JOIN names n ON n.category_id = e.label + 1"""),
    # I
    "i1_knn_exact": _with("ranked", f"""
        SELECT query_id, rank, image_id, {_r('distance', 'distance')},
               {_r(_score('distance'), 'similarity_score')}
        FROM ranked WHERE rank <= 10"""),
    "i1_knn_in_blocks": _with("ranked", _top(10)),
    "i9_replace_in_index": _with("vectors", f"""
        SELECT query_id, rank, image_id, {_r('distance', 'distance')} FROM (
            SELECT q.vec_id AS query_id, v.image_id, d.distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY d.distance, v.image_id) AS INTEGER) AS rank
            FROM embeddings q, (SELECT image_id, CASE WHEN image_id % 50 = 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM vectors) v,
                 LATERAL (SELECT pow(list_distance(CAST(q.embedding AS DOUBLE[]), v.embedding), 2) AS distance) d)
        WHERE rank <= 10"""),
    "i1_knn_by_pivots": _with("ranked", _top(10)),
    "i1_knn_of_prototypes": _with("prototypes vectors", f"""
        SELECT query_id, rank, image_id, {_r('distance', 'distance')} FROM (
            SELECT query_id, image_id, distance,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS INTEGER) AS rank
            FROM (SELECT CAST(p.category_id AS BIGINT) AS query_id, v.image_id,
                         pow(list_distance(p.prototype, v.embedding), 2) AS distance
                  FROM prototypes p, vectors v))
        WHERE rank <= 50"""),
    "i2_ivf_search_all_cells": _with("ranked", _top(10)),
    "i2_ivf_search": _with("prototypes vectors pairs", f"""
        SELECT query_id, rank, image_id, {_r('distance', 'distance')} FROM (
            SELECT p.query_id, p.image_id, p.distance,
                   CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.image_id) AS INTEGER) AS rank
            FROM pairs p
            JOIN (SELECT * FROM (SELECT v.image_id, t.category_id,
                         row_number() OVER (PARTITION BY v.image_id ORDER BY list_distance(v.embedding, t.prototype), t.category_id) AS near
                  FROM vectors v, prototypes t) WHERE near = 1) i USING (image_id)
            JOIN (SELECT * FROM (SELECT e.vec_id AS query_id, t.category_id,
                         row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), t.prototype), t.category_id) AS near
                  FROM embeddings e, prototypes t) WHERE near <= 4) q ON q.query_id = p.query_id AND q.category_id = i.category_id)
        WHERE rank <= 10"""),
    "i3_ann_lsh": _HASHED,
    "i3_ann_lsh_stored": _HASHED,
    "i4_search_postfilter": _with("postfiltered", _top(10, "postfiltered")),
    "i5_search_prefilter": _PREFILTERED,
    "i5_search_prefilter_stored": _PREFILTERED,
    "i6_rank_prototypes": _with("near_categories names", f"""
        SELECT s.query_id, s.rank, s.category_id,
               coalesce(n.category_name, 'Category ' || s.category_id) AS category_name,
               {_r('s.similarity', 'similarity')}
        FROM near_categories s LEFT JOIN names n USING (category_id)"""),
    "i7_predict_category": _with("near_categories", f"""
        SELECT query_id AS image_id, category_id AS predicted_category, {_r('similarity', 'similarity')}
        FROM near_categories WHERE rank = 1"""),
    "i8_search": _with("ranked images names", f"""
        SELECT {_SEARCH_COLUMNS}, false AS used_prototype_filtering, CAST(NULL AS VARCHAR) AS prototype_categories
        FROM ranked h JOIN images i USING (image_id) JOIN names n USING (category_id) WHERE h.rank <= 10"""),
    "i8_search_with_prototypes": _SEARCHED,
    "i8_search_index": _SEARCHED,
    "i9_index_add": _with("ranked", _top(10)),
    "i9_index_append_stored": _with("ranked", f"""
        SELECT query_id, rank, image_id, {_r('distance', 'distance')}, (SELECT count(*) FROM embeddings) AS ntotal
        FROM ranked WHERE rank <= 10"""),
    "i10_register_index": _with("vectors indexes", """
        SELECT i.index_id, i.index_type, i.path, count(v.vector_id) AS n_vectors
        FROM (SELECT index_id, index_type, path FROM indexes
              UNION ALL SELECT (SELECT max(index_id) + 1 FROM indexes), 'ivfflat', 'index/new') i
        LEFT JOIN vectors v ON coalesce(v.index_id, (SELECT max(index_id) + 1 FROM indexes)) = i.index_id
        GROUP BY ALL"""),
    # J
    "j1_recompute_queue": _with("recompute_queue names", f"""
        SELECT category_id, max(last_updated) AS last_updated
        FROM (SELECT * FROM recompute_queue UNION ALL SELECT category_id, TIMESTAMP '{AS_OF}' FROM names)
        GROUP BY category_id"""),
    "j2_deletion_queue": _with("deletion_queue toxic", f"""
        SELECT image_id, TIMESTAMP '{AS_OF}' AS queued_at FROM toxic
        UNION ALL
        SELECT image_id, queued_at FROM deletion_queue WHERE image_id NOT IN (SELECT image_id FROM toxic)"""),
    "j3_drain_recompute": _with("means german_means changes", _MERGED_MEANS.format(
        old="german_means",
        new="(SELECT * FROM means WHERE category_id IN (SELECT category_id FROM changes WHERE op = 'DELETE'))")),
    "j3_drain_recompute_queue": _with("prototypes changes", """
        SELECT category_id, CASE WHEN category_id IN (SELECT category_id FROM prototypes) THEN 'done' ELSE 'pending' END AS state
        FROM (SELECT DISTINCT category_id FROM changes WHERE op = 'DELETE'
              UNION ALL SELECT max(category_id) + 1 FROM changes WHERE op = 'DELETE')"""),
    "j4_drain_deletions": _with("members deletion_queue", """
        SELECT image_id, 'indexed' AS state FROM members
        WHERE image_id NOT IN (SELECT image_id FROM deletion_queue)"""),
    "j4_drain_all_vectors": _with("indexes", """
        SELECT *, CAST(0 AS BIGINT) AS n_left FROM indexes
        UNION ALL
        SELECT max(index_id) + 1, 'flatl2', 'index/new', max_by(dim, index_id), 0, 0 FROM indexes"""),
    "j4_drain_deletions_registry": _with("members indexes deletion_queue", """
        SELECT * FROM indexes
        UNION ALL
        SELECT (SELECT max(index_id) + 1 FROM indexes), 'flatl2', 'index/new', CAST(max(len(embedding)) AS INTEGER), count(*)
        FROM members WHERE image_id NOT IN (SELECT image_id FROM deletion_queue)"""),
    "j5_delete_items": _with("names images members vectors prototypes toxic deletion_queue", _snapshot(
        categories="category_id FROM names",
        images="image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM toxic)",
        vectors="image_id FROM vectors WHERE image_id NOT IN (SELECT image_id FROM toxic JOIN images USING (image_id))",
        prototypes="category_id FROM prototypes",
        recompute_queue="category_id FROM (SELECT DISTINCT category_id FROM images JOIN toxic USING (image_id))",
        deletion_queue="image_id FROM (SELECT image_id FROM deletion_queue UNION SELECT image_id FROM members JOIN toxic USING (image_id))",
    )),
    "j5_delete_items_counts": _with("names images toxic", """
        SELECT n.category_id, n.category_name, count(i.image_id) AS image_count
        FROM names n LEFT JOIN (SELECT * FROM images ANTI JOIN toxic USING (image_id)) i USING (category_id)
        GROUP BY ALL"""),
    "j6_delete_categories": _with("names images vectors members prototypes recompute_queue deletion_queue", _snapshot(
        categories=f"category_id FROM names WHERE category_id NOT IN ({CATEGORY}, {CATEGORY + 4})",
        images=f"image_id FROM images WHERE category_id NOT IN ({CATEGORY}, {CATEGORY + 4})",
        vectors=f"image_id FROM vectors WHERE image_id NOT IN (SELECT image_id FROM images WHERE category_id IN ({CATEGORY}, {CATEGORY + 4}))",
        prototypes=f"category_id FROM prototypes WHERE category_id NOT IN ({CATEGORY}, {CATEGORY + 4})",
        recompute_queue=f"category_id FROM recompute_queue WHERE category_id NOT IN ({CATEGORY}, {CATEGORY + 4})",
        deletion_queue=f"image_id FROM (SELECT image_id FROM deletion_queue UNION SELECT image_id FROM members WHERE category_id IN ({CATEGORY}, {CATEGORY + 4}))",
    )),
    "j6_drop_index": _with("vectors indexes", f"""
        SELECT v.vector_id, v.index_id, i.path
        FROM (SELECT vector_id, nullif(index_id, {INDEX}) AS index_id FROM vectors) v
        LEFT JOIN indexes i ON i.index_id = v.index_id"""),
    "j7_dedupe_append": _with("images", """
        SELECT image_id, content_hash,
               row_number() OVER (PARTITION BY content_hash ORDER BY image_id) = 1
               AND content_hash NOT IN (SELECT sha256(text) FROM benchmark) AS accepted
        FROM images"""),
    "j8_embed_missing": _with("images vectors", """
        SELECT image_id, CAST(pos AS INTEGER) AS pos, CAST(value AS DOUBLE) AS value FROM (
            SELECT image_id, 0 AS pos, octet_length(encode(text)) AS value, text FROM images
            UNION ALL SELECT image_id, 1, length(text) - length(replace(text, ' ', '')), text FROM images
            UNION ALL SELECT image_id, 2, length(text) - length(replace(text, chr(10), '')), text FROM images
            UNION ALL SELECT image_id, 3, length(text) - length(replace(text, '.', '')), text FROM images)
        WHERE image_id NOT IN (SELECT image_id FROM vectors)"""),
    "j9_rebuild_index": _with("vectors images", f"""
        SELECT query_id, rank, image_id, {_r('distance', 'distance')} FROM (
            SELECT query_id, image_id, distance,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS INTEGER) AS rank
            FROM (SELECT q.vec_id AS query_id, v.image_id,
                         pow(list_distance(CAST(q.embedding AS DOUBLE[]), v.embedding), 2) AS distance
                  FROM embeddings q, vectors v WHERE v.image_id IN (SELECT image_id FROM images)))
        WHERE rank <= 10"""),
    "j10_bootstrap": _with("names images vectors indexes", """
        SELECT (SELECT count(*) FROM names) AS total_categories, (SELECT count(*) FROM images) AS total_images,
               (SELECT count(*) FROM (SELECT image_id FROM images UNION SELECT image_id FROM vectors)) AS total_vectors,
               (SELECT count(DISTINCT category_id) FROM images) AS categories_with_prototypes,
               (SELECT max(index_id) + 1 FROM indexes) AS latest_index_id, 'flatl2' AS latest_index_type,
               (SELECT count(*) FROM images) AS latest_index_ntotal"""),
    "j10_system_check": _with("images vectors", """
        SELECT (SELECT count(*) FROM images) AS total_images, count(*) AS total_vectors,
               least(CAST(5 AS BIGINT), count(*)) AS trial_hits, true AS trial_found_itself
        FROM vectors"""),
    "j11_upload": _with("images", """,
        uploads AS (
            SELECT page_id AS upload_id, sha256(html) AS content_hash, url,
                   CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 10 + 1 AS INTEGER) END AS given_category,
                   CASE WHEN page_id % 5 = 0 THEN 'File must be an image'
                        WHEN length(html) > 10485760 THEN 'File too large' END AS reason
            FROM pages),
        judged AS (
            SELECT *, coalesce(reason, CASE WHEN content_hash IN (SELECT content_hash FROM images)
                   OR row_number() OVER (PARTITION BY content_hash, reason IS NULL ORDER BY upload_id) > 1
                   THEN 'Duplicate image detected' END) AS reject_reason
            FROM uploads),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY upload_id) AS place FROM judged)
        SELECT upload_id, reject_reason,
               CASE WHEN reject_reason IS NULL THEN place + (SELECT max(image_id) FROM images) END AS image_id,
               CASE WHEN reject_reason IS NULL THEN place + (SELECT max(vec_id) FROM embeddings) END AS vector_id,
               CASE WHEN reject_reason IS NULL THEN content_hash END AS content_hash,
               CASE WHEN reject_reason IS NULL THEN CAST(json_object(
                   'filename', url, 'content_type', 'image/png', 'upload_source', 'api') AS VARCHAR) END AS metadata,
               CASE WHEN reject_reason IS NULL THEN given_category END AS given_category,
               CASE WHEN reject_reason IS NULL THEN true END AS placed
        FROM numbered"""),
    "j12_search_by_content": """
        SELECT page_id AS query_id,
               CASE WHEN page_id % 5 <> 0 THEN least(CAST(10 AS BIGINT), (SELECT count(*) FROM embeddings)) END AS n_hits,
               CASE WHEN page_id % 5 = 0 THEN 'File must be an image' END AS reject_reason
        FROM pages""",
    # K
    "k1_stream_recompute_queue": _with("recompute_queue", "SELECT * FROM recompute_queue"),
    "k2_stream_deletion_queue": _with("deletion_queue", "SELECT * FROM deletion_queue"),
    "k3_run_maintenance": _UPKEEP,
    "k4_drain_now": _UPKEEP,
}
