"""The queries of :mod:`textquarry.plans.registry` as SQL over the same tables."""

from __future__ import annotations

from textquarry.functions.stopwords import ENGLISH
from textquarry.operators.ledger import RETRY_STATUSES
from textquarry.plans.registry import BATCH, LOAD_LIMIT

# White space of the corpus format, as an RE2 class.
SPACE = (r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def _strip(text: str) -> str:
    return _replace(_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def _collapse(text: str) -> str:
    return f"trim({_replace(text, SPACE + '+', ' ')})"


def _normalize(text: str) -> str:
    return _collapse(f"lower(coalesce({text}, ''))")


def _clean(sql: str) -> str:
    return _strip(_replace(_replace(sql, r"(?s)/\*.*?\*/", ""), "(?m)--.*?$", ""))


def _normalize_sql(sql: str) -> str:
    text = _clean(f"coalesce({sql}, '')")
    for pattern in (r"--[^\n]*?(\r?\n|$)", r"#[^\n]*?(\r?\n|$)", r"(?s)/\*.*?\*/"):
        text = _replace(text, pattern, " ")
    return _collapse(f"lower({text})")


def _mask(text: str) -> str:
    spaced = _replace(f"lower(coalesce({text}, ''))", SPACE + "+", " ")
    masked = _replace(spaced, "''[^'']*''", "''<val>''")
    return f"trim({_replace(masked, r'\b0x[a-f0-9]+\b', '<address>')})"


def _hash(text: str) -> str:
    return f"sha1({text})"


def _tags(column: str) -> str:
    return f"list_transform({column}, lambda x: trim(lower(x)))"


RAW = """raw AS (
  SELECT doc_id AS query_id,
         concat(' Text  ', upper(lang), ' of ', CAST(n_chars AS VARCHAR), ' Chars ') AS name,
         CASE WHEN n_chars >= 500 THEN text END AS description,
         [concat(' ', upper(lang)), concat('Digits', CAST(length(CAST(n_chars AS VARCHAR)) AS VARCHAR)),
          CASE WHEN n_chars > 1000 THEN lang ELSE '' END] AS tags,
         CASE WHEN source NOT IN ('src3', 'src7') THEN source END AS owner,
         text AS query_sql,
         CASE WHEN source = 'src0' THEN -1 ELSE CAST(substr(source, 4) AS INTEGER) END AS cluster
  FROM documents)"""
CORPUS = f"""{RAW}, corpus AS (
  SELECT query_id, {_normalize('name')} AS name, {_normalize('description')} AS description,
         {_tags('tags')} AS tags, owner, query_sql, cluster
  FROM raw)"""
TAG_CASE = """CASE WHEN l_linenumber % 7 = 0 THEN ''
              WHEN l_linenumber % 2 = 0 THEN concat(upper(p_name), ' ') ELSE p_name END"""
BASKETS = f"""baskets AS (
  SELECT l_orderkey AS query_id,
         list({TAG_CASE} ORDER BY l_linenumber, l_partkey, {TAG_CASE}) AS tags
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""
SQL_TEXTS = r"""sql_texts AS (
  SELECT o_orderkey AS query_id, o_orderpriority AS name,
         concat('owner', CAST(o_custkey % 10 AS VARCHAR)) AS owner,
         CAST(o_custkey % 7 AS INTEGER) AS cluster,
         concat('SELECT  * FROM t', CAST(o_custkey % 50 AS VARCHAR),
                CASE o_orderkey % 4
                  WHEN 0 THEN concat(' -- note ', CAST(o_orderkey AS VARCHAR), chr(10))
                  WHEN 1 THEN concat(' /* a', chr(10), 'b */ ')
                  WHEN 2 THEN concat(' # h', chr(13), chr(10))
                  ELSE ' ' END,
                'WHERE s = ''', o_orderstatus, ''' AND a = 0xAB',
                CAST(o_custkey % 3 AS VARCHAR)) AS query_sql
  FROM orders)"""
LINE_IDS = """ids AS (SELECT DISTINCT l_orderkey AS query_id FROM lineitem),
rng AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)"""
LABEL_IDS = """ids AS (SELECT DISTINCT doc_id AS query_id FROM labels),
rng AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents)"""
NEXT = """nexts AS (SELECT query_id, lead(query_id) OVER (ORDER BY query_id) AS next_id FROM ids)"""
MISSING = """missing AS (
  SELECT e.query_id FROM (SELECT unnest(generate_series(lo, hi)) AS query_id FROM rng) e
  ANTI JOIN ids USING (query_id))"""
RANGES = f"""{MISSING}, ranges AS (
  SELECT min(query_id) AS start_id, max(query_id) AS end_id
  FROM (SELECT query_id, query_id - row_number() OVER (ORDER BY query_id) AS island FROM missing)
  GROUP BY island)"""
POINTS = """points AS (
  SELECT vec_id AS query_id, label AS cluster,
         list_transform(embedding, lambda x, i: x::DOUBLE * 0.1::DOUBLE
                        + CASE WHEN i = label + 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS pseudo
  FROM embeddings)"""
CENTROIDS = f"""{POINTS}, dims AS (
  SELECT cluster, i, avg(x) AS m FROM (
    SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM points)
  GROUP BY cluster, i), sizes AS (
  SELECT cluster, count(*) AS size FROM points GROUP BY cluster), centroids AS (
  SELECT cluster, any_value(size) AS size, list(m ORDER BY i) AS c
  FROM dims JOIN sizes USING (cluster) GROUP BY cluster), spread AS (
  SELECT p.query_id, p.cluster, c.size, c.c, list_distance(p.v, c.c) AS distance
  FROM points p JOIN centroids c USING (cluster))"""
TIGHTNESS = f"""{POINTS}, tightness AS (
  SELECT a.cluster, count(DISTINCT a.query_id) AS size,
         CASE WHEN count(DISTINCT a.query_id) > 1 THEN sum(CASE WHEN a.query_id <> b.query_id
              THEN list_distance(a.v, b.v) ELSE 0 END)
              / (count(DISTINCT a.query_id) * (count(DISTINCT a.query_id) - 1)) ELSE 0.0 END AS tightness
  FROM points a JOIN points b ON a.cluster = b.cluster GROUP BY a.cluster)"""
SILHOUETTE = f"""{POINTS}, sizes AS (
  SELECT cluster, count(*) AS n FROM points GROUP BY cluster), means AS (
  SELECT a.query_id, a.cluster = b.cluster AS own,
         sum(CASE WHEN a.query_id <> b.query_id THEN list_distance(a.v, b.v) ELSE 0 END)
         / any_value(CASE WHEN a.cluster = b.cluster THEN greatest(s.n - 1, 1) ELSE s.n END) AS mean
  FROM points a CROSS JOIN points b JOIN sizes s ON s.cluster = b.cluster
  GROUP BY a.query_id, a.cluster, b.cluster), per_point AS (
  SELECT query_id, max(CASE WHEN own THEN mean END) AS a, min(CASE WHEN NOT own THEN mean END) AS b
  FROM means GROUP BY query_id), silhouette AS (
  SELECT avg((b - a) / greatest(a, b)) AS silhouette_score FROM per_point)"""
CALINSKI = """calinski AS (
  SELECT (sum(between_part) / (count(*) - 1)) / (sum(within_part) / (sum(size) - count(*)))
         AS calinski_harabasz_score
  FROM (SELECT s.cluster, any_value(s.size) AS size, sum(s.distance * s.distance) AS within_part,
               any_value(s.size) * power(list_distance(any_value(s.c), any_value(g.c)), 2) AS between_part
        FROM spread s CROSS JOIN (
          SELECT list(m ORDER BY i) AS c FROM (
            SELECT i, avg(x) AS m FROM (
              SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM points)
            GROUP BY i)) g
        GROUP BY s.cluster))"""
DAVIES = """scatter AS (
  SELECT cluster, any_value(c) AS c, avg(distance) AS s FROM spread GROUP BY cluster),
davies AS (
  SELECT avg(worst) AS davies_bouldin_index FROM (
    SELECT a.cluster, max((a.s + b.s) / list_distance(a.c, b.c)) AS worst
    FROM scatter a JOIN scatter b ON a.cluster <> b.cluster GROUP BY a.cluster))"""
AGREEMENT = """counts AS (
  SELECT pseudo, cluster, count(*) AS n FROM points GROUP BY pseudo, cluster),
parts AS (
  SELECT (SELECT sum(n) FROM counts) AS t, (SELECT sum(n * ln(n)) FROM counts) AS s_joint,
         (SELECT sum(n * ln(n)) FROM (SELECT sum(n) AS n FROM counts GROUP BY pseudo)) AS s_truth,
         (SELECT sum(n * ln(n)) FROM (SELECT sum(n) AS n FROM counts GROUP BY cluster)) AS s_pred),
hc AS (
  SELECT 1 - ((s_pred - s_joint) / t) / (ln(t) - s_truth / t) AS h,
         1 - ((s_truth - s_joint) / t) / (ln(t) - s_pred / t) AS c FROM parts)"""
ATTEMPTS = f"""attempts AS (
  SELECT CAST(floor(event_id / 4) AS BIGINT) AS query_id, CAST(event_id % 4 AS INTEGER) AS attempt,
         CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 200 WHEN 'purchase' THEN 404
              WHEN 'error' THEN 503 END AS status
  FROM events), judged AS (
  SELECT *, CASE WHEN status = 200 THEN 'success' WHEN status = 404 THEN 'not_found'
              WHEN (status IS NULL OR status IN {RETRY_STATUSES}) AND attempt < 3 THEN 'retry'
              ELSE 'failed' END AS outcome
  FROM attempts), finals AS (
  SELECT query_id, min(attempt) AS final_attempt FROM judged WHERE outcome <> 'retry'
  GROUP BY query_id), outcomes AS (
  SELECT j.query_id, j.outcome, j.attempt + 1 AS attempts
  FROM judged j JOIN finals f ON j.query_id = f.query_id AND j.attempt = f.final_attempt)"""
LEDGER = f"""{ATTEMPTS}, ledger AS (
  SELECT count(*) AS processed, count(*) FILTER (outcome = 'success') AS success,
         count(*) FILTER (outcome <> 'success') AS failed,
         CAST(coalesce(sum(attempts - 1) FILTER (outcome = 'success'), 0) AS BIGINT) AS total_retried,
         CAST(coalesce(sum(attempts - 1) FILTER (outcome <> 'success'), 0) AS BIGINT) AS failed_after_retry,
         CAST(sum(attempts) AS BIGINT) AS total_attempts
  FROM outcomes)"""
COUNTS = f"""{BASKETS}, uses AS (
  SELECT query_id, trim(lower(unnest(tags))) AS tag, generate_subscripts(tags, 1) AS pos
  FROM baskets), counts AS (
  SELECT tag, count(*) AS count, min(query_id * 1000 + pos) AS seen FROM uses WHERE tag <> ''
  GROUP BY tag)"""
CORPUS_COLUMNS = "query_id, name, description, array_to_string(tags, '|') AS tags, owner, query_sql"


def _pairs(source: str) -> str:
    return f"""sets AS (
  SELECT query_id, list_sort(list_distinct(tags)) AS tags FROM {source}), pairs AS (
  SELECT query_id, tags[i] AS tag1, tags[j] AS tag2 FROM (
    SELECT query_id, tags, i, unnest(generate_series(i + 1, len(tags))) AS j FROM (
      SELECT query_id, tags, unnest(generate_series(1, len(tags))) AS i FROM sets)))
SELECT tag1, tag2, count(*) AS count FROM pairs GROUP BY tag1, tag2
ORDER BY count(*) DESC, min(query_id), tag1, tag2 LIMIT 20"""


def _gaps(missing: bool = False) -> str:
    nexts = NEXT.replace("FROM ids", "FROM missing") if missing else NEXT
    return f"""{nexts}
SELECT count(*) AS total_ids, min(query_id) AS min_id, max(query_id) AS max_id,
       max(query_id) - min(query_id) + 1 AS id_range_span,
       round(avg(next_id - query_id), 6) AS average_gap,
       round(median(next_id - query_id), 6) AS median_gap, max(next_id - query_id) AS max_gap,
       count(*) FILTER (next_id - query_id > 1) AS gaps_over_1,
       count(*) FILTER (next_id - query_id > 10) AS gaps_over_10,
       count(*) FILTER (next_id - query_id > 100) AS gaps_over_100,
       round(count(*) / (SELECT hi - lo + 1 FROM rng) * 100, 6) AS coverage_percentage
FROM nexts"""


def _batches(starts: str, last: str, size: int) -> str:
    end = f"least(batch_start + {size - 1}, {last})"
    return (f"batch_start, {end} AS batch_end, concat(CAST(batch_start AS VARCHAR), '-', "
            f"CAST({end} AS VARCHAR), '.parquet') AS file_name FROM {starts}")


def _hashed(mode: str) -> str:
    if mode == "sql":
        return f"""{SQL_TEXTS}, hashed AS (
  SELECT *, {_hash('normalized_text')} AS hash FROM (
    SELECT *, {_normalize_sql('query_sql')} AS normalized_text FROM sql_texts))"""
    return f"""{CORPUS}, hashed AS (
  SELECT *, {_hash('normalized_text')} AS hash FROM (
    SELECT *, {_normalize(DESCRIBED)} AS normalized_text FROM corpus))"""


DESCRIBED = "concat_ws(' ', nullif(name, ''), nullif(description, ''), array_to_string(tags, ' '))"
SEMANTIC = ("concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(owner, ''), "
            "array_to_string(tags, ' '))")
STRUCTURE = f"""{SQL_TEXTS}, hashed AS (
  SELECT *, {_hash('normalized_text')} AS hash FROM (
    SELECT *, {_mask(_normalize_sql('query_sql'))} AS normalized_text FROM sql_texts))"""
DUPLICATES = """SELECT query_id, normalized_text, hash FROM hashed
WHERE hash IN (SELECT hash FROM hashed GROUP BY hash HAVING count(*) > 1)"""


def _names(limit: int = 3) -> str:
    return f"""names AS (
  SELECT hash, string_agg(name, '|' ORDER BY query_id) AS sample_names FROM (
    SELECT hash, query_id, name, row_number() OVER (PARTITION BY hash ORDER BY query_id) AS n
    FROM hashed) WHERE n <= {limit} GROUP BY hash)"""


GROUPS = """groups AS (
  SELECT hash, count(*) AS count, count(DISTINCT owner) AS n_owners FROM hashed
  GROUP BY hash HAVING count(*) > 1)"""
OWNERS = """owners AS (
  SELECT hash, string_agg(owner, '|' ORDER BY owner) AS sample_owners FROM (
    SELECT hash, owner, row_number() OVER (PARTITION BY hash ORDER BY owner) AS n FROM (
      SELECT DISTINCT hash, owner FROM hashed WHERE owner IS NOT NULL)) WHERE n <= 3 GROUP BY hash)"""


def _duplicate_queries(mode: str) -> dict[str, str]:
    rows = f"WITH {_hashed(mode)}"
    return {
        f"duplicates_{mode}": f"{rows} {DUPLICATES}",
        f"duplicate_groups_{mode}": f"""{rows}, {GROUPS}, {_names()}
SELECT hash, count, sample_names, n_owners FROM groups JOIN names USING (hash)""",
        f"duplicate_group_owners_{mode}": f"""{rows}, {GROUPS}
SELECT DISTINCT hash, owner FROM hashed JOIN groups USING (hash) WHERE owner IS NOT NULL""",
        f"top_duplicate_groups_{mode}": f"""{rows}, {GROUPS}, {_names()}, {OWNERS}
SELECT hash, count, sample_names, coalesce(sample_owners, '') AS sample_owners
FROM groups JOIN names USING (hash) LEFT JOIN owners USING (hash)
ORDER BY count DESC, hash LIMIT 10""",
        f"duplicate_summary_{mode}": f"""{rows}, per_hash AS (
  SELECT hash, count(*) AS n FROM hashed GROUP BY hash)
SELECT CAST(sum(n) AS BIGINT) AS total_queries,
       CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_entries,
       round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n) * 100, 6) AS duplicate_ratio,
       count(*) FILTER (n > 1) AS duplicate_patterns FROM per_hash""",
    }


def _deduplicated(rows: str, key: str) -> str:
    return f"""WITH {rows}
SELECT query_id, query_sql FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY query_id) AS n FROM hashed)
WHERE n = 1"""


PROFILE = f"""{CORPUS}, uses AS (
  SELECT cluster, query_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM corpus),
ranked AS (
  SELECT cluster, tag, count, row_number() OVER (
    PARTITION BY cluster ORDER BY count DESC, seen) AS rank
  FROM (SELECT cluster, tag, count(*) AS count, min(query_id * 1000 + pos) AS seen
        FROM uses GROUP BY cluster, tag)), firsts AS (
  SELECT cluster, name, row_number() OVER (PARTITION BY cluster ORDER BY query_id) AS rank
  FROM corpus), profile AS (
  SELECT cluster AS cluster_id, count(*) AS size, avg(length(name)) AS avg_name_length
  FROM corpus GROUP BY cluster)"""
PROFILE_ROWS = f"""WITH {PROFILE}
SELECT cluster_id, size,
       (SELECT string_agg(tag, '|' ORDER BY rank) FROM ranked r
        WHERE r.cluster = cluster_id AND rank <= 5) AS top_tags,
       (SELECT string_agg(name, '|' ORDER BY rank) FROM firsts f
        WHERE f.cluster = cluster_id AND rank <= 3) AS sample_names,
       round(avg_name_length, 6) AS avg_name_length FROM profile"""
SUMMARY_ROWS = f"""WITH {PROFILE}
SELECT cluster_id, size,
       coalesce((SELECT string_agg(tag, ', ' ORDER BY rank) FROM ranked r
        WHERE r.cluster = cluster_id AND rank <= 5), 'None') AS top_tags,
       (SELECT string_agg(substr(name, 1, 60), ' | ' ORDER BY rank) FROM firsts f
        WHERE f.cluster = cluster_id AND rank <= 3) AS sample_names,
       round(avg_name_length, 6) AS avg_name_length FROM profile"""


def _keywords(expression: str) -> str:
    stop = ", ".join("'" + word.replace("'", "''") + "'" for word in ENGLISH)
    return f"""WITH {CORPUS}, words AS (
  SELECT cluster, unnest(regexp_extract_all(lower({expression}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM corpus WHERE cluster <> -1), ranked AS (
  SELECT cluster, term, row_number() OVER (
    PARTITION BY cluster ORDER BY count(*) DESC, term) AS rank
  FROM words WHERE term NOT IN ({stop}) GROUP BY cluster, term)
SELECT cluster, string_agg(term, '|' ORDER BY term) AS keywords FROM ranked
WHERE rank <= 10 GROUP BY cluster"""


def _metrics() -> str:
    tail = SILHOUETTE.removeprefix(POINTS + ", ").replace("sizes", "cluster_sizes")
    tight = TIGHTNESS.removeprefix(POINTS + ", ")
    return f"""WITH {CENTROIDS}, {tail}, {tight}, {CALINSKI}, {DAVIES}, {AGREEMENT}, metrics AS (
  SELECT 'semantic' AS mode,
         (SELECT round(silhouette_score, 6) FROM silhouette) AS silhouette_score,
         (SELECT round(davies_bouldin_index, 6) FROM davies) AS davies_bouldin_index,
         (SELECT round(calinski_harabasz_score, 6) FROM calinski) AS calinski_harabasz_score,
         (SELECT round(h, 6) FROM hc) AS homogeneity_score,
         (SELECT round(c, 6) FROM hc) AS completeness_score,
         (SELECT round(2 * h * c / (h + c), 6) FROM hc) AS v_measure_score,
         (SELECT round(avg(tightness), 6) FROM tightness) AS avg_cluster_tightness,
         (SELECT count(DISTINCT cluster) FROM points) AS n_clusters,
         CAST(0 AS BIGINT) AS n_noise, (SELECT count(*) FROM points) AS n_clustered)"""


def all_sql() -> dict[str, str]:
    corpus_rows = f"WITH {CORPUS} SELECT {CORPUS_COLUMNS} FROM corpus"
    tag_rows = f"WITH {COUNTS} SELECT tag, count FROM counts"
    total = "(SELECT hi - lo + 1 FROM rng)"
    cursor = (f"WITH {LEDGER} SELECT processed AS total_processed, success AS total_success, "
              "failed AS total_failed")
    sql = {
        "load_corpus": corpus_rows,
        "load_corpus_limit": f"{corpus_rows} ORDER BY query_id LIMIT {LOAD_LIMIT}",
        "load_masked_sample": f"""WITH {RAW}
SELECT query_id, {_mask('name')} AS name, {_mask('description')} AS description,
       array_to_string({_tags('tags')}, '|') AS tags
FROM raw WHERE description IS NOT NULL ORDER BY query_id LIMIT {LOAD_LIMIT}""",
        "load_report": """SELECT DISTINCT concat(
         CASE WHEN n_chars >= 500 THEN 'description string,' ELSE '' END,
         'name string,owner string,query_id int64,query_sql string,tags list<element: string>')
       AS columns, CAST(NULL AS VARCHAR) AS error FROM documents""",
        "saved_ids": "SELECT DISTINCT doc_id AS query_id FROM documents",
        "high_water_mark": "SELECT max(doc_id) AS total_processed FROM documents",
        "load_cursor": f"{cursor} FROM ledger",
        "write_cursor": f"{cursor}, true AS has_last_run FROM ledger",
        "resume_cursor": f"""WITH {LEDGER}
SELECT greatest(processed, (SELECT max(doc_id) FROM documents)) AS total_processed,
       success AS total_success, failed AS total_failed FROM ledger""",
        "incremental_rows": f"""WITH {SQL_TEXTS}, {LEDGER}
SELECT query_id, query_sql FROM sql_texts WHERE query_id > (SELECT processed FROM ledger)""",
        "incremental_stream": corpus_rows,
        "incremental_stream_drifting": corpus_rows,
        "write_corpus": corpus_rows,
        "write_clustered": f"WITH {CORPUS} SELECT {CORPUS_COLUMNS}, cluster FROM corpus",
        "write_by_cluster": f"WITH {CORPUS} SELECT {CORPUS_COLUMNS}, cluster FROM corpus",
        "write_cluster_stats": PROFILE_ROWS,
        "write_keywords": _keywords(DESCRIBED),
        "write_tags": tag_rows,
        "write_tags_tsv": tag_rows,
        "write_cooccurrence_tsv": f"WITH {CORPUS}, {_pairs('corpus')}",
        "frequent_pairs": f"WITH {CORPUS}, {_pairs('corpus')}",
        "write_duplicates": f"WITH {_hashed('sql')} SELECT query_id, hash FROM ({DUPLICATES})",
        "write_deduplicated": f"""WITH {CORPUS}
SELECT {CORPUS_COLUMNS} FROM (
  SELECT *, row_number() OVER (
    PARTITION BY {_normalize_sql('query_sql')} ORDER BY query_id) AS n FROM corpus) WHERE n = 1""",
        "write_cluster_state": f"""WITH {POINTS}
SELECT query_id, cluster, CAST(len(v) AS INTEGER) AS dimensions, round(list_sum(v), 6) AS total
FROM points""",
        "text_semantic": f"WITH {CORPUS} SELECT query_id, {SEMANTIC} AS text FROM corpus",
        "text_sql": f"WITH {SQL_TEXTS} SELECT query_id, {_clean('query_sql')} AS text FROM sql_texts",
        "dedup_text_semantic":
            f"WITH {CORPUS} SELECT query_id, {_normalize(DESCRIBED)} AS text FROM corpus",
        "dedup_text_sql":
            f"WITH {SQL_TEXTS} SELECT query_id, {_normalize_sql('query_sql')} AS text FROM sql_texts",
        "keyword_text_semantic": f"WITH {CORPUS} SELECT query_id, {DESCRIBED} AS text FROM corpus",
        "keyword_text_sql": "SELECT doc_id AS query_id, text FROM documents",
        "blank_text_count": f"""WITH {CORPUS}
SELECT count(*) FILTER ({_strip('description')} = '') AS blank_descriptions,
       count(*) FILTER ({_strip(SEMANTIC)} = '') AS blank_semantic,
       count(*) FILTER ({_clean('query_sql')} = '') AS blank_sql FROM corpus""",
        "fn_normalize_text":
            f"SELECT doc_id AS query_id, {_normalize('text')} AS text FROM documents",
        "fn_clean_sql": f"WITH {SQL_TEXTS} SELECT query_id, {_clean('query_sql')} AS text FROM sql_texts",
        "fn_normalize_sql":
            f"WITH {SQL_TEXTS} SELECT query_id, {_normalize_sql('query_sql')} AS text FROM sql_texts",
        "fn_normalize_sql_documents":
            f"SELECT doc_id AS query_id, {_normalize_sql('text')} AS text FROM documents",
        "fn_hash": "SELECT doc_id AS query_id, sha1(text) AS text FROM documents",
        "fn_mask_literals": f"WITH {SQL_TEXTS} SELECT query_id, {_mask('query_sql')} AS text FROM sql_texts",
        "fn_mask_literals_documents":
            f"SELECT doc_id AS query_id, {_mask('text')} AS text FROM documents",
        "fn_normalize_tags": f"""WITH {BASKETS}
SELECT query_id, array_to_string({_tags('tags')}, '|') AS tags FROM baskets""",
        "fn_tokens": r"""SELECT doc_id AS query_id,
       coalesce(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), '|'), '') AS text
FROM documents""",
        "fn_euclidean": f"""WITH {CENTROIDS}
SELECT query_id, cluster, round(distance, 6) AS distance FROM spread""",
        "missing_ids": f"WITH {LINE_IDS}, {MISSING} SELECT query_id FROM missing",
        "missing_ranges": f"WITH {LINE_IDS}, {RANGES} SELECT start_id, end_id FROM ranges",
        "consecutive_ranges": f"""WITH {LINE_IDS}
SELECT min(query_id) AS start_id, max(query_id) AS end_id
FROM (SELECT query_id, query_id - row_number() OVER (ORDER BY query_id) AS island FROM ids)
GROUP BY island""",
        "largest_missing_ranges": f"""WITH {LINE_IDS}, {RANGES}
SELECT end_id - start_id + 1 AS size, start_id, end_id FROM ranges
ORDER BY size DESC, start_id DESC, end_id DESC LIMIT 5""",
        "coverage_summary": f"""WITH {LINE_IDS}, {MISSING}
SELECT {total} AS total_ids, (SELECT count(*) FROM ids) AS saved_ids,
       (SELECT count(*) FROM missing) AS missing_ids,
       round((SELECT count(*) FROM ids) / {total} * 100, 6) AS percentage_saved""",
        "coverage_pie": f"""WITH {LINE_IDS}, slices AS (
  SELECT 'Found' AS slice, count(*) AS ids FROM ids
  UNION ALL SELECT 'Missing', {total} - count(*) FROM ids)
SELECT slice, ids, round(ids / {total} * 100, 6) AS share FROM slices""",
        "coverage_timeline": f"""WITH {LINE_IDS}
SELECT query_id, round(row_number() OVER (ORDER BY query_id) / {total} * 100, 6) AS coverage_pct
FROM ids""",
        "id_gaps": f"""WITH {LINE_IDS}, {NEXT}
SELECT query_id, next_id - query_id AS gap FROM nexts WHERE next_id IS NOT NULL""",
        "gap_statistics": f"WITH {LINE_IDS}, {_gaps()}",
        "gap_statistics_labels": f"WITH {LABEL_IDS}, {_gaps()}",
        "missing_gap_statistics": f"WITH {LABEL_IDS}, {MISSING}, {_gaps(missing=True)}",
        "gap_histogram": f"""WITH {LABEL_IDS}, {NEXT}, gaps AS (
  SELECT next_id - query_id AS gap FROM nexts WHERE next_id IS NOT NULL), b AS (
  SELECT min(gap) AS lo, max(gap) AS hi FROM gaps), placed AS (
  SELECT CAST(least(floor((gap - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS bin, count(*) AS n
  FROM gaps, b GROUP BY 1)
SELECT e.bin, round(lo + (hi - lo) * e.bin / 50, 6) AS lower,
       round(lo + (hi - lo) * (e.bin + 1) / 50, 6) AS upper, coalesce(n, 0) AS frequency
FROM (SELECT CAST(unnest(generate_series(0, 49)) AS INTEGER) AS bin) e
CROSS JOIN b LEFT JOIN placed USING (bin)""",
        "batch_plan": f"""WITH {LINE_IDS}, starts AS (
  SELECT unnest(generate_series(lo, hi, 500)) AS batch_start, hi FROM rng)
SELECT {_batches('starts', 'hi', 500)}""",
        "retry_plan": f"""WITH {LINE_IDS}, {RANGES}, starts AS (
  SELECT start_id AS range_start, end_id AS range_end,
         unnest(generate_series(start_id, end_id, {BATCH})) AS batch_start FROM ranges)
SELECT range_start, range_end, {_batches('starts', 'range_end', BATCH)}""",
        "retry_totals": f"""WITH {LINE_IDS}, {RANGES}
SELECT count(*) AS ranges, CAST(coalesce(sum(end_id - start_id + 1), 0) AS BIGINT) AS ids_to_retry
FROM ranges""",
        "attempt_outcomes": f"""WITH {ATTEMPTS}
SELECT query_id, attempt, status, outcome,
       CASE WHEN outcome = 'retry' THEN power(2.0, attempt) END AS delay
FROM judged LEFT JOIN finals USING (query_id)
WHERE final_attempt IS NULL OR attempt <= final_attempt""",
        "fetch_ledger": f"""WITH {LEDGER}
SELECT *, round(total_attempts / processed, 6) AS avg_attempts FROM ledger""",
        "tag_counts": tag_rows,
        "tag_statistics": f"""WITH {COUNTS}
SELECT count(*) AS total_queries, (SELECT count(*) FROM counts) AS unique_tags,
       CAST(sum(len(tags)) AS BIGINT) AS total_tag_assignments,
       count(*) FILTER (len(tags) > 0) AS queries_with_tags,
       count(*) FILTER (len(tags) = 0) AS queries_without_tags,
       round(avg(len(tags)), 6) AS avg_tags_per_query,
       CAST(min(len(tags)) AS INTEGER) AS min_tags_per_query,
       CAST(max(len(tags)) AS INTEGER) AS max_tags_per_query,
       round(count(*) FILTER (len(tags) > 0) / count(*) * 100, 6) AS percentage_with_tags
FROM baskets""",
        "tag_cooccurrence": f"""WITH {BASKETS}, clean AS (
  SELECT query_id, {_tags('tags')} AS tags FROM baskets), {_pairs('clean')}""",
        "top_tags_share": f"""WITH {COUNTS}
SELECT tag, count, round(count / (SELECT count(*) FROM baskets) * 100, 6) AS percentage,
       CAST(floor(count / (SELECT count(*) FROM baskets) * 100 / 2) AS BIGINT) AS bar_width
FROM counts ORDER BY count DESC, seen LIMIT 15""",
        "chart_top_tags": f"{tag_rows} ORDER BY count DESC, seen LIMIT 50",
        "chart_tag_share": f"""WITH {COUNTS}, top AS (
  SELECT tag, count FROM counts ORDER BY count DESC, seen LIMIT 20)
SELECT tag, count, round(count / (SELECT sum(count) FROM top) * 100, 6) AS share FROM top""",
        "duplicates_structure": f"WITH {STRUCTURE} {DUPLICATES}",
        "deduplicated_exact": _deduplicated(_hashed("sql"), "normalized_text"),
        "deduplicated_hash": _deduplicated(_hashed("sql"), "hash"),
        "deduplicated_structure": _deduplicated(STRUCTURE, "hash"),
        "duplication_by_cluster": f"""WITH {_hashed('sql')}, copies AS (
  SELECT cluster, count(*) OVER (PARTITION BY hash) AS n FROM hashed)
SELECT cluster, count(*) AS total_queries, count(*) FILTER (n > 1) AS duplicate_entries,
       round(count(*) FILTER (n > 1) / count(*) * 100, 6) AS duplicate_ratio
FROM copies GROUP BY cluster""",
        "attach_labels": f"WITH {CORPUS} SELECT query_id, name, cluster FROM corpus",
        "cluster_profile": PROFILE_ROWS,
        "cluster_summary": SUMMARY_ROWS,
        "cluster_top_tags":
            f"WITH {PROFILE} SELECT cluster, CAST(rank AS INTEGER) AS rank, tag, count FROM ranked WHERE rank <= 5",
        "cluster_sample_names":
            f"WITH {PROFILE} SELECT cluster, CAST(rank AS INTEGER) AS rank, name FROM firsts WHERE rank <= 3",
        "cluster_keywords_sql": _keywords("query_sql"),
        "cluster_keywords_semantic": _keywords(DESCRIBED),
        "cluster_counts": f"""WITH {RAW}
SELECT count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters,
       count(*) FILTER (cluster = -1) AS n_noise, count(*) FILTER (cluster <> -1) AS n_clustered
FROM raw""",
        "label_contingency": f"""WITH {POINTS}
SELECT pseudo, cluster, count(*) AS count FROM points GROUP BY pseudo, cluster""",
        "cluster_tightness":
            f"WITH {TIGHTNESS} SELECT cluster, size, round(tightness, 6) AS tightness FROM tightness",
        "tightest_clusters": f"""WITH {TIGHTNESS}
SELECT cluster, size, round(tightness, 6) AS tightness FROM tightness
ORDER BY tightness.tightness, cluster LIMIT 5""",
        "silhouette":
            f"WITH {SILHOUETTE} SELECT round(silhouette_score, 6) AS silhouette_score FROM silhouette",
        "davies_bouldin": f"""WITH {CENTROIDS}, {DAVIES}
SELECT round(davies_bouldin_index, 6) AS davies_bouldin_index FROM davies""",
        "calinski_harabasz": f"""WITH {CENTROIDS}, {CALINSKI}
SELECT round(calinski_harabasz_score, 6) AS calinski_harabasz_score FROM calinski""",
        "homogeneity": f"WITH {POINTS}, {AGREEMENT} SELECT round(h, 6) AS homogeneity_score FROM hc",
        "completeness": f"WITH {POINTS}, {AGREEMENT} SELECT round(c, 6) AS completeness_score FROM hc",
        "v_measure": f"""WITH {POINTS}, {AGREEMENT}
SELECT round(2 * h * c / (h + c), 6) AS v_measure_score FROM hc""",
        # the points are pulled apart by label, so the labels are the clusters to be
        # found; they are numbered by their lowest id
        "density_clusters": f"""WITH {POINTS}, firsts AS (
  SELECT cluster, min(query_id) AS first_id FROM points GROUP BY cluster), numbers AS (
  SELECT cluster, CAST(row_number() OVER (ORDER BY first_id) - 1 AS INTEGER) AS number FROM firsts)
SELECT query_id, number AS cluster FROM points JOIN numbers USING (cluster)""",
        # a row is placed on its own spot, in its own cluster
        "score_corpus": "SELECT doc_id AS query_id, true AS same_cluster FROM documents",
        "duplicates_arriving": f"""WITH {_hashed('sql')}
SELECT hash, count(*) AS copies, min(query_id) AS first_id FROM hashed GROUP BY hash HAVING count(*) > 1""",
        "near_duplicates": f"""WITH RECURSIVE t AS (
  SELECT doc_id AS query_id, {_normalize_sql("coalesce(text, '')")} AS x FROM documents),
firsts AS (SELECT x, min(query_id) AS id, string_split(x, ' ') AS w FROM t GROUP BY x),
grams AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM firsts WHERE x <> '')),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id
  GROUP BY a.id, b.id),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
  WHERE c / (x.n + y.n - c) >= 0.8),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS g FROM firsts UNION
  SELECT l.b, r.g FROM reach r JOIN both_ways l ON l.a = r.id),
groups AS (SELECT id, min(g) AS group_id FROM reach GROUP BY id)
SELECT query_id, group_id FROM t JOIN firsts USING (x) JOIN groups USING (id)""",
        "cluster_metrics": f"{_metrics()} SELECT * FROM metrics",
        "write_metrics": f"{_metrics()} SELECT * FROM metrics",
        "assessment": f"""{_metrics()}
SELECT CASE WHEN silhouette_score > 0.5 THEN 'EXCELLENT' WHEN silhouette_score > 0.3 THEN 'GOOD'
            WHEN silhouette_score > 0.1 THEN 'FAIR' ELSE 'POOR' END AS separation,
       CASE WHEN homogeneity_score > 0.7 THEN 'VERY HOMOGENEOUS'
            WHEN homogeneity_score > 0.5 THEN 'HOMOGENEOUS'
            WHEN homogeneity_score > 0.3 THEN 'MODERATELY HOMOGENEOUS'
            ELSE 'LOW HOMOGENEITY' END AS homogeneity
FROM metrics""",
    }
    sql["high_water_mark_footers"] = sql["high_water_mark"]
    sql["fetch_ledger_stream"] = sql["fetch_ledger"]
    sql["neighbour_graph"] = f"""WITH {POINTS}, sites AS (SELECT v, min(query_id) AS id FROM points GROUP BY v)
SELECT a.id AS query_id, b.id AS neighbour_id, CAST(row_number() OVER (
  PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS INTEGER) AS place
FROM sites a JOIN sites b ON a.id <> b.id QUALIFY place <= 15"""
    # a point that is moved a little stays in its cluster
    sql["place_points"] = sql["density_clusters"]
    for mode in ("sql", "semantic"):
        sql.update(_duplicate_queries(mode))
    return sql
