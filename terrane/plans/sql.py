"""The queries in SQL, for a second engine on the same tables."""

from __future__ import annotations

from terrane.functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}-]{2,}')"

_SPACE = f"""
toks AS (SELECT doc_id AS id, unnest({_TOK}) AS term FROM documents),
cnt AS (SELECT id, term, count(*) AS n FROM toks WHERE term NOT IN ({_STOP}) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
num AS (SELECT count(*) AS nn FROM documents),
vocab AS (SELECT term, df, ln((1 + nn) / (1 + df)) + 1 AS idf FROM dfs, num WHERE df >= 2 AND df <= 0.15::DOUBLE * nn
          ORDER BY round(df * pow(ln(nn / df), 2), 9) DESC, term LIMIT 384),
raw AS (SELECT id, c.term, (1 + ln(n)) * idf AS w FROM cnt c JOIN vocab v ON c.term = v.term),
vecs AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
qtok AS (SELECT item_id AS q, unnest({_TOK}) AS term FROM benchmark),
qraw AS (SELECT q, t.term, (1 + ln(count(*))) * max(idf) AS w FROM qtok t JOIN vocab v ON t.term = v.term GROUP BY ALL),
qvec AS (SELECT q, term, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS w FROM qraw),
scores AS (SELECT q, id, sum(v.w * x.w) AS score FROM vecs v JOIN qvec x ON v.term = x.term GROUP BY q, id)
"""
_AUTH = """
works AS (SELECT o_orderkey AS work, year(o_orderdate) AS year FROM orders),
au0 AS (SELECT l_orderkey AS work, l_partkey AS author, min(l_linenumber) AS line FROM lineitem GROUP BY ALL),
auth AS (SELECT work, author, row_number() OVER (PARTITION BY work ORDER BY line, author) AS pos, count(*) OVER (PARTITION BY work) AS n_authors FROM au0)
"""
_SIG = """
sig AS (SELECT author, count(*) FILTER (WHERE year >= 1998) AS recent_output, max(year) AS publication_recency FROM auth JOIN works USING (work) GROUP BY author)
"""
_PAIRS = """
pairs AS (SELECT x.author AS a, y.author AS b, count(*) AS n, max(year) AS latest
          FROM auth x JOIN auth y ON x.work = y.work AND x.author < y.author JOIN works w ON w.work = x.work WHERE x.n_authors <= 50 GROUP BY ALL)
"""
_NAME = r"len(list_filter(regexp_extract_all(name, '\p{L}[\p{L}\p{M}''’-]*'), lambda t: len(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 2)) >= 2"
_STATS = """
stats AS (SELECT author, count(*) AS n_works, bool_or(year >= 1998) AS recent, bool_or(pos = 1 OR pos = n_authors) AS lead
          FROM auth JOIN works USING (work) WHERE n_authors <= 50 GROUP BY author)
"""
_KEEP = f"keep AS (SELECT p_partkey AS author FROM (SELECT p_partkey, p_name AS name FROM part) p JOIN stats s ON s.author = p_partkey WHERE {_NAME} AND n_works >= 3 AND recent AND lead)"
_VEC = """
units AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS vec FROM embeddings),
parts AS (SELECT label, d, sum(vec[d + 1]) AS x FROM units, (SELECT unnest(range(64)) AS d) GROUP BY ALL),
sized AS (SELECT label, list(x ORDER BY d) AS v, sqrt(sum(x * x)) AS n FROM parts GROUP BY label),
cents AS (SELECT label, list_transform(v, lambda y: y / n) AS vec FROM sized),
near0 AS (SELECT u.id, c.label AS theme, round(list_dot_product(u.vec, c.vec), 6) AS score FROM units u, cents c),
near AS (SELECT id, theme, score FROM near0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, theme) = 1)
"""
_FIT = """
q0 AS (SELECT vec AS q FROM cents WHERE label = 0),
th AS (SELECT vec AS t, list_dot_product(q, vec) AS qt FROM cents, q0),
fits AS (SELECT id, greatest(0.0::DOUBLE, max(list_dot_product(vec, q))) AS direct, greatest(0.0::DOUBLE, max(qt * list_dot_product(vec, t))) AS fit
         FROM units, q0, th GROUP BY id)
"""


def _faculty(fit: str) -> str:
    return f"""ranked AS (SELECT id, round(0.55::DOUBLE * {fit} + 0.25::DOUBLE * direct + 0.12::DOUBLE * greatest(0, 1 - (2001 - publication_recency) / 4)
      + 0.08::DOUBLE * least(1, recent_output / 8), 6) AS score FROM fits JOIN sig ON sig.author = id ORDER BY score DESC, id LIMIT 12)"""


_THEMES = """
reps AS (SELECT doc_id AS id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5),
tl AS (SELECT b.item_id AS q, r.source, round(sum(coalesce(s.score, 0)) / count(*), 6) AS score
       FROM reps r CROSS JOIN benchmark b LEFT JOIN scores s ON s.id = r.id AND s.q = b.item_id GROUP BY b.item_id, r.source),
every AS (SELECT b.item_id AS q, d.source, d.doc_id AS id, round(coalesce(s.score, 0), 6) AS score
          FROM documents d CROSS JOIN benchmark b LEFT JOIN scores s ON s.id = d.doc_id AND s.q = b.item_id),
cp AS (SELECT q, source, id, score FROM every QUALIFY row_number() OVER (PARTITION BY q, source ORDER BY score DESC, id) = 1)
"""
_ROLL = """
roll AS (SELECT theme, count(*) AS publication_count, count(*) FILTER (WHERE year >= 1998) AS recent_publications
         FROM near JOIN works ON work = id WHERE score >= 0 GROUP BY theme),
rk AS (SELECT theme, id, row_number() OVER (PARTITION BY theme ORDER BY score DESC, id) AS r FROM near JOIN works ON work = id WHERE score >= 0),
rolled AS (SELECT r.*, coalesce(f.k, 0) AS faculty_count, t.representative_publications FROM roll r
  LEFT JOIN (SELECT theme, count(DISTINCT author) AS k FROM near JOIN works ON work = id JOIN auth a ON a.work = id WHERE score >= 0 GROUP BY theme) f USING (theme)
  JOIN (SELECT theme, string_agg(id::VARCHAR, ',' ORDER BY r) AS representative_publications FROM rk WHERE r <= 5 GROUP BY theme) t USING (theme)),
toa AS (SELECT DISTINCT author, theme FROM auth JOIN near ON id = work)
"""
_GROUPS = """
mean AS (SELECT p_brand AS "group", d, avg(vec[d + 1]) AS x FROM part JOIN units ON id = p_partkey, (SELECT unnest(range(64)) AS d) GROUP BY ALL),
gs AS (SELECT "group", label AS theme, sum(x * vec[d + 1]) AS score FROM mean, cents GROUP BY ALL),
gt AS (SELECT "group", theme, score FROM gs QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY round(score, 12) DESC, theme) = 1)
"""

_LISTS = {
    "dept": "Biology|Chemistry|Physics|Psychology|Computer Science|Biomedical Engineering|Earth and Environmental Sciences|Public Health|Political Science|Sociology|History|English|Mathematics|Information Studies|Architecture",
    "topic": "Climate resilience|Machine learning|Public health equity|Quantum materials|Civic media|Neural development|Water systems|Digital humanities|Autonomous systems|Inclusive education|Urban policy|Cellular metabolism|Cybersecurity|Migration studies|Renewable energy",
    "one": "Avery|Jordan|Taylor|Morgan|Riley|Casey|Cameron|Quinn|Parker|Reese|Skyler|Drew|Alex|Jamie|Rowan|Emerson|Harper|Dakota|Hayden|Finley",
    "two": "Adams|Bennett|Chen|Diaz|Evans|Foster|Gupta|Hassan|Ito|Johnson|Kim|Lopez|Martin|Nguyen|Owens|Patel|Rivera|Singh|Turner|Williams",
}
_pick = lambda name, i: f"(string_split('{_LISTS[name]}', '|'))[({i}) % {len(_LISTS[name].split('|'))} + 1]"
_SYNTHETIC = f"""
syn AS (SELECT i, {_pick("dept", "i")} AS dept, {_pick("topic", "i * 7")} AS topic, 'fallback-person-' || (i + 1) AS me,
        'fallback-person-' || ((i + 1) % 300 + 1) AS next FROM (SELECT unnest(range(300)) AS i))
"""

ORACLE_SQL = {
    "token_counts": f"WITH {_SPACE} SELECT id, term, n, round(1 + ln(n), 6) AS tf FROM cnt",
    "document_frequency": f"WITH {_SPACE} SELECT term, df FROM dfs",
    "vocabulary_select": f"WITH {_SPACE} SELECT term, df, round(idf, 6) AS idf FROM vocab",
    "tfidf_vectors_long": f"WITH {_SPACE} SELECT id, term, round(w, 6) AS w FROM vecs",
    "text_search_topk": f"WITH {_SPACE} SELECT id, round(score, 6) AS score FROM scores WHERE q = 0 ORDER BY round(score, 6) DESC, id LIMIT 12",
    "sparse_query_guard": f"WITH {_SPACE} SELECT q AS id, count(*) AS dims FROM qvec GROUP BY q HAVING count(*) >= 3",
    "word_chunks": r"""WITH w AS (SELECT doc_id AS id, regexp_split_to_array(text, '\s+') AS w FROM documents),
      c AS (SELECT id, w, unnest(range((len(w) + 179) // 180)) AS chunk FROM w)
      SELECT id, chunk::INTEGER AS chunk, md5(array_to_string(w[chunk * 180 + 1 : chunk * 180 + 180], ' ')) AS digest FROM c""",
    "substring_search": "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'idiot')",
    "lexical_paper_scores": f"WITH {_SPACE} SELECT q, id, round(score, 6) AS score FROM scores",
    "author_composite": f"""WITH {_SPACE}, {_AUTH}, s AS (SELECT author AS person, term, sum(w * CASE WHEN year >= 1998 THEN 2 ELSE 1 END) AS w
      FROM auth JOIN works USING (work) JOIN vecs ON id = work GROUP BY ALL)
      SELECT person, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY person)), 6) AS w FROM s""",
    "theme_ranking_lexical": f"WITH {_SPACE}, {_THEMES} SELECT q, source, score FROM tl",
    "closest_paper_per_person": f"WITH {_SPACE}, {_THEMES} SELECT q, source, id, score FROM cp",
    "explanation_text": f"""WITH {_SPACE}, {_THEMES}, top AS (SELECT q, source AS theme FROM tl QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, source) = 1)
      SELECT cp.q, cp.source, 'Closest work ' || id || '; strongest theme ' || theme || '.' AS reason FROM cp JOIN top ON top.q = cp.q""",
    "oversized_filter": f"WITH {_AUTH} SELECT work, author, n_authors FROM auth WHERE n_authors <= 4",
    "author_stats": f"WITH {_AUTH}, {_STATS} SELECT author, n_works, recent, lead FROM stats",
    "plausible_name": f"SELECT author, name, {_NAME} AS plausible FROM (SELECT p_partkey AS author, p_name AS name FROM part UNION ALL SELECT c_custkey, c_name FROM customer)",
    "retained_people": f"WITH {_AUTH}, {_STATS}, {_KEEP} SELECT author FROM keep",
    "retained_publications": f"WITH {_AUTH}, {_STATS}, {_KEEP} SELECT DISTINCT work FROM auth JOIN keep USING (author)",
    "coauthor_rollup": f"WITH {_AUTH}, {_PAIRS} SELECT a, b, n, latest FROM pairs",
    "coauthor_edges": f"WITH {_AUTH}, {_PAIRS} SELECT a AS src, b AS dst, n FROM pairs UNION ALL SELECT b, a, n FROM pairs",
    "activity_signals": f"""WITH {_AUTH}, {_SIG} SELECT author, recent_output, publication_recency, false AS opted_in,
      round(greatest(0.0::DOUBLE, 1 - (2001 - publication_recency) / 4), 6) AS recency, round(least(1.0::DOUBLE, recent_output / 8), 6) AS output FROM sig""",
    "evidence_containment": "SELECT DISTINCT doc_id AS project FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE length(b.text) > 8",
    "upsert_last_wins": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "first_wins_attributes": "SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id",
    "distinct_ordered_array": """WITH a AS (SELECT l_orderkey, l_partkey, min((l_linenumber, l_partkey)) AS m FROM lineitem GROUP BY ALL)
      SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY m) - 1)::INTEGER AS pos, l_partkey FROM a""",
    "inverted_index_rebuild": "SELECT doc_id AS id, md5(text) AS digest FROM documents",
    "date_validation": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "label_centroids": f"WITH {_VEC} SELECT label, unnest(range(64))::INTEGER AS d, round(unnest(vec), 6) AS x FROM cents",
    "nearest_theme": f"WITH {_VEC} SELECT id, theme, score FROM near",
    "theme_ranking_neural": f"WITH {_VEC} SELECT a.label AS q, b.label AS theme, round(list_dot_product(a.vec, b.vec), 6) AS score FROM cents a, cents b",
    "theme_fit": f"WITH {_VEC}, {_FIT} SELECT id, round(direct, 6) AS direct, round(fit, 6) AS fit FROM fits",
    "faculty_ranking_api": f"WITH {_VEC}, {_FIT}, {_AUTH}, {_SIG}, {_faculty('fit')} SELECT id, score FROM ranked",
    "faculty_ranking_lexical_ui": f"WITH {_VEC}, {_FIT}, {_AUTH}, {_SIG}, {_faculty('direct')} SELECT id, score FROM ranked",
    "optin_boost": f"""WITH {_VEC}, {_FIT}, {_AUTH}, {_SIG}, {_faculty('fit')},
      b AS (SELECT id, round(CASE WHEN row_number() OVER (ORDER BY score DESC, id) = 1 THEN least(0.99::DOUBLE, score + 0.1::DOUBLE) ELSE score END, 6) AS score FROM ranked)
      SELECT id, score, floor(score * 100 + 0.5::DOUBLE)::BIGINT AS percent FROM b ORDER BY score DESC, id LIMIT 6""",
    "group_ranking": f"""WITH {_VEC}, {_FIT}, {_GROUPS}, g AS (SELECT p_brand AS "group", avg(direct) AS score FROM part JOIN fits ON id = p_partkey GROUP BY ALL)
      SELECT "group", round(g.score, 6) AS score, theme, CASE WHEN theme <> 3 THEN 'theme ' || theme END AS theme_name,
        row_number() OVER (ORDER BY g.score DESC, "group")::INTEGER AS rank FROM g JOIN gt USING ("group") ORDER BY g.score DESC, "group" LIMIT 3""",
    "student_ranking": f"""WITH {_SPACE}, {_THEMES} SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INTEGER AS rank FROM every QUALIFY rank <= 3""",
    "theme_rollup": f"WITH {_VEC}, {_AUTH}, {_ROLL} SELECT * FROM rolled",
    "theme_lookup": f"WITH {_VEC}, {_AUTH}, {_ROLL} SELECT theme, publication_count, representative_publications FROM rolled WHERE theme = 3",
    "themes_of_person": f"WITH {_VEC}, {_AUTH}, {_ROLL} SELECT author, theme FROM toa",
    "group_members": f"""WITH {_VEC}, {_AUTH}, {_ROLL} SELECT theme, author, row_number() OVER (PARTITION BY theme ORDER BY author)::INTEGER AS rank FROM toa QUALIFY rank <= 8""",
    "coverage_counts": "SELECT (SELECT count(*) FROM part) AS people, (SELECT count(*) FROM orders) AS works",
    "label_validation": r"""WITH p AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS line FROM documents)
      SELECT id, len(list_filter(regexp_split_to_array(trim(line), '\s+'), lambda w: w <> '')) BETWEEN 4 AND 8 AND NOT regexp_matches(line, '[/,;|]')
        AND NOT regexp_matches(line || '.', '(?i)^Research on') AS valid FROM p""",
    "faculty_ranking_open": f"""WITH {_VEC}, {_FIT}, {_AUTH}, {_SIG}, {_faculty('fit').replace(' ORDER BY score DESC, id LIMIT 12', '')},
      b AS (SELECT id, round(score + CASE WHEN p_size = 1 THEN 0.1::DOUBLE ELSE 0 END, 6) AS score FROM ranked LEFT JOIN part ON p_partkey = id)
      SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM b ORDER BY score DESC, id LIMIT 12""",
    "group_themes": f"WITH {_VEC}, {_GROUPS} SELECT \"group\", theme, round(score, 6) AS score FROM gt",
    "group_ranking_by_theme": f"""WITH {_VEC}, {_GROUPS},
      tn AS (SELECT b.label AS theme, round(list_dot_product(a.vec, b.vec), 6) AS score FROM cents a, cents b WHERE a.label = 0)
      SELECT "group", theme, tn.score, row_number() OVER (ORDER BY tn.score DESC, "group")::INTEGER AS rank FROM gt JOIN tn USING (theme) ORDER BY tn.score DESC, "group" LIMIT 6""",
    "group_works": f"""WITH {_AUTH}, s AS (SELECT p_brand AS "group", work, any_value(year) AS year FROM auth JOIN part ON p_partkey = author JOIN works USING (work)
      GROUP BY ALL HAVING count(*) >= 2)
      SELECT "group", work, year, row_number() OVER (PARTITION BY "group" ORDER BY year DESC, work)::INTEGER AS rank FROM s""",
    "student_ranking_ui": f"""WITH {_SPACE}, {_THEMES} SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM every WHERE q = 0 ORDER BY score DESC, id LIMIT 6""",
    "nearest_theme_of_text": f"""WITH {_SPACE}, {_THEMES} SELECT q, source, score FROM tl WHERE q IN (SELECT q FROM qvec GROUP BY q HAVING count(*) >= 3)
      QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, source) = 1""",
    "theme_keys": f"WITH {_VEC}, {_AUTH}, {_ROLL} SELECT theme, 'hashed-64:' || representative_publications AS key FROM rolled",
    "coauthor_lists": f"""WITH {_AUTH}, {_PAIRS}, sides AS (SELECT a AS author, b AS id, n, latest FROM pairs UNION ALL SELECT b, a, n, latest FROM pairs)
      SELECT author, (row_number() OVER (PARTITION BY author ORDER BY n DESC, id) - 1)::INTEGER AS pos, id, n, latest FROM sides
      WHERE author IN (SELECT p_partkey FROM part) AND id IN (SELECT p_partkey FROM part)""",
    "evidence_projects": f"""WITH {_AUTH}, t AS (SELECT work, p_name AS text FROM auth JOIN part ON p_partkey = author WHERE pos = 1),
      e AS (SELECT work, author, pos, length(p_name) AS len FROM auth JOIN t USING (work) JOIN part ON p_partkey = author WHERE contains(lower(text), lower(p_name)))
      SELECT work AS project, (row_number() OVER (PARTITION BY work ORDER BY pos) - 1)::INTEGER AS pos, author FROM e WHERE work IN (SELECT work FROM e WHERE len > 8)""",
    "synthetic_people": f"""WITH {_SYNTHETIC} SELECT me AS id, {_pick("one", "i")} || ' ' || {_pick("two", "i * 3")} AS name,
      CASE i % 5 WHEN 0 THEN 'Associate Professor' ELSE 'Professor' END AS title, dept AS departments,
      array_to_string([format('fallback-pub-{{}}-{{}}', i + 1, j) for j in [1, 2, 3, 4]], ',') AS publications,
      CASE i % 2 WHEN 0 THEN 'fallback-project-' || (i + 1) ELSE '' END AS projects, next AS coauthor FROM syn""",
    "synthetic_works": f"""WITH {_SYNTHETIC} SELECT format('fallback-pub-{{}}-{{}}', i + 1, j + 1) AS id,
      topic || ': ' || (['methods', 'evidence', 'systems', 'applications'])[j + 1] || ' in ' || dept AS title,
      'A study of ' || lower(topic) || ' using contemporary approaches from ' || lower(dept) || ', with implications for communities and future research.' AS abstract,
      (2023 + j)::INTEGER AS year, 'Journal of ' || dept AS venue, me || ',fallback-person-' || ((i + j + 1) % 300 + 1) AS authors FROM syn, (SELECT unnest(range(4)) AS j)""",
    "synthetic_projects": f"""WITH {_SYNTHETIC} SELECT 'fallback-project-' || (i + 1) AS id, 'Advancing ' || topic || ' across communities' AS title,
      'A sponsored research program investigating ' || lower(topic) || '.' AS description, CASE i % 4 WHEN 0 THEN '2027-12-31' ELSE '2025-12-31' END AS end_date,
      (['NSF', 'NIH', 'Department of Energy'])[i % 3 + 1] AS funder, me || ',' || next AS people FROM syn WHERE i % 2 = 0""",
    "publication_texts": "SELECT doc_id, md5(source || '. ' || coalesce(text, '') || ' ' || coalesce(lang, '')) AS digest FROM documents",
    "person_texts": "SELECT p_partkey, concat_ws('. ', p_name, p_brand, p_type, p_name) AS text FROM part",
    "replaced_names": "SELECT p_partkey, replace(replace(replace(p_type, 'ECONOMY', 'offer'), 'PROMO', 'offer'), 'LARGE', 'big') AS type FROM part",
    "theme_counts": "SELECT p_size, least(count(*), 120) AS wanted, greatest(40, least(80, count(*)))::INTEGER AS themes FROM part GROUP BY p_size",
    "lead_titles": f"""WITH {_AUTH} SELECT DISTINCT author, lower(o_orderpriority || ' ' || o_orderkey) AS title FROM auth JOIN orders ON o_orderkey = work
      WHERE n_authors <= 50 AND (pos = 1 OR pos = n_authors)""",
    "retained_works_by_author": f"WITH {_AUTH}, {_STATS}, {_KEEP} SELECT DISTINCT author, work FROM auth JOIN keep USING (author)",
    "person_lists": f"""WITH {_AUTH}, {_STATS}, {_KEEP}, w AS (SELECT author, string_agg(work::VARCHAR, ',' ORDER BY work) AS publications FROM (SELECT DISTINCT author, work FROM auth) GROUP BY author),
      u AS (SELECT l_partkey AS author, l_orderkey AS project, min(l_linenumber) AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
      p AS (SELECT author, string_agg(project::VARCHAR, ',' ORDER BY pos, project) AS projects FROM u GROUP BY author)
      SELECT author, publications, coalesce(projects, '') AS projects FROM keep JOIN w USING (author) LEFT JOIN p USING (author)""",
    "stored_explanations": f"""WITH {_VEC}, {_AUTH}, newest AS (SELECT author, work FROM auth JOIN works USING (work) QUALIFY row_number() OVER (PARTITION BY author ORDER BY year DESC, work) = 1)
      SELECT author, p_name || ' matches through “order ' || work || '” and the theme ' || theme || ' theme.' AS explanation
      FROM newest JOIN part ON p_partkey = author JOIN near ON id = author""",
    "groups_of_theme": f"WITH {_VEC}, {_GROUPS} SELECT \"group\", theme FROM gt WHERE theme = 3",
    "json_round_trip": "SELECT p_partkey, round(p_retailprice / 7, 8) AS price FROM part",
    "robots_paths": """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
      SELECT page_id, CASE WHEN path LIKE '/en%' THEN false WHEN path LIKE '/e%' THEN true WHEN path LIKE '/%' THEN false ELSE true END AS allowed FROM p""",
    "connected_components": f"""WITH RECURSIVE {_AUTH}, {_PAIRS}, e AS (SELECT a, b FROM pairs WHERE n >= 2), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      reach(node, r) AS (SELECT a, a FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
      SELECT node, min(r) AS component FROM reach GROUP BY node""",
}
