"""The same results in the SQL of another engine, over the same tables."""

from __future__ import annotations

from splitloom.plans.configs import SplitConfig, all_configs

DOCS = """
docs AS (
  SELECT doc_id, source AS author, lang AS language, n_chars, text,
    CASE WHEN n_chars % 4 = 0 THEN 'test' ELSE 'train' END AS data_type,
    printf('problem%05d', (n_chars // 4) % 10 + 1) AS problem,
    (['Politics', 'Society', 'World', 'UK', 'Books'])[(n_chars // 4) % 5 + 1] AS category,
    (['C', 'G', 'I', 'M', 'P', 'S', NULL])[(n_chars // 4) % 7 + 1] AS topic,
    (['B', 'C', 'D', 'E', 'P', 'S'])[(n_chars // 28) % 6 + 1] AS genre,
    source || '-' || ((doc_id // 20) % 25) AS title,
    source || '/' || (((doc_id // 20) % 25) // 2) AS novelist,
    'text_raw/' || doc_id || '_' || source || '.txt' AS text_path
  FROM documents
)"""

CORPORA = f"""{DOCS},
placed AS (
  SELECT * REPLACE ('author' || (doc_id % 4) AS author),
    (['reuters-c50', 'cmcc', 'guardian', 'imdb62', 'cl_novels', 'pan18_attribution',
      'R-CL1-DE', 'R-CL2-ES', 'R-CL3-PT', 'R-CL4-NL', 'R-CL5-FR'])[doc_id % 11 + 1] AS corpus
  FROM docs
),
corpora AS (
  SELECT * REPLACE (
    CASE WHEN corpus = 'reuters-c50' THEN data_type ELSE category END AS category,
    CASE WHEN language <> 'en' AND corpus LIKE 'R-CL%'
         THEN (['de', 'es', 'pt', 'nl', 'fr'])[doc_id % 11 - 5] ELSE language END AS language)
  FROM placed
)"""


def _detected(taught: str) -> str:
    """Language by trigrams, learnt from some of the documents."""
    return r""",
told AS (SELECT *, md5(CAST(doc_id AS VARCHAR)) < '3' AS held_out FROM docs),
runs AS (SELECT doc_id, language, held_out, unnest(regexp_extract_all(lower(text), '\pL+')) AS run FROM told),
grams AS (
  SELECT doc_id, language, held_out, substr(' ' || run || ' ', unnest(range(1, length(run) + 1))::INT, 3) AS gram FROM runs
),
taught AS (SELECT language, gram, count(*) AS n FROM grams WHERE %s GROUP BY ALL),
totals AS (SELECT language, sum(n) + (SELECT count(DISTINCT gram) FROM taught) AS size FROM taught GROUP BY ALL),
logs AS (
  SELECT g.gram, t.language AS name, ln((coalesce(n, 0) + 1) / size::DOUBLE) AS l
  FROM (SELECT DISTINCT gram FROM taught) g CROSS JOIN totals t
  LEFT JOIN taught h ON h.gram = g.gram AND h.language = t.language
),
scores AS (SELECT doc_id, name, sum(l) AS score FROM grams JOIN logs USING (gram) GROUP BY ALL),
best AS (SELECT doc_id, name FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) = 1),
detected AS (SELECT d.doc_id, d.language, d.held_out, b.name AS detected FROM told d LEFT JOIN best b ON b.doc_id = d.doc_id)
""" % taught


SENTENCES = r""",
short AS (
  SELECT doc_id, language, replace(text, ', ', CASE doc_id % 3 WHEN 0 THEN '... '
    WHEN 1 THEN CASE language WHEN 'de' THEN ' bzw. ' ELSE ', Mr. ' END ELSE ', ' END) AS text FROM docs
),
raw_tokens AS (
  SELECT doc_id, language, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, language, regexp_extract_all(
      regexp_replace(text, '^[ \t\n\r\f]+', ''), '[^ \t\n\r\f]+[ \t\n\r\f]*') AS l FROM short)
),
cores AS (
  SELECT *, regexp_replace(regexp_replace(raw, '[ \t\n\r\f]+\z', ''),
    '^["''(\[«„“”‘’]+|["'')\]»“”‘’]+\z', '', 'g') AS core FROM raw_tokens
),
words AS (SELECT *, lower(regexp_replace(core, '[.,;:!?…]+\z', '')) AS word FROM cores),
placed_tokens AS (
  SELECT *, lead(core) OVER d AS after, lead(word) OVER d AS next_word FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
counted AS (
  SELECT language, word, count(*) FILTER (core LIKE '%.' AND core NOT LIKE '%..') AS n_period,
    count(*) FILTER (NOT (core LIKE '%.' AND core NOT LIKE '%..')) AS n_plain
  FROM words WHERE regexp_matches(word, '\pL') GROUP BY ALL
),
sums AS (SELECT language, sum(n_period)::DOUBLE AS periods, sum(n_period + n_plain)::DOUBLE AS total FROM counted GROUP BY ALL),
scored AS (
  SELECT c.*, length(replace(word, '.', ''))::DOUBLE AS letters, length(word) AS size,
    n_period * ln(0.99) + n_plain * ln(0.01) - n_period * ln(periods / total) - n_plain * ln(1 - periods / total) AS ratio
  FROM counted c JOIN sums USING (language) WHERE n_period > 0
),
abbreviations AS (
  SELECT * FROM scored WHERE 2 * ratio * exp(-letters) * (size - letters + 1) * pow(letters, -n_plain) >= 0.3
),
after_ends AS (
  SELECT language, next_word AS word, count(*) FILTER (regexp_matches(after, '^\p{Lu}')) AS n_after, count(*) AS n_ends
  FROM placed_tokens p
  WHERE after IS NOT NULL AND core LIKE '%.' AND core NOT LIKE '%..' AND length(replace(word, '.', '')) > 1
    AND regexp_matches(word, '\pL')
    AND NOT EXISTS (FROM abbreviations a WHERE a.language = p.language AND a.word = p.word)
  GROUP BY ALL
),
starters AS (
  SELECT * FROM (
    SELECT a.language, a.word, n_after, n_period + n_plain AS n_all, n_after::DOUBLE AS h,
      (n_period + n_plain)::DOUBLE AS c, b, total AS n
    FROM after_ends a JOIN counted USING (language, word) JOIN sums USING (language)
    JOIN (SELECT language, sum(n_ends)::DOUBLE AS b FROM after_ends GROUP BY ALL) USING (language)
    WHERE n_after > 0 AND regexp_matches(a.word, '\pL'))
  WHERE h / b > c / n AND 2 * (
      h * ln(h / b) + (b - h) * CASE WHEN h < b THEN ln(1 - h / b) ELSE 0 END
    + (c - h) * CASE WHEN c > h THEN ln((c - h) / (n - b)) ELSE 0 END + (n - b - c + h) * ln(1 - (c - h) / (n - b))
    - h * ln(c / n) - (b - h) * ln(1 - c / n) - (c - h) * ln(c / n) - (n - b - c + h) * ln(1 - c / n)) >= 30
)"""


def _with(sql: str, base: str = DOCS) -> str:
    return f"WITH {base}{sql}"


def _draw(*keys: str) -> str:
    return f"md5(concat_ws('|', '42', 'document', {', '.join(keys)}))"


def _target_draw(column: str) -> str:
    return f"md5(concat_ws('|', '42', 'target', {column}))"


def _folds(source: str, doc_id: str, target: str, k: int, name: str = "folds") -> str:
    """Common tables that give every row its fold, by the published rule."""
    return f"""
{name}_rows AS (SELECT CAST({doc_id} AS BIGINT) AS doc_id, {target} AS target FROM {source}),
{name}_classes AS (
  SELECT target, count(*) AS c, min(doc_id) AS first_id FROM {name}_rows GROUP BY target
),
{name}_placed AS (
  SELECT target, c, coalesce(sum(c) OVER (
    ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
  FROM {name}_classes
),
{name}_shares AS (
  SELECT target, i, (st + c - 1 - i + {k}) // {k} - (st - 1 - i + {k}) // {k} AS a
  FROM {name}_placed, range({k}) AS r(i)
),
{name}_ends AS (
  SELECT target, i, sum(a) OVER (PARTITION BY target ORDER BY i) AS upto FROM {name}_shares
),
{name}_ranked AS (
  SELECT doc_id, target, row_number() OVER (PARTITION BY target ORDER BY doc_id) - 1 AS r
  FROM {name}_rows
),
{name} AS (
  SELECT d.doc_id, d.target, CAST(count(*) FILTER (d.r >= e.upto) AS BIGINT) AS fold
  FROM {name}_ranked d JOIN {name}_ends e USING (target)
  GROUP BY d.doc_id, d.target
)"""


TITLE_PLAN = """
languages AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS test_language),
n_author AS (
  SELECT test_language, novelist, count(*) AS n FROM languages, docs
  WHERE language <> test_language GROUP BY ALL
),
n_author_title AS (
  SELECT test_language, novelist, title, count(*) AS n FROM languages, docs
  WHERE language <> test_language GROUP BY ALL
),
n_train_title AS (
  SELECT test_language, title, count(*) AS n FROM languages, docs
  WHERE language <> test_language GROUP BY ALL
),
tested_authors AS (
  SELECT test_language, title, novelist, count(*) AS n FROM languages, docs
  WHERE language = test_language GROUP BY ALL
),
titles AS (
  SELECT t.test_language, t.title, sum(t.n)::BIGINT AS n_test,
    bool_and(coalesce(a.n, 0) - coalesce(x.n, 0) > 0) AS covered
  FROM tested_authors t
  LEFT JOIN n_author a USING (test_language, novelist)
  LEFT JOIN n_author_title x ON x.test_language = t.test_language
    AND x.novelist = t.novelist AND x.title = t.title
  GROUP BY ALL
),
plan AS (
  SELECT test_language, title, n.n IS NOT NULL AS overlaps, covered,
    CASE WHEN n.n IS NOT NULL AND covered THEN title
         WHEN n.n IS NULL THEN '*rest*' END AS split_id,
    n_test, coalesce(n.n, 0)::BIGINT AS n_removed
  FROM titles LEFT JOIN n_train_title n USING (test_language, title)
)"""

# Every row of every split, the rest of each language included.
TITLE_LONG = """
title_ids AS (
  SELECT DISTINCT test_language, split_id FROM plan WHERE split_id IS NOT NULL
  UNION SELECT test_language, '*rest*' FROM languages
),
title_long AS (
  SELECT i.test_language, i.split_id, 'test' AS role, d.novelist AS target, d.language
  FROM title_ids i JOIN plan p ON p.test_language = i.test_language AND p.split_id = i.split_id
  JOIN docs d ON d.title = p.title AND d.language = i.test_language
  UNION ALL
  SELECT i.test_language, i.split_id, 'train', d.novelist, d.language
  FROM title_ids i JOIN docs d ON d.language <> i.test_language
  WHERE d.title <> i.split_id OR i.split_id = '*rest*'
),
title_targets AS (
  SELECT test_language, split_id, target, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'test') AS test
  FROM title_long GROUP BY ALL
),
title_summary AS (
  SELECT test_language, split_id, sum(train)::BIGINT AS n_train, sum(test)::BIGINT AS n_test,
    count(*) FILTER (train > 0) AS n_train_targets, count(*) FILTER (test > 0) AS n_test_targets,
    count(*) FILTER (train = 0 AND test > 0) AS n_unseen_targets, 0::BIGINT AS n_null_targets
  FROM title_targets GROUP BY test_language, split_id
)"""

RAW_SIDES = """
splits AS (
  SELECT problem AS split_id, data_type AS role, doc_id, novelist AS target, language,
    md5(text) AS text_md5
  FROM docs
),
per_target AS (
  SELECT split_id, target, count(*) FILTER (role = 'train') AS train,
    count(*) FILTER (role = 'test') AS test
  FROM splits GROUP BY ALL
),
summary AS (
  SELECT split_id, sum(train)::BIGINT AS n_train, sum(test)::BIGINT AS n_test,
    count(*) FILTER (train > 0) AS n_train_targets, count(*) FILTER (test > 0) AS n_test_targets,
    count(*) FILTER (train = 0 AND test > 0) AS n_unseen_targets, 0::BIGINT AS n_null_targets
  FROM per_target GROUP BY split_id
)"""

def _quoted(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def _condition(config: SplitConfig, side: str) -> str:
    if config.test_domain is not None:
        comparison = "IS NOT DISTINCT FROM" if side == "test" else "IS DISTINCT FROM"
        rule = f"{config.domain} {comparison} '{config.test_domain}'"
    else:
        values = config.test_values if side == "test" else config.train_values
        rule = f"{config.domain} IN ({', '.join(map(_quoted, values))})"
    if config.problem:
        rule += f" AND problem = '{config.problem}'"
    return f"corpus = '{config.corpus}' AND {rule}"


def _sided(configs: list[SplitConfig]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c.config_id}' AS config_id, '{side}' AS role, doc_id, author AS target,"
        f" CAST({c.max_docs_per_target or 'NULL'} AS INT) AS cap FROM corpora WHERE {_condition(c, side)}"
        for c in configs
        for side in ("train", "test")
    )


def _matrix_long() -> str:
    """All rows of the rules on sides and of the folds, capped."""
    configs = all_configs()
    sided = [c for c in configs if c.rule == "sides"]
    folded = [c for c in configs if c.rule == "folds"]
    caps = ", ".join(f"('{c.config_id}', CAST({c.max_docs_per_target or 'NULL'} AS INT))" for c in folded)
    return f""",
imdb AS (SELECT * FROM corpora WHERE corpus = 'imdb62'),{_folds("imdb", "doc_id", "author", 5)},
sided AS ({_sided(sided)}),
usable AS (
  SELECT s.config_id, '0' AS split_id, role, doc_id, target, cap FROM sided s
  WHERE role = 'train' OR EXISTS (
    SELECT 1 FROM sided t WHERE t.role = 'train' AND t.config_id = s.config_id AND t.target = s.target)
  UNION ALL
  SELECT config_id, CAST(i AS VARCHAR), CASE WHEN i = fold THEN 'test' ELSE 'train' END,
    doc_id, target, cap
  FROM folds, range(5) AS r(i), (VALUES {caps}) AS v(config_id, cap)
),
long AS (
  SELECT config_id, split_id, role, doc_id, target FROM usable
  QUALIFY role = 'test' OR cap IS NULL OR row_number() OVER (
    PARTITION BY config_id, split_id, role, target
    ORDER BY {_draw("split_id", "doc_id")}, doc_id) <= cap
)"""


def _config_rows() -> str:
    rows = []
    for c in all_configs():
        train = ",".join(c.train_values) if c.train_values else None
        test = ",".join(c.test_values) if c.test_values else None
        fields = [c.config_id, c.loader, c.path, c.domain, c.test_domain, train, test, c.problem, c.test_language]
        numbers = [c.n_splits, c.max_docs_per_target]
        rows.append(f"({', '.join([*map(_quoted, fields), *(str(n or 'NULL') for n in numbers)])})")
    return ", ".join(rows)


def oracle_sql() -> dict[str, str]:
    """SQL for every query that SQL can express."""
    sql: dict[str, str] = {}

    chosen = f"""
chosen AS (
  SELECT author FROM (SELECT DISTINCT author FROM docs WHERE language = 'en')
  ORDER BY {_target_draw("author")}, author LIMIT 4
)"""
    sql["train_test_split"] = _with(f""",{chosen}
SELECT '0' AS split_id, 'train' AS role, doc_id, author AS target
FROM docs JOIN chosen USING (author) WHERE language = 'en'
QUALIFY row_number() OVER (PARTITION BY author ORDER BY {_draw("'0'", "doc_id")}, doc_id) <= 7
UNION ALL
SELECT '0', 'test', doc_id, author FROM docs JOIN chosen USING (author) WHERE language = 'de'""")
    sql["train_test_split_all_targets"] = _with("""
SELECT '0' AS split_id, 'train' AS role, doc_id, novelist AS target FROM docs WHERE language <> 'fr'
UNION ALL
SELECT '0', 'test', doc_id, novelist FROM docs
WHERE language = 'fr' AND novelist IN (SELECT novelist FROM docs WHERE language <> 'fr')""")
    sql["cv_split"] = _with(f""",{_folds("docs", "doc_id", "author", 5)}
SELECT CAST(i AS VARCHAR) AS split_id, CASE WHEN i = fold THEN 'test' ELSE 'train' END AS role,
  doc_id, target
FROM folds, range(5) AS r(i)""")
    sql["cv_split_limited"] = _with(f""",
picked AS (
  SELECT author FROM (SELECT DISTINCT author FROM docs) ORDER BY {_target_draw("author")}, author LIMIT 4
),
own AS (SELECT * FROM docs JOIN picked USING (author)),{_folds("own", "doc_id", "author", 5)},
fanned AS (
  SELECT CAST(i AS VARCHAR) AS split_id, CASE WHEN i = fold THEN 'test' ELSE 'train' END AS role,
    doc_id, target
  FROM folds, range(5) AS r(i)
)
SELECT * FROM fanned QUALIFY role = 'test' OR row_number() OVER (
  PARTITION BY split_id, role, target ORDER BY {_draw("split_id", "doc_id")}, doc_id) <= 7""")
    sql["split_heldout_title"] = _with(f""",{TITLE_PLAN}
SELECT 'test' AS role, split_id, CAST(NULL AS VARCHAR) AS not_in_split, doc_id,
  novelist AS target, test_language
FROM plan JOIN docs USING (title) WHERE language = test_language AND split_id IS NOT NULL
UNION ALL
SELECT 'train', NULL, split_id, doc_id, novelist, l.test_language
FROM languages l JOIN docs d ON d.language <> l.test_language
LEFT JOIN plan p ON p.test_language = l.test_language AND p.title = d.title""")
    sql["heldout_title_plan"] = _with(f",{TITLE_PLAN} SELECT * FROM plan")
    sql["heldout_title_plan_covered"] = _with(f""",{TITLE_PLAN}
SELECT * REPLACE (CASE WHEN covered THEN split_id END AS split_id) FROM plan""")

    sql["title_split_summary"] = _with(f",{TITLE_PLAN},{TITLE_LONG} SELECT * FROM title_summary")
    sql["validate_title_splits"] = _with(f""",{TITLE_PLAN},{TITLE_LONG}
SELECT test_language, split_id, unnest(['two_train_classes', 'test_classes_in_train', 'two_train_rows', 'one_test_row',
    'every_row_has_a_target']) AS rule,
  unnest([CASE WHEN n_train_targets < 2 THEN 1 ELSE 0 END, n_unseen_targets, CASE WHEN n_train < 2 THEN 1 ELSE 0 END,
    CASE WHEN n_test < 1 THEN 1 ELSE 0 END, n_null_targets])::BIGINT AS n_violations
FROM title_summary""")
    sql["validate_title_languages"] = _with(f""",{TITLE_PLAN},{TITLE_LONG}
SELECT test_language, split_id, count(*) FILTER (train > 0) AS n_train_languages, count(*) FILTER (test > 0) AS n_test_languages,
  count(*) FILTER (train > 0 AND test > 0) AS n_shared_languages, sum(train)::BIGINT AS n_train, sum(test)::BIGINT AS n_test
FROM (SELECT test_language, split_id, language, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'test') AS test
      FROM title_long GROUP BY ALL)
GROUP BY ALL""")

    sql["attach_target"] = _with(" SELECT doc_id, language AS y_0, author AS y_1 FROM docs")
    sql["distinct_targets"] = _with(" SELECT DISTINCT novelist FROM docs")
    sql["select_targets"] = f"""SELECT author FROM (SELECT DISTINCT source AS author FROM documents)
ORDER BY {_target_draw("author")}, author LIMIT 7"""
    sql["restrict_targets"] = _with("""
SELECT doc_id, language, novelist FROM docs WHERE language = 'en'
  AND novelist IN (SELECT novelist FROM docs WHERE language = 'de')""")
    sql["cap_docs_per_target"] = _with(f"""
SELECT doc_id, author FROM docs
QUALIFY row_number() OVER (PARTITION BY author ORDER BY {_draw("doc_id")}, doc_id) <= 10""")
    sql["cap_orders_per_priority"] = f"""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderpriority IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority
  ORDER BY {_draw("o_orderstatus", "o_orderkey")}, o_orderkey) <= 50"""
    sql["docs_per_target_bounds"] = _with("""
SELECT language, count(*) AS n_targets, min(n) AS min_docs, max(n) AS max_docs
FROM (SELECT language, novelist, count(*) AS n FROM docs GROUP BY ALL) GROUP BY language""")
    sql["union_sides"] = _with("""
SELECT doc_id, author, 'train' AS role, CAST(NULL AS VARCHAR) AS title FROM docs WHERE language = 'en'
UNION ALL SELECT doc_id, author, 'test', title FROM docs WHERE language = 'de'""")

    sql["split_predefined"] = _with(" SELECT problem, doc_id, author, data_type AS role FROM docs")
    sql["split_leave_one_out"] = _with("""
SELECT doc_id, topic, author,
  CASE WHEN topic IS NOT DISTINCT FROM 'C' THEN 'test' ELSE 'train' END AS role FROM docs""")
    sql["split_by_value_sets"] = _with("""
SELECT doc_id, category, author, CASE category WHEN 'Books' THEN 'test' ELSE 'train' END AS role
FROM docs WHERE category IN ('Politics', 'Society', 'World', 'UK', 'Books')""")
    sql["exclude_rows"] = _with("""
SELECT doc_id, author FROM docs
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = docs.doc_id AND l.toxic = 1)""")
    sql["resolve_languages"] = """
SELECT language, bool_or(a) AS in_train, bool_or(b) AS in_test FROM (
  SELECT lang AS language, true AS a, false AS b FROM documents
  UNION ALL SELECT regexp_extract(url, '://[^/]+/([a-z]+)/', 1), false, true FROM pages
) GROUP BY language"""

    plain = "SELECT * FROM folds"
    sql["stratified_kfold"] = _with(f""",{_folds("docs", "doc_id", "author", 5)} {plain}""")
    sql["stratified_kfold_novelists"] = _with(f""",{_folds("docs", "doc_id", "novelist", 2)} {plain}""")
    sql["stratified_kfold_languages"] = _with(f""",{_folds("docs", "doc_id", "language", 7)} {plain}""")
    sql["stratified_kfold_roles"] = (
        f"WITH {_folds('conversations', 'conv_id * 1000000 + turn', 'role', 5)} {plain}"
    )
    sql["stratified_kfold_labels"] = f"WITH {_folds('embeddings', 'vec_id', 'label', 10)} {plain}"
    sql["stratified_kfold_orders"] = (
        f"WITH {_folds('orders', 'o_orderkey', 'o_orderpriority', 5)} {plain}"
    )
    sql["fold_column"] = _with(f""",{_folds("docs", "doc_id", "author", 5)}
SELECT doc_id, fold, title, md5(text) AS text_md5 FROM docs JOIN folds USING (doc_id)""")

    sql["title_overlap"] = _with("""
SELECT DISTINCT title, title IN (SELECT title FROM docs WHERE language <> 'de') AS overlaps
FROM docs WHERE language = 'de'""")
    sql["untested_titles"] = _with(f""",{TITLE_PLAN}
SELECT DISTINCT title FROM docs WHERE title NOT IN (
  SELECT title FROM plan WHERE test_language IN ('es', 'en') AND split_id IS NOT NULL)""")

    sql["split_summary"] = _with(f",{RAW_SIDES} SELECT * FROM summary")
    sql["validate_splits"] = _with(f""",{RAW_SIDES}
SELECT split_id, 'two_train_classes' AS rule, CAST(n_train_targets < 2 AS BIGINT) AS n_violations FROM summary
UNION ALL SELECT split_id, 'test_classes_in_train', n_unseen_targets FROM summary
UNION ALL SELECT split_id, 'two_train_rows', CAST(n_train < 2 AS BIGINT) FROM summary
UNION ALL SELECT split_id, 'one_test_row', CAST(n_test < 1 AS BIGINT) FROM summary
UNION ALL SELECT split_id, 'every_row_has_a_target', n_null_targets FROM summary""")
    leak = """
SELECT split_id, count(*) FILTER (train > 1) AS n_repeated_in_train,
  count(*) FILTER (test > 1) AS n_repeated_in_test,
  count(*) FILTER (train > 0 AND test > 0) AS n_on_both_sides
FROM (
  SELECT split_id, text_md5, count(*) FILTER (role = 'train') AS train,
    count(*) FILTER (role = 'test') AS test
  FROM splits GROUP BY ALL
) GROUP BY split_id"""
    sql["split_leakage"] = _with(f",{RAW_SIDES}{leak}")
    sql["fold_leakage"] = _with(f""",{_folds("docs", "doc_id", "author", 5)},
splits AS (
  SELECT CAST(i AS VARCHAR) AS split_id, CASE WHEN i = fold THEN 'test' ELSE 'train' END AS role,
    md5(text) AS text_md5
  FROM docs JOIN folds USING (doc_id), range(5) AS r(i)
){leak}""")
    sql["validate_language_split"] = _with("""
, splits AS (
  SELECT 'held out' AS split_id, CASE language WHEN 'de' THEN 'test' ELSE 'train' END AS role, language FROM docs
  UNION ALL SELECT problem, data_type, language FROM docs
),
seen AS (
  SELECT split_id, language, count(*) FILTER (role = 'train') AS train,
    count(*) FILTER (role = 'test') AS test
  FROM splits GROUP BY ALL
)
SELECT split_id, count(*) FILTER (train > 0) AS n_train_languages,
  count(*) FILTER (test > 0) AS n_test_languages,
  count(*) FILTER (train > 0 AND test > 0) AS n_shared_languages,
  sum(train)::BIGINT AS n_train, sum(test)::BIGINT AS n_test
FROM seen GROUP BY split_id""")
    sql["validate_paths"] = _with("".join(
        f"""{joiner}
SELECT count(*) AS n_docs, count(*) FILTER (author <> {target}) AS n_author_is_not_target,
  count(*) FILTER (NOT contains(text_path, {target})) AS n_not_in_text_path,
  count(*) FILTER (NOT contains('stanza/' || title, {target})) AS n_not_in_stanza,
  '{target}' AS "check" FROM docs"""
        for joiner, target in (("", "author"), (" UNION ALL", "novelist"))
    ))
    sql["language_audit"] = _with(_detected("language IS NOT NULL") + """
SELECT language, detected, count(*) AS n_docs, count(*) FILTER (language IS DISTINCT FROM detected) AS n_misses
FROM detected GROUP BY ALL""")
    sql["detect_language"] = _with(_detected("NOT held_out") + """
SELECT doc_id, language, held_out, detected FROM detected""")

    sql["scan_metadata"] = _with("""
SELECT author, language, topic, text_path AS text_raw, true AS under_root,
  '/parsed/' || doc_id || '.pckl' AS stanza FROM docs""")
    sql["drop_incomplete"] = _with("""
SELECT doc_id, author, topic, quality, md5(text) AS text_md5
FROM docs JOIN labels USING (doc_id)
WHERE topic IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
  AND text NOT IN ('', 'NA', 'N/A', 'n/a', 'NULL', 'null', 'NaN', 'nan', 'None', '<NA>')""")
    sql["remap_codes"] = _with("""
SELECT doc_id, CASE language WHEN 'es' THEN 'sp' ELSE language END AS code, language FROM docs""")
    sql["chunk_documents"] = _with(r""",
cut AS (
  SELECT doc_id, author, language, title, string_split(regexp_replace(
    regexp_replace(text, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'),
    '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)) AS s
  FROM docs
),
kept AS (SELECT * REPLACE (list_filter(s, lambda x: x <> '') AS s) FROM cut)
SELECT doc_id, i AS chunk,
  'text_raw/' || author || '_' || language || '_' || title || '_' || i || '.txt' AS text_path,
  array_to_string(s[i * 5 + 1:i * 5 + 5], ' ') AS text
FROM kept, range((len(s) + 4) // 5) AS r(i)""")
    sql["train_sentences"] = _with(SENTENCES + """
SELECT language, 'abbreviation' AS kind, word, n_period AS n, n_plain AS n_other FROM abbreviations
UNION ALL
SELECT language, 'starter', word, n_after, n_all FROM starters""")
    sql["split_sentences"] = _with(SENTENCES + r""",
flagged AS (
  SELECT doc_id, i, raw,
    CASE WHEN after IS NULL THEN true
         WHEN regexp_matches(core, '[!?]\z') THEN true
         WHEN NOT regexp_matches(core, '[.…]\z') THEN false
         WHEN regexp_matches(core, '(\.\.|…)\z') OR regexp_matches(word, '^\pL\z') OR
              EXISTS (FROM abbreviations a WHERE a.language = p.language AND a.word = p.word)
         THEN regexp_matches(after, '^\p{Lu}') AND
              EXISTS (FROM starters s WHERE s.language = p.language AND s.word = p.next_word)
         ELSE NOT (regexp_matches(word, '^[0-9]+\z') AND regexp_matches(after, '^\p{Ll}')) END AS ends
  FROM placed_tokens p
),
numbered AS (
  SELECT *, count(*) FILTER (ends) OVER (PARTITION BY doc_id ORDER BY i) - CASE WHEN ends THEN 1 ELSE 0 END AS sentence
  FROM flagged
),
joined AS (
  SELECT doc_id, sentence, regexp_replace(string_agg(raw, '' ORDER BY i), '[ \t\n\r\f]+\z', '') AS s
  FROM numbered GROUP BY ALL
)
SELECT d.doc_id, count(j.s) AS n_sentences, md5(coalesce(string_agg(j.s, '|' ORDER BY j.sentence), '')) AS sentences_md5
FROM short d LEFT JOIN joined j ON j.doc_id = d.doc_id GROUP BY d.doc_id""")
    sql["externalize_text"] = _with("""
SELECT doc_id, author, topic, 'en' AS language, text_path, text FROM docs
WHERE topic IS NOT NULL
  AND text NOT IN ('', 'NA', 'N/A', 'n/a', 'NULL', 'null', 'NaN', 'nan', 'None', '<NA>')""")
    sql["number_documents"] = _with("""
SELECT text_path AS path, row_number() OVER (ORDER BY text_path COLLATE "C") - 1 AS doc_id FROM docs""")

    sql["decode_cp1252"] = _with("""
, quoted AS (SELECT doc_id, '“' || replace(text, ', ', ' – ') || '”' AS text FROM docs)
SELECT CAST(doc_id AS VARCHAR) AS path, length(text) AS n_bytes, text FROM quoted""")
    sql["scan_labelled_tree"] = _with("""
SELECT category || '/' || author || '/' || doc_id || '.txt' AS path, category, author, text FROM docs""")
    sql["scan_train_test_tree"] = _with("""
SELECT 'C50' || data_type || '/' || author || '/' || doc_id || '.txt' AS path,
  data_type AS category, author, text FROM docs""")
    sql["scan_language_tree"] = _with("""
SELECT author || '/' || language || '/' || title || ' vol.' || doc_id || '.txt' AS path, author,
  language, title || ' vol.' || doc_id AS title, text FROM docs""")
    sql["filename_attributes"] = _with("""
, named AS (
  SELECT doc_id, 'S' || substr(author, 4) AS author, genre, coalesce(topic, 'X') AS topic,
    n_chars % 4 AS n FROM docs
)
SELECT doc_id, 'Chat/Correlated/' || CASE WHEN author = 'S1' AND genre = 'D' AND topic = 'I' AND n = 3
    THEN 'S1D113.txt' ELSE author || genre || '1' || topic || n || '.txt' END AS path,
  author, genre, topic FROM named""")
    sql["scan_tsv"] = _with("""
SELECT CAST(doc_id AS VARCHAR) AS review_id, author, title AS item_id,
  CAST(n_chars AS VARCHAR) AS rating, language AS title, text AS text_raw FROM docs""")
    sql["scan_xml_documents"] = _with("""
, cut AS (SELECT language, author, string_split(text, chr(10)) AS s FROM docs)
SELECT language, author, i AS position, nullif(s[i + 1], '') AS text FROM cut, range(len(s)) AS r(i)""")
    sql["scan_xml_elements"] = _with("""
, cut AS (SELECT doc_id, language, string_split(text, chr(10)) AS s FROM docs)
SELECT language, doc_id AS author, 2 * i AS position, nullif(split_part(s[i + 1], ' ', 1), '') AS text
FROM cut, range(len(s)) AS r(i)
UNION ALL SELECT language, doc_id, 2 * i + 1, NULL FROM cut, range(len(s)) AS r(i)""")
    sql["scan_files"] = _with("""
SELECT '_' || author || '/' || language || '/' || CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '' END || title || doc_id || '.txt' AS path,
  '_' || author AS author, language, CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '' END || title || doc_id AS title, text
FROM docs WHERE doc_id % 7 = 0
UNION ALL SELECT author || '/' || language || '/' || CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '' END || title || doc_id || '.txt',
  author, language, CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '' END || title || doc_id, text
FROM docs WHERE doc_id % 7 NOT IN (0, 3)""")
    sql["parse_delimited_truth"] = """
SELECT CAST(doc_id AS VARCHAR) AS author, CAST(quality AS VARCHAR) AS quality,
  CAST(toxic AS VARCHAR) AS toxic
FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL"""
    sql["join_truth"] = _with("""
SELECT doc_id, author, language, quality, toxic FROM docs LEFT JOIN labels USING (doc_id)""")
    sql["scan_problem_collection"] = _with("""
SELECT problem || CASE data_type WHEN 'train' THEN '/candidate' || author || '/known' ELSE '/unknown/unknown' END
    || doc_id || '.txt' AS path,
  'candidate' || author AS author,
  CASE WHEN CAST(right(problem, 1) AS INT) % 2 = 0 THEN 'es' ELSE 'en' END AS language,
  data_type, problem, text FROM docs""")

    sided = [c for c in all_configs() if c.rule == "sides"]
    sql["config_matrix"] = _with(f""",
sided AS ({_sided(sided)}),
matching AS (
  SELECT config_id, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test
  FROM sided GROUP BY config_id
),
listed(config_id, loader, path, domain, test_domain, train_values, test_values, problem,
       test_language, n_splits, max_docs_per_target) AS (VALUES {_config_rows()})
SELECT listed.*, n_train, n_test FROM listed LEFT JOIN matching USING (config_id)""", CORPORA)
    novels = f"""
novels AS (SELECT doc_id, author AS novelist, language, title FROM corpora WHERE corpus = 'cl_novels'),
{TITLE_PLAN.replace(", docs", ", novels").replace("FROM docs", "FROM novels")}"""
    sql["matrix_splits"] = _with(f"""{_matrix_long()},{novels}
SELECT config_id, split_id, role, doc_id, target, CAST(NULL AS VARCHAR) AS not_in_split FROM long
UNION ALL
SELECT 'cl_novels/' || test_language, split_id, 'test', doc_id, novelist, NULL
FROM plan JOIN novels USING (title)
WHERE language = test_language AND split_id IS NOT NULL AND test_language IN ('es', 'en')
UNION ALL
SELECT 'cl_novels/' || l.test_language, NULL, 'train', doc_id, novelist, split_id
FROM languages l JOIN novels n ON n.language IS DISTINCT FROM l.test_language
LEFT JOIN plan p ON p.test_language = l.test_language AND p.title = n.title
WHERE l.test_language IN ('es', 'en')""", CORPORA)
    sql["run_matrix"] = _with(f"""{_matrix_long()},{novels},
counted AS (
SELECT config_id, count(DISTINCT split_id) AS n_splits, count(*) FILTER (role = 'train') AS n_train,
  count(*) FILTER (role = 'test') AS n_test
FROM long GROUP BY config_id
UNION ALL
SELECT 'cl_novels/' || l.test_language AS config_id,
  1 + count(*) FILTER ("overlaps" AND covered),
  (1 + count(*) FILTER ("overlaps" AND covered))
    * (SELECT count(*) FROM novels WHERE language <> l.test_language)
    - coalesce(sum(n_removed) FILTER ("overlaps" AND covered), 0)::BIGINT,
  coalesce(sum(n_test) FILTER (split_id IS NOT NULL), 0)::BIGINT
FROM languages l LEFT JOIN plan USING (test_language)
WHERE l.test_language IN ('es', 'en') GROUP BY l.test_language
)
SELECT config_id, coalesce(n_splits, 1) AS n_splits, coalesce(n_train, 0)::BIGINT AS n_train,
  coalesce(n_test, 0)::BIGINT AS n_test
FROM (VALUES {', '.join(f"('{c.config_id}')" for c in all_configs())}) AS v(config_id)
LEFT JOIN counted USING (config_id)""", CORPORA)
    return sql
