"""Registered queries of the features of code, paths and texts.

The tables have no code, so contents stand for it: a function's name is the first word of its content, its code the whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import adapters as A
from graphloom.functions import context as C
from graphloom.functions import structure as X
from graphloom.functions import text as T
from graphloom.operators import callgraph as G
from graphloom.plans.registry import query
from graphloom.session import read_table

_CODE = "code AS (SELECT id, regexp_extract(coalesce(content, ''), '([A-Za-z0-9_]+)', 1) AS name, coalesce(content, '') AS code, language FROM contents)"
_PATH = "paths AS (SELECT page_id, regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1) AS path FROM pages)"
_EXT = r"regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.(\.[^.]+)$', 1)"


def _code(spark, d):
    c = A.contents(spark, d)
    code = F.coalesce("content", F.lit(""))
    return c.select("id", F.regexp_extract(code, "([A-Za-z0-9_]+)", 1).alias("name"), code.alias("code"), "language")


def _paths(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1).alias("path"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(value: str, table: dict[str, str], default: str) -> str:
    """SQL of a lookup."""
    return f"CASE {value} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _first(value: str, table: dict[str, str]) -> str:
    """SQL of the first key that a value has in it."""
    return "CASE " + " ".join(f"WHEN contains({value}, {_quoted(k)}) THEN {_quoted(v)}" for k, v in table.items()) + " END"


def _holds(value: str, words) -> str:
    return "(" + " OR ".join(f"contains({value}, {_quoted(w)})" for w in words) + ")"


def _rule(rules, hit) -> str:
    return "CASE " + " ".join(f"WHEN {hit(words) if words else 'true'} THEN {_quoted(C.PURPOSE + purpose)}" for words, purpose in rules) + " END"


# --- paths


@query(f"""WITH {_PATH} SELECT page_id, {_case(_EXT, T.LANGUAGES, "'unknown'")} AS language, {_case(f"lower({_EXT})", T.INDEX_LANGUAGES, "'unknown'")} AS indexed_as,
{_case(f"lower({_EXT})", T.DESCRIBED_LANGUAGES, "'python'")} AS described_as FROM paths""")
def s7_languages(spark, d):
    p = F.col("path")
    return _paths(spark, d).select(
        "page_id", T.language(p).alias("language"), T.language(p, T.INDEX_LANGUAGES, fold=True).alias("indexed_as"), T.language(p, T.DESCRIBED_LANGUAGES, "python", fold=True).alias("described_as")
    )


_ENDS = ("", "_test.py", "/test_x", "/__init__.py", "/setup.py", "/requirements.py", "/x.py", ".md", ".json", "/attestation.py")


@query(f"""WITH {_PATH}, two AS (SELECT page_id, path || s AS path FROM paths, (SELECT unnest({list(_ENDS)}) AS s))
SELECT page_id, path, CASE WHEN ends_with(path, '_test.py') OR contains(path, 'test_') THEN 'test' WHEN ends_with(path, '.py') THEN CASE WHEN contains(path, '__init__.py') THEN 'package_init'
WHEN contains(path, 'setup.py') THEN 'setup' WHEN contains(path, 'requirements') THEN 'requirements' ELSE 'module' END WHEN ends_with(path, '.md') THEN 'documentation' WHEN ends_with(path, '.json') THEN 'configuration' ELSE 'other' END AS file_type FROM two""")
def p19_file_type(spark, d):
    two = _paths(spark, d).select("page_id", "path", F.explode(F.array(*map(F.lit, _ENDS))).alias("end")).select("page_id", F.concat("path", "end").alias("path"))
    return two.select("page_id", "path", T.file_type(F.col("path")).alias("file_type"))


@query(f"""WITH {_PATH}, n AS (SELECT page_id, replace(substr(path, 2), '/', s) AS name FROM paths, (SELECT unnest(['.', '[', '["', 'x[']) AS s))
SELECT page_id, name, name = '' OR regexp_matches(name, '^(window|document|console|navigator|location|history|screen|global|self)[.[]')
OR (contains(name, '[') AND contains(name, ']') AND NOT (length(name) - length(replace(name, '[', '')) = 1 AND length(name) - length(replace(name, ']', '')) = 1))
OR length(name) - length(replace(name, '.', '')) > 1 OR (starts_with(name, '$') AND length(name) > 1) OR contains(name, chr(39)) OR contains(name, chr(34)) OR contains(name, '`') AS dropped FROM n""")
def p6_script_names(spark, d):
    glue = F.explode(F.array(*map(F.lit, (".", "[", '["', "x["))))
    names = _paths(spark, d).select("page_id", "path", glue.alias("glue")).select("page_id", F.replace(F.expr("substr(path, 2)"), F.lit("/"), F.col("glue")).alias("name"))
    return names.select("page_id", "name", X.no_script_function(F.col("name")).alias("dropped"))


# --- functions


_TYPE = """CASE WHEN starts_with(name, 'test') THEN 'test' WHEN starts_with(name, '__') AND ends_with(name, '__') THEN 'magic_method' WHEN starts_with(name, '_') THEN 'private'
WHEN contains(code, 'async def') THEN 'async' WHEN contains(code, 'yield') THEN 'generator' WHEN contains(code, '@') AND contains(code, 'def') THEN 'decorated'
WHEN contains(code, 'def ') AND contains(code, '(') AND contains(code, ')') AND contains(code, 'return') THEN 'decorator' ELSE 'regular' END"""


@query(f"""WITH {_CODE}, t AS (SELECT id, {_TYPE} AS function_type FROM code) SELECT *, function_type = 'async' AS is_async, function_type = 'generator' AS is_generator,
function_type = 'decorator' AS is_decorator, function_type = 'test' AS is_test FROM t""")
def p21_function_type(spark, d):
    kind = _code(spark, d).select("id", T.function_type(F.col("name"), F.col("code")).alias("function_type"))
    return kind.withColumns(T.function_flags(F.col("function_type")))


@query(f"""WITH {_CODE} SELECT id, CASE WHEN contains(lower(name), 'test') THEN 'test' WHEN contains(code, 'async') OR contains(code, 'await') THEN 'async' WHEN contains(code, '@') AND contains(code, 'def') THEN 'decorator'
WHEN contains(code, 'class') AND contains(code, 'def') THEN 'method' ELSE 'regular' END AS function_type, contains(code, 'async def') OR contains(code, 'await') AS is_async,
starts_with(name, 'test_') OR ends_with(name, '_test') OR contains(code, 'assert') OR contains(code, 'unittest') AS is_test, contains(code, '@') AND contains(code, 'def') AS is_decorator FROM code""")
def p22_content_type(spark, d):
    rows, name, code = _code(spark, d), F.col("name"), F.col("code")
    return rows.select("id", T.content_type(name, code).alias("function_type"), *[flag.alias(k) for k, flag in T.content_flags(name, code).items()])


@query(f"""WITH {_CODE} SELECT id, CASE WHEN starts_with(name, '__') THEN 'magic' WHEN starts_with(name, '_') THEN 'private' WHEN contains(code, '@staticmethod') THEN 'static'
WHEN contains(code, '@classmethod') THEN 'class' ELSE 'instance' END AS method_type FROM code""")
def p23_method_type(spark, d):
    return _code(spark, d).select("id", T.method_type(F.col("name"), F.col("code")).alias("method_type"))


_PARAMETERS = r"len(list_filter(string_split(regexp_extract(code, 'def\s+\w+\s*\(([^)]*)\)', 1), ','), lambda x: NOT regexp_full_match(x, '\s*')))"
# signatures made of the names and first words, so that there is something to find
_SAMPLE = """'def ' || name || '(' || array_to_string(string_split(substr(code, 1, 60), ' '), ', ') || ') -> ' || name || ':' || chr(10) || repeat(chr(34), 3) || ' ' || replace(substr(code, 1, 80), chr(34), '') || ' ' || repeat(chr(34), 3)"""


def _signatures(spark, d):
    name, start = F.col("name"), F.substring("code", 1, 60)
    said = F.replace(F.substring("code", 1, 80), F.lit('"'), F.lit(""))
    code = F.concat(F.lit("def "), name, F.lit("("), F.array_join(F.split(start, " "), ", "), F.lit(") -> "), name, F.lit(':\n""" '), said, F.lit(' """'))
    return _code(spark, d).select("id", "name", code.alias("code"))


@query(f"""WITH {_CODE}, s AS (SELECT id, name, {_SAMPLE} AS code FROM code), n AS (SELECT *, {_PARAMETERS} AS k FROM s)
SELECT id, CASE WHEN regexp_matches(lower(name), 'main|init|setup|config') THEN 2.0::DOUBLE WHEN regexp_matches(lower(name), 'get|set|create|build') THEN 1.5 WHEN regexp_matches(lower(name), 'test|check|validate') THEN 1.0 ELSE 0.0 END
+ CASE WHEN contains(code, repeat(chr(34), 3)) OR contains(code, repeat(chr(39), 3)) THEN 1.0 ELSE 0.0 END + CASE WHEN k > 5 THEN 1.0 WHEN k > 2 THEN 0.5 ELSE 0.0 END
+ CASE WHEN contains(code, 'if __name__ == "__main__"') THEN 2.0 ELSE 0.0 END AS score FROM n""")
def p25_heuristic_importance(spark, d):
    return _signatures(spark, d).select("id", T.heuristic_importance(F.col("name"), F.col("code")).alias("score"))


@query(rf"""WITH {_CODE}, s AS (SELECT id, {_SAMPLE} AS code FROM code) SELECT id, CAST({_PARAMETERS} AS BIGINT) AS n_parameters, regexp_extract(code, '->\s*(\w+)', 1) AS return_type,
regexp_replace(regexp_extract(code, '"{{3}}([^"]*)"{{3}}', 1), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS docstring FROM s""")
def p26_signature(spark, d):
    c = F.col("code")
    return _signatures(spark, d).select("id", T.parameter_count(c).alias("n_parameters"), T.return_type(c).alias("return_type"), T.docstring(c).alias("docstring"))


@query(rf"""WITH {_CODE} SELECT id, substr(regexp_replace('/* ' || code || ' */', '^[/#*\s]+|[*/\s]+$', '', 'g'), 1, 50) AS summary FROM code""")
def p28_comment_summary(spark, d):
    return _code(spark, d).select("id", T.comment_summary(F.concat(F.lit("/* "), F.col("code"), F.lit(" */"))).alias("summary"))


_BREAKS = "lambda x: length(x) - length(replace(x, chr(10), ''))"


def _lines_sql(pattern: str) -> str:
    """SQL of name:line of the matches of a pattern with one group, joined by commas."""
    p = _quoted(pattern)
    return f"""array_to_string(list_transform(range(1, len(regexp_extract_all(code, {p})) + 1), lambda i: regexp_extract_all(code, {p}, 1)[i] || ':' ||
CAST(1 + list_sum(list_transform(string_split_regex(code, {p})[1:i], {_BREAKS})) + coalesce(list_sum(list_transform(regexp_extract_all(code, {p})[1:i - 1], {_BREAKS})), 0) AS BIGINT)), ',')"""


@query(f"""WITH {_CODE}, s AS (SELECT id, replace(replace(code, ' et ', chr(10) || 'def et ( x ):' || chr(10)), ' the ', chr(10) || 'class The(a):' || chr(10) || ' import the' || chr(10)) AS code FROM code)
SELECT id, {_lines_sql(X.PYTHON_FUNCTION)} AS functions, {_lines_sql(X.PYTHON_CLASS)} AS classes, array_to_string(list_transform(regexp_extract_all(code, {_quoted(X.PYTHON_IMPORT)}, 1), lambda x: trim(x)), '|') AS imports FROM s""")
def p16_structure(spark, d):
    # prose with definitions put in place of two common words
    code = F.replace(F.col("code"), F.lit(" et "), F.lit("\ndef et ( x ):\n"))
    code = F.replace(code, F.lit(" the "), F.lit("\nclass The(a):\n import the\n"))
    found = _code(spark, d).select("id", X.structure(code, F.lit("python")).alias("s"))
    line = lambda array: F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["name"], x["line"].cast("string"))), ",")
    return found.select("id", line(F.col("s.functions")).alias("functions"), line(F.col("s.classes")).alias("classes"), F.array_join("s.imports", "|").alias("imports"))


# --- context


_SURROUND = """ctx AS (SELECT id, file_path, parent_class, name, string_split(name, ' ') AS words, CAST(coalesce(k, 0) AS BIGINT) AS n_calls, CAST(coalesce(u, 0) AS BIGINT) AS n_files FROM functions
LEFT JOIN (SELECT src, count(*) AS k FROM edges GROUP BY src) o ON o.src = id LEFT JOIN (SELECT dst, count(DISTINCT f.file_path) AS u FROM edges JOIN functions f ON f.id = src GROUP BY dst) i ON i.dst = id)"""


def _surround(spark, d):
    f, e = A.functions(spark, d), G.distinct_edges(A.calls(spark, d))
    calls = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_calls"))
    files = e.join(f.select(F.col("id").alias("src"), "file_path"), "src").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("file_path").alias("n_files"))
    rows = f.select("id", "file_path", "parent_class", "name", F.split("name", " ").alias("words"))
    return rows.join(calls, "id", "left").join(files, "id", "left").fillna(0, ["n_calls", "n_files"])


@query(f"""WITH {_SURROUND} SELECT id, concat_ws(' | ', '{C.FILE}' || file_path, '{C.CLASS}' || parent_class, '{C.IMPORTS}' || array_to_string(words[1:2], ', ')) AS fast,
concat_ws(' | ', '{C.FILE}' || file_path, '{C.CLASS}' || parent_class, '{C.IMPORTS}' || array_to_string(words[1:3], ', '), CASE WHEN n_calls > 0 THEN '{C.CALLS}' || n_calls || '个函数' END) AS fallback FROM ctx""")
def p29_context_summaries(spark, d):
    x, place = _surround(spark, d), (F.col("file_path"), F.col("parent_class"), F.col("words"))
    return x.select("id", C.fast_summary(*place).alias("fast"), C.fallback_summary(*place, F.col("n_calls")).alias("fallback"))


_TAGS = f"list_transform(words, lambda x: {_first('x', C.DOMAINS)})"


def _any(words) -> str:
    return f"len(list_filter(words, lambda x: {_holds('x', words)})) > 0"


def _named(words) -> str:
    return _holds("lower(name)", words)


def _said(words) -> str:
    return _holds("lower(code)", words)


@query(f"""WITH {_CODE}, t AS (SELECT id, name, code, string_split(lower(substr(code, 1, 400)), ' ') AS words FROM code),
g AS (SELECT *, list_filter(list_concat({_TAGS}, {_TAGS}, [{_first("lower(name)", C.FUNCTION_PATTERNS)}, {_first("lower(name)", C.API_NAMES)}]), lambda x: x IS NOT NULL) AS tags,
list_filter(list_transform(words, lambda x: {_first("x", C.API_CALLS)}), lambda x: x IS NOT NULL) AS known FROM t),
u AS (SELECT *, list_filter(tags, lambda x, i: list_position(tags, x) = i) AS found FROM g)
SELECT id, CASE WHEN {_any(C.MODEL_LIBRARIES)} THEN coalesce(CASE WHEN {_named(("client", "init"))} THEN {_rule(C.MODEL_CLIENT, _said)} END, {_rule(C.MODEL_BY_NAME, _named)}, {_rule(C.MODEL_BY_CODE, _said)}) END AS model_purpose,
CASE WHEN len(found) > 0 THEN coalesce(CASE WHEN {_any(C.MODEL_LIBRARIES)} THEN {_rule(C.MODEL_DOMAIN, _named)} END, CASE WHEN {_any(("requests", "aiohttp"))} THEN {_rule(C.NETWORK_DOMAIN, _named)} END,
{_rule(C.MODEL_CALLS, _any)}, '{C.PURPOSE}' || array_to_string(found[1:2], ', ')) END AS domain_purpose,
'{C.CALLS}' || coalesce(known[1], len(words) || '个函数' || CASE WHEN len(words) > 3 THEN '（复杂调用）' ELSE '' END) AS call_pattern FROM u""")
def p32_purposes(spark, d):
    x = _code(spark, d).withColumn("words", F.split(F.lower(F.substring("code", 1, 400)), " "))  # a function's imports and calls are few
    name, words = F.col("name"), F.col("words")
    return x.select(
        "id", C.model_purpose(name, F.col("code"), words).alias("model_purpose"), C.domain_purpose(words, words, name).alias("domain_purpose"), C.call_pattern(words).alias("call_pattern")
    )


@query(f"""WITH {_SURROUND} SELECT id, CASE WHEN n_files = 1 THEN '{C.USE}单文件内调用' WHEN n_files > 1 THEN '{C.USE}' || n_files || '个文件调用' || CASE WHEN n_files > 3 THEN '（广泛使用）' ELSE '' END END AS usage FROM ctx""")
def p34_usage(spark, d):
    return _surround(spark, d).select("id", C.usage_breadth(F.col("n_files")).alias("usage"))


@query(f"""WITH {_CODE} SELECT id, concat_ws(' | ', '函数名: ' || nullif(name, ''), '上下文: ' || language, '代码: ' || nullif(CASE WHEN length(code) > 100 THEN substr(code, 1, 100) || '...' ELSE code END, '')) AS description FROM code""")
def p36_search_description(spark, d):
    row = {"name": F.col("name"), "context": F.col("language"), "code": F.col("code"), "level": F.lit(None).cast("string")}
    return _code(spark, d).select("id", C.search_description(row).alias("description"))


@query("""SELECT id, coalesce(name, 'Unknown') AS function_name, coalesce(file_path, 'Unknown') AS file_path, coalesce(parent_class, '') AS parent_class, complexity_score, 'regular' AS function_type, false AS is_test FROM functions""")
def p38_result_context(spark, d):
    row = {"function_name": F.col("name"), "file_path": F.col("file_path"), "parent_class": F.col("parent_class"), "complexity_score": F.col("complexity_score")}
    found = A.functions(spark, d).select("id", C.result_context(row).alias("c"))
    return found.select("id", *[f"c.{k}" for k in ("function_name", "file_path", "parent_class", "complexity_score", "function_type", "is_test")])


@query(r"""SELECT id, substr(concat_ws('::', name, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]+$', ''), substr(md5(file_path), 1, 8)), 1, 100) AS key FROM functions""")
def p40_unique_key_without_class(spark, d):
    return A.functions(spark, d).select("id", T.unique_key(F.col("name"), F.col("file_path"), F.lit(None).cast("string")).alias("key"))


@query("""SELECT id, round(least(1.0::DOUBLE, CASE WHEN lines_of_code > 0 THEN least(lines_of_code / 10.0::DOUBLE, 1) * 0.4 ELSE 0.1 END + CASE WHEN complexity_score > 0 THEN least(complexity_score / 20.0::DOUBLE, 1) * 0.3 ELSE 0.05 END
+ CASE WHEN branch_count = 0 THEN 0.1 ELSE 0 END + CASE WHEN parent_class IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN branch_count = 0 THEN 0.1 ELSE 0 END + 0.05), 6) AS score FROM functions""")
def r19_graph_score(spark, d):
    kind = F.when(F.col("branch_count") == 0, "test").otherwise("regular")
    score = T.graph_score(F.col("lines_of_code"), F.col("complexity_score"), kind, F.col("parent_class"))
    return A.functions(spark, d).select("id", F.round(score, 6).alias("score"))
