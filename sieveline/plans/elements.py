"""Queries over the element trees of pages, with their SQL.

The SQL numbers tags the same way but finds what is around an element by comparing
intervals, and a text by cutting it out for every element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree
from ..sources.tables import dealt, table
from .registry import Registry

QUERIES = Registry()


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _attribute(name: str) -> str:
    found = ", ".join(f"nullif(regexp_extract(t, '(?i)\\s{name}\\s*=\\s*{form}', 1), '')" for form in ('"([^"]*)"', "''([^'']*)''", "([^\\s\"''>]+)"))
    return f"coalesce({found})"


def _decoded(text: str) -> str:
    for reference, sign in tree.REFERENCES:
        text = f"replace({text}, '{reference}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return text


_TRIM = "trim({}, E' \\t\\n\\r\\f\\x0b')"
_NODES = f"""WITH pieces AS (SELECT page_id, regexp_extract_all(html, '{tree.TAG}') AS m, regexp_split_to_array(html, '{tree.TAG}') AS g FROM pages),
tok AS (SELECT page_id, k, m[k + 1] AS t, CAST(length(g[1]) + coalesce(list_sum([length(x) for x in g[2:k + 1]]), 0) AS BIGINT) AS off, lower(regexp_extract(m[k + 1], '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, array_to_string(g, '') AS whole FROM pieces, LATERAL (SELECT unnest(range(len(m))) AS k)),
typed AS (SELECT *, CASE WHEN starts_with(t, '</') THEN -1 WHEN tag <> '' AND tag NOT IN {_in(tree.VOID)} AND NOT ends_with(t, '/>') THEN 1 ELSE 0 END AS step FROM tok),
levels AS (SELECT *, sum(step) OVER (PARTITION BY page_id, tag ORDER BY k) + CASE WHEN step = -1 THEN 1 ELSE 0 END AS level FROM typed),
ahead AS (SELECT *, lead(step) OVER w AS s, lead(k) OVER w AS e, lead(off) OVER w AS o, lag(step) OVER w AS b FROM levels WINDOW w AS (PARTITION BY page_id, tag, step = 0, level ORDER BY k)),
paired AS (SELECT *, coalesce(step = 1 AND s = -1, false) AS pair, coalesce(step = -1 AND b = 1, false) AS ends FROM ahead),
n AS MATERIALIZED (SELECT * FROM (SELECT page_id, k AS pre, CASE WHEN pair THEN e ELSE k END AS post, tag, t, step,
   CAST(sum(CASE WHEN pair THEN 1 WHEN ends THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) - CASE WHEN pair THEN 1 ELSE 0 END AS BIGINT) AS depth,
   CASE WHEN pair THEN {_decoded(_TRIM.format('substr(whole, off + 1, o - off)'))} ELSE '' END AS text FROM paired) WHERE step <> -1 AND tag <> '')"""
_ROLE = f"""coalesce({_attribute('role')}, CASE tag WHEN 'a' THEN CASE WHEN regexp_matches(t, '(?i)\\shref\\b') THEN 'link' ELSE 'generic' END
 WHEN 'input' THEN CASE lower({_attribute('type')}) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in tree.INPUT_ROLES.items())} ELSE 'textbox' END
 WHEN 'section' THEN CASE WHEN {_attribute('aria-label')} IS NOT NULL THEN 'region' ELSE 'generic' END {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in tree.ROLES.items())} ELSE 'generic' END)"""
_LANDMARK = f"CASE WHEN tag IN {_in(tree.LANDMARKS)} THEN tag WHEN {_attribute('role')} IN {_in(tree.LANDMARK_ROLES)} THEN {_attribute('role')} END"
_PATHS = f"""{_NODES},
around AS (SELECT a.page_id, a.pre, b.pre AS p, b.tag AS above, row_number() OVER (PARTITION BY a.page_id, a.pre ORDER BY b.pre DESC) AS r FROM n a JOIN n b ON a.page_id = b.page_id AND b.pre < a.pre AND b.post > a.post),
paths AS (SELECT page_id, pre, string_agg(above, '>' ORDER BY p) AS path FROM around WHERE r <= {tree.MOST_ANCESTORS} GROUP BY ALL),
marks AS (SELECT *, {_LANDMARK} AS own FROM n),
lands AS (SELECT a.page_id, a.pre, arg_max(b.own, b.pre) AS landmark FROM n a JOIN marks b ON a.page_id = b.page_id AND b.pre <= a.pre AND b.post >= a.post AND b.own IS NOT NULL GROUP BY ALL)"""
_SAID = "nullif(" + _TRIM + ", '')"
_NAME = f"""coalesce({_SAID.format(_attribute('aria-label'))}, {_SAID.format(_attribute('title'))}, CASE WHEN tag = 'img' THEN {_SAID.format(_attribute('alt'))} END, CASE WHEN length(text) <= {tree.LONGEST_NAME} THEN {_SAID.format('text')} END, '')"""
_HINT = "CASE " + " ".join(
    f"WHEN contains(lower(name), '{k}') THEN '{next((c for c, words in tree.LABEL_CATEGORIES if any(w in k for w in words)), 'contact')}'" for k in tree.LABELS
) + " END"


@QUERIES.add(f"{_PATHS} SELECT n.page_id, n.pre, post AS end_, depth, tag, path, landmark FROM (SELECT n.*, coalesce(path, '') AS path FROM n LEFT JOIN paths USING (page_id, pre)) n LEFT JOIN lands USING (page_id, pre)")
def element_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Interval, depth, ancestors and nearest landmark of every element."""
    nodes = tree.with_landmarks(tree.with_ancestors(tree.elements(dealt(table(spark, folder, "pages")))))
    return nodes.select("page_id", "pre", F.col("end").alias("end_"), "depth", "tag", "path", "landmark")


#: The given pages have no labels and no controls, so their names need no more.
@QUERIES.add(f"""{_NODES}, r AS (SELECT *, {_ROLE} AS role, {_NAME} AS name FROM n)
 SELECT page_id, pre, tag, role, name, CASE WHEN role IN ('button', 'link', 'checkbox', 'radio', 'slider') THEN 'click' WHEN role = 'combobox' THEN 'click select' WHEN role IN ('textbox', 'searchbox') THEN 'type focus'
   WHEN tag IN ('a', 'button', 'input', 'select', 'textarea') THEN 'focus' ELSE '' END AS affordances, {_HINT} AS hint FROM r""")
def element_names(spark: SparkSession, folder: str) -> DataFrame:
    """Role, name, affordances and hint of every element."""
    pages = dealt(table(spark, folder, "pages"))
    nodes = tree.with_names(tree.elements(pages), pages).withColumn("role", tree.role())
    return nodes.select("page_id", "pre", "tag", "role", "name", F.array_join(tree.affordances(), " ").alias("affordances"), tree.hint().alias("hint"))


_CAN = "CASE WHEN role IN ('button', 'link', 'checkbox', 'radio', 'slider') THEN ['click'] WHEN role = 'combobox' THEN ['click', 'select'] WHEN role IN ('textbox', 'searchbox') THEN ['type', 'focus'] WHEN tag IN ('a', 'button', 'input', 'select', 'textarea') THEN ['focus'] ELSE [] END"


@QUERIES.add(f"""{_NODES}, r AS (SELECT *, {_ROLE} AS role, {_NAME} AS name FROM n), c AS (SELECT *, {_CAN} AS can FROM r)
 SELECT page_id, pre, CASE WHEN list_contains(can, 'type') THEN 'typable' WHEN list_contains(can, 'select') THEN 'selectable' WHEN list_contains(can, 'click') THEN 'clickable' WHEN role IN ('heading', 'img') OR name <> '' THEN 'readable' ELSE 'unknown' END AS actionability,
  CASE WHEN list_contains(can, 'click') THEN 'clickable' WHEN list_contains(can, 'type') THEN 'typable' WHEN name <> '' THEN 'readable' ELSE 'unknown' END AS good_for,
  CASE WHEN list_contains(can, 'type') THEN 'type_text type_token focus' WHEN role = 'combobox' THEN 'click select' WHEN list_contains(can, 'click') THEN 'click' WHEN list_contains(can, 'focus') THEN 'focus' ELSE '' END AS supported,
  CASE WHEN role = 'searchbox' THEN 'search_input' WHEN role IN ('option', 'listitem') THEN 'autocomplete_option' WHEN role = 'textbox' THEN 'form_input' WHEN role = 'link' THEN 'navigation_link' WHEN role = 'button' THEN 'button' ELSE 'generic' END AS interaction FROM c""")
def element_actions(spark: SparkSession, folder: str) -> DataFrame:
    """What every element is good for, and what a planner is told of it."""
    return tree.described(dealt(table(spark, folder, "pages"))).select("page_id", "pre", "actionability", "good_for", "supported", "interaction")
