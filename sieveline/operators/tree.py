"""Elements of pages as trees whose nodes are intervals.

Tags are numbered in order. An element's interval runs from its opening tag to the
closing one, which is the next of its name on the same level; levels are running
sums, so that tags are paired by windows and no stack is kept. An ancestor is an
interval around another one: the ancestor on a level is the last one that opened
there, so ancestors are found as of a place and not by comparing all pairs. Texts
are looked up by the offsets of intervals in the text of the whole page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as one tag; scripts, styles and comments are one whole.
TAG = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|</?[a-z][^>]*>"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "script", "style")
BLANKS = " \t\n\r\f\v"
#: Landmarks by tag and by role, ancestors of a path, the longest name.
LANDMARKS = ("nav", "main", "header", "footer", "aside", "form", "section")
LANDMARK_ROLES = ("navigation", "main", "banner", "contentinfo", "complementary", "form", "region")
MOST_ANCESTORS, LONGEST_NAME = 10, 200
#: Roles by tag, and of inputs by type.
ROLES = {
    "button": "button", "select": "combobox", "textarea": "textbox", "img": "img", "canvas": "img", "video": "video", "audio": "audio", "nav": "navigation", "main": "main", "header": "banner",
    "footer": "contentinfo", "aside": "complementary", "form": "form", "table": "table", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "ul": "list", "ol": "list", "li": "listitem", "dialog": "dialog", "progress": "progressbar", "meter": "meter",
}
INPUT_ROLES = {"submit": "button", "button": "button", "reset": "button", "checkbox": "checkbox", "radio": "radio", "range": "slider", "search": "searchbox", "hidden": "hidden"}
#: What a name must hold to hint at a category, in order, and the
#: categories by words in them.
LABELS = ("password", "credential", "bank", "account", "card", "cvv", "cvc", "ssn", "aadhaar", "pan", "passport", "identity", "health", "medical", "student", "employee", "government", "social security", "otp", "pin", "secret", "private key", "api key", "token")
LABEL_CATEGORIES = (("financial", ("bank", "account", "card")), ("credential", ("password", "otp", "pin", "secret", "key")), ("health", ("health", "medical")), ("identity-document", ("aadhaar", "ssn", "passport", "pan")))
#: References that are decoded, the sign for itself last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    for reference, sign in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return text


def attribute(name: str, tag: Column | str = "t") -> Column:
    """The value of an attribute, null if it is not there or empty."""
    found = [F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*{form}", 1) for form in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def elements(pages: DataFrame) -> DataFrame:
    """A row per element of ``pages`` (page_id, html; page_id names a page).

    Returns page_id, pre, end, depth, tag, t (the tag as written), and lo and hi,
    the offsets of its trimmed text in the text of the page (equal: no text). An
    element without a closing tag ends where it starts and has no text. A null page
    has no elements.
    """
    pieces = pages.where("html is not null").select("page_id", F.regexp_extract_all("html", F.lit(TAG), F.lit(0)).alias("m"), F.split("html", TAG).alias("g"))
    rows = pieces.select("page_id", F.length(F.get("g", F.lit(0))).alias("before"), F.posexplode(F.zip_with("m", F.slice("g", 2, F.size("g")), lambda t, x: F.struct(t.alias("t"), F.coalesce(x, F.lit("")).alias("x")))).alias("k", "p"))
    rows = rows.select("page_id", "before", F.col("k").cast("bigint").alias("k"), "p.t", "p.x").withColumn("tag", F.lower(F.regexp_extract("t", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1)))
    closing = F.col("t").startswith("</")
    opening = ~closing & (F.col("tag") != "") & ~F.col("tag").isin(*VOID) & ~F.col("t").endswith("/>")
    page = Window.partitionBy("page_id").orderBy("k")
    by_name = Window.partitionBy("page_id", "tag").orderBy("k")
    rows = rows.withColumns({"step": F.when(opening, 1).when(closing, -1).otherwise(0)})
    rows = rows.withColumns({"level": F.sum("step").over(by_name) + F.when(F.col("step") == -1, 1).otherwise(0), "off": F.col("before") + F.sum(F.length("x")).over(page) - F.length("x")})
    some = _trimmed(F.col("x")) != ""
    rows = rows.withColumns({
        "first": F.when(some, F.col("off") + F.length("x") - F.length(F.ltrim(F.col("x"), F.lit(BLANKS)))),
        "last": F.when(some, F.col("off") + F.length(F.rtrim(F.col("x"), F.lit(BLANKS)))),
    })
    rows = rows.withColumns({
        "first": F.last("first", ignorenulls=True).over(Window.partitionBy("page_id").orderBy(F.col("k").desc())),
        "last": F.last("last", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1)),
    })
    pairs = Window.partitionBy("page_id", "tag", F.col("step") == 0, "level").orderBy("k")
    ahead = F.lead(F.struct("step", "k", "last")).over(pairs)
    rows = rows.withColumns({"ahead": ahead, "behind": F.lag("step").over(pairs)})
    paired = (F.col("step") == 1) & (F.col("ahead.step") == -1)
    ends = (F.col("step") == -1) & (F.col("behind") == 1)
    rows = rows.withColumns({"paired": F.coalesce(paired, F.lit(False)), "ends": F.coalesce(ends, F.lit(False))})
    depth = F.sum(F.when(F.col("paired"), 1).when(F.col("ends"), -1).otherwise(0)).over(page) - F.col("paired").cast("int")
    inside = F.col("paired") & (F.col("first") < F.col("ahead.last"))
    return rows.withColumn("depth", depth).where((F.col("step") != -1) & (F.col("tag") != "")).select(
        "page_id", F.col("k").alias("pre"), F.when(F.col("paired"), F.col("ahead.k")).otherwise(F.col("k")).alias("end"), "depth", "tag", "t",
        F.when(inside, F.col("first")).otherwise(0).alias("lo"), F.when(inside, F.col("ahead.last")).otherwise(0).alias("hi"),
    )


def with_ancestors(nodes: DataFrame, most: int = MOST_ANCESTORS) -> DataFrame:
    """Adds path, the tags of at most ``most`` ancestors, outermost first.

    Every element stands on its level and asks for the levels above; the answer
    is the last element that opened there.
    """
    asked = F.sequence(F.greatest(F.col("depth") - most, F.lit(0)), F.greatest(F.col("depth") - 1, F.lit(0)))
    asks = nodes.where("depth > 0").select("page_id", F.explode(asked).alias("level"), "pre", F.lit(None).cast("string").alias("is"))
    stands = nodes.where("end > pre").select("page_id", F.col("depth").alias("level"), "pre", F.col("tag").alias("is"))
    w = Window.partitionBy("page_id", "level").orderBy("pre")
    answers = asks.unionByName(stands).withColumn("above", F.last("is", ignorenulls=True).over(w)).where("`is` is null")
    paths = answers.groupBy("page_id", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "above"))), lambda a: a["above"]), ">").alias("path"))
    return nodes.join(paths, ["page_id", "pre"], "left").withColumn("path", F.coalesce("path", F.lit("")))


def with_landmarks(nodes: DataFrame) -> DataFrame:
    """Adds landmark: of the element itself or else of the nearest around it."""
    role = attribute("role")
    own = F.when(F.col("tag").isin(*LANDMARKS), F.col("tag")).when(role.isin(*LANDMARK_ROLES), role)
    marked = nodes.withColumn("own", own)
    held = marked.where("own is not null and end > pre")
    bounds = held.select("page_id", F.col("pre").alias("at"), F.lit(1).alias("by")).unionByName(held.select("page_id", F.col("end").alias("at"), F.lit(-1).alias("by")))
    rows = marked.select("page_id", F.col("pre").alias("at"), F.lit(0).alias("by"), "own").unionByName(bounds.withColumn("own", F.lit(None).cast("string")))
    # Within landmarks a place has a level of its own; bounds go before their element.
    w = Window.partitionBy("page_id").orderBy("at", F.col("by").desc())
    levels = rows.withColumn("level", F.sum("by").over(w)).where("by = 0")
    last = F.last("own", ignorenulls=True).over(Window.partitionBy("page_id", "level").orderBy("at"))
    found = levels.withColumn("landmark", F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("level") > 0, last)).select("page_id", F.col("at").alias("pre"), "landmark")
    return marked.join(found, ["page_id", "pre"]).drop("own")


def role() -> Column:
    """Of tag and t; an explicit role counts first."""
    by_tag = F.create_map(*[F.lit(x) for item in ROLES.items() for x in item])
    by_type = F.create_map(*[F.lit(x) for item in INPUT_ROLES.items() for x in item])
    tag, given = F.col("tag"), attribute("role")
    kind = F.coalesce(F.try_element_at(by_type, F.lower(attribute("type"))), F.lit("textbox"))
    link = F.when(F.col("t").rlike(r"(?i)\shref\b"), "link").otherwise("generic")
    region = F.when(attribute("aria-label").isNotNull(), "region").otherwise("generic")
    return F.coalesce(given, F.when(tag == "a", link).when(tag == "input", kind).when(tag == "section", region), F.try_element_at(by_tag, tag), F.lit("generic"))


def _texts(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """page_id, pre, text: decoded texts of spans (page_id, pre, lo, hi), each of
    at most a name's length; a page's text is cut in its own row."""
    longest = max(len(r) for r, _ in REFERENCES) * LONGEST_NAME
    wanted = spans.where((F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") <= longest)).groupBy("page_id").agg(F.collect_list(F.struct("pre", "lo", "hi")).alias("spans"))
    whole = pages.select("page_id", F.array_join(F.split("html", TAG), "").alias("whole"))
    cut = lambda s: F.struct(s["pre"].alias("pre"), decoded(F.substring(F.col("whole"), (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int"))).alias("text"))
    cuts = wanted.join(whole, "page_id").select("page_id", F.explode(F.transform("spans", cut)).alias("c"))
    return cuts.select("page_id", "c.pre", "c.text").where(F.length("text") <= LONGEST_NAME)


def with_names(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds name: of aria-label, the elements of aria-labelledby, a control's label
    (by its id, or around it), placeholder, title, alt and the text, the first one
    that says something; texts over 200 characters are no names.
    """
    texts = nodes.join(_texts(pages, nodes), ["page_id", "pre"], "left")
    ids = texts.select("page_id", attribute("id").alias("id"), "pre", "text").where("id is not null").groupBy("page_id", "id").agg(F.min_by("text", "pre").alias("said"))
    refs = texts.select("page_id", "pre", F.posexplode(F.split(attribute("aria-labelledby"), r"\s+")).alias("j", "id"))
    by_id = refs.join(ids, ["page_id", "id"]).where("said is not null").groupBy("page_id", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "said"))), lambda x: x["said"]), " ").alias("by_id"))
    labels = texts.where("tag = 'label'")
    fors = labels.select("page_id", attribute("for").alias("id"), "pre", "text").where("id is not null").groupBy("page_id", "id").agg(F.min_by("text", "pre").alias("by_for"))
    # The nearest label around a control is the last that opened before it, if it is open still.
    control = F.col("tag").isin("input", "select", "textarea")
    stand = labels.where("end > pre").select("page_id", "pre", F.struct("pre", "end", "text").alias("label")).unionByName(texts.where(control).select("page_id", "pre", F.lit(None).cast("struct<pre:bigint,end:bigint,text:string>").alias("label")))
    near = stand.withColumn("near", F.last("label", ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pre"))).where("label is null and near.end > pre").select("page_id", "pre", F.col("near.text").alias("around"))
    joined = texts.withColumn("own_id", attribute("id")).join(by_id, ["page_id", "pre"], "left").join(fors.withColumnRenamed("id", "own_id"), ["page_id", "own_id"], "left").join(near, ["page_id", "pre"], "left")
    said = lambda c: F.nullif(_trimmed(c), F.lit(""))
    labelled = F.when(control, F.coalesce(said(F.col("by_for")), said(F.col("around")), attribute("placeholder")))
    alt = F.when(F.col("tag") == "img", said(attribute("alt")))
    name = F.coalesce(said(attribute("aria-label")), F.nullif("by_id", F.lit("")), labelled, said(attribute("title")), alt, said(F.col("text")), F.lit(""))
    return joined.withColumn("name", name).drop("own_id", "by_id", "by_for", "around", "text")


def affordances() -> Column:
    """What may be done with an element of role, tag and t, in order."""
    role_, tag = F.col("role"), F.col("tag")
    typed = role_.isin("textbox", "searchbox")
    rules = ((role_.isin("button", "link", "checkbox", "radio", "combobox", "slider"), "click"), (typed, "type"), (typed, "focus"), (role_ == "combobox", "select"), (F.lower(attribute("contenteditable")) == "true", "type"), ((tag == "input") & (F.lower(attribute("type")) == "file"), "upload"))
    listed = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(what)) for rule, what in rules]))
    native = tag.isin("a", "button", "input", "select", "textarea") | (attribute("tabindex").cast("int") >= 0)
    return F.when((F.size(listed) == 0) & F.coalesce(native, F.lit(False)), F.array(F.lit("focus"))).otherwise(listed)


def hint() -> Column:
    """The category at which a name hints by the first keyword in it, or null."""
    name = F.lower("name")
    keyword = F.coalesce(*[F.when(F.contains(name, F.lit(k)), F.lit(k)) for k in LABELS])
    out = F.when(keyword.isNotNull(), "contact")
    for category, words in reversed(LABEL_CATEGORIES):
        holds = F.lit(False)
        for w in words:
            holds = holds | F.contains(keyword, F.lit(w))
        out = F.when(holds, category).otherwise(out)
    return out


def actionability() -> Column:
    """What an element of role, name, tag, t and the array ``can`` (its affordances)
    is good for on the page itself."""
    has = lambda what: F.array_contains("can", what)
    flag = lambda name: F.col("t").rlike(rf"(?i)\s{name}(?=[\s=/>])")
    role_ = F.col("role")
    return (
        F.when(flag("disabled") | flag("hidden"), "non-actionable").when(has("type") | role_.isin("textbox", "searchbox"), F.when(flag("readonly"), "readable").otherwise("typable"))
        .when((role_ == "combobox") | has("select"), "selectable").when(has("click") | role_.isin("button", "link"), "clickable").when(has("scroll"), "scrollable")
        .when(role_.isin("heading", "img") | (F.col("name") != ""), "readable").otherwise("unknown")
    )


def planner_view() -> dict[str, Column]:
    """What a planner is told of an element: what it is good for, what may be done
    with it, in order, and its part in an interaction."""
    has = lambda what: F.array_contains("can", what)
    role_, kind = F.col("role"), F.coalesce(F.lower(attribute("type")), F.lit(""))
    good_for = F.when(has("click"), "clickable").when(has("type"), "typable").when(has("select"), "selectable").when(F.col("name") != "", "readable").otherwise("unknown")
    rules = ((has("type"), "type_text"), (has("type"), "type_token"), (has("click") | role_.isin("button", "link"), "click"), (has("select") | (role_ == "combobox"), "select"), (has("focus") | has("type"), "focus"), (has("scroll"), "scroll"))
    part = (
        F.when((role_ == "searchbox") | (kind == "search"), "search_input").when(((role_ == "button") | (kind == "submit")) & F.col("landmark").eqNullSafe(F.lit("search")), "search_submit")
        .when(role_.isin("option", "listitem"), "autocomplete_option").when((role_ == "textbox") & has("type"), "form_input").when(kind.isin("submit", "button") & (role_ == "button"), "form_submit")
        .when(role_ == "link", "navigation_link").when(role_ == "button", "button").otherwise("generic")
    )
    return {"good_for": good_for, "supported": F.array_join(F.array_compact(F.array(*[F.when(rule, F.lit(what)) for rule, what in rules])), " "), "interaction": part}


def described(pages: DataFrame) -> DataFrame:
    """page_id, pre, end, depth, tag, role, name, landmark, path, affordances, hint,
    actionability, and what a planner is told: good_for, supported, interaction."""
    nodes = with_landmarks(with_ancestors(with_names(elements(pages), pages))).withColumn("role", role()).withColumn("can", affordances())
    nodes = nodes.withColumns({"hint": hint(), "actionability": actionability(), **planner_view()}).withColumn("affordances", F.array_join("can", " "))
    return nodes.drop("can", "t", "lo", "hi")
