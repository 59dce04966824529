from sieveline.operators import tree

PAGE = """lead<html><!-- <p>no</p> --><script>var t="</p>";</script><body><nav><a href="/x"> Home &amp; more </a><a>plain</a></nav><main><form>
<label for="mail">Your mail</label><input id="mail" type="email"><label>Pass word <input type='password'></label><input placeholder="Find" type=search>
<div id="d1">First</div><div id="d2">Second</div><button aria-labelledby="d1 d2 none">x</button><span title=" Tip ">t</span><img alt="A cat" src=c.png></form>
<section aria-label="Part"><p>open<p>one <b>bold</b> end</p></section><div role="region"><i>deep</i></div></main></body></html>"""


def test_names_roles_and_places(spark):
    rows = tree.described(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<b>" + "x" * 300 + "</b>")], "page_id bigint, html string")).collect()
    own = {r.pre: r for r in rows if r.page_id == 1}
    by = lambda tag: [r for _, r in sorted(own.items()) if r.tag == tag]
    assert [(r.name, r.role, r.landmark, r.path, r.affordances) for r in by("a")] == [("Home & more", "link", "nav", "html>body>nav", "click"), ("plain", "generic", "nav", "html>body>nav", "focus")]
    assert [(r.name, r.role, r.landmark, r.affordances, r.hint) for r in by("input")] == [("Your mail", "textbox", "form", "type focus", None), ("Pass word", "textbox", "form", "type focus", None), ("Find", "searchbox", "form", "type focus", None)]
    assert by("button")[0].name == "First Second" and by("span")[0].name == "Tip" and by("img")[0].name == "A cat"
    assert (by("section")[0].name, by("section")[0].role, by("section")[0].landmark) == ("Part", "region", "section")
    assert [(r.name, r.end == r.pre) for r in by("p")] == [("", True), ("one bold end", False)]
    assert (by("i")[0].landmark, by("i")[0].path, by("i")[0].depth) == ("region", "html>body>main>div", 4)
    assert by("label")[1].hint is None and [r.hint for r in by("div")] == [None, None, None]
    assert [r.name for r in rows if r.page_id == 4] == [""] and not [r for r in rows if r.page_id in (2, 3)]


def test_ten_ancestors_and_hints(spark):
    deep = "".join(f"<d{k}>" for k in range(15)) + "<a title='Bank account'>x</a>" + "".join(f"</d{k}>" for k in reversed(range(15)))
    rows = tree.described(spark.createDataFrame([(1, deep)], "page_id bigint, html string")).collect()
    a = next(r for r in rows if r.tag == "a")
    assert a.depth == 15 and a.path == ">".join(f"d{k}" for k in range(5, 15)) and a.hint == "financial" and a.landmark is None
