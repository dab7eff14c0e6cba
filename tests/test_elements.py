"""Elements at any depth against the standard library's tree."""

import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from feedcore.sources import scan
from feedcore.sources.elements import elements


def feed(rnd, depth=0):
    out = []
    for _ in range(rnd.randint(0, 3)):
        kind = rnd.choice(["item", "items", "group", "x:item", "note", "c", "empty", "item"])
        if kind == "note":
            out.append("<note a='/item>'><![CDATA[<item></item>]]></note>")
        elif kind == "c":
            out.append("<!-- <item> </item -->")
        elif kind == "empty":
            out.append("<item/>")
        else:
            inside = f"<title>t{rnd.randrange(99)} &amp; é</title>" if kind == "item" and rnd.random() < 0.8 else ""
            inside += "<link>l</link><title>second</title>" if rnd.random() < 0.3 else ""
            out.append(f"<{kind} k=\"a>b\">{inside}{feed(rnd, depth + 1) if depth < 5 else ''}</{kind}>")
    return "".join(out)


def test_items_equal_a_tree(spark):
    rnd = random.Random(4)
    bodies = [f"<rss xmlns:x='u'><channel>{feed(rnd)}</channel>{feed(rnd)}</rss>" for _ in range(150)]
    bodies += ["<item><title>root</title><item><title>in</title></item></item>", "<r><g><item><title>cut</title></g></r>", "", None, "<item"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {i: [] for i in range(len(bodies))}
    for r in scan.rss_entries(rows).orderBy("id", "feed_pos").collect():
        got[r.id].append((r.raw_title.strip(), r.raw_link))
    deep = 0
    for i, body in enumerate(bodies):
        try:
            root = ET.fromstring(body or "")
        except ET.ParseError:
            assert got[i] == []
            continue
        want = [((n.findtext("title") or "").strip(), n.findtext("link") or "") for n in root.iter("item")]
        deep += any(n.find(".//item") is not None for n in root.iter("item"))
        assert got[i] == want, body
    assert deep > 20


def test_laws_at_any_depth(spark):
    law = lambda n, more="": f"<law><법령명한글>{n}</법령명한글>{more}</law>"
    bodies = [
        f"<L><a>{law('one')}<b>{law('two', law('three'))}</b></a>{law('four')}</L>",
        f"<L>{law('one')}{law('two')}</L>",
        law("root"),
        "<L><r><법령명>other</법령명></r></L>",
        f"<L><a>{law('cut')}</L>",
    ]
    rows = scan.law_entries(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"))
    got = [(r.id, r.law_name) for r in rows.orderBy("id", "feed_pos").collect()]
    assert got == [(0, "one"), (0, "two"), (0, "three"), (0, "four"), (1, "one"), (1, "two"), (2, "root"), (3, "other")]


def test_html_rows(spark):
    pages = [
        "<TBODY><TR><td>a<tr><td>b</TBODY><tr><td>out",
        "<table><tbody><tr>1<table><tbody><tr>2</tr><tr>3</table>4</tr><tr>5",
        "<tbody></tr></tbody></tbody><tr>out<tbody><tr x='>'>in</table>still</tr>",
        "<tbody>" + "<tr><td>" * 3000,
        "<tbody><tr>" + "<b>x</b>" * 40_000 + "</tr></tbody>",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, body string")
    rows = df.select("id", F.posexplode(elements(F.col("body"), "tr", "tbody"))).orderBy("id", "pos")
    got = {}
    for r in rows.collect():
        got.setdefault(r.id, []).append(r.col.inner)
    assert got[0] == ["<td>a", "<td>b"]
    assert got[1] == ["1<table><tbody><tr>2</tr><tr>3</table>4", "2", "3", "5"]
    assert got[2] == ["in"] or got[2] == ["in</table>still"]
    assert len(got[3]) == 3000 and len(got[4][0]) == 8 * 40_000 and 5 not in got
