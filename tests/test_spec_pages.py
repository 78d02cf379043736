"""One fixture a maker, and what broken pages give."""

import json

import pytest

from sparkshelf.sources import spec_pages as S


def flat(state):
    """The flat form of a state, written place by place."""
    places = []

    def put(v):
        at = len(places)
        places.append(None)
        places[at] = {k: put(x) for k, x in v.items()} if isinstance(v, dict) else [put(x) for x in v] if isinstance(v, list) else v
        return at

    put(state)
    return f'<script type="application/json" id="__NUXT_DATA__">{json.dumps(places)}</script>'


TWO = flat({"pinia": {"pdPageStore": {"productTabList": {"ModelName": "Zen 14"}, "PDTechSpecM2List": {"TechSpec": []}, "PDTechSpec": {"TechSpec": [{"Name": " UX1 ", "SpecList": {"Memory": "16GB", "Empty": "", "Ports": 4}}, {"Name": "", "SpecList": {"Memory": "32GB"}}]}}}})
CALLED = """<script>window.__NUXT__=(function(a,b){a.descriptionText="16GB\\\\n DDR5";return {state:{Spec:{spec:[{mktName:"Strix",skuName:"G8",price:b,specContent:[a,{displayField:"None",descriptionText:null}]},{mktName:"Strix",skuName:"",price:0,specContent:[a]}]}}}}({displayField:" Memory "},9099));</script>"""
GROUPS = """<html><head><title>Book 8 - shop</title></head><body><span data-price-amount=835 data-price-type=""></span><span data-price-amount="10014" data-price-type="finalPrice">RM10,014</span>
<div class="x product-spec-swapper"><h3 class="product-spec-group">Product Info</h3><dl class="product-spec-attribute"><dt class=label>Sku</dt><dd class=value> D09 &amp; <b>more</b> </dd></dl><dl class="product-spec-attribute"><dt class=label>Nothing</dt><dd class=value></dd></dl></div>
<div class="product-spec-swapper"><dl class="product-spec-attribute"><dt class=label>RAM</dt><dd class=value>16 GB</dd></dl></div></body></html>"""
SECTIONS = """<title>Air - Tech Specs</title><div class="techspecs-section"><h2>Chip</h2><p>10-core   CPU,
8-core GPU</p><script>no</script><span hidden>no</span><p class="medium-down">no</p><ul><li>a<li>b</ul>—<span class="visuallyhidden">Not configurable</span></div><div class="techspecs-section-not">x</div>"""


def test_makers():
    rows, error = S.read_page(TWO, S.LAYOUTS["flat"])
    assert error is None and rows == [(1, "Zen 14 (UX1)", "", "Memory", "16GB", None), (1, "Zen 14 (UX1)", "", "Ports", "4", None), (2, "Zen 14", "", "Memory", "32GB", None)]
    rows, error = S.read_page(CALLED, S.LAYOUTS["call"])
    assert error is None and rows == [(1, "Strix (G8)", "", "Memory", "16GB\n DDR5", "9099.00"), (2, "Strix", "", "Memory", "16GB\n DDR5", None)]
    rows, error = S.read_page(GROUPS, S.LAYOUTS["groups"])
    assert error is None and rows == [(1, "Book 8 - shop", "Product Info", "Sku", "D09 & more", "10014.00"), (1, "Book 8 - shop", "", "RAM", "16 GB", "10014.00")]
    rows, error = S.read_page(SECTIONS, S.LAYOUTS["lines"])
    assert error is None and [r[4] for r in rows] == ["Chip", "10-core CPU, 8-core GPU", "a", "b", "—", "Not configurable"] and rows[0][1] == "Air"


@pytest.mark.parametrize("layout", list(S.LAYOUTS))
@pytest.mark.parametrize("page", [None, "", "<html>Just a moment...</html>", "<div class=product-spec-swapper><p>", "<script>window.__NUXT__=(function(){return {state:{Spec:{spec:[]}}}}())</script>", flat({"pinia": {"pdPageStore": {}}}), flat({"pinia": {"pdPageStore": {"PDTechSpec": {"TechSpec": [{"SpecList": [{"Title": "a"}]}]}}}}), "<p>" * 30_000 + "</b>"])
def test_pages_without_rows_are_errors(layout, page):
    rows, error = S.read_page(page, S.LAYOUTS[layout])
    assert rows == [] and error


def test_frame(spark):
    pages = spark.createDataFrame([(1, TWO, "flat"), (2, GROUPS, "groups"), (3, "", "lines"), (4, GROUPS, "unknown"), (None, None, None), (2, GROUPS, "groups")], "page_id int, html string, maker string").selectExpr("*", "1 AS rows", "'x' AS error")
    out = S.spec_rows(pages, "page_id", "html", "maker")
    assert out.columns == ["page_id", "variant", "product", "section", "label", "value", "price", "error"]
    got = sorted((r["page_id"] or 0, r["variant"] or 0, r["label"] or "", r["error"] or "") for r in out.collect())
    assert got == [(0, 0, "", "no layout for None"), (1, 1, "Memory", ""), (1, 1, "Ports", ""), (1, 2, "Memory", ""), (2, 1, "RAM", ""), (2, 1, "RAM", ""), (2, 1, "Sku", ""), (2, 1, "Sku", ""), (3, 0, "", "no specification rows"), (4, 0, "", "no layout for unknown")]
    assert S.spec_rows(pages.limit(0), "page_id", "html", "maker").count() == 0
