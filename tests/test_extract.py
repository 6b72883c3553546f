"""Extraction on small HTML pages."""

from pyspark.sql import functions as F

from siteloom.functions import text as TX
from siteloom.operators import elements as E
from siteloom.operators import extract as X

PARA = "We bake every cake to order in our own kitchen and deliver across the whole region."

CAKE = f"""<html><head><title>Cakes</title></head><body>
<header><nav><a href="/x">Menu</a></nav></header>
<main>
 <h1>Wedding cakes</h1><p>{PARA} <a href="/order">Order   now</a>.</p><img src="/hero.jpg" alt=" The cake ">
 <h2>How it works</h2><p>Choose a flavour and a size, then tell us the date.</p><ul><li>One</li><li>Two <ol><li>deep</li></ol></li><li> </li></ul>
 <h2>Photos</h2><img src="/1.jpg"><img src="/2.jpg"><img src="/3.jpg"><img src="/3.jpg"><img src="/dot.gif" width="1">
 <h2>FAQ</h2><h3>Do you deliver?</h3><p>Yes, everywhere.</p><h3>Empty?</h3><h3>How long?</h3><p>Two days of work.</p><p>Two days of work.</p>
</main><footer>Footer text that is not content</footer></body></html>"""


def pages(spark, *html, url="https://cakes.example/p"):
    rows = [("cakes.example", i, url, "/p", 200, h) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "site string, page_id long, url string, path string, http_status int, html string")


def test_atoms_and_blocks_of_the_cake_page(spark):
    atoms = E.page_atoms(pages(spark, CAKE)).orderBy("ord").collect()
    assert [a.type for a in atoms] == [
        "heading", "para", "image", "heading", "para", "list", "heading", "image", "image", "image",
        "heading", "heading", "para", "heading", "heading", "para",
    ]
    assert atoms[2].src == "https://cakes.example/hero.jpg" and atoms[2].alt == "The cake"
    assert atoms[5].items == ["One", "Two deep"]
    sections = E.page_sections(E.page_atoms(pages(spark, CAKE)))
    blocks = E.section_blocks(sections).orderBy("block_no").collect()
    assert [b.type for b in blocks] == ["hero", "richText", "gallery", "faq"]
    assert blocks[0].heading == "Wedding cakes" and blocks[0].image_src.endswith("/hero.jpg")
    assert blocks[2].gallery_images == 3
    faq = E.faq_items(sections).orderBy("item").collect()
    assert [(f.question, f.answer) for f in faq] == [("Do you deliver?", "Yes, everywhere."), ("How long?", "Two days of work.")]


def test_media_text_sides_alternate(spark):
    body = "".join(f"<h2>S{i}</h2><p>{PARA} Number {i}</p><img src='/{i}.png'>" for i in range(3))
    blocks = E.section_blocks(E.page_sections(E.page_atoms(pages(spark, f"<main>{body}</main>")))).orderBy("block_no").collect()
    assert [(b.type, b.image_side) for b in blocks] == [("mediaText", "right"), ("mediaText", "left"), ("mediaText", "right")]


def test_runs_keep_links(spark):
    el = E.page_elements(pages(spark, CAKE)).filter("tag = 'p'").orderBy("ord").limit(1)
    runs = E.inline_runs(el).orderBy("run").collect()
    assert [(r.text, r.href) for r in runs] == [(PARA + " ", None), ("Order now", "/order"), (".", None)]


def test_skip_images_of_the_whole_site(spark):
    skip = spark.createDataFrame([("cakes.example", "https://cakes.example/1.jpg")], "site string, src string")
    srcs = [r.src for r in E.page_atoms(pages(spark, CAKE), skip).filter("type = 'image'").collect()]
    assert "https://cakes.example/1.jpg" not in srcs and len(srcs) == 3


def test_tree_layouts_use_main_sections(spark):
    html = f"<body><main><section><h1>Welcome</h1><p>{PARA}</p></section><div>{PARA} contact</div><div>short</div></main></body>"
    rec = X.page_records(pages(spark, html, f"<body><article>{PARA}</article></body>", "<body>tiny</body>")).orderBy("page_id").collect()
    assert [s.kind for s in rec[0].sections] == ["hero", "contact"]
    assert rec[1].sections[0].text == PARA
    assert [(s.kind, s.text) for s in rec[2].sections] == [("prose", "tiny")]


def test_pages_without_html_stay_without_sections(spark):
    nested = f"<body><article>{PARA}<article>{PARA} twice</article></article></body>"
    rec = X.page_records(pages(spark, None, "", nested)).orderBy("page_id").collect()
    assert [r.page_id for r in rec] == [0, 1, 2]
    assert (rec[0].title, rec[0].sections, rec[1].sections) == (None, [], [])
    assert [s.text for s in rec[2].sections] == [f"{PARA}{PARA} twice", f"{PARA} twice"]
    assert X.page_section_rows(X.page_records(pages(spark, None, ""))).count() == 0


def test_a_stored_extraction_gives_what_the_html_gives(spark):
    from siteloom.operators import findings as Q
    from siteloom.session import stored

    mail = "4f" + "".join(f"{ord(c) ^ 0x4F:02x}" for c in "me@x.co")
    extra = f'<article>{PARA} Call 032601560 <a data-cfemail="{mail}">x</a><img src="/a.png"><img src="/b.png" alt="b"><img alt=""></article>'
    html = pages(spark, CAKE, extra, extra.replace("<article>", "<!-- <img src='/gone.png'> --><article>"), None, "")
    kept, rec = stored(X.page_extract(html), "extract"), X.page_records(html)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(X.page_entities(kept)) == rows(X.page_entities(rec)) and "me@x.co" in str(rows(X.page_entities(kept)))
    assert rows(X.page_images(kept)) == rows(X.page_images(html)) != []
    assert rows(Q.page_signals(kept)) == rows(Q.page_signals(rec))
    assert "html" not in kept.columns


def test_hidden_emails(spark):
    enc = lambda e, k: f"{k:02x}" + "".join(f"{ord(c) ^ k:02x}" for c in e)
    html = f'<a data-cfemail="{enc("me@x.co", 0x4F)}">x</a><a href="/cdn-cgi/l/email-protection#{enc("you@x.co", 0x21)}">y</a>'
    got = {r.email for r in X.hidden_emails(pages(spark, html)).collect()}
    assert got == {"me@x.co", "you@x.co"}


def test_entities(spark):
    text = "Ring (03) 260 1566 or +64 3 260 1566, mail A.b@c.co.nz. 12 High Street, Gore. From NZ$1,200.50 or $5"
    df = spark.createDataFrame([("s", 1, text)], "site string, page_id long, text string")
    got = {(r.kind, r.value) for r in X.entity_rows(df).collect()}
    assert ("phones", "(03) 260 1566") in got and ("emails", "A.b@c.co.nz") in got
    assert ("prices", "NZ$1,200.50") in got and ("prices", "$5") in got
    assert any(k == "addresses" and v.startswith("12 High Street") for k, v in got)


def test_references_are_decoded(spark):
    df = spark.createDataFrame([("&amp;lt; &#8211; &#x41; &copy; caf&#233;",)], "t string")
    assert df.select(TX.decode_entities("t")).first()[0] == "&lt; – A © café"


def test_stored_html_is_scrubbed_and_capped(spark):
    ok = '<script id="__NEXT_DATA__">{"a":{"ipAddress":"1","b":[{"apiUrl":"u","c":2}]}}</script>'
    broken = '<script id="__NEXT_DATA__">{"captchaKey": </script>'
    out = [r.html for r in X.sanitise_html(pages(spark, ok, broken, "x" * 50), max_bytes=200).orderBy("page_id").collect()]
    assert out[0] == '<script id="__NEXT_DATA__">{"a":{"b":[{"c":2}]}}</script>'
    assert out[1] == '<script id="__NEXT_DATA__">{}</script>'
    assert out[2] == "x" * 50
    capped = X.sanitise_html(pages(spark, "x" * 50), max_bytes=20).first().html
    assert capped == "<!-- truncated: 50 bytes → cap 20 -->\n" + "x" * 20


def test_platforms_and_brand(spark):
    css = ":root{--brand-color:#123456} a{color:#fff;font-family:'Lora', serif} b{color:#FFF}"
    html = (
        f"<head><style>{css}</style><meta content='WordPress 6' name='generator'><meta name='generator' content='WordPress 6'>"
        "<link rel='icon' href='/i.ico'></head><script src='/wp-content/x.js'></script>"
    )
    hit = X.platform_hits(pages(spark, html)).first()
    assert (hit.platform, hit.hits, hit.confidence) == ("wordpress", 2, round(0.55 + 0.4 * 2 / 3, 6))
    brand = X.site_brand(pages(spark, html)).first()
    assert brand.colors == ["#123456", "#fff"] and brand.fonts == ["'Lora', serif"]
    assert brand.logo == "https://cakes.example/i.ico"
    plain = [r.platform for r in X.platform_hits(pages(spark, "<p>x</p>", "  ")).orderBy("page_id").collect()]
    assert plain == ["static", "unknown"]
    served = pages(spark, "<p>x</p>").withColumn("server", F.lit("Wix edge"))
    assert X.platform_hits(served, server_col="server").first().platform == "wix"
