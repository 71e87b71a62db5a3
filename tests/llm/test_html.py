import re
from html import unescape

from swellcast.llm.html import extract, main_text

LONG = "A sentence with some words, and a comma, that is long enough to count as a paragraph of an article."


def test_boilerplate_goes():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><p>{LONG}</p></header>
    <nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav><div class="cookie-notice"><p>{LONG}</p></div>
    <div id=main-content><h1>Head &amp; line</h1><p>First&nbsp;one.\n  {LONG}<p>Second &lt;b&gt; one, <a href=z>linked</a>. {LONG}<script>var a = "</p>";</script>
    <ul><li>item one</li><li>item two</li></ul><div class="ad-slot">Buy now, cheap</div><blockquote>Quoted words</blockquote><form><p>{LONG}</p></form></div>
    <aside>{LONG}</aside><div class="sidebar"><p>{LONG}</p></div><section id="comments"><p>{LONG}</p></section><footer>{LONG}</footer></body>"""
    assert main_text(page) == "\n".join(["Head & line", f"First one. {LONG}", f"Second <b> one, linked. {LONG}", "item one", "item two", "Quoted words"])


def test_class_names():
    for kept in ("article has-sidebar", "post share-enabled", "no-ads", "main-content", "headline"):
        assert main_text(f'<div class="{kept}"><p>{LONG}</p></div>') == LONG, kept
    for cut in ("sidebar-content", "comment-body", "ad", "cookie-consent", "site-footer", "main_menu", "post-comments"):
        assert main_text(f'<div><p>{LONG}</p><div class="{cut}"><p>{LONG} {LONG}</p></div></div>') == LONG, cut


def test_broken_markup():
    assert main_text(f"<article><p><b>{LONG}<br><p>{LONG}</article><div>&copy; site") == f"{LONG}\n{LONG}"
    assert main_text("<p>unclosed <b>bold <!-- never closed") == "unclosed bold"
    assert main_text("plain text only, without tags") == "plain text only, without tags"
    assert main_text(None) == main_text("") == main_text("<html><script>x</script>") == ""
    assert main_text("<div>" * 3000 + LONG) == LONG


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_names_inside_an_article():
    kept = [f'<section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section>', '<h2 id="related-work">Related work</h2>', '<h2 id="search">Search</h2>',
            f'<section id="legal"><p>{LONG}</p><p>Short one.</p></section>', '<p class="notice">Mind the gap.</p>', f'<div id="feedback"><p>{LONG}</p></div>',
            '<p>One <span class="search-term">found</span> word, <a class="related" href=x>linked</a>.</p>', '<ul><li class="notice">An item</li></ul>',
            '<table class="legal"><tr><td class="form">Cell</td></tr></table>', '<ol><li><a href=x>First reference</a></li><li><a href=y>Second reference</a></li></ol>',
            '<div><a href=z>A linked line</a></div>']
    cut = ['<div class="share"><a href=x>Share this page with all of your friends, with your family and with everybody else on earth</a></div>',
           '<section id="related"><h3>More</h3><ul><li><a href=x>Another story</a></li><li><a href=y>Yet another story</a></li></ul></section>',
           '<div class="ad-slot">Buy now, cheap</div>', f'<section id="comments"><p>{LONG} {LONG}</p></section>', f'<aside class="related">{LONG}</aside>']
    for tag in ("article", "main"):
        got = main_text(f"<body><{tag}><h1>Title</h1><p>{LONG}</p>" + "".join(kept + cut) + f"</{tag}></body>").split("\n")
        assert got == ["Title", LONG, "Discussion", LONG, "Related work", "Search", LONG, "Short one.", "Mind the gap.", LONG, "One found word, linked.", "An item", "Cell",
                       "First reference", "Second reference", "A linked line"]


def test_names_inside_a_plain_container():
    links = "".join(f"<li><a href=x>Reference {k}</a></li>" for k in range(3))
    got = main_text(f'<body><div id="content"><h2 id="related-work">Related work</h2><p>{LONG}</p><p>{LONG}</p><ul>{links}</ul></div><div class="sidebar"><p>{LONG}</p></div></body>')
    assert got == f"Related work\n{LONG}\n{LONG}\nReference 0\nReference 1\nReference 2"


def test_a_name_never_cuts_what_holds_the_text():
    assert main_text(f'<div class="post-form"><p>{LONG}') == LONG
    assert main_text(f'<div id="promotion-theory"><p>{LONG}') == LONG
    assert main_text(f'<body class="search-results"><div class="search-content"><p>{LONG}') == LONG
    assert main_text(f'<body><form action=x><div class="wrapper"><p>{LONG}</p><p>{LONG}</p></div></form></body>') == f"{LONG}\n{LONG}"
    assert main_text(f'<div class="sidebar"><div class="promo"><p>{LONG}</p></div></div>') == LONG
    assert main_text(f'<div><p>{LONG}</p></div><div class="comments"><p>{LONG * 9}</p></div>') == LONG


def test_text_beside_the_container_and_titles_stay():
    got = main_text(f'<div class="entry">Line one<br>Line two <b>bold</b><div>{LONG}</div></div>')
    assert got == f"Line one Line two bold\n{LONG}"
    got = main_text(f'<article><header><h1>Title</h1><p>Standfirst.</p><ul><li><a href=x>Share</a></li></ul></header><p>{LONG}</p></article>')
    assert got == f"Title\nStandfirst.\n{LONG}"
    assert main_text(f"<article><p>Use the <label>Name</label> field, press <button>Save</button> now. {LONG}</p><label>Search</label></article>") == \
        f"Use the Name field, press Save now. {LONG}"


def test_the_article_beats_its_neighbours():
    assert main_text(f'<article><p>{LONG}</p></article><div class="reviews"><p>{LONG} {LONG}</p></div>') == LONG
    assert main_text(f"<main><article><p>{LONG} First.</p></article><section><article><p>{LONG}</p></article></section></main>") == f"{LONG} First."
    assert main_text(f"<main><article><p>{LONG}</p></article><article><p>{LONG} Two.</p></article></main>") == f"{LONG}\n{LONG} Two."
    teaser = f'<div id="content"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class="box"><article><p>Only this one short teaser.</p></article></div>'
    assert main_text(teaser) == "\n".join([LONG] * 5)


def test_hostile_pages_take_linear_time():
    import time
    began = time.perf_counter()
    for junk in ("i <b and c ", '<a "', '<a b="', "<a b='x\" ", "<", "<!", "</p", "<b ", "<i><p>", "</b></i>", "&lt;"):
        text = main_text(f"<article><p>{LONG}</p></article>" + junk * (1_000_000 // len(junk)))
        assert text.startswith(LONG), junk
    for nest in (f"{'<div>' * 4000}{LONG}{'</div>' * 4000}", f"{'<b>' * 4000}{LONG}", "".join(f"<div><p>{LONG}</p>" for _ in range(4000)), "<ul>" + "<li>item <b>x" * 20_000,
                 '<div class="ad">' * 3000 + LONG, "".join(f'<div class="ad">{LONG}</div>' for _ in range(4000))):
        assert main_text(nest)
    assert time.perf_counter() - began < 40
