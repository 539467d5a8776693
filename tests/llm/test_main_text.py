import itertools
import random

from parvis.llm import main_text


def brute_cut(gain, ties):
    best = min(
        (sum(g for g, s in zip(gain, side) if g > 0 and not s) + sum(-g for g, s in zip(gain, side) if g < 0 and s)
         + sum(c for a, b, c in ties if side[a] != side[b]), sum(side), side)
        for side in itertools.product([False, True], repeat=len(gain))
    )
    return list(best[2])


def test_cut_is_least():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randint(1, 9)
        gain = [round(rng.uniform(-4, 4), 3) for _ in range(n)]
        ties = [(a, b, round(rng.uniform(0, 2), 3)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        cost = lambda side: sum(abs(g) for g, s in zip(gain, side) if (g > 0) != s) + sum(c for a, b, c in ties if side[a] != side[b])  # noqa: B023,E731
        assert abs(cost(main_text.minimum_cut(gain, ties)) - cost(brute_cut(gain, ties))) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="post-page">
<header><div>Site</div></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies to make all of this work for you and others.</div>
<!-- ad --><div class="ad">Buy this now, it is very good and everyone has one.</div>
<article><h1>Title &amp; more</h1><p><b>First  paragraph
of&nbsp;text.<br><p>Les.</p><ul><li>item one<li>item two</ul><aside>Read also this other thing we wrote about a year ago.</aside>
<p>Last &lt;one&gt; 5 &#8364;.</p><form><label>Mail</label><input><button>Go</button></form></article>
<section id="comments"><p>I think that this is a wonderful article, thank you so much for writing it down.</p></section>
<footer>&copy; site</footer></body></html>"""


def test_page():
    assert main_text.main_text(PAGE).split("\n") == ["Title & more", "First paragraph of text.", "Les.", "item one", "item two", "Last <one> 5 €."]


def test_page_without_article():
    text = "Many words make up this paragraph of the page, which has no element around it that says what it is."
    page = f"<div class=menu><a href=x>Home</a> <a href=y>News</a></div><div><p>{text}</p><p>Yes.</p><p>{text}</p></div><div><a href=z>One more link</a></div>"
    assert main_text.main_text(page) == f"{text}\nYes.\n{text}"


def test_odd_pages(spark):
    odd = [None, "", " ", "<", "<p", "plain words only, but quite a number of them in one line", "<script>never closed", "<p>" * 3000 + "x", "<div>" * 2000 + "deep enough words " * 9,
           '<a href="unclosed>text', "&am", "</p></div>", "<article>" + "<p>word " * 20_000]
    pages = spark.createDataFrame([(i, "u", h, "c") for i, h in enumerate([*odd, odd[5]])], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in main_text.extracted(pages).collect()}
    assert len(rows) == len(odd) + 1 and all(r.text is not None and r.n_chars == len(r.text) for r in rows.values())
    assert rows[0].text == rows[1].text == rows[2].text == ""
    assert rows[len(odd) - 1].text.count("\n") == 19_999
    assert main_text.extracted(pages.limit(0)).collect() == []


LONG = "Thirty words or so make up each of the paragraphs of this article, which lies in a wrapper whose name or kind says something bad about all that it holds, wrongly so."


def test_wrappers_are_no_boilerplate():
    article = f"<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
    nav = "<nav><a href=/a>Home</a> <a href=/b>News</a></nav>"
    for page in (
        f"<body><div class='has-sidebar'>{nav}{article}<div class='sidebar'>Some more to read at the side of it</div></div></body>", f"<body><form>{nav}{article}</form></body>",
        f"<div id='content' class='search-results'>{article}</div>", f"<div class='has-sidebar'><main><article>{article}</article></main></div>",
        f"<form><div class='page with-sidebar'>{nav}<div class='post has-comments'>{article}</div></div><footer>The site</footer></form>",
    ):
        assert main_text.main_text(page) == "\n".join([LONG] * 3)


def test_large_boilerplate_stays_out():
    comments = f"<section id='comments'>{'<p>' + LONG + ' Indeed!</p>'}</section>"
    assert main_text.main_text(f"<div class='has-sidebar'><p>{LONG}</p>{comments * 2}</div>") == LONG
    assert main_text.main_text(f"<p>{LONG}</p><div class='comments'>{('<p>' + LONG + ' No.</p>') * 3}</div>") == LONG


def test_math_and_object_are_content():
    page = f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><object data=a.swf><param name=b><p>Said in other words.</p></object></article>"
    assert main_text.main_text(page) == f"{LONG} x=1\nSaid in other words."


def test_short_texts_and_lists_of_links_stay():
    assert main_text.main_text("<div><p>Short note here.</p></div>") == "Short note here."
    assert main_text.main_text(f"<body><p>{LONG}</p><p>Ok.</p></body>") == f"{LONG}\nOk."
    links = "".join(f"<li><a href=/{i}>Source {i}</a></li>" for i in range(6))
    assert main_text.main_text(f"<article><p>{LONG}</p><ul>{links}</ul></article>").split("\n") == [LONG, *[f"Source {i}" for i in range(6)]]
    assert main_text.main_text(f"<article><p>{LONG}</p><nav><ul>{links}</ul></nav></article><div><ul>{links}</ul></div>") == LONG


def test_what_follows_a_heading_of_comments_is_by_readers():
    comments = f"<ol>{'<li>' + LONG + ' Indeed!</li>'}</ol>"
    for heading in ("Comments (3)", "12 comments", "Kommentare:", "Leave a reply", "3 commentaires"):
        assert main_text.main_text(f"<article><p>{LONG}</p></article><section><h2>{heading}</h2>{comments * 3}</section>") == LONG
        assert main_text.main_text(f"<p>{LONG}</p><h3>{heading}</h3>{comments}<h3>After</h3><p>{LONG} No.</p>") == f"{LONG}\nAfter\n{LONG} No."
    for heading in ("Comments on the budget", "Responses of the cell"):
        assert heading in main_text.main_text(f"<p>{LONG}</p><h3>{heading}</h3><p>{LONG}</p>")
    assert main_text.main_text(f"<article><p>{LONG}</p><h2>Comments</h2><p>{LONG}</p></article>").count(LONG) == 2


def test_wrappers_one_by_one():
    """The pass outside in against taking every element in turn."""
    rng = random.Random(5)

    def slow(found):
        chains = [[] for _ in found]
        for chain, block in zip(chains, found):
            node = block.against
            while node:
                chain.append(node[:2])
                node = node[2]
        size = sum(len(b.text) for b in found)
        for element in sorted({e for c in chains for e in c}):
            holds = sum(len(b.text) for b, c in zip(found, chains) if element in c)
            if holds > main_text.MOST * size and sum(len(b.text) for b, c in zip(found, chains) if element not in c and b.score() > 0) < main_text.LEFT * holds:
                for b, c in zip(found, chains):
                    b.around -= element[1] if element in c else 0

    place, seen = (0, None, 0, ""), set()
    for _ in range(300):
        nodes = [None]
        for n in range(1, rng.randint(2, 9)):
            nodes.append((n, rng.choice([-8.0, -9.0]), rng.choice([nodes[-1], rng.choice(nodes)])))

        def make():
            made = []
            for length, node, linked in picks:
                total, at = 0.0, node
                while at:
                    total, at = total + at[1], at[2]
                made.append(main_text.Block("w " * length + "w", linked, total, place, False, node))
            return made

        picks = [(rng.randint(1, 200), rng.choice([nodes[-1], rng.choice(nodes)]), rng.choice([0, 0, 1])) for _ in range(rng.randint(1, 8))]
        fast, want = make(), make()
        main_text._unwrap(fast)
        slow(want)
        assert [b.around for b in fast] == [b.around for b in want]
        seen.add(any(b.around != c.around for b, c in zip(fast, make())))
    assert seen == {True, False}


def test_deep_pages_take_linear_time():
    import time

    for unit in ("<div>x ", "<div class=sidebar>x ", "<form>x ", "<ul><li>x ", "<p>x<span>"):
        started = time.process_time()
        main_text.main_text(unit * 20_000)
        assert time.process_time() - started < 20, unit
