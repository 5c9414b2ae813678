"""The minimum cut on pages without named elements, with misleading names, and with unnamed comments."""

from __future__ import annotations

import random

from geoloom.llm import html_extract as H

WORDS = "river stone market winter letter garden captain season measure village engine paper history window number mountain story evening machine people".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def unnamed_page(rng):
    """A page of bare div and p elements and the text of its article."""
    body = [f"<h1>{sentence(rng, 5)[:-1]}</h1>"]
    for _ in range(rng.randrange(4, 9)):
        n = rng.choice((2, 3, 15, 30, 60))
        body.append(f"<p>{sentence(rng, n)}</p>")
    text = " ".join(b.split(">", 1)[1].rsplit("<", 1)[0] for b in body)
    menu = "".join(f"<div><a href=/{i}>{rng.choice(WORDS)}</a></div>" for i in range(6))
    more = "".join(f"<div><a href=/{i}>{sentence(rng, 8)}</a></div>" for i in range(4))
    page = f"<html><body><div>{menu}</div><div>{''.join(body)}</div><div>{more}</div><div>© 2020 {rng.choice(WORDS)} All rights reserved</div></body></html>"
    return page, text


def test_pages_without_named_elements_need_the_cut():
    rng = random.Random(8)
    pages = [unnamed_page(rng) for _ in range(60)]
    right = changed = flowed = total = 0
    for page, text in pages:
        right += H.main_text(page) == text
        found = H.blocks(page)
        own = H.evidence(found)
        edges = H.cut_edges(found)
        keep = H.keep_blocks(found)
        changed += [x > 0 for x in own] != keep
        weight = [0.0] * (1 + max(b for _, b, _ in edges))
        for a, b, w in edges:
            weight[a] += w
            weight[b] += w
        flowed += sum(abs(x) <= w for x, w in zip(own, weight))
        total += len(found)
    print(f"right {right}, changed {changed} of {len(pages)}; {flowed} of {total} blocks not settled by their own evidence")
    assert right >= 55 and changed >= 30 and flowed > 0.1 * total


def test_poor_words_in_names_inside_an_article_lose_no_prose():
    prose = "The settlers came here in the early spring of that year, and they built their first houses by the river."
    for opening in ('<section id="social-history">', '<div class="form-factor">', '<p data-id="legal">', '<div class="legal-reform">', '<section class="widget-theory">'):
        tag = opening[1:].split()[0]
        page = f"<body><article><h1>On history</h1><p>{prose}</p>{opening}{prose}</{tag}><p>{prose}</p></article></body>"
        assert H.main_text(page) == f"On history {prose} {prose} {prose}", opening
    assert H.main_text(f"<article><p>We know that <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds for every body at rest here.</p><p>{prose}</p></article>") == f"We know that E=m holds for every body at rest here. {prose}"


def test_sure_names_inside_an_article_and_unnamed_comments_go():
    prose = "The settlers came here in the early spring of that year, and they built their first houses by the river."
    for name in ("comments", "comment-list", "social-share", "related-posts", "cookieNotice", "newsletter signup", "ad", "sidebar right"):
        assert H.main_text(f'<article><p>{prose}</p><div class="{name}"><p>{prose}</p></div><p>{prose}</p></article>') == f"{prose} {prose}", name
    said = "I do not think that this is right at all, because my uncle lived there and he told me another tale of it."
    page = f"<body><div><h1>On history</h1><p>{prose}</p><p>{prose}</p></div><div><h3>2 Comments</h3><div><p>Anna says:</p><p>{said}</p></div><div><p>Bert says:</p><p>{said}</p></div></div></body>"
    assert H.main_text(page) == f"On history {prose} {prose}"
    page = f"<body><div><p>{prose}</p><p>{prose}</p></div><div><div><p>{said}</p><a href=#>Reply</a></div><div><p>{said}</p><a href=#>Reply</a></div></div></body>"
    assert H.main_text(page) == f"{prose} {prose}"


def test_fit_stays_near_the_prior_without_labels_and_learns_with_them():
    assert H.fit_text_weights([]) == list(H.PRIOR)
    long, short = tuple(int(i in (0, 1, 2, 3, 9)) for i in range(15)), tuple(int(i in (0, 8)) for i in range(15))
    w = H.fit_text_weights([(long, 1, 10_000), (short, 0, 10_000)])
    score = lambda x: sum(a for a, b in zip(w, x) if b)
    assert score(long) > 2 and score(short) < -2


def test_min_cut_of_a_long_chain_is_fast_and_right():
    n = 20_000
    source, sink = [float(i % 7 == 0) * 2 for i in range(n)], [float(i % 7 != 0) * 0.3 for i in range(n)]
    keep = H.min_cut(source, sink, [(i, i + 1, 0.4) for i in range(n - 1)])
    value = lambda x: sum(sink[i] if k else source[i] for i, k in enumerate(x)) + sum(0.4 for i in range(n - 1) if x[i] != x[i + 1])
    assert value(keep) <= min(value([True] * n), value([False] * n), value([s > 0 for s in source])) + 1e-6


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", "<p>x", "a", 1), (1, "u", "<p>x", "a", 1), (None, None, None, "b", 2), (2, None, "", None, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in H.extract_text(df).collect())
    assert [g[:2] for g in got] == [("1", "u"), ("1", "u"), ("2", "None"), ("None", "None")] and got[0] == got[1] and got[2][2:] == ("", 0) == got[3][2:]


def test_prose_that_holds_the_labels_of_comments_stays():
    """By the weights before and after fitting: paragraphs, a menu and a copyright line, and nothing named."""
    p = [
        "The settlers came here in the early spring of that year, and they built their first houses by the river with stone.",
        "In the letters that she sent home she spoke of long winters, of the market in the town and of the people she had met.",
        "Nobody knew at that time how far the new railway would reach, or who in the end was going to pay for all of it.",
        "Later writers have doubted the whole story, but the papers that were found in the garden leave little room for that.",
    ]
    menu = "<div>" + "".join(f"<div><a href=/{w}>{w}</a></div>" for w in WORDS[:6]) + "</div>"
    page = lambda body: f"<html><body>{menu}<div><h1>A history of the valley</h1>{body}</div><div>© 2020 The valley. All rights reserved</div></body></html>"
    para = lambda *k: "".join(f"<p>{p[i]}</p>" for i in k)
    fitted = H.fit_text_weights([(H.features(t, b), int(b.tag == "p" and b.linked == 0 and t.endswith(".")), 40) for t, b in H.blocks(page(para(0, 1, 2, 3)))])
    for weights in (H.PRIOR, fitted):
        for said in ("As Mary wrote:", "The minister says:", "Karl schrieb:"):
            assert all(x in H.main_text(page(para(0, 1) + f"<p>{said}</p>" + para(2)), weights) for x in p[:3]), said
        for label in ("Responses", "Subscribers of the paper", "More from the hills", "Replies"):
            got = H.main_text(page(para(0, 1) + f"<h2>{label}</h2>" + para(2, 3)), weights)
            assert all(x in got for x in p), label
        for label in ("Responses", "Comments", "3 replies"):
            comments = "".join(f"<div><div>{w.capitalize()} says:</div><p>{p[3]}</p><div>Reply</div></div>" for w in WORDS[:3])
            got = H.main_text(page(para(0, 1, 2)) .replace("</div><div>©", f"</div><div><h2>{label}</h2>{comments}</div><div>©"), weights)
            assert p[3] not in got and all(x in got for x in p[:3]), label
