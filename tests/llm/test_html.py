"""Page text: what density chooses, and what names may still take away."""

import duckdb

from venation.llm import html_text as H

PAGES = "/root/testdata/sf0.01/pages.parquet"
PART = "Some words of a paragraph. " * 8


def pages():
    return [r[0] for r in duckdb.sql(f"select html from '{PAGES}' order by page_id").fetchall()]


def plain_densities(node):
    """Of each element that isn't FIRM: (characters, tags, link characters, link tags), by recursion."""
    import re

    out = {}

    def walk(n, linked):
        linked = linked or n.tag == "a"
        c = t = lc = lt = 0
        for k in n.kids:
            if isinstance(k, str):
                size = len(re.sub(r"\s+", " ", k).strip())
                c, lc = c + size, lc + (size if linked else 0)
            elif k.tag not in H.FIRM:
                kc, kt, klc, klt = walk(k, linked)
                silent = k.tag != "a" and (k.tag in H.INLINE or k.tag in H.VOID)
                c, t, lc, lt = c + kc, t + kt + (not silent), lc + klc, lt + klt + (k.tag == "a")
        out[n] = (c, t, lc, lt)
        return out[n]

    walk(node, False)
    return out


def test_measures_against_recursion():
    for page in pages()[:40]:
        root = H.parse(page)
        want = plain_densities(root)
        got = {n: (n.chars, n.tags, n.link_chars, n.link_tags) for n in H._measure(root)}
        assert got == want


def test_density_chooses_and_names_only_trim(monkeypatch):
    every = pages()
    whole = [H.main_text(p) for p in every]
    by_density = [H.main_text(p, names=False) for p in every]
    assert sum(a == b for a, b in zip(whole, by_density)) > 0.6 * len(every)
    article = [H.main_text("<body>" + p[p.index("<article>") :].split("</article>")[0] + "</body>", names=False) for p in every if "<article>" in p]
    held = [w for w, p in zip(whole, every) if "<article>" in p]
    assert sum(a == b for a, b in zip(article, held)) > 0.95 * len(held)
    monkeypatch.setattr(H, "_densities", lambda nodes, body: None)
    assert sum(H.main_text(p, names=False) == w for p, w in zip(every, whole)) < 0.05 * len(every)


def test_what_is_inside_the_article_stays():
    page = f"""<body><header><h1>The Site</h1></header><nav><a href=/>Home</a><a href=/b>About</a></nav><article><header><h1>Title</h1></header>
    <p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be. {PART}</p><div class="side-by-side"><p>Left. {PART}</p></div><p hidden>Hidden. {PART}</p>
    <div class="meta-analysis related">Study. {PART}</div><form><input><label>Mail</label></form><div class="comments"><p>First!</p></div></article><footer>Legal</footer></body>"""
    lines = H.main_text(page).split("\n")
    assert [x.split(".")[0] for x in lines] == ["Title", "Let x=2 be", "Left", "Hidden", "Study"]


def test_a_comment_section_larger_than_the_article_gives_way():
    page = f"<body><article><h1>T</h1><p>{PART}</p><p>{PART}</p></article><div id=comments>{'<p>' + PART + '</p>'}</div></body>"
    assert H.main_text(page) == "\n".join(["T", PART.strip(), PART.strip()])
