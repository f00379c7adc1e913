import html
import math
import re
from collections import Counter, defaultdict

import pytest

from tidewatch.llm.html_text import IMPORTANCE, LEAST, SHARE, blocks, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<header>Site name</header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="box"><p>Every page of this host says so.</p></div>
<div class="post"><h1>Title &amp; more {n}</h1><p><b>First<br>line {n}<p>Second &lt;b&gt; &#233; line {n}.</p><ul><li>one {n}<li>two {n}</ul>
<form>Name <input></form><aside>See also</aside><!-- ad --></div><div class="comments"><p>Nice post!</p></div><footer>&copy; us</footer></body></html>"""


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, low string, host int")


def test_structure_and_template(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.replace("{n}", str(i)), "x", 1) for i in range(30)]
    rows += [(100 + i, f"http://copy.example/{i}", "<body><div><p>The same text on all pages.</p><p>Again.</p></div></body>", "x", 1) for i in range(30)]
    got = {r.page_id: r for r in main_text(frame(spark, rows).repartition(3)).collect()}
    for i in range(30):
        assert got[i].text == f"Title & more {i}\nFirst line {i}\nSecond <b> é line {i}.\none {i}\ntwo {i}"
        assert got[i].n_chars == len(got[i].text)
        assert got[100 + i].text == "The same text on all pages.\nAgain."


def test_edges(spark):
    odd = [None, "", "   ", "plain text", "<p>a<p>b", "<div>cut &am", "<div>open <b", "<article>in</article>out", "<p>x</p>" * 3000, "</div></p>text", "<SCRIPT>x", "a" * 100_000, "<" * 50]
    rows = [(i, None if i == 3 else "http://b.example/", h, "x", 1) for i, h in enumerate(odd)] + [(4, "http://b.example/", odd[4], "x", 1)]
    got = sorted((r.page_id, r.text) for r in main_text(frame(spark, rows)).collect())
    assert len(got) == len(odd) + 1
    text = dict(got)
    assert [text[i] for i in range(8)] == ["", "", "", "plain text", "a\nb", "cut &am", "open", "in\nout"]
    assert text[8] == "\n".join(["x"] * 3000) and text[9] == "text" and text[10] == "" and len(text[11]) == 100_000
    assert main_text(frame(spark, [])).count() == 0


def test_generated_pages(spark, sf_dir):
    """On the generated pages the main text is the article; a plain reading of it is the comparison."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in main_text(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)
        parts = re.split(r"</?(?:article|p|h1|h2|ul|li|div|section|blockquote)\b[^>]*>", article[1]) if article else []
        want = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", p)).split()) for p in parts]
        assert r.text.split() == " ".join(w for w in want if w).split(), r.page_id


def test_blocks_of_nested_inline_tags():
    assert [t for _, t in blocks("<div>a<i>b</i> <a href=x>c</a><p>d</div>e")] == ["ab c", "d", "e"]


def test_near_copies_keep_their_paragraphs(spark):
    """Paragraphs on 4 of 200 pages tell something; those of one page are no copy for their titles."""
    page = "<body><article><h1>Title {i}</h1><p>Paragraph one of {g}.</p><p>Paragraph two of {g}.</p></article></body>"
    rows = [(i, "http://d.example/", page.replace("{i}", str(i)).replace("{g}", str(i // 4)), "x", 1) for i in range(200)]
    got = {r.page_id: r.text for r in main_text(frame(spark, rows).repartition(3)).collect()}
    assert got == {i: f"Title {i}\nParagraph one of {i // 4}.\nParagraph two of {i // 4}." for i in range(200)}


def plain_tree(pages):
    """The site style tree by plain loops: text of each page."""
    hosts = defaultdict(list)
    for k, url, source in pages:
        hosts[re.match(r"[a-z]+://([^/?#]*)", url)[1].lower()].append((k, list(blocks(source or ""))))
    out = {}
    for own in hosts.values():
        seen, having = defaultdict(set), defaultdict(set)  # leaf -> (text, page); node or leaf -> pages
        for _, found in own:
            leaves = defaultdict(list)
            for path, text in dict.fromkeys(found):
                leaves[path].append(text)
            page = tuple(max(leaves.values(), key=lambda x: sum(map(len, x)), default=()))
            for path, texts in leaves.items():
                seen[path] |= {(t, page) for t in texts}
                for k in range(1, len(path) + 1):
                    having[path[:k]].add(page)
                having[path, "text"].add(page)
        times = {path: Counter(t for t, _ in x) for path, x in seen.items()}

        def entropy(n, m):
            return math.log(n) / math.log(max(m, 2)) if m >= LEAST else 0.0

        def mass(node, paths, weight):
            words = sum(n * len(t.split(" ")) for p in paths for t, n in times[p].items())
            base = math.log(max(2, len(having[node])))
            common = sum(n * math.log(n) * len(t.split(" ")) for p in paths for t, n in times[p].items())
            return (max(0.0, words - common / base) if len(having[node]) >= LEAST else words) * (1 if weight < 0 else weight)

        nodes = {p[:k] for p in seen for k in range(1, len(p) + 1)}
        weigh = {n: mass(n, [p for p in seen if p[: len(n)] == n], n[-1][1]) for n in nodes}
        weigh |= {(p, "text"): mass((p, "text"), [p], -1) for p in seen}
        beside = defaultdict(float)
        for n, x in weigh.items():
            above = n[0] if n and n[-1] == "text" else n[:-1]
            beside[above] = max(beside[above], x)
        low = {n for n in nodes if n[-1][1] >= 0 and (weigh[n] / beside[n[:-1]] if weigh[n] else 0.0) < SHARE}
        for p, c in times.items():
            if 1 - sum(n * entropy(n, len(having[p, "text"])) for n in c.values()) / sum(c.values()) < IMPORTANCE:
                low.add((p, "text"))
        for k, found in own:
            out[k] = "\n".join(t for path, t in found if (path, "text") not in low and not any(path[:i] in low for i in range(1, len(path) + 1)))
    return out


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_tree_by_plain_loops(spark, sf_dir, size):
    """The same texts as from a plain tree; and it is the importances that make them, on most pages."""
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', size)}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rows += [(10_000 + i, f"http://a.example/{i}", PAGE.replace("{n}", str(i))) for i in range(30)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, low string, host int").repartition(3)
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert got == plain_tree(rows)
    everything = {r.page_id: r.text for r in main_text(df, 0, 0).collect()}
    assert sum(got[k] != everything[k] for k in got) > len(got) / 2


def test_what_an_element_says_is_outweighed(spark):
    """An article in a faint element stays, on a host where it is nearly all there is; short plain parts go."""
    page = "<body><div class='share'>{words}</div><div>Brand {i}</div><textarea>open<p>last {i}</p></body>"
    rows = [(i, f"http://e.example/{i}", page.replace("{words}", " ".join(f"w{i}x{k}" for k in range(400))).replace("{i}", str(i)), "x", 1) for i in range(9)]
    got = {r.page_id: r.text for r in main_text(frame(spark, rows)).collect()}
    assert all(t.startswith(f"w{i}x0 w{i}x1 ") and t.endswith(f"last {i}") for i, t in got.items())
