"""The page converter, by cases of its own and by a plain reading of random marks."""

import random

import pytest

from gleanery.functions import htmltree
from gleanery.functions.htmltree import blocks

PAGE = "https://page.test/d/x"


def shapes(html):
    return [(b["type"], b["text"]) for b in blocks(html, PAGE)]


def spans(html):
    return [(s["text"], *sorted(k for k in s if k != "text")) for s in blocks(html, PAGE)[0]["content"]]


def test_marks_go_down_and_like_neighbours_meet():
    assert spans("<p>  A <b>b <i>c</i></b><b> d</b> e <kbd>f  g</kbd> </p>") == [("A ",), ("b ", "bold"), ("c", "bold", "italic"), (" d", "bold"), (" e ",), ("f g", "code")]
    assert spans("<p>x<br>y <span>z</span></p>") == [("x y z",)]
    assert spans("<p><b>a </b><i> b</i></p>") == [("a ", "bold"), ("b", "italic")]
    linked = blocks("<p><a href='../up'>up <b>b</b></a><a href='javascript:x'>no</a><a href='#'> </a></p>", PAGE)[0]["content"]
    assert [(s["text"], s.get("href")) for s in linked] == [("up ", "https://page.test/up"), ("b", "https://page.test/up"), ("no", None)]
    assert blocks("<p> <b> </b>\n</p><p>&nbsp;</p>", PAGE) == []


@pytest.mark.parametrize("seed", range(20))
def test_spans_against_a_letter_by_letter_reading(seed):
    """Each letter with its marks; runs of blanks count once, with the marks of the first; none at either end."""
    rng = random.Random(seed)
    letters = []

    def make(depth, marks):
        out = ""
        for _ in range(rng.randint(1, 5)):
            if depth and rng.random() < 0.5:
                tag, mark = rng.choice([("b", "bold"), ("strong", "bold"), ("em", "italic"), ("i", "italic"), ("span", None)])
                out += f"<{tag}>{make(depth - 1, marks | ({mark} - {None}))}</{tag}>"
            else:
                text = "".join(rng.choice("ab  \n") for _ in range(rng.randint(1, 4)))
                letters.extend((" " if c.isspace() else c, frozenset(marks)) for c in text)
                out += text
        return out

    html = f"<p>{make(3, frozenset())}</p>"
    want = [x for i, x in enumerate(letters) if x[0] != " " or i and letters[i - 1][0] != " "]
    while want and want[0][0] == " ":
        want.pop(0)
    while want and want[-1][0] == " ":
        want.pop()
    found = blocks(html, PAGE)
    got = [(c, frozenset(k for k in s if k != "text")) for s in (found[0]["content"] if found else []) for c in s["text"]]
    assert got == want


@pytest.mark.parametrize("seed", range(20))
def test_a_marked_paragraph_is_read_without_a_tree_and_alike(seed, monkeypatch):
    rng = random.Random(seed)

    def make(depth):
        out = ""
        for _ in range(rng.randint(1, 5)):
            tag = rng.choice(["b", "em", "strong", "code", "samp", "a"]) if depth and rng.random() < 0.6 else ""
            start = f'a href="{rng.choice(["/x", "#", "javascript:1", "", "/y z", "up/z"])}"' if tag == "a" else tag
            text = rng.choice(["x", " ", "a  b", "\n", "&amp;", "&nbsp;", "y\u3000z", "\x1c", "\ufeff", ">"])
            out += f"<{start}>{text if tag in ('code', 'samp') else make(depth - 1)}</{tag}>" if tag else text
        return out

    html = f"<p>{make(4)}</p>"
    with monkeypatch.context() as m:
        m.setattr(htmltree, "cleaned", None)
        got = blocks(html, PAGE)
    monkeypatch.setattr(htmltree, "paragraph", lambda html, page: None)
    assert got == blocks(html, PAGE)


@pytest.mark.parametrize("html", ["<p><b>a<i>b</b>c</i></p>", "<p>a<br>b</p>", "<p>a<p>b</p>", "<p><code>a<b>b</b></code></p>", "<p><a class='ad' href='/x'>a</a></p>", "<p>a</b></p>", "<p>a <b</p>", "<p><b>a</p>"])
def test_other_pages_are_no_marked_paragraph(html):
    assert htmltree.paragraph(html, PAGE) is None and blocks(html, PAGE)


def test_lists_follow_the_one_that_they_are_in():
    assert shapes("<ul><li>one<ol><li>two<ul><li>three</ul></ol><li>four</ul>") == [("list", "one\nfour"), ("list", "two"), ("list", "three")]
    assert shapes("<ol><li><p>Run:</p><pre>a\n b</pre><li><img src='/p.png' alt='P'></ol>") == [("list", "Run:"), ("code", "a\n b"), ("image", "P")]
    assert shapes("<ul><li><span><p>a</p><ul><li>b</ul></span></ul>") == [("list", "a"), ("list", "b")]
    assert shapes("<ul>text<div>x</div></ul>") == []


def test_tables_are_one_list_of_rows():
    assert shapes("<table><tr><td>a<td>b<tr><td>c<td> <td>d</table>") == [("list", "a · b\nc · d")]
    assert shapes("<table><thead><tr><th>h<tbody><tr><td><img src='/i.png'><td><p>x<p>y</table>") == [("list", "h\nx y"), ("image", "")]
    assert shapes("<table class='ltx_equation'><tr><td><math alttext='a^2'><mi>a</mi></math></table>") == [("paragraph", "a^2")]
    assert spans("<p>so <math alttext='n+1'><mi>n</mi></math></p>") == [("so ",), ("n+1", "code")]


def test_figures_and_their_captions():
    figure = lambda inner: [(b["type"], b.get("caption") or b["text"]) for b in blocks(f"<figure>{inner}</figure>", PAGE)]
    assert figure("<img src='/a.png' alt='A'><figcaption> One  a</figcaption>") == [("image", "One a")]
    assert figure("<img src='/a.png' alt='A'><img src='/b.png' alt='B'><figcaption>Both</figcaption>") == [("image", "A"), ("image", "B"), ("paragraph", "Both")]
    assert figure("<table><tr><td>x</table><img src='/a.png' alt='A'><figcaption>C</figcaption>") == [("image", "A"), ("list", "x"), ("paragraph", "C")]
    assert figure("<div><figure><img src='/a.png'><figcaption>In</figcaption></figure></div><img src='/b.png' alt='B'><figcaption>Out</figcaption>") == [("image", "In"), ("image", "B"), ("paragraph", "Out")]
    assert figure("<table><tr><td><figure><img src='/a.png'><figcaption>Cell</figcaption></figure></table>") == [("image", "Cell")]
    assert figure("<pre>code</pre><figcaption>said</figcaption>") == [("code", "code"), ("paragraph", "said")]
    assert figure("") == []


def test_frames_and_pictures_in_running_text():
    assert shapes("<p>a<img src='/x.png' alt='X'> b<picture><source srcset='/s.avif'><img src='/y.png' alt='Y'></picture></p>") == [("paragraph", "a b"), ("image", "X"), ("image", "Y")]
    played = blocks("<p>see <iframe src='//player.vimeo.com/video/123'></iframe></p><iframe src='https://youtu.be/abcdefghijk'></iframe><iframe src='https://www.youtube.com/embed/videoseries?list=1'></iframe>", PAGE)
    assert [(b["type"], b.get("provider"), b.get("video_id")) for b in played] == [("paragraph", None, None), ("video", "vimeo", "123"), ("video", "youtube", "abcdefghijk")]
    assert shapes("a <iframe src='https://ads.test'></iframe>b") == [("paragraph", "a b")]


def test_wrappers_around_blocks():
    assert shapes("<b>x<p>one</p>y</b>") == [("paragraph", "x"), ("paragraph", "one"), ("paragraph", "y")]
    assert shapes("<p><b>A<br><p>B</p><p>C") == [("paragraph", "A"), ("paragraph", "B"), ("paragraph", "C")]
    assert shapes("<blockquote cite='/c'>a<p>b</p></blockquote><h5>x <i>y</i></h5>") == [("quote", "a b"), ("heading", "x y")]
    assert [b.get("cite") for b in blocks("<blockquote cite='/c'>a</blockquote>", PAGE)] == ["https://page.test/c"]


def test_code_keeps_its_form():
    assert [(b["text"], b["language"]) for b in blocks("<pre>\n\n x<br>y\n\n</pre><div class='highlight-source-c++'><pre>z</pre></div><pre><code class='a lang-f#'>w", PAGE)] == [("\n x\ny", None), ("z", "c++"), ("w", "f#")]
    assert shapes("<pre> \n </pre>") == []


def test_hostile_pages():
    assert blocks(None) == [] and blocks("") == [] and shapes("</p></b>a<") == [("paragraph", "a<")]
    deep = blocks("<div><b>" * 4000 + "end", PAGE)
    assert [b["text"] for b in deep] == ["end"]
    assert len(blocks("<p>x" * 5000, PAGE)) == 5000
    assert shapes("<img src='http://[bad'><a href='http://[bad'>t</a>") == [("paragraph", "t")]


def test_pictures_of_another_address():
    found = blocks("<a href='docs/a.md'>a</a> text<img src='shot.png'><img src='/b.png'>", "https://github.com/o/r/blob/main/", "https://raw.githubusercontent.com/o/r/main/")
    assert found[0]["content"][0]["href"] == "https://github.com/o/r/blob/main/docs/a.md" and [b["url"] for b in found[1:]] == ["https://raw.githubusercontent.com/o/r/main/shot.png", "https://raw.githubusercontent.com/b.png"]
