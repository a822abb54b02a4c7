"""What belongs to an article stays: lists of links, headings, and languages that the list of stop words doesn't know."""

import pytest

from millrace.llm.html_blocks import main_text

PROSE = "It was the best of times and the worst of them for all. " * 8
POLISH = "Zażółć gęślą jaźń, wczoraj wieczorem pojechaliśmy samochodem nad rzekę. " * 4
CHINESE = "我们昨天晚上开车去了城里看电影,然后回家睡觉。" * 6
LINKS = "<ul><li><a href=a>First work</a></li><li><a href=b>Second work</a></li><li><a href=c>Third work</a></li></ul>"
WORKS = ["First work", "Second work", "Third work"]

CASES = {
    "references at the end": (f"<article><h1>T</h1><p>{PROSE}</p><h2>References</h2>{LINKS}</article>", ["T", PROSE, "References", *WORKS]),
    "links amid the article": (f"<article><h1>T</h1><p>{PROSE}</p>{LINKS}<p>{PROSE}</p></article>", ["T", PROSE, *WORKS, PROSE]),
    "a menu at the top": (f"<article>{LINKS}<h1>T</h1><p>{PROSE}</p></article>", ["T", PROSE]),
    "a menu at the end": (f"<article><h1>T</h1><p>{PROSE}</p>{LINKS}</article>", ["T", PROSE]),
    "related pages": (f"<article><h1>T</h1><p>{PROSE}</p><h3>Related stories</h3>{LINKS}</article>", ["T", PROSE]),
    "a list by its name": (f"<article><h1>T</h1><p>{PROSE}</p><div class=related><h3>Works</h3>{LINKS}</div><p>{PROSE}</p></article>", ["T", PROSE, PROSE]),
    "heading over one short paragraph": ("<body><h1>A title here</h1><p>It was the best of times and the worst of them for all of us in this town.</p></body>", ["A title here", "It was the best of times and the worst of them for all of us in this town."]),
    "two headings over a paragraph": (f"<body><h1>One</h1><h2>Two</h2><p>{PROSE}</p></body>", ["One", "Two", PROSE]),
    "heading over a menu": (f"<body><h1>One</h1><p>{PROSE}</p><h2>Elsewhere</h2>{LINKS}</body>", ["One", PROSE]),
    "Polish": (f"<body><h1>Tytuł strony</h1><p>{POLISH}</p><p>{POLISH}</p></body>", ["Tytuł strony", POLISH, POLISH]),
    "Chinese": (f"<body><h1>标题</h1><p>{CHINESE}</p></body>", ["标题", CHINESE]),
    "Polish with a menu and a footer": (f"<body><div>{LINKS}</div><h1>Tytuł</h1><p>{POLISH}</p><footer>{POLISH}</footer></body>", ["Tytuł", POLISH]),
    "Chinese in an article": (f"<body><nav>{LINKS}</nav><article><h1>标题</h1><p>{CHINESE}</p><p>短句。</p></article></body>", ["标题", CHINESE, "短句。"]),
}


@pytest.mark.parametrize("name", CASES)
def test_article_text(name):
    page, want = CASES[name]
    assert main_text(page).split("\n") == [w.strip() for w in want]
