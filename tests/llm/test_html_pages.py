"""Pages whose article stands in forms, beside words of comments and lists of links; and markup that is never closed."""

import time

import pytest

from lakemetrics.llm.html_extraction import main_text

BODY = "<p>First sentence, of the article, is here.</p><p>Second one, with more words, follows it.</p>"
TEXT = "First sentence, of the article, is here. Second one, with more words, follows it."
NAV = "<nav><a href=/>Home</a> <a href=/a>About</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm action=/><div>{BODY}</div></form></body>",
        f"<body>{NAV}<form id=f><div id=wrap><input name=q><button>Go</button>{BODY}</div></form></body>",
        f"<body><fieldset><div>{BODY}</div></fieldset></body>",
        f"<body><div class='single comments-open'>{BODY}</div><footer>foot, of, page</footer></body>",
        f"<body class='x'>{NAV}<div class='post no-reply'>{BODY}</div></body>",
        f"<body><div class='has-comments entry'>{BODY}</div><div class=comments><p>I agree, really.</p></div></body>",
        f"<body><div class='comment'>{BODY}</div></body>",
        f"<body><main>{BODY}<div><h4></h4><ul><li><a href=1>Read next, one</a></li><li><a href=2>Read next, two</a></li><li><a href=3>Three</a></li></ul></div></main></body>",
        f"<body><div id=content>{BODY}<form action=/search><input><label>Search</label> in this site</form></div></body>",
        f"<body><div id=content>{BODY}</div><div id=comments-area><p>One, two, three, four, five, six, seven.</p><p>Eight, nine, ten, eleven.</p></div></body>",
        f"<body><div id=content>{BODY}</div><section id=disqus_thread><p>So, this is, what I think, of it.</p></section></body>",
        f"<body><table><tr><td>{NAV}<td><div>{BODY}</div></table></body>",
        f"<body><div><p>First sentence, of the article, is here.<p>Second one, with more words, follows it.</div></body>",
    ],
)
def test_the_article_stays(page):
    assert main_text(page) == TEXT


def test_links_within_a_sentence_stay():
    page = "<body><main><p>See <a href=1>one</a>, <a href=2>two</a>, and <a href=3>three</a> for more of it.</p></main></body>"
    assert main_text(page) == "See one, two, and three for more of it."


@pytest.mark.parametrize(
    "page",
    ["<i>" * 60_000 + "<div>x, y</div>" * 60_000, "<i>" + "<div>" * 60_000 + "</i>" * 60_000, "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000, "<table><tr><td><table>" + "<i>" * 60_000 + "<td>a</td>" * 60_000, "<ul>" + "<li><b>" * 60_000, "<div class='a b'>" * 60_000],
)
def test_markup_that_is_never_closed_takes_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 15
