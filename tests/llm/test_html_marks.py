"""Names of classes and forms must not silence the main text itself."""

import pytest

from neurotab.llm.html_extract import extract

BODY = "<p>" + "One real sentence of the text. " * 9 + "</p><p>" + "Another real sentence. " * 9 + "</p><p>End.</p>"
TEXT = "\n".join([("One real sentence of the text. " * 9).strip(), ("Another real sentence. " * 9).strip(), "End."])
SIDE = "<div class='sidebar'><p>Read the other pages too.</p></div>"


@pytest.mark.parametrize("html", [
    f"<body><div class='site-content has-sidebar'><div>{BODY}</div>{SIDE}</div>",
    f"<body><div class='site-content has-sidebar'><article>{BODY}</article>{SIDE}</div>",
    f"<div class='post no-comments'>{BODY}</div>",
    f"<div id='page-with-cookie-bar'><main>{BODY}</main><div id=cookie-bar>We use cookies.</div></div>",
    f"<body><form id=aspnetForm><nav><a href=x>Home</a></nav><div>{BODY}</div></form>",
    f"<form><div class='widget Blog'>{BODY}</div>{SIDE}</form>",
    f"<span class='with-menu'><div>{BODY}</div></span>",
])
def test_wrapper_keeps_its_text(html):
    assert extract(html) == TEXT


def test_marks_hold_elsewhere():
    comments = "<section class='comments'>" + "<article><p>A reader says a lot about this here. </p></article>" * 80 + "</section>"
    assert extract(f"<article>{BODY}</article>{comments}") == TEXT
    assert extract(f"<div class=story>{BODY}</div><div class='promo'>{BODY}</div>") == TEXT
    assert extract(f"<article>{BODY}<form><p>Your mail address, please.</p></form></article>") == TEXT
    assert extract(f"<form class=login><p>Name and password, please.</p></form><div>{BODY}</div>") == TEXT
