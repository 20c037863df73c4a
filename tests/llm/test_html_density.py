import pytest

from lanternfish.llm import html_text

LONG = ("A sentence with quite some words in it, and a comma; it goes on. " * 4).strip()
LINKS = "".join(f'<li><a href="/{i}">entry {i}</a></li>' for i in range(20))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (f"<body><article><p>{LONG}</p></article><article><p>short</p></article><article><p>{LONG}</p><p>{LONG}</p></article></body>", [LONG, "short", LONG, LONG]),
        (f"<body><main><h1>Title</h1><p>Lead</p><article><p>{LONG}</p><p>{LONG}</p></article></main></body>", ["Title", "Lead", LONG, LONG]),
        (f"<body><main><h1>T</h1><article><p>one {LONG}</p></article><article><p>two {LONG}</p></article></main><div>{LINKS}</div></body>", ["T", f"one {LONG}", f"two {LONG}"]),
        (f"<body><article><p>{LONG}</p><p>{LONG}</p></article><article><ul>{LINKS}</ul></article></body>", [LONG, LONG]),
        (f"<body><article><p>teaser</p></article><div><h2>H</h2><p>{LONG}</p><p>{LONG}</p></div></body>", ["teaser", "H", LONG, LONG]),
    ],
)
def test_marks_are_a_hint(source, want):
    assert html_text.main_blocks(source) == want
