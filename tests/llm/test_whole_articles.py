from cinderlog.llm.html_text import main_text

LONG = "A long paragraph, with commas, and many words, so that it earns points, one after the other, yes. " * 2


def paragraphs(n, word):
    return "".join(f"<p>{word} {k}. {LONG}</p>" for k in range(n))


def lines(n, word):
    return [f"{word} {k}. {LONG}".strip() for k in range(n)]


def test_uneven_sections_of_an_article():
    for tag in ("article", "main", "article class=sidebar"):
        page = f"<body><nav><a href=x>x</a></nav><{tag}><section>{paragraphs(15, 'a')}</section><section>{paragraphs(2, 'b')}</section></{tag.split()[0]}><footer>f</footer></body>"
        assert main_text(page).split("\n") == lines(15, "a") + lines(2, "b")


def test_heading_short_blocks_and_lists_of_links():
    page = (
        "<body><p>Site.</p><main><h1>Not of the article</h1><article><h1>Title</h1><p>Short</p>"
        f"<div class=content>{paragraphs(8, 'c')}</div><aside>Side</aside><div class=share>Share</div>"
        "<ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul>"
        "<table><tr><td><a href=3>Row</a></td></tr></table><p>End</p></article></main></body>"
    )
    want = ["Title", "Short", *lines(8, "c"), "Source one", "Source two", "Row", "End"]
    assert main_text(page).split("\n") == want


def test_siblings_without_an_article_element():
    page = f"<body><div id=x><h2>Head</h2><div>{paragraphs(9, 'd')}</div><div>{paragraphs(6, 'e')}</div><div><p>Short end</p></div></div><div class=related>Other</div></body>"
    assert main_text(page).split("\n") == ["Head", *lines(9, "d"), *lines(6, "e"), "Short end"]


def test_names_that_only_look_like_boilerplate():
    body = paragraphs(6, "a")
    want = lines(6, "a")
    for page in (
        f'<body class="no-ads">{body}</body>',
        f'<body><article class="post ad-free">{body}</article></body>',
        f'<body><article class="ad">{body}</article></body>',
        f'<body><form action=x><div>{body}</div><label>Name</label><input><button>Go</button></form></body>',
        f'<body><div class="comments">{paragraphs(9, "x")}</div><article>{body}</article></body>',
        f'<body><article>{body}<div class="ad-box">Buy</div><div class="comment-list">x</div></article></body>',
    ):
        assert main_text(page).split("\n") == want, page


def test_parts_of_an_article_with_such_names():
    page = (
        f'<body><article>{paragraphs(6, "a")}<p>He gave a <span class="reply">quick reply</span> of <math><mi>x</mi></math>.</p>'
        '<section id="related-work"><p>Earlier work.</p></section><div class="tags-explained"><p>What tags mean.</p></div></article></body>'
    )
    assert main_text(page).split("\n") == [*lines(6, "a"), "He gave a quick reply of x.", "Earlier work.", "What tags mean."]


def test_a_short_part_beside_a_long_one():
    page = f'<body><div>Site</div><div id=content><div>{paragraphs(9, "d")}</div><div><p>Short end</p></div></div><div>Other</div></body>'
    assert main_text(page).split("\n") == [*lines(9, "d"), "Short end"]
