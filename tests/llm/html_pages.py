"""Pages by rule with names and layouts of their own, simpler than those that op3 trains on."""

import random

BAD_TAGS = ("nav", "footer", "aside", "form", "header")


def written_page(rng: random.Random) -> str:
    """A page of a random layout. Main text is marked by words starting with "q", all else has none."""
    def prose(main, lo, hi):
        words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi))]
        words = [("q" + w if main else w) + rng.choice(("", "", "", "", "", ",", ".")) + rng.choice(("", "", "", "", "###", "&amp;") if rng.random() < 0.1 else ("",)) for w in words]
        return " ".join(words) + "."

    def links(n):
        return "".join(f'<li><a href="/{k}">{prose(False, 1, 2)}</a></li>' for k in range(n))

    def wrap(names, inner, tags):
        tag, name = rng.choice(tags), rng.choice(names)
        attribute = "" if tag in BAD_TAGS and rng.random() < 0.7 else f' {rng.choice(("class", "id"))}="{name}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    boilerplate = {
        "nav": lambda: wrap(("nav", "menu", "navbar", "site-navigation"), f"<ul>{links(rng.randint(2, 9))}</ul>", ("nav", "div", "nav")),
        "header": lambda: wrap(("header", "masthead", "site-header"), f"<h1>{prose(False, 1, 4)}</h1><p>{prose(False, 2, 8)}</p>", ("header", "div")),
        "ad": lambda: wrap(("ad", "ads", "advert", "promo-box", "sponsored", "banner"), rng.choice(("{}", "<p>{}</p>")).format(prose(False, 3, 40)), ("div", "aside", "section")),
        "side": lambda: wrap(("sidebar", "side-rail", "widget", "related"), f"<h2>{prose(False, 1, 3)}</h2>" + rng.choice((f"<ul>{links(rng.randint(2, 6))}</ul>", f"<p>{prose(False, 10, 40)}</p>")), ("aside", "div")),
        "notice": lambda: wrap(("notice", "cookie-consent", "alert", "popup"), f"<p>{prose(False, 6, 30)}</p><button>ok</button>", ("div", "section")),
        "form": lambda: wrap(("form", "subscribe", "login", "search-form"), f"<label>{prose(False, 1, 3)}</label><input type=text><p>{prose(False, 3, 10)}</p>", ("form",)),
        "comments": lambda: wrap(("comments", "comment-list", "replies"), "".join(f'<div class="comment"><p>{prose(False, 5, 60)}</p></div>' for _ in range(rng.randint(1, 5))), ("div", "section")),
        "footer": lambda: wrap(("footer", "site-footer", "copyright"), f"&copy; {prose(False, 3, 20)}", ("footer", "footer", "div")),
    }

    def paragraph():
        kind = rng.random()
        body = prose(True, 1, 2) if kind < 0.1 else prose(True, 4, 120)
        if kind > 0.9:
            return f"<h2>{prose(True, 1, 5)}</h2>"
        if kind > 0.84:
            return "<ul>" + "".join(f"<li>{prose(True, 2, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind > 0.8:
            return f"<blockquote>{body}</blockquote>"
        if kind > 0.77:
            return f"<table><tr><td>{prose(True, 1, 4)}<td>{prose(True, 1, 4)}</table>"
        return f"<p>{body}" if kind > 0.7 else f"<p><b>{body}<br>" if kind > 0.6 else f"<p>{body} <a href=x>{prose(True, 1, 3)}</a></p>" if kind > 0.55 else f"<p>{body}</p>"

    parts = [f"<h1>{prose(True, 1, 10)}</h1>"] * (rng.random() < 0.8) + [paragraph() for _ in range(rng.choice((1, 1, 2, 4, 8, 16)))]
    for name in ("ad", "notice", "form", "side"):
        if rng.random() < 0.15:
            parts.insert(rng.randrange(len(parts) + 1), boilerplate[name]())
    tag = rng.choice(("article", "article", "article", "main", "div", "section"))
    attribute = f' class="{rng.choice(("content", "post", "article-body", "entry", "story", "main"))}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
    article = f"<{tag}{attribute}>{''.join(parts)}" + f"</{tag}>" * (rng.random() < 0.95)
    before = [boilerplate[n]() for n in ("header", "nav", "notice", "ad", "side", "form") if rng.random() < 0.45]
    after = [boilerplate[n]() for n in ("comments", "side", "ad", "form", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    inner = "".join(before) + article + "".join(after)
    if rng.random() < 0.4:
        inner = f'<div class="{rng.choice(("wrapper", "container", "page"))}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{prose(False, 2, 5)}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>{inner}" + "</body></html>" * (rng.random() < 0.9)
