"""Generated pages with known main text, to train the block labeller."""

from __future__ import annotations

import html

import numpy as np

# Names that pages give to their parts.
HEADER = "header site-header masthead topbar top-bar page-header branding hero-header".split()
MENU = "nav navbar menu navigation main-menu links breadcrumb breadcrumbs toc pagination pager tabs subnav".split()
SIDEBAR = "sidebar side rail right-rail widget widgets aside related related-posts recommended more-stories popular trending".split()
NOTICE = "notice cookie cookies cookie-banner consent gdpr alert alert-box popup modal privacy-notice newsletter-banner warning message".split()
ADVERT = "ad ads advert advertisement adsbox banner-ad sponsor sponsored promo promotion ad-slot adbox dfp outbrain".split()
FORM = "form search search-form subscribe signup login newsletter contact-form".split()
COMMENT = "comments comment comment-list discussion replies responses reader-comments disqus user-comments feedback".split()
FOOTER = "footer site-footer page-footer bottom copyright legal colophon foot".split()
MAIN = "content article post entry story main main-content post-content entry-content article-body story-body post-body text body-text article-text".split()
WRAP = "wrap wrapper container row col page inner outer site layout grid block section box".split()
SPOKEN = "home about contact login subscribe search share next previous read more news sports archive help terms privacy follow us menu accept cookies reply advertisement all rights reserved by comments".split()
SYLLABLES = "an er in the re on ti es st en at ed nd to or ea hi is ou ar as de rt ve al le se me ch ei un que ión do ra ue la pa eau vi é ö ü ß sch keit lich ung ge ver".split()


def page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """(html, texts of the blocks that are main text)."""
    pick = lambda names: names[int(rng.integers(len(names)))]
    chance = lambda p: rng.random() < p
    main: set[str] = set()
    odd = pick(["", "", "", "%%%", "$$$", " |", "!!", "***"])

    def word() -> str:
        return pick(SPOKEN) if chance(0.03) else "".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 5))))

    def words(n: int) -> str:
        out = [word() + (odd if odd and chance(0.5) else "") + ("," if chance(0.06) else "") for _ in range(n)]
        return " ".join(out)

    def sentence(n: int | None = None) -> str:
        text = words(n or int(rng.integers(3, 18)))
        text = text.upper() if chance(0.05) else text[0].upper() + text[1:]
        return text + pick([".", ".", ".", "?", "!", ""])

    def paragraph(most: int = 7) -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(1, most + 1))))

    def name(names: list[str]) -> str:
        label = pick(names)
        label = pick([label, label, f"{label}-{int(rng.integers(9))}", label.replace("-", "_"), f"{pick(WRAP)} {label}", f"{label} {word()}"])
        return pick([f'class="{label}"', f'class="{label}"', f'id="{label}"', f'id="{word()}" class="{label}"'])

    def wrap(inner: str) -> str:
        for _ in range(int(rng.integers(0, 3))):
            inner = f'<div {name(WRAP)}>{inner}</div>' if chance(0.7) else f"<div>{inner}</div>"
        return inner

    def part(tag: str, names: list[str], inner: str, role: str = "") -> str:
        """The part by its own element, by a named one, or both."""
        way = rng.random()
        if tag and way < 0.4:
            return f"<{tag}>{inner}</{tag}>"
        if tag and way < 0.55:
            return f"<{tag} {name(names)}>{inner}</{tag}>"
        if role and way < 0.62:
            return f'<div role="{role}">{inner}</div>'
        return f"<{pick(['div', 'div', 'section'])} {name(names)}>{inner}</div>" if chance(0.02) else f"<div {name(names)}>{inner}</div>"

    def link_list(n: int | None = None) -> str:
        items = [f'<a href="/{word()}">{words(int(rng.integers(1, 4)))}</a>' for _ in range(n or int(rng.integers(2, 9)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if chance(0.75) else pick([" | ", " ", ""]).join(items)

    def extra() -> str:
        """Text that is not main, in any of the usual shapes."""
        out = [pick([f"<p>{paragraph(3)}</p>", f"<h{pick('2345')}>{sentence(4)}</h3>", sentence(), f"<p>{sentence()}</p>", link_list(), f"<span>{words(3)}</span>", f"<div>{paragraph(4)}</div>"]) for _ in range(int(rng.integers(1, 4)))]
        return "".join(out)

    def form() -> str:
        inner = "".join(pick([f"<label>{words(2)}</label><input name=q>", f"<p>{sentence()}</p>", f"<button>{words(1)}</button>", f"<select><option>{word()}</option></select>", f"<legend>{words(2)}</legend>"]) for _ in range(int(rng.integers(1, 5))))
        return part("form", FORM, inner) if chance(0.6) else f"<form>{inner}</form>"

    def comments() -> str:
        one = lambda: f'<{pick(["div", "li", "article"])} {name(["comment", "reply", "comment-body", "response"])}><b>{words(2)}</b><p>{paragraph(4)}</p></div>'
        return part("section" if chance(0.2) else "", COMMENT, f"<h3>{words(2)}</h3>" * chance(0.6) + "".join(one() for _ in range(int(rng.integers(1, 6)))))

    def keep(text: str) -> str:
        main.add(" ".join(html.unescape(text).split()))
        return text

    def advert() -> str:
        return part("", ADVERT, extra() if chance(0.6) else sentence())

    def article() -> str:
        title = html.escape(sentence())
        out = [f"<h1>{keep(title)}</h1>"] if chance(0.85) else []
        if chance(0.4):
            out.append(f"<p><b>{keep(title if chance(0.5) else html.escape(paragraph(2)))}<br>")
        again = paragraph()
        for _ in range(int(rng.integers(1, 45 if chance(0.1) else 14))):
            text = html.escape(again if chance(0.1) else paragraph(), quote=chance(0.5))
            way = rng.random()
            if way < 0.6:
                out.append(f"<p>{keep(text)}</p>")
            elif way < 0.68:
                out.append(f"<p>{keep(sentence(int(rng.integers(1, 5))))}</p>")
            elif way < 0.74:
                out.append(f"<h{pick('23')}>{keep(html.escape(sentence(int(rng.integers(1, 7)))))}</h2>")
            elif way < 0.8:
                out.append("<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif way < 0.84:
                out.append(f"<blockquote><p>{keep(text)}</p></blockquote>")
            elif way < 0.88:
                out.append(f"<p><b>{keep(text if chance(0.5) else words(2))}<br>")
            elif way < 0.91:
                a, b, c = words(3), words(2), words(4)
                keep(f"{a} {b} {c}")
                out.append(f'<p>{a} <a href="/{word()}">{b}</a> {c}</p>')
            elif way < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{keep(words(2))}</td><td>{keep(sentence())}</td></tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>")
            elif way < 0.95:
                out.append(f"<div>{keep(text)}</div>")
            elif way < 0.97:
                out.append(advert())
            elif way < 0.98:
                out.append(part("aside", SIDEBAR, extra()))
            else:
                out.append(part("nav", MENU, link_list()))
        if chance(0.15):
            out.append(pick([advert, comments, form, lambda: part("aside", SIDEBAR, extra()), lambda: part("footer", FOOTER, sentence())])())
        return "".join(out)

    def body_part() -> str:
        inner, way = article(), rng.random()
        if way < 0.45:
            inner = f"<article>{inner}</article>" if chance(0.7) else f"<article {name(MAIN)}>{inner}</article>"
        elif way < 0.55:
            inner = f"<main>{inner}</main>"
        elif way < 0.65:
            inner = f"<main><article>{inner}</article></main>"
        elif way < 0.72:
            inner = f'<div role="main">{inner}</div>'
        else:
            inner = f"<div {name(MAIN)}>{inner}</div>"
        return wrap(inner)

    out = [part("header", HEADER, pick([f'<a href="/">{words(2)}</a>', f"<h1>{words(2)}</h1><p>{sentence()}</p>", f"<div>{words(3)}</div>"]) + (part("nav", MENU, link_list()) if chance(0.5) else ""), "banner")] if chance(0.4) else []
    if chance(0.75):
        out.append(part("nav", MENU, link_list(), "navigation"))
    top = [f for p, f in ((0.25, lambda: part("", NOTICE, extra())), (0.5, advert), (0.15, form), (0.2, lambda: part("aside", SIDEBAR, extra(), "complementary"))) if chance(p)]
    bottom = [f for p, f in ((0.3, lambda: part("aside", SIDEBAR, extra(), "complementary")), (0.3, comments), (0.2, form), (0.3, advert), (0.15, lambda: part("", NOTICE, extra())), (0.15, lambda: part("nav", MENU, link_list()))) if chance(p)]
    out += [wrap(top[k]()) if chance(0.3) else top[k]() for k in rng.permutation(len(top))]
    if not chance(0.04):
        out.append(body_part())
    out += [wrap(bottom[k]()) if chance(0.3) else bottom[k]() for k in rng.permutation(len(bottom))]
    if chance(0.8):
        out.append(part("footer", FOOTER, pick([f"&copy; {word()}.example.com &middot; {sentence()}", f"<p>&copy; 20{int(rng.integers(10, 30))} {words(3)}</p>", extra(), f"{words(4)} {link_list(3)}"]), "contentinfo"))
    inner = "".join(x + pick(["", "\n", f"<!-- {word()} -->", "<script>var t='</p>';f(0);</script>"]) for x in out)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{words(4)}</title><style>p{{margin:0}}</style></head><body>{wrap(inner)}</body></html>', main
