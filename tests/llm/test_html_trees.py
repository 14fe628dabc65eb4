"""HTML extraction against a plain renderer that walks random trees, written out with and without the tags that may be left out."""

import html
import random
import re

import pytest

from pulsegrid.llm import html_text

INLINE = ("b", "span", "a", "em", "code")
PLAIN, SPACED = ("div", "section", "main"), ("p", "h1", "h2", "blockquote")
GAP = object()


def words(rng):
    return "".join(rng.choice(["word", "x", "é", "a & b", "<tag>", "1 < 2", '"q"']) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(rng.randint(1, 3)))


def inline(rng, depth=2):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.55:
            out.append(rng.choice(["", " "]) + words(rng).rstrip() + rng.choice(["", " ", "\n"]))
        elif kind < 0.65:
            out.append(("br", []))
        elif kind < 0.75:
            out.append((rng.choice(["unseen", "script", "style"]), [words(rng)]))
        elif depth:
            out.append((rng.choice(INLINE), inline(rng, depth - 1)))
    return out


def flow(rng, depth):
    """Children of a block: text and blocks of all kinds."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.3 or not depth:
            out += inline(rng)
        elif kind < 0.45:
            out.append(("p", inline(rng)))
        elif kind < 0.55:
            out.append((rng.choice(["h1", "h2"]), inline(rng)))
        elif kind < 0.65:
            out.append((rng.choice([*PLAIN, "blockquote"]), flow(rng, depth - 1)))
        elif kind < 0.72:
            out.append(("hidden", flow(rng, depth - 1)))
        elif kind < 0.88:
            out.append((rng.choice(["ul", "ol"]), [("li", [words(rng), *(flow(rng, depth - 1) if rng.random() < 0.4 else inline(rng))]) for _ in range(rng.randint(1, 3))]))
        else:
            n = rng.randint(1, 3)
            out.append(("table", [("tr", [(rng.choice(["td", "th"]), [words(rng)]) for _ in range(n)]) for _ in range(rng.randint(1, 3))]))
    return out


def spelled(rng, node, following=None, brief=False):
    if isinstance(node, str):
        return "".join(f"&#{ord(c)};" if c.isalpha() and rng.random() < 0.05 else html.escape(c, quote=False) for c in node)
    tag, children = node
    inside = "".join(spelled(rng, c, children[i + 1] if i + 1 < len(children) else "end", brief) for i, c in enumerate(children))
    name = tag.upper() if rng.random() < 0.1 else tag
    if tag == "br":
        return rng.choice(["<br>", "<br/>", "<BR />"])
    if tag in ("script", "style"):
        return f"<{name}>{children[0].replace('<', '')}</{name}>"
    if tag == "unseen":
        return rng.choice(['<span style="color:red; display : none">{}</span>', "<span hidden>{}</span>", "<i style='visibility:hidden'>{}</i>", "<svg a='>'>{}</svg>"]).format(inside)
    if tag == "hidden":
        return f"<div hidden class='>'>{inside}</div>"
    after = following if isinstance(following, str) else following and following[0]
    may_end = {"li": ("li", "end"), "td": ("td", "th", "end"), "th": ("td", "th", "end"), "tr": ("tr", "end"), "p": ("p", "ul", "ol", "table", "div", "section", "main", "h1", "h2", "blockquote", "end")}
    left_out = brief and after in may_end.get(tag, ()) and rng.random() < 0.7
    given = rng.choice(["", "", ' title="a > b"', " data-x=1 disabled"])
    return f"<{name}{given}>{inside}" + ("" if left_out else f"</{name}>")


def collapsed(text):
    return re.sub(r"[ \t\n\r\f]+", " ", text).strip(" ")


def runs(children):
    """Inline children as text with a line break wherever there is one, block children by themselves."""
    out = [""]
    for c in children:
        if isinstance(c, str):
            out[-1] += c
        elif c[0] == "br":
            out += [("br",), ""]
        elif c[0] in INLINE:
            for part in runs(c[1]):
                if isinstance(part, str):
                    out[-1] += part
                else:
                    out += [part, ""]
        elif c[0] not in ("unseen", "script", "style", "hidden"):
            out += [c, ""]
    return out


def rows(children, lists=0):
    """Lines and gaps of a block's content."""
    out, line = [], ""
    for part in [*runs(children), ("end",)]:
        if isinstance(part, str):
            line += part
            continue
        text = collapsed(line)
        line = ""
        if text:
            out.append(text)
        tag = part[0]
        if tag == "br" and not text:
            out.append(GAP)
        if tag in ("br", "end"):
            continue
        inner = part[1]
        if tag in ("ul", "ol"):
            made = []
            for n, (_, item) in enumerate(inner, 1):
                mark = "- " if tag == "ul" else f"{n}. "
                own, first = [], True
                for r in rows(item, lists + 1):
                    own.append(r if r is GAP else (mark if first else " " * len(mark)) + r)
                    first = first and r is GAP
                made += own
            out += made if lists else [GAP, *made, GAP]
        elif tag == "table":
            cells = [[collapsed("".join(c[1])) for c in row[1]] for row in inner]
            width = [max(len(r[i]) for r in cells if i < len(r)) for i in range(max(map(len, cells)))]
            out += [GAP, *["  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells], GAP]
        else:
            made = [r if r is GAP or tag != "blockquote" else "  " + r for r in rows(inner, lists)]
            out += [GAP, *made, GAP] if tag in SPACED else made
    return out


def plain(children):
    out = []
    for r in rows(children):
        if r is not GAP:
            out.append(r)
        elif out and out[-1] != "":
            out.append("")
    return "\n".join(out).strip("\n")


@pytest.mark.parametrize("brief", [False, True])
def test_random_trees(brief):
    rng = random.Random(brief)
    for _ in range(1_500):
        tree = flow(rng, 3)
        page = "".join(spelled(rng, c, tree[i + 1] if i + 1 < len(tree) else "end", brief) for i, c in enumerate(tree))
        if rng.random() < 0.5:
            page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}</body></html>"
        assert html_text.render(page).strip("\n") == plain(tree), page
