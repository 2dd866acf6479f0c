"""Job-card parsing for T4: a small stdlib ``html.parser`` tree plus the handful of
selectors the job board uses.  Runs per page inside ``mapInPandas``; everything
after the card text (salary, remote policy, ids, URLs) is native Spark.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Selectors of the job board.  Card selectors are tried one after the other; of a field's
# selectors the first element in the page wins.
CARD_SELECTORS = ["div.job_seen_beacon", "div.jobsearch-ResultsList > div", "li.css-5lfssm"]
TITLE_SELECTOR = "h2.jobTitle a, a[data-jk]"
#: output column -> (selectors, value where nothing matches, longest value)
FIELDS = {
    "role_title": (TITLE_SELECTOR, "", None),
    "company_name": ("span[data-testid='company-name'], span.companyName", "Unknown", None),
    "location": ("div[data-testid='text-location'], div.companyLocation", "", None),
    "salary_text": ("div.salary-snippet-container, div[data-testid='attribute_snippet_testid']", "", None),
    "description_text": ("div.job-snippet, td.resultContent div.css-9446fg", "", 5000),
}
JOB_KEY_RE = re.compile(r"jk=([a-f0-9]+)")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def classes(self):
        return (self.attrs.get("class") or "").split()

    def text(self) -> str:
        """``get_text(strip=True)``: every text piece stripped, joined without separator."""
        out = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                s = n.strip()
                if s:
                    out.append(s)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def iter(self):
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack.extend(reversed(n.children))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in VOID:
            self.cur = node

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse_html(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"^([a-zA-Z0-9]*)(?:\.([\w-]+))?(?:\[([\w-]+)(?:='([^']*)')?\])?$")


def _match(node: Node, simple: str) -> bool:
    m = _SIMPLE.match(simple)
    if not m:
        return False
    tag, cls, attr, val = m.groups()
    if tag and node.tag != tag:
        return False
    if cls and cls not in node.classes():
        return False
    if attr and (attr not in node.attrs or (val is not None and node.attrs[attr] != val)):
        return False
    return True


def _select(root: Node, selector: str) -> list[Node]:
    """Descendant (``A B``) and child (``A > B``) combinators over simple selectors."""
    parts = selector.replace(">", " > ").split()
    out = []
    for node in root.iter():
        if not _match(node, parts[-1]):
            continue
        i, cur, ok = len(parts) - 2, node, True
        while i >= 0 and ok:
            if parts[i] == ">":
                cur = cur.parent
                ok = cur is not None and cur is not root and _match(cur, parts[i - 1])
                i -= 2
            else:
                cur = cur.parent
                while cur is not None and cur is not root and not _match(cur, parts[i]):
                    cur = cur.parent
                ok = cur is not None and cur is not root
                i -= 1
        if ok:
            out.append(node)
    return out


def select_one(root: Node, selectors: str) -> Node | None:
    """First element in document order that matches any of the comma-separated selectors."""
    hits = {id(n) for one in selectors.split(",") for n in _select(root, one.strip())}
    return next((n for n in root.iter() if id(n) in hits), None)


def find_cards(root: Node) -> list[Node]:
    return next((cards for one in CARD_SELECTORS if (cards := _select(root, one))), [])


def job_key(card: Node) -> str:
    """The key in the title link's address, else the link's own key attribute."""
    link = select_one(card, TITLE_SELECTOR)
    attrs = link.attrs if link is not None else {}
    found = JOB_KEY_RE.search(attrs.get("href", ""))
    return found[1] if found else attrs.get("data-jk", "")


def page_cards(html: str) -> list[dict]:
    out = []
    for card in find_cards(parse_html(html)):
        row = {"job_key": job_key(card)}
        for column, (selectors, default, longest) in FIELDS.items():
            element = select_one(card, selectors)
            row[column] = (default if element is None else element.text())[:longest]
        out.append(row)
    return out
