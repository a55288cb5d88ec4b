"""A small reader of markup for what regular expressions can't nest."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

_WANTED = {"h1", "h2", "h3", "b", "strong"}
_HIDDEN = {"script", "style", "noscript", "template"}


class _Cards(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.hidden = 0
        self.found: list[str] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        if tag in _WANTED:
            if not self.open:
                self.parts = []
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))
        if tag in self.open:
            self.open.remove(tag)
            if not self.open and (text := " ".join("".join(self.parts).split())):
                self.found.append(text)

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.parts.append(data)


def card_texts(html: str) -> list[str]:
    """Texts of headings and emphasised spans, in order, each once."""
    parser = _Cards()
    parser.feed(html)
    parser.close()
    return list(dict.fromkeys(parser.found))


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Which nested objects of a linked-data object name people, and the context they give.
_ROLES = {"event": (("organizer", "performer"), "event"), "profilepage": (("mainEntity",), "profile"), "organization": (("employee", "founder", "member"), "structured")}
_ADDRESS = re.compile(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}")


class _Node:
    def __init__(self, tag: str = "", attrs=()) -> None:
        self.tag, self.attrs = tag, {k: v or "" for k, v in attrs}
        self.classes = set(self.attrs.get("class", "").split())
        self.inside: list[_Node | str] = []

    def nodes(self):
        """All nodes below, in document order; a stack, as pages nest without bound."""
        stack = [x for x in reversed(self.inside) if isinstance(x, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.inside) if isinstance(x, _Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.inside))
        return " ".join(" ".join(out).split())

    def is_a(self, classes: set[str], prop: str = "") -> bool:
        return bool(self.classes & classes) or (prop != "" and self.attrs.get("itemprop") == prop)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.open = [_Node()]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs)
        self.open[-1].inside.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def _as_list(x) -> list:
    return x if isinstance(x, list) else [] if x in (None, "") else [x]


def _kinds(x) -> set[str]:
    names = {str(k).rstrip("/").rsplit("/", 1)[-1].casefold() for k in _as_list(x.get("@type"))} if isinstance(x, dict) else set()
    return names | {"organization" for n in names if n == "corporation" or n.endswith("business")}


def _objects(x, out: list[dict]) -> list[dict]:
    for one in _as_list(x):
        if isinstance(one, list):
            _objects(one, out)
        elif isinstance(one, dict):
            out.append(one)
            _objects(one.get("@graph"), out)
    return out


def _linked(source: str):
    """(context, person) for each person that linked data names, by itself or in a role."""
    try:
        objects = _objects(json.loads(source), [])
    except (ValueError, RecursionError):
        return
    by_id = {str(o["@id"]): o for o in objects if o.get("@id")}
    for o in objects:
        kinds = _kinds(o)
        if "person" in kinds:
            yield "structured", o
        for kind in sorted(kinds & _ROLES.keys()):
            roles, context = _ROLES[kind]
            for person in [p for role in roles for p in _as_list(o.get(role)) if isinstance(p, dict)]:
                person = by_id.get(str(person.get("@id", "")), {}) | person
                if "person" in _kinds(person):
                    yield context, person


def _linked_fields(o: dict) -> tuple[str, str, list[str], list[str]]:
    job = o.get("hasOccupation")
    title = o.get("jobTitle") or (job.get("name") if isinstance(job, dict) else "") or ""
    values = lambda x: [str(v) for v in _as_list(x.get("value") if isinstance(x, dict) else x)]
    return str(o.get("name") or ""), str(title), values(o.get("telephone")), values(o.get("email"))


def _is_card(n: _Node) -> bool:
    named = n.is_a({"vcard", "team_member", "staff-member", "staff_member", "employee"})
    return named or "team-member" in n.attrs.get("class", "") or "schema.org/Person" in n.attrs.get("itemtype", "")


def _value(n: _Node, attrs: tuple[str, ...]) -> str:
    inner = next((x for x in n.nodes() if x.is_a({"value"}, "value")), None)
    return inner.text() if inner else next((n.attrs[a] for a in attrs if n.attrs.get(a)), None) or n.text()


def _card_fields(card: _Node) -> tuple[str, str, list[str], list[str]] | None:
    below = list(card.nodes())
    name = next((n for n in below if n.is_a({"fn"}, "name") or n.tag in ("h2", "h3", "h4")), None)
    if name is None:
        return None
    title = next((n for n in below if n.is_a({"title", "role", "position"}, "jobTitle")), None)
    links = [n.attrs.get("href", "") for n in below if n.tag == "a"]
    phones = [_value(n, ("content", "title", "data-value")) for n in below if n.is_a({"tel"}, "telephone")] + [h[4:].split("?")[0] for h in links if h.startswith("tel:")]
    emails = [_value(n, ("content", "data-value", "title")) for n in below if n.is_a({"email"}, "email")] + [h[7:].split("?")[0] for h in links if h.startswith("mailto:")]
    return name.text(), title.text() if title else "", phones, emails


def structured_people(html: str, most: int = 8) -> list[tuple[str, str, str, list[str], list[str]]]:
    """(name, title, context, phones, emails) of people in linked data and contact cards, linked data first.

    One of a name and title, with the numbers and addresses of all its places;
    names of over six words are none; at most so many people, the first ones.
    """
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = list(tree.open[0].nodes())
    found = [(context, _linked_fields(o)) for n in nodes if n.tag == "script" and n.attrs.get("type") == "application/ld+json" for context, o in _linked("".join(x for x in n.inside if isinstance(x, str)).strip())]
    found += [("structured", fields) for n in nodes if _is_card(n) and (fields := _card_fields(n))]
    people: dict[tuple[str, str], tuple] = {}
    for context, (name, title, phones, emails) in found:
        name, title = " ".join(name.split()), " ".join(title.split())
        key = (name.casefold(), title.casefold())
        if not 1 <= len(name.split()) <= 6 or (key not in people and len(people) == most):
            continue
        _, _, _, numbers, addresses = people.setdefault(key, (name, title, context, {}, {}))
        for phone in (" ".join(p.split()) for p in phones):
            if phone:
                numbers.setdefault(re.sub(r"\D", "", phone), phone)
        for email in (e.strip().removeprefix("mailto:").split("?")[0].lower() for e in emails):
            if _ADDRESS.fullmatch(email):
                addresses[email] = email
    return [(n, t, c, list(p.values()), list(e.values())) for n, t, c, p, e in people.values()]
