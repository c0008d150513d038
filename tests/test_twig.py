import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import selectors
from tablewright.functions.html import html_nodes, page_nodes
from tablewright.operators import twig
from tablewright.plans.page_queries import SHOP_SELECTORS

PLAIN = {
    "a": "div", "b": "div p", "c": "div > p", "d": ".x .y", "e": ".x > .y > a", "f": "p + p", "g": "h2 ~ p", "h": "ul li:last", "i": "li:first, .y:last", "j": "dt + dd",
    "k": "div div a[href]", "l": "[data-k=v] > *", "m": "p:not(.x)", "n": "*:contains('red')", "o": "ul > li:first-child", "p": "a[href^='/p' I], a[href$=\".html\"]", "q": "p:eq(1)",
    "r": "div p:eq(-1)", "s": ".x.y", "t": "#m a, #m", "u": "ul li + li a", "v": "a[rel~=nofollow], a[lang|=de], a[rel!=me]", "w": "ul > li ~ li",
}


class Tree:
    """A page as a tree, and the plain meaning of a selector on it, read from right to left."""

    def __init__(self, html):
        self.rows = list(page_nodes(html))

    def simple(self, i, text):
        _, _, parent, _, tag, attrs, inner = self.rows[i]
        for m in re.finditer(r"""^(?:\*|\w+)|\.[\w-]+|\#[\w-]+|\[([\w-]+)(?:([*^$~|!]?=)(?:"([^"]*)"|'([^']*)'|([^\]\s]*))\s*(i|I)?)?\]|:not\(([^)]*)\)|:contains\(["']?([^)]*?)["']?\)|:first-child""", text):
            part = m[0]
            if part == "*":
                ok = True
            elif part[0] == ".":
                ok = part[1:] in attrs.get("class", "").split()
            elif part[0] == "#":
                ok = attrs.get("id") == part[1:]
            elif part == ":first-child":
                ok = not any(r[2] == parent for r in self.rows[:i])
            elif part.startswith(":not"):
                ok = not any(self.simple(i, x.strip()) for x in m[7].split(","))
            elif part.startswith(":contains"):
                ok = m[8] in inner
            elif part[0] == "[":
                have, want = attrs.get(m[1].lower()), next((g for g in m.group(3, 4, 5) if g is not None), "")
                if m[6] and have is not None:
                    have, want = have.lower(), want.lower()
                if m[2] == "!=":
                    ok = have != want
                elif have is None:
                    ok = False
                else:
                    ok = {None: True, "=": have == want, "*=": bool(want) and want in have, "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want),
                          "~=": want in have.split(), "|=": have == want or have.startswith(want + "-")}[m[2]]
            else:
                ok = tag == part.lower()
            if not ok:
                return False
        return True

    def siblings(self, i):
        return [j for j in range(i) if self.rows[j][2] == self.rows[i][2]]

    def above(self, i):
        while self.rows[i][2] >= 0:
            i = self.rows[i][2]
            yield i

    def match(self, i, parts):
        *rest, text = parts
        if not self.simple(i, text):
            return False
        if not rest:
            return True
        *more, join = rest
        where = {" ": list(self.above(i)), ">": list(self.above(i))[:1], "+": self.siblings(i)[-1:], "~": self.siblings(i)}[join]
        return any(self.match(j, more) for j in where)

    def find(self, selector):
        out = set()
        for one in re.split(r",(?![^\[]*\])(?![^(]*\))", selector):
            one = one.strip()
            pick = re.search(r":(first|last|eq\((-?\d+)\))$", one)
            one = one[: pick.start()] if pick else one
            parts = re.split(r"""(\s*[>+~](?![=])\s*|\s+)(?![^\[]*\])(?![^(]*\))""", one)
            parts = [p.strip() or " " if k % 2 else p or "*" for k, p in enumerate(parts)]
            hit = [i for i in range(len(self.rows)) if self.match(i, parts)]
            if pick:
                at = {"first": 0, "last": -1}.get(pick[1], int(pick[2] or 0))
                hit = [hit[at]] if -len(hit) <= at < len(hit) else []
            out |= set(hit)
        return out


def random_page(rng):
    tags, words = ["div", "p", "ul", "li", "a", "h2", "dl", "dt", "dd", "span", "section"], ["red", "blue", "Artikel-Nr 1", "9,99 €"]
    out, open_tags = [], []
    for _ in range(rng.integers(0, 60)):
        if open_tags and rng.random() < 0.4:
            out.append(f"</{open_tags.pop()}>")
            continue
        tag, attrs = tags[rng.integers(len(tags))], ""
        for name, values in (("class", ["x", "y", "x y", "price amount"]), ("id", ["m"]), ("data-k", ["v", "w"]), ("href", ["/p/1", "/P.html", "x.html"]), ("rel", ["me", "a nofollow"]), ("lang", ["de", "de-AT", "den"])):
            if rng.random() < 0.25:
                attrs += f' {name}="{values[rng.integers(len(values))]}"'
        out.append(f"<{tag}{attrs}>" + (words[rng.integers(len(words))] if rng.random() < 0.5 else ""))
        open_tags.append(tag)
    return "".join(out)


@pytest.fixture(scope="module")
def pages():
    rng = np.random.default_rng(7)
    return [(i, random_page(rng)) for i in range(120)] + [(120, None), (121, ""), (122, "plain"), (123, "<div>" * 300 + "<p class=y>deep</p>")]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("chosen", [PLAIN, SHOP_SELECTORS])
def test_find_equals_a_tree_walk(spark, pages, chosen):
    chosen = dict(chosen)
    trees = {i: Tree(h) for i, h in pages}
    want = sorted((i, name, n, t.rows[n][1]) for i, t in trees.items() for name, s in chosen.items() for n in t.find(s))
    nodes = html_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    assert got(twig.find(nodes, chosen, in_order=True)) == want
    # Nodes in any order, as a written table gives them.
    assert got(twig.find(nodes.repartition(7, "node"), chosen)) == want
    if chosen == PLAIN:
        assert {w[1] for w in want} == set(PLAIN)


def test_near(spark, pages):
    trees = {i: Tree(h) for i, h in pages}
    nodes = html_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    closest, follow = [], []
    for i, t in trees.items():
        for n in t.find("a"):
            other = next((m for m in [n, *t.above(n)] if m in t.find("li, .x, div > section")), None)
            closest += [(i, n, other)] if other is not None else []
        for n in t.find("dt, p"):
            right = next((m for m in range(n + 1, len(t.rows)) if t.rows[m][2] == t.rows[n][2]), None)
            follow += [(i, n, right)] if right in t.find("dd, .y") else []
    assert closest and follow
    assert got(twig.near(nodes, "a", "li, .x, div > section", in_order=True)) == sorted(closest)
    assert got(twig.near(nodes, "dt, p", "dd, .y", "next")) == sorted(follow)


def test_fields_equal_plain_loops(spark, pages):
    trees = {i: Tree(h) for i, h in pages}
    nodes = html_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    roots = {"box": "div, .x", "list": "ul > li", "page": None}
    roles = {"box": {"title": ["h2", ".y", "p"], "href": ["a[href]"]}, "list": {"title": ["div a"]}, "page": {"href": ["a[href$='.html']", "a"]}}
    counts = {"box": {"n": "p"}, "page": {"n": "p, a", "m": "li"}}
    values = {"title": F.nullif(F.col("text"), F.lit("")), "href": F.col("attrs")["href"]}
    for whole in (True, False):
        want = []
        for i, t in trees.items():
            value = {"title": lambda n, t=t: t.rows[n][6] or None, "href": lambda n, t=t: t.rows[n][5].get("href")}
            for kind, top in roots.items():
                for r in t.find(top) if top else ([-1] if t.rows else []):
                    inside = range(r + (0 if whole or r < 0 else 1), (t.rows[r][1] if r >= 0 else len(t.rows) - 1) + 1)
                    found = {}
                    for role, tests in roles[kind].items():
                        best = min(((k, n) for k, s in enumerate(tests) for n in t.find(s) if n in inside and value[role](n) is not None), default=None)
                        if best:
                            found[role] = value[role](best[1])
                    n = {name: len([m for m in t.find(s) if m in inside]) for name, s in counts.get(kind, {}).items()}
                    want.append((i, kind, r, t.rows[r][1] if r >= 0 else -1, sorted(found.items()), sorted(n.items())))
        for df in (twig.fields(nodes, roots, roles, values, counts, whole, True), twig.fields(nodes.repartition(5), roots, roles, values, counts, whole)):
            mine = sorted((r[0], r[1], r[2], r[3], sorted(r[4].items()), sorted(r[5].items())) for r in df.collect())
            assert mine == sorted(want)


def test_outside(spark, pages):
    trees = {i: Tree(h) for i, h in pages}
    want = sorted((i, n) for i, t in trees.items() for n in range(len(t.rows)) if not any(m in t.find(".x, ul") for m in [n, *t.above(n)]))
    nodes = html_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    assert got(twig.outside(nodes, selectors.selects(".x, ul")).select("page_id", "node")) == want


@pytest.mark.parametrize("bad", ["", "> a", "a >", "a,,b", "a:hover", "a:last b", "a[", "a:contains('x'"])
def test_bad_selectors(bad):
    with pytest.raises(ValueError):
        selectors.parse(bad)


def test_structure_needs_a_pass():
    with pytest.raises(ValueError):
        selectors.selects("ul > li")


def test_values_hold_commas_and_brackets():
    got = selectors.parse("""a[title="x, y > z"], *:contains("a, (b)")""")
    assert [c.compounds for c in got] == [((("tag", "a"), ("attr", "title", "=", "x, y > z", False)),), ((("tag", "*"), ("contains", "a, (b)")),)]
