"""Operator 9 against a plain version: another parser, neighbours by trying all."""

import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from astroloom.llm import html

PROSE = "The best of the day is the walk to the sea and the way it was for all of us in the sun."
OTHER = "Other people of the town were on the road for a day and it was as warm as in the summer."
ODD = "Xyzzy plugh quux corge grault garply waldo fred thud frob foo bar baz."


class Plain(HTMLParser):
    """Blocks of a well-formed page as (text, share of links, containers)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.found, self.parts, self.number = [], [], [], 0

    def end(self):
        text = " ".join("".join(x for x, _ in self.parts).split())
        if text:
            linked = sum(len("".join(x.split())) for x, link in self.parts if link)
            self.found.append((text, linked / len(text), [p for p in self.path]))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCK_TAGS:
            self.end()
            if self.path and self.path[-1][0] == "p":
                self.path.pop()
        if tag not in html.VOID_TAGS:
            self.number += 1
            self.path.append((tag, dict(attrs), self.number))

    def handle_endtag(self, tag):
        if tag in html.BLOCK_TAGS:
            self.end()
        for k in range(len(self.path) - 1, -1, -1):
            if self.path[k][0] == tag:
                del self.path[k:]
                break

    def handle_data(self, data):
        if not any(t in ("script", "style", "title", "noscript", "button") for t, _, _ in self.path):
            self.parts.append((data, any(t == "a" and "href" in a for t, a, _ in self.path)))


def containers(path):
    """(level, whether by a name, in an article, the innermost container's number)"""
    level, named, article, own = 0, False, False, 0
    for tag, attrs, number in path:
        here, by_name = 0, False
        if tag in ("nav", "footer", "aside", "menu", "form", "fieldset") or tag == "header" and not article:
            here, by_name = 2, tag in ("form", "fieldset")
        for value in attrs.get("class", "").split():
            words = value.split("-")
            if tag in ("body", "article", "main"):
                if tag == "article" and (words[-1] in ("comment", "teaser") or words[1:] == [] and words[0] in html.ASIDE_ARTICLES):
                    here, by_name = 2, True
                continue
            if words[-1] in (html.STRONG_NAMES if article else html.BOILERPLATE_NAMES):
                this = 2
            elif article:
                this = int(words[-1] in html.BOILERPLATE_NAMES)
            else:
                this = int(any(w in html.BOILERPLATE_NAMES | html.PAGE_NAMES for w in words))
            if this > here:
                here, by_name = this, True
        if tag in ("article", "main"):
            article = True
            if level < 2 or named and tag == "main":
                level, named = 0, False
        if here > level or here == 2 and not by_name:
            level, named = here, by_name
        if here or tag in ("article", "main"):
            own = number
    return level, named, article, own


def plain_text(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.end()
    rows = []
    for text, links, path in parser.found:
        ws = html._WORD.findall(text.lower())
        level, named, article, own = containers(path)
        block = [t for t, _, _ in path if t in html.BLOCK_TAGS]
        rows.append((text, links, len(ws), sum(w in html.STOP_WORDS for w in ws) / max(1, len(ws)), level, named, article, own, block[-1:] or [""]))

    def first(row, known):
        text, links, n, dense, level, _, article, _, tag = row
        inside = article and level < 2
        if links > 0.4:
            return "open" if inside and tag[0] in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") else "bad"
        if "©" in text and not inside:
            return "bad"
        if n < (24 if level == 1 and not article else 12):
            return "open"
        if known and dense < 0.12:
            return "open" if inside else "bad"
        return "held" if level == 2 else "good"

    labels = [first(r, True) for r in rows]
    if not {"good", "held"} & set(labels) and any(
        r[1] <= 0.4 and r[2] >= (24 if r[4] == 1 and not r[6] else 12) and not ("©" in r[0] and not (r[6] and r[4] < 2)) for r in rows
    ):
        labels = [first(r, False) for r in rows]
    article = any(r[6] and r[4] < 2 for r in rows)
    some = "good" in labels
    labels = [("good" if r[5] and not some and not article else "bad") if x == "held" else x for x, r in zip(labels, rows)]
    some = "good" in labels
    article = article or any(x == "good" and r[6] for x, r in zip(labels, rows))
    out = []
    for i, (x, r) in enumerate(zip(labels, rows)):
        if x == "open":
            level, inside, own = r[4], r[6], r[7]
            bad_at = 4 if level == 2 else 5 if level == 1 or not inside and article else None
            votes = [(abs(i - j) + 4 * (rows[j][7] != own), y) for j, y in enumerate(labels) if y != "open"]
            leaning = "bad" if bad_at else "good"
            if bad_at:
                votes.append((bad_at, "bad"))
            elif inside:
                votes.append((4, "good"))
            if not some and level == 0 and r[1] <= 0.4:
                x = "good"
            elif not votes:
                x = "good"
            else:
                nearest = {y for d, y in votes if d == min(v[0] for v in votes)}
                x = nearest.pop() if len(nearest) == 1 else leaning
        if x == "good":
            out.append(r[0])
    return " ".join(out)


def random_page(rng, depth=0):
    pieces = []
    for _ in range(rng.randint(1, 5)):
        k = rng.random()
        name = rng.choice(["", "", "ad", "share", "login-guide", "post-comments", "story", "cookie-notice", "top", "related"])
        name = f' class="{name}"' if name else ""
        if depth < 3 and k < 0.45:
            tag = rng.choice(["div", "div", "section", "article", "aside", "nav", "form", "header", "footer", "main"])
            pieces.append(f"<{tag}{name}>{random_page(rng, depth + 1)}</{tag}>")
        elif k < 0.6:
            pieces.append(f"<ul><li><a href=x>{rng.choice(['Home', 'All the news of the day'])}</a></li><li>one</li></ul>")
        else:
            tag = rng.choice(["p", "p", "h2", "div", "td"])
            text = rng.choice([PROSE, OTHER, ODD, "Short one.", "&copy; 2020 me", "<a href=y>linked title</a>", f"{PROSE} {OTHER}", "A &lt; B <b>bold</b>"])
            pieces.append(f"<{tag}{name}>{text}</{tag}>")
    return "".join(pieces)


@pytest.mark.parametrize("seed", range(8))
def test_rules_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(400):
        page = f"<html><title>t</title><body>{random_page(rng)}</body></html>"
        assert html.main_text(page) == plain_text(page), page


def test_all_small_pages():
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        assert html.main_text(page or "") == plain_text(page or "")


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("AT&T", "AT&T"),
        ("<p>Rates at AT&T", "Rates at AT&T"),
        (f"<article><div class='login-guide share'><p>{PROSE}</p></div></article>", PROSE),
        (f"<article><div class='share'>{PROSE}</div><p>{OTHER}</p></article>", f"{PROSE} {OTHER}"),
        (f"<article><h1><a href=x>Title</a></h1><p>{PROSE}</p></article>", f"Title {PROSE}"),
        # A name alone loses no page.
        (f"<div class=comments><p>{PROSE}</p></div>", PROSE),
        (f"<form id=page><p>{PROSE}</p><p>ok</p></form>", f"{PROSE} ok"),
        (f"<div class=comments><p>{PROSE}</p></div><div><p>{OTHER}</p></div>", OTHER),
        # An aside between two short paragraphs says nothing of them.
        (f"<article><p>{PROSE}</p><aside><p>{OTHER}</p></aside><p>Ok</p></article>", f"{PROSE} Ok"),
        (f"<article><ul><li><a href=a>See also this</a></li></ul><p>End.</p><p>{PROSE}</p></article>", f"End. {PROSE}"),
        ("<nav><a href=x>a</a></nav><p>Hello world</p>", "Hello world"),
        (f"<p>{PROSE}</p><p>&copy; 2020 X</p>", PROSE),
        (f"<article><p>{PROSE}</p><p>Photo &copy; X</p></article>", f"{PROSE} Photo © X"),
        (f"<article><p>m = <math><mi>x</mi></math>c</p><p>{PROSE}</p></article>", f"m = xc {PROSE}"),
        (f"<article><p>{PROSE}<a href='x>{OTHER}</p>", PROSE + OTHER),
        (f"<article><p>{PROSE}</p><p>{ODD}</p></article><div>{ODD}</div>", f"{PROSE} {ODD}"),
    ],
)
def test_no_name_decides_alone(page, expected):
    assert html.main_text(page) == expected


def test_passes_decide():
    """Of the small pages' blocks, nearly all go by text features and neighbours."""
    why = []
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        found = html.blocks(page or "")
        html.label(found)
        why += [b.why for b in found]
    assert sum(w in ("links", "long", "copyright", "no stop words", "neighbour") for w in why) > 0.9 * len(why)


@pytest.mark.parametrize(
    "page", ["<span x>" * 20000 + "</b>" * 20000, '<a href="x' * 20000, "<p><span y>" * 9000 + "<hr>" * 9000, "<article>" + "</div>" * 40000, "<a '" * 20000, "<!" * 30000]
)
def test_odd_markup_takes_linear_time(page):
    html.main_text(page)


def test_html_tables(spark, tmp_path):
    schema = "page_id long, url string, html string"
    for name, rows in (("none", []), ("some", [(1, "u", f"<p>{PROSE}</p>"), (1, "u", f"<p>{PROSE}</p>"), (None, None, None)])):
        df = spark.createDataFrame(rows, schema)
        for c in ("text", "n_chars", "row", "doc_id"):
            df = df.withColumn(c, F.lit("x"))
        df.write.parquet(str(tmp_path / name / "pages.parquet"))
        got = html.op9_html(spark, str(tmp_path / name))
        assert got.columns == ["page_id", "url", "text", "n_chars"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, u, PROSE if h else "", len(PROSE) if h else 0) for i, u, h in rows), key=repr)
