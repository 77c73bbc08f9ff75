"""Main text of web pages by site style trees (free style: a small tag reader inside Arrow batches; the trees are Spark aggregates).

The pages of a host are merged into one tree. An element node is known by its place: the tag with its class and id, its position and the
sequence of its parent's children (the style); repeated paragraphs, items and cells in a row are one position. Two kinds of entropy, both to
the base of the number of pages m that hold a node, give its importance:

- presentation: the entropy of an element's styles over its pages; 0 where all pages arrange its children alike;
- content: one less the mean, over the distinct texts of a text node, of log_m of the number of pages that hold the text; 0 where all pages say
  the same, 1 where no two do.

A text branch goes when its content importance is below ``LEAST`` and so is the presentation importance of the element that arranges it, on at
least ``PAGES`` pages of the host. Pages of a host with equal text count once, so copies of an article are no evidence against it.

What an element says of itself comes first: scripts, styles, forms, navigation, footers, asides, page headers and elements whose class, id or
role names an advert, menu, notice, sidebar or comment never enter the tree, however varied their texts (reader comments are). Fewer pages than
``PAGES`` leave it at that.

Only counts by (host, node, text digest) are shuffled, never texts; the low nodes of a host are one row, which its pages meet in a join that
Spark broadcasts where it is small and splits where a host is hot. Pages are read twice.

A null html is empty; a null url, or one without a host, belongs to the site ''. Null or repeated page_ids are rows of their own. A page without
text gives an empty text. Broken markup is read as browsers do: paragraphs, items and cells end where the next one begins, unknown closing tags
mean nothing, an open comment or tag reaches to the end. White space is tab to carriage return and space. Other columns are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import materialize, slices

#: Importance below which a branch goes, and pages of a host needed for a verdict.
LEAST, PAGES = 0.4, 3
#: Labels of elements remembered by a task.
LABELS = 20_000

# --- fixed values: element names of HTML by what they do ------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
RUNS = frozenset("#text p li tr td th dt dd blockquote pre h2 h3 h4 h5 h6".split())
#: Elements that end where one of these names begins, and where the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
# --- fixed values: what elements that are not the article call themselves -------------------------------
NOISE_TAGS = frozenset("nav footer aside form button select option fieldset label menu dialog svg math canvas object audio video map head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners "
    "popup modal cookie cookies consent gdpr notice notices newsletter subscribe signup login share sharing social sidebar sidebars aside widget "
    "widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer comment comments commentlist disqus replies respond "
    "related recommended trending copyright toolbar topbar masthead alert alerts announcement announcements".split()
)
HEADER_WORDS = frozenset(("header",))
#: Words that turn the next one into the name of a layout.
NOT_NAMES = frozenset("no not has with without is hide show".split())

_TOKEN = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)"
    r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+|["'])*+)(?:>|\Z))""", re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNREAD_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in UNREAD}
_WHITE = re.compile(r"[\x20\x09-\x0d]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


def _names(value: str) -> set[str]:
    """Words of a class or id, without those that name a layout (``no-sidebar``)."""
    found = set()
    for token in value.split():
        before = ""
        for word in _WORD.findall(token):
            if before not in NOT_NAMES:
                found.add(word.lower())
            before = word.lower()
    return found


class Labels(dict):
    """(tag, attributes) to (label, kind): 'noise', 'header' (noise outside the article), 'main' or ''."""

    def __missing__(self, key: tuple[str, str]) -> tuple[str, str]:
        tag, attributes = key
        given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        names = _names(given.get("class", "")) | _names(given.get("id", "")) if tag not in ("html", "body", "main") else set()
        role = given.get("role", "").strip().lower()
        if tag == "main" or role == "main" or given.get("itemprop") == "articleBody":
            kind = "main"
        elif tag in NOISE_TAGS or role in NOISE_ROLES or names & NOISE_WORDS or "hidden" in given or given.get("aria-hidden") == "true":
            kind = "noise"
        elif tag == "header" or names & HEADER_WORDS:
            kind = "header"
        else:
            kind = ""
        shown = _DIGITS.sub("0", f"{tag}.{' '.join(sorted(given.get('class', '').split()))}#{given.get('id', '')}")
        if len(self) >= LABELS:
            self.clear()
        value = self[key] = (shown, kind)
        return value


class Page:
    """The elements of a page outside noise, parents first, and its texts in page order."""

    def __init__(self, markup: str, labels: Labels) -> None:
        self.parent, self.label, self.text = [-1], ["html"], [None]
        self._open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, node, left out, inside an article
        self._count: dict[str, int] = {}
        self._said: list[str] = []
        self._read(markup, labels)

    def _add(self, label: str, text: str | None = None) -> int:
        self.parent.append(self._open[-1][1])
        self.label.append(label)
        self.text.append(text)
        return len(self.label) - 1

    def _flush(self) -> None:
        if self._said:
            said = _WHITE.sub(" ", "".join(self._said)).strip(" ")
            self._said.clear()
            if said:
                self._add("#text", said)

    def _push(self, tag: str, node: int, out: bool, inside: bool) -> None:
        self._open.append((tag, node, out, inside))
        self._count[tag] = self._count.get(tag, 0) + 1

    def _close(self, tag: str) -> None:
        """Pops up to the innermost ``tag``, if there is one."""
        if self._count.get(tag):
            while True:
                gone = self._open.pop()[0]
                self._count[gone] -= 1
                if gone == tag:
                    return

    def _end_open(self, tag: str) -> None:
        if self._count.get("p"):
            self._close("p")
        names, stops = ENDS.get(tag, ((), ()))
        if any(self._count.get(n) for n in names):
            for open_tag, *_ in reversed(self._open):
                if open_tag in names:
                    return self._close(open_tag)
                if open_tag in stops:
                    return None
        return None

    def _read(self, markup: str, labels: Labels) -> None:
        at = 0
        while True:
            token = _TOKEN.search(markup, at)
            if not self._open[-1][2]:
                said = markup[at : token.start() if token else len(markup)]
                self._said.append(html.unescape(said) if "&" in said else said)
            if token is None:
                break
            at = token.end()
            closing, tag = token[1], token[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                self._said.append(" ")
                continue
            inline = tag not in BLOCK
            if closing:
                if not inline:
                    self._flush()
                if tag not in ("html", "body"):
                    self._close(tag)
                continue
            if tag in UNREAD:
                end = _UNREAD_END[tag].search(markup, at)
                at = end.end() if end else len(markup)
                continue
            if tag in VOID:
                if tag == "hr":
                    self._flush()
                continue
            label, kind = labels[tag, token[3]]
            _, node, out, inside = self._open[-1]
            if inline:
                if kind == "noise":
                    self._push(tag, node, True, inside)
                elif self._count.get(tag):  # keeps its closing tag from ending an outer one
                    self._push(tag, node, out, inside)
                continue
            self._flush()
            if tag in ("html", "body"):
                self._close("head")
                continue
            self._end_open(tag)
            _, node, out, inside = self._open[-1]
            if kind == "main" or (tag == "article" and not kind and any(t == "form" for t, _, o, _ in self._open if o)):
                out = False
            noise = kind == "noise" or (kind == "header" and not inside)
            if not out:
                node = self._add(label)
            self._push(tag, node, out or noise, inside or tag in ("article", "main") or kind == "main")
        self._flush()

    def keys(self) -> tuple[list[int], list[int]]:
        """Each node's key, and each element's style (0 for texts)."""
        n = len(self.label)
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            children[self.parent[k]].append(k)
        key, style = [0] * n, [0] * n
        digest = xxhash.xxh3_64_intdigest
        for k in range(n):
            if not children[k]:
                continue
            places, sequence = [], []
            for c in children[k]:
                label = self.label[c]
                if not (sequence and sequence[-1] == label and label.partition(".")[0] in RUNS):
                    sequence.append(label)
                places.append(len(sequence) - 1)
            style[k] = digest(f"{key[k]}|{'|'.join(sequence)}".encode())
            for c, place in zip(children[k], places):
                key[c] = digest(f"{style[k]}|{place}|{self.label[c]}".encode())
        return key, style

    def arranger(self, leaf: int) -> int:
        """The element whose children include the block of a text: its parent, or its parent's parent if the text is all the parent has."""
        up = self.parent[leaf]
        alone = self.text[up + 1] is not None and (up + 2 >= len(self.label) or self.parent[up + 2] != up) and self.parent[leaf] != 0
        return self.parent[up] if alone else up


def _strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(name).to_pylist()


_ENTRY = pa.struct([("key", pa.int64()), ("feature", pa.int64()), ("opens", pa.int32()), ("leaf", pa.bool_())])


def _entries(page: Page) -> list[tuple[int, int, int, bool]]:
    """Distinct (node, text digest) and (element, style) of a page; ``opens`` marks the first of a node."""
    key, style = page.keys()
    seen, out, known = set(), [], set()
    for k, text in enumerate(page.text):
        feature = style[k] if text is None else xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
        if (text is None and not feature) or (key[k], feature) in seen:
            continue
        seen.add((key[k], feature))
        out.append((key[k], feature, int(key[k] not in known), text is not None))
        known.add(key[k])
    return out


def _signed(values) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels = Labels()
    for batch in slices(batches, "_html"):
        hosts, bodies, offsets, entries = [], [], [0], []
        for host, markup in zip(_strings(batch, "_host"), _strings(batch, "_html")):
            page = Page(markup, labels)
            texts = [t for t in page.text if t is not None]
            if not texts:
                continue
            hosts.append(host)
            bodies.append(xxhash.xxh3_128_digest("\n".join(texts).encode("utf-8", "surrogatepass")))
            entries += _entries(page)
            offsets.append(len(entries))
        if hosts:
            key, feature, opens, leaf = zip(*entries)
            whole = pa.StructArray.from_arrays(
                [_signed(key), _signed(feature), pa.array(opens, pa.int32()), pa.array(leaf, pa.bool_())], fields=list(_ENTRY)
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(bodies, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), whole)],
                names=["_host", "body", "entries"],
            )


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Nodes of the merged trees: host, node, whether it is a text node, distinct pages with it, and its importance (content or presentation)."""
    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("_host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_html"))
    read = rows.mapInArrow(_evidence, "_host string, body binary, entries array<struct<key: long, feature: long, opens: int, leaf: boolean>>")
    once = read.groupBy("_host", "body").agg(F.min("entries").alias("entries"))
    counts = once.select("_host", F.explode("entries").alias("e")).groupBy(
        "_host", F.col("e.key").alias("node"), F.col("e.leaf").alias("is_text"), F.col("e.feature").alias("feature")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("e.opens").alias("opens"))
    nodes = counts.groupBy("_host", "node", "is_text").agg(
        F.sum("opens").alias("pages"), F.avg(F.log("n")).alias("mean_log"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("n_log"),
    )
    base = F.log("pages")
    importance = F.when(F.col("pages") < 2, F.lit(1.0)).when(F.col("is_text"), 1 - F.col("mean_log") / base).otherwise(
        (F.log("total") - F.col("n_log") / F.col("total")) / base
    )
    return nodes.select(F.col("_host").alias("host"), "node", "is_text", "pages", importance.alias("importance"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels = Labels()
    for batch in slices(batches, "_html"):
        texts = []
        for markup, low in zip(_strings(batch, "_html"), _strings(batch, "low")):
            page, kept = Page(markup, labels), []
            if low:
                key, _ = page.keys()
                gone = set(np.array(low, np.int64).view(np.uint64).tolist())
            for k, text in enumerate(page.text):
                if text is not None and not (low and key[k] in gone and key[page.arranger(k)] in gone):
                    kept.append(text)
            texts.append(" ".join(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["_id", "_url", "text", "n_chars"],
        )


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST, least_pages: int = PAGES
) -> DataFrame:
    """Each page's identifier, url, main text and its length in code points."""
    low = site_tree(pages, url_col, html_col).filter((F.col("pages") >= least_pages) & (F.col("importance") < least))
    low = materialize(low.groupBy(F.col("host").alias("_site")).agg(F.sort_array(F.collect_set("node")).alias("low")), "low")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"), host_of(F.col(f"`{url_col}`")).alias("_host"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_html"),
    )
    met = rows.join(low, F.col("_host") == F.col("_site"), "left").select("_id", "_url", "_html", "low")
    out = met.mapInArrow(_extract, f"_id {dict(pages.dtypes)[id_col]}, _url string, text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
