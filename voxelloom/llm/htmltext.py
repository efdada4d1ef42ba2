"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of blocks, each with the path of structural tags above it (a tag is its name and
class or id words). Runs of one path fold into repeated terms, and runs that recur in tandem (periods of
two to four) into repeated groups of terms. Wrappers are inferred per host from all its pages, as
distinct streams of terms with the number of distinct pages (by title) that have them: the commonest
stream is the wrapper, and every next one is aligned with it. A mismatch is resolved into a repeated group
where the terms on one side repeat those on the other, and into optional groups elsewhere. A text that
``FIXED_PAGES`` pages and ``FIXED_SHARE`` of those with its term have is part of the template, every other
one fills a slot. Terms are then labelled with the evidence of all pages: menus, headers, footers,
sidebars, notices, adverts, forms and comments by tags and class words, the article by its tag or by
being the container of most of the slots' text.

Every page is aligned with its host's wrapper, which alone decides: the blocks of article terms are kept,
whole and in order. Nothing inside an article goes for being template text, or a link: only a run of two
or more blocks that are all links, where the wrapper has mostly links too, is a menu; and where no tag or
class names the article, a template text with words of a notice (``NOTICE``), and text directly in an
element beside the article's own that merely shares its path. Blocks that the alignment leaves over take
the label that the wrapper has for their path; paths it does not know are no article.

Streams of a host are merged in groups of ``FAN_IN``, and the wrappers of the groups again, so that a
host with very many layouts is no single group. Html meets the wrappers by host: as a broadcast while
Spark finds them small, else by a join whose skewed hosts AQE splits.

Edge cases: null, empty and blank html give empty text; pages without a host share one wrapper; a host
with one page has all its texts as slots; repeated rows are read each; an empty table gives an empty
result; html is read whole, unclosed elements, comments and scripts to where a browser would close
them; other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.urlfilter import host_path
from voxelloom.session import ship, written

#: Distinct pages, and the share of those with its term, that make a text part of the template.
FIXED_PAGES = 3
FIXED_SHARE = 0.5
MAX_PERIOD = 4
#: Streams or wrappers of one host that one group merges.
FAN_IN = 512

# Elements of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OUTSIDE = frozenset("head nav footer aside form button select option textarea menu dialog script style noscript iframe template object svg canvas".split())
#: Class and id words of what is not the article.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar sidenav aside footer foot header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert disclaimer comment comments reply replies respond response discussion disqus social share sharing related recommended recommendations "
    "breadcrumb breadcrumbs newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager paywall copyright legal search form skip".split()
)
ARTICLE = frozenset(("article", "main"))
#: Words that are headers of the page, or of the article itself where they stand in it.
HEAD_WORDS = frozenset("header head masthead".split())
#: First words of classes that tell of something else on the page ("no-sidebar").
OTHERS = frozenset("no has with without".split())
ARTICLE_WORDS = frozenset("article post entry story content body text main prose".split())

#: Words of notices, which tell only where a text is part of a template and nothing names the article.
NOTICE = re.compile(r"©|copyright|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign (?:in|up)|log ?in\b|advertis|sponsored", re.I)
#: Share of a container's text below which text directly in it counts as text of elements beside the article.
DIRECT = 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _tag(name: str, attrs: str) -> str:
    """A tag's signature: name, then class, id and role words without digits."""
    words = []
    if "=" in attrs:
        for _, a, b, c in _ATTR.findall(attrs):
            for token in (a or b or c).lower().split():
                own = re.findall(r"[a-z]+", token)
                words += own if own[:1] and own[0] not in OTHERS else []
    return ".".join([name, *dict.fromkeys(words)])


Block = tuple[str, str, int, tuple[int, ...]]


def blocks(page: str) -> list[Block]:
    """(path, text, linked characters, where the elements of the path begin) of every block with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush():
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            out.append(("/".join(s for _, s, _ in stack), text, sum(len(t) for t, linked in parts if linked), tuple(a for _, _, a in stack)))
        parts.clear()

    def close(names) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                return

    def say(raw: str) -> None:
        if raw:
            parts.append((entities.unescape(raw), links > 0))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE:
                flush()
                close((name,))
            continue
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            inner = page[at : end.start() if end else n]
            at = end.start() if end else n
            flush()
            stack.append((name, _tag(name, m[3]), m.start()))
            if name == "title":
                say(inner)
            flush()
            stack.pop()
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        if name == "a":
            links = 1  # a new link ends one that was left open
            continue
        if name in INLINE or name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        links = 0
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        elif name == "li" and stack and stack[-1][0] in ("li", "p"):
            close(("li",))
        elif name in ("td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] in ("td", "th", "dt", "dd", "option"):
            stack.pop()
        if not m[3].rstrip().endswith("/"):
            stack.append((name, _tag(name, m[3]), m.start()))
    flush()
    return out


def fold(paths: list[str]) -> list[tuple[tuple[str, ...], int, int, bool]]:
    """Terms of a stream: (group of paths, first block, number of blocks, whether repeated)."""
    runs: list[list] = []
    for i, p in enumerate(paths):
        if runs and runs[-1][0] == p:
            runs[-1][2] += 1
        else:
            runs.append([p, i, 1])
    names, out, i = [r[0] for r in runs], [], 0
    while i < len(names):
        best = (1, 1)
        for period in range(2, MAX_PERIOD + 1):
            group, k = names[i : i + period], 1
            while len(group) == period and names[i + k * period : i + (k + 1) * period] == group:
                k += 1
            if k > 1 and k * period > best[0] * best[1]:
                best = (period, k)
        part = runs[i : i + best[0] * best[1]]
        n = sum(r[2] for r in part)
        out.append((tuple(names[i : i + best[0]]), part[0][1], n, n > best[0]))
        i += len(part)
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def page_terms(page: list[Block]) -> list[dict]:
    """The terms of one page as a wrapper holds them; texts: pages that have each text's hash in the term."""
    out = []
    for group, i, k, repeated in fold([b[0] for b in page]):
        part = page[i : i + k]
        out.append({"group": group, "repeated": repeated, "seen": 1, "texts": Counter({_hash(b[1]): 1 for b in part}), "size": sum(len(b[1]) for b in part), "linked": sum(b[2] for b in part)})
    return out


class Wrapper:
    """Terms in order: group, repeated, pages seen in, pages by text, sizes of text and links."""

    def __init__(self):
        self.terms: list[dict] = []
        self.pages = 0

    def add(self, page: list[Block]) -> None:
        """Aligns one more page and resolves the mismatches."""
        self.merge(page_terms(page), 1)

    def merge(self, new: list[dict], pages: int) -> None:
        """Aligns the summed terms of so many pages of one stream."""
        self.pages += pages
        merged: list[dict] = []
        for kind, a, b, c, d in _aligned([t["group"] for t in self.terms], [t["group"] for t in new]):
            old, add = self.terms[a:b], new[c:d]
            if kind == "equal":
                merged += [_summed([x, y], x["group"], x["repeated"] or y["repeated"]) for x, y in zip(old, add)]
            elif group := _repeats([t["group"] for t in old], [t["group"] for t in add]):
                merged.append(_summed([*old, *add], group, True))
            else:
                merged += old + add  # optional: seen in fewer pages than there are
        self.terms = merged

    def state(self) -> str:
        return json.dumps([self.pages, [{**t, "texts": list(t["texts"].items())} for t in self.terms]])

    @staticmethod
    def parts(state: str) -> tuple[list[dict], int]:
        """What :meth:`merge` takes, of a wrapper's state."""
        pages, terms = json.loads(state)
        return [{**t, "group": tuple(t["group"]), "texts": Counter(dict(map(tuple, t["texts"])))} for t in terms], pages

    def expression(self) -> str:
        """The wrapper as a regular expression over groups, for people."""
        return " ".join(f"({' '.join(t['group'])})" + "+" * t["repeated"] + "?" * (t["seen"] < self.pages) + ("=const" if max(t["texts"].values(), default=0) == t["seen"] > 1 else "=#") for t in self.terms)

    def labels(self) -> dict:
        """What reading a page needs: every term's group, the label of each of its paths (article or not), template
        texts and whether it is mostly links; the label of each path where most of its text has it; and, where
        nothing names the article, its container (``root``)."""
        size, linked = Counter(), Counter()
        for t in self.terms:
            for p in t["group"]:
                size[p] += t["size"] / len(t["group"])
                linked[p] += t["linked"] / len(t["group"])
        fixed = [sorted(h for h, n in t["texts"].items() if n >= max(FIXED_PAGES, FIXED_SHARE * t["seen"])) for t in self.terms]
        open_ = {p for p in size if not outside(p)}
        article, root = {p for p in open_ if in_article(p)}, ""
        named = bool(article)
        if not article and open_:
            plain = {p for p in open_ if linked[p] <= 0.5 * size[p] or _is_title(p)}
            root = self._root(plain or open_, fixed)
            article = {p for p in open_ if not root or p == root or p.startswith(root + "/")} or open_
            if size[root] >= DIRECT * sum(size[p] for p in article):
                root = ""  # the article's own text lies directly in it
        terms, by_path = [], Counter()
        for t, f in zip(self.terms, fixed):
            keep = [p in article for p in t["group"]]
            terms.append([t["group"], keep, [] if named else f, t["linked"] > 0.5 * t["size"] and not any(map(_is_title, t["group"]))])
            for p, k in zip(t["group"], keep):
                by_path[p] += t["size"] if k else -t["size"]
        return {"terms": terms, "paths": {p: n > 0 for p, n in by_path.items()}, "root": root}

    def _root(self, open_: set[str], fixed: list) -> str:
        """The deepest container of most of the slots' text."""
        variable = Counter()
        for t, f in zip(self.terms, fixed):
            if not f or t["repeated"]:
                for p in t["group"]:
                    if p in open_:
                        variable[p] += t["size"] / len(t["group"])
        total, depth = sum(variable.values()), Counter()
        for p, n in variable.items():
            steps = p.split("/")
            for i in range(1, len(steps) + 1):
                depth["/".join(steps[:i])] += n
        most = [p for p, n in depth.items() if n >= 0.6 * total]
        root = max(most, key=lambda p: (p.count("/"), p), default="")
        # The container of the paragraphs, not the paragraphs.
        return root.rpartition("/")[0] if re.match(r"(p|h\d|li|td|blockquote|pre)\b", root.rsplit("/", 1)[-1]) else root


def _aligned(old: list, new: list):
    return SequenceMatcher(None, old, new, autojunk=False).get_opcodes()


def _repeats(old: list[tuple], new: list[tuple]) -> tuple | None:
    """The group that both sides of a mismatch repeat, some number of times, where one of them is that group."""
    for one, other in ((old, new), (new, old)):
        if len(one) == 1 and other:
            group, flat = one[0], [p for g in other for p in g]
            if len(flat) % len(group) == 0 and flat == [*group] * (len(flat) // len(group)):
                return group
    return None


def _summed(terms: list[dict], group: tuple, repeated: bool) -> dict:
    """Terms of the same blocks as one. Sides of a mismatch come in several terms, each seen by the same pages."""
    texts = Counter()
    for t in terms:
        texts.update(t["texts"])
    seen = sum({id(t): t["seen"] for t in (terms[0], terms[-1])}.values())
    return {"group": group, "repeated": repeated, "seen": seen, "texts": texts, "size": sum(t["size"] for t in terms), "linked": sum(t["linked"] for t in terms)}


def _steps(path: str) -> list[list[str]]:
    return [s.split(".") for s in path.split("/")]


def _is_title(path: str) -> bool:
    return path.rsplit("/", 1)[-1].split(".")[0] == "h1"


@lru_cache(1 << 16)
def outside(path: str) -> bool:
    """Whether tags or class words tell that a block is no part of the article."""
    steps = _steps(path)
    last = max((i for i, (name, *_) in enumerate(steps) if name in ARTICLE), default=-1)
    inside = False
    for i, (name, *words) in enumerate(steps):
        if name in ("html", "body"):
            continue  # their classes tell of the whole page
        if name in OUTSIDE and not (name == "form" and i < last):  # a form around everything is none of its parts
            return True
        if not inside and (name == "header" or HEAD_WORDS.intersection(words)):
            return True
        if (OUTSIDE_WORDS - HEAD_WORDS).intersection(words):
            return True
        inside |= name in ARTICLE
    return False


@lru_cache(1 << 16)
def in_article(path: str) -> bool:
    return any(name in ARTICLE or (name in ("div", "section", "td") and ARTICLE_WORDS.intersection(words)) for name, *words in _steps(path))


@lru_cache(1 << 14)
def _known(old: tuple, new: tuple) -> list[int]:
    """The wrapper's term of each term of a page, -1 where it has none."""
    out = [-1] * len(new)
    for kind, a, b, c, d in _aligned(old, new):
        if kind == "equal":
            out[c:d] = range(a, a + d - c)
        elif b - a == 1 and _repeats([old[a]], list(new[c:d])):
            out[c:d] = [a] * (d - c)
    return out


def read(page: str, labels: dict) -> str:
    """The article's blocks of one page, by its wrapper: without one, none."""
    found = blocks(page)
    terms, paths, root, kept = labels["terms"], labels["paths"], labels["root"], []
    folded = fold([b[0] for b in found])
    known = _known(tuple(tuple(t[0]) for t in terms), tuple(g for g, *_ in folded))
    depth = root.count("/") + 1
    holders = {b[3][:depth] for b in found if root and b[0].startswith(root + "/")}  # elements that have blocks of their own below
    for (group, i, n, _), j in zip(folded, known):
        keep, fixed, links = (dict(zip(terms[j][0], terms[j][1])), terms[j][2], terms[j][3]) if j >= 0 else (paths, (), True)
        run = found[i : i + n]
        if links and n > 1 and all(b[2] > 0.5 * len(b[1]) for b in run) and not any(_is_title(p) for p in group):
            continue  # a menu
        for p, t, _, at in run:
            notice = fixed and NOTICE.search(t) and _hash(t) in fixed
            beside = root and p == root and at not in holders
            if keep.get(p) and not notice and not beside:
                kept.append(t)
    return "\n".join(kept)


def page_name(page: list[Block]) -> int:
    """What tells pages from copies of them: the title, else the longest text."""
    title = next((t for p, t, *_ in page if p.rsplit("/", 1)[-1].split(".")[0] in ("title", "h1")), None)
    return _hash(title if title is not None else max((b[1] for b in page), key=len, default=""))


_STREAM = "host string, page long, stream long, at int, text long, size long, linked long, repeated boolean, groups string"


def _streams(batches):
    """For each page a row of its stream, at -1, and a row for each text of each term."""
    names = [c.split()[0] for c in _STREAM.split(", ")]
    for batch in batches:
        out = []
        for host, page in zip(*(c.to_pylist() for c in batch.columns)):
            found = blocks(page)
            terms, h = page_terms(found), page_name(found)
            groups = json.dumps([t["group"] for t in terms])
            stream = _hash(groups)
            out.append((host, h, stream, -1, 0, 0, 0, False, groups))
            for at, t in enumerate(terms):
                for i, text in enumerate(t["texts"]):
                    out.append((host, h, stream, at, text, 0 if i else t["size"], 0 if i else t["linked"], t["repeated"], None))
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [()] * len(types), types)], names)


def _infer(rows: pd.DataFrame) -> pd.DataFrame:
    """A wrapper of some of a host's distinct streams, the commonest first."""
    w = Wrapper()
    heads = rows[rows["at"] < 0].sort_values(["n", "stream"], ascending=[False, True])
    parts = dict(iter(rows[rows["at"] >= 0].sort_values("at").groupby("stream")))
    for stream, groups, n in zip(heads["stream"], heads["groups"], heads["n"]):
        if stream in parts:
            part = parts[stream]
            new = [
                {"group": tuple(g), "repeated": bool(rep), "seen": int(n), "texts": Counter({int(x["text"]): int(x["n"]) for x in texts if x is not None}), "size": int(size), "linked": int(linked)}
                for g, rep, size, linked, texts in zip(json.loads(groups), part["repeated"], part["size"], part["linked"], part["texts"])
            ]
            w.merge(new, int(n))
    return _state(rows, w)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Wrappers of groups of a host's streams as one, that of most pages first."""
    w = Wrapper()
    for state in rows.sort_values(["pages", "part"], ascending=[False, True])["state"]:
        w.merge(*Wrapper.parts(state))
    return _state(rows, w)


def _state(rows: pd.DataFrame, w: Wrapper) -> pd.DataFrame:
    return pd.DataFrame({"host": rows["host"].iloc[:1], "part": rows["part"].iloc[:1], "pages": [w.pages], "state": [w.state()], "wrapper": [json.dumps(w.labels())]})


def wrappers(terms: DataFrame) -> DataFrame:
    """host, wrapper from the summed terms of all streams, in rounds of ``FAN_IN``."""
    schema = "host string, part long, pages long, state string, wrapper string"
    width = terms.where("at < 0").groupBy("host").agg(F.ceil(F.count("*") / FAN_IN).alias("width"))
    some = terms.join(width, "host").withColumn("part", F.pmod("stream", F.col("width")).cast("long"))
    now = written(some.groupBy("host", "part").applyInPandas(_infer, schema), "html-wrappers")
    while (most := now.agg(F.max("part")).first()[0]) and most > 0:
        now = written(now.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("host", "part").applyInPandas(_merge, schema), "html-wrappers")
    return written(now.select("host", "wrapper"), "html-wrappers")  # without the states, so that its size tells how it can be joined


_labels = lru_cache(4096)(json.loads)


def _read(batches):
    for batch in batches:
        found = [read(h or "", _labels(w)) if w else "" for h, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    ship(pages.sparkSession)
    host, _ = host_path(url)
    src = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    # Texts are counted by hash over all pages, copies of a page once; what reaches a host's groups is its distinct
    # streams and the texts that several of its pages have.
    rows = src.select("host", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_streams, _STREAM)
    own = [F.max(c).alias(c) for c in ("size", "linked", "repeated", "groups")]
    rows = rows.groupBy("host", "stream", "at", "text", "page").agg(*own)
    sums = [F.sum(c).alias(c) for c in ("size", "linked")] + [F.max(c).alias(c) for c in ("repeated", "groups")]
    by_text = written(rows.groupBy("host", "stream", "at", "text").agg(F.count("*").alias("n"), *sums), "html-texts")
    often = by_text.where("at >= 0").groupBy("host", "text").agg(F.sum("n").alias("m")).where(F.col("m") >= FIXED_PAGES).select("host", "text", F.lit(True).alias("often"))
    some = F.collect_list(F.when(F.col("often"), F.struct("text", "n"))).alias("texts")
    terms = by_text.join(often, ["host", "text"], "left").groupBy("host", "stream", "at").agg(F.max("n").alias("n"), *sums, some)
    return src.select("page_id", "url", "host", "html").join(wrappers(terms), "host", "left").mapInArrow(_read, "page_id long, url string, text string, n_chars long")
