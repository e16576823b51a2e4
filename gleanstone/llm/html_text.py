"""Main text of pages: structure first, then a suffix array over each host's pages.

A page is cut into blocks by its block elements. Scripts, styles and the like are never text. Blocks in an article are main text,
without the menus, forms, adverts, notices, comments and so on inside it, which elements, roles, classes and ids tell. Blocks outside that these signs rule out are not.

What structure says is weighed against the host's other pages. Every page goes through it: the streams of what is outside the articles, ruled out or not, are joined for up to `pages_each` pages of a host, a mark of its own after each
page, and sorted into a suffix array by prefix doubling. Runs of `run` tokens or more that repeat on at least `least` distinct pages of the host are boilerplate.
Undecided blocks (outside an article, or on a page without one, and not ruled out) that such runs cover go, as do stretches of `run` covered tokens inside a block; unique runs stay. Blocks that are ruled out stay out, and what they say
is evidence against their copies elsewhere. n_repeated counts all tokens in such runs. Inside an article structure decides: an article's own lines stand in adverts and footers, too, and its text is wanted whole.

A host's pages are dealt to groups of bounded size, so a host with a third of all pages is many groups. For such hosts a pass before counts the distinct pages of each run over the whole host, by a hash of its tokens; each
group gets the runs that are on enough of them.

Defined results: null and empty html give an empty text; tags that never close end with the page; a tag whose quotes never close ends at its first `>`, and without one its `<` is text; repeated rows get rows each, and count as one page
(by id); a null url is a host of its own; an empty table gives an empty result; only page_id, url and html are read. Work is linear in a page's length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import mixed
from .storage import given_id, held_id, parts, small_batches, written

#: Elements whose content is no text.
RAW = frozenset("script style noscript template iframe textarea select svg object title button".split())
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"(?:^|(?<=[\s\"']))(class|id|role|hidden|aria-hidden)(?![^\s=/])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("nav footer aside form head menu dialog fieldset".split())
#: Words that rule a block out as any part of a class or id,
OUT_PARTS = frozenset(
    "advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal sidebar navbar navigation breadcrumb breadcrumbs masthead comment comments disqus related sharing newsletter subscribe subscription pagination".split()
)
#: and those that do so as the whole of it, or as its last part behind a word that does not stand for the text itself.
OUT_WORDS = frozenset("ad ads promotion banner notice notices alert overlay side menu nav header footer replies share social widget toolbar pager login signup search".split())
TEXT_WORDS = frozenset("article post entry story content main page section chapter text".split())
AD_PLACES = frozenset("slot box unit banner container wrapper space block label top bottom left right".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

ARTICLE, MAIN, OTHER, RULED_OUT = range(4)


#: Words behind `share` and `social` that speak of buttons and not of the text's matter.
WIDGETS = frozenset("bar box button buttons icon icons item items link links list media menu row this tools widget widgets".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def out_by_name(value: str, strict: bool = False) -> bool:
    """Whether a class or id says that its block is not main text. strict: only if its last part or the whole of it does, not any part."""
    for token in value.split():
        parts = [p for p in re.split(r"[^a-z0-9]+", token) if p]
        if not parts:
            continue
        if (parts[0] in ("ad", "ads") and parts[1:2] and parts[1] in AD_PLACES) or (parts[-1] in OUT_WORDS and (len(parts) == 1 or parts[0] not in TEXT_WORDS)):
            return True
        if parts[-1] in OUT_PARTS if strict else not OUT_PARTS.isdisjoint(parts):
            return True
        if len(parts) > 1 and (parts[0] in ("nav", "menu", "footer", "banner") or parts[0] in ("social", "share") and parts[1] in WIDGETS):
            return True
    return False


def _ruled_out(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's name, role, class or id tells that it is no main text. Inside an article an id may name a place in the text, and a heading its matter: those are judged strictly."""
    if name in OUT or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    for kind, a, b, c in ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), (a or b or c).lower()
        if kind in ("class", "id") and out_by_name(value, inside and (kind == "id" or name in HEADINGS)):
            return True
        if kind == "role" and value in OUT_ROLES or kind == "hidden" or kind == "aria-hidden" and value == "true":
            return True
    return False


def markup(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each piece of markup in page order: a closing tag's name has a slash, comments and the like have no name, a raw element is one piece.

    Linear: quotes that were once found to run past the end of the page are not followed again.
    """
    lost: set[int] = set()  # where quotes open from which no tag's end is reached
    find, at, closers = page.find, 0, {}
    while (start := find("<", at)) >= 0:
        name = NAME.match(page, start + 1)
        if not name:
            if page.startswith("<!--", start):
                stop = find("-->", start + 4)
                at = len(page) if stop < 0 else stop + 3
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                stop = find(">", start)
                if stop < 0:
                    return
                at = stop + 1
            else:
                at = start + 1
                continue
            yield start, at, "", ""
            continue
        opened, i = [], name.end()
        while True:
            i = PLAIN.match(page, i).end()
            if i >= len(page) or page[i] == ">":
                break
            close = -1 if i in lost else find(page[i], i + 1)
            opened.append(i)
            if close < 0:
                i = len(page)
                break
            i = close + 1
        if i >= len(page):
            lost.update(opened)
            i = find(">", name.end())
            if i < 0:
                return
        word = name[0].lower()
        at = i + 1
        if word in RAW:
            if word not in closers:
                closers[word] = re.compile(rf"</{word}\s*>", re.I)
            end = closers[word].search(page, at)
            at = end.end() if end else len(page)
            yield start, at, "", ""
        else:
            yield start, at, word, page[name.end() : i]


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block with text, in page order; white space is one space, character references are decoded."""
    out: list[tuple[int, str]] = []
    waiting: list[str] = []
    article = main = depth = within = lists = 0
    skipped = ""

    def flush() -> None:
        if waiting:
            text = " ".join(entities.unescape("".join(waiting)).split())
            if text:
                out.append((RULED_OUT if skipped else ARTICLE if article else MAIN if main else OTHER, text))
            waiting.clear()

    at = 0
    page = page or ""
    for start, stop, name, attributes in markup(page):
        if start > at:
            waiting.append(page[at:start])
        at = stop
        if not name:
            continue
        closing = name[0] == "/"
        name = name[1:] if closing else name
        if name == "br":
            waiting.append("\n")
        block = name in BLOCKS
        if block:
            flush()
        if skipped and closing and not within and (name == "article" and article or name == "main" and main):
            skipped = ""  # what was never closed ends with the article around it
        elif skipped:
            within += (name in ("article", "main")) * (-1 if closing else 1)
            of_list = name in ("ul", "ol", "menu")
            if skipped == "p" and block or skipped == "li" and not lists and (name == "li" or of_list and closing):
                skipped = ""  # a paragraph ends where a block begins, an item where the next one does or its list ends
                if closing:
                    continue
            elif skipped == "li":
                lists += of_list * (-1 if closing else 1)
                continue
            elif name == skipped:
                depth += -1 if closing else name not in VOID
                if depth <= 0:
                    flush()
                    skipped = ""
                continue
            else:
                continue
        if closing:
            article -= name == "article" and article > 0
            main -= name == "main" and main > 0
        elif name not in VOID and _ruled_out(name, attributes, bool(article or main)):
            flush()
            skipped, depth, within, lists = name, 1, 0, 0
        else:
            article += name == "article"
            main += name == "main"
    if at < len(page):
        waiting.append(page[at:])
    flush()
    return out


def suffix_array(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each position the class of the `least` tokens from it (a power of two): equal runs, equal class.

    Prefix doubling: the order by 2 * h tokens comes from the ranks by h tokens.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width, classes = 1, rank if least == 1 else None
    order = np.argsort(rank, kind="stable")
    while width < n:
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:]
        order = np.lexsort((second, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        nxt = np.empty(n, np.int64)
        nxt[order] = np.cumsum(new) - 1
        rank, width = nxt, 2 * width
        if width == least:
            classes = rank
        if rank.max(initial=0) == n - 1:
            break
    return order, classes if classes is not None else rank


def token_keys(streams: list[list[str]]) -> list[np.ndarray]:
    """A 64-bit hash of each token."""
    keys = {t: int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t in {t for s in streams for t in s}}
    return [np.array([keys[t] for t in s], np.uint64) for s in streams]


def run_keys(h: np.ndarray, run: int) -> np.ndarray:
    """A hash of the `run` tokens from each position that has so many."""
    n = max(len(h) - run + 1, 0)
    acc = h[:n].copy()
    for j in range(1, run):
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return acc.astype(np.int64)


def covered(streams: list[list[str]], run: int, pages: list, least: int = 3, known: np.ndarray | None = None) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of `run` or more tokens that repeats on `least` distinct pages or has a key in known."""
    sizes = np.array([len(s) for s in streams])
    names: dict[str, int] = {}
    ids = [names.setdefault(t, len(names)) for s in streams for t in s]
    number = {p: k for k, p in enumerate(dict.fromkeys(pages))}
    masks = [np.zeros(n, bool) for n in sizes]
    if (len(number) < least and known is None) or not ids:
        return masks
    place = np.arange(len(ids)) + np.repeat(np.arange(len(streams)), sizes)
    text = np.empty(len(ids) + len(streams), np.int64)
    text[np.cumsum(sizes + 1) - 1] = len(names) + np.arange(len(streams))  # a mark of its own behind each page
    text[place] = ids
    owner = np.repeat([number[p] for p in pages], sizes + 1)
    order, classes = suffix_array(text, run)
    same = classes[order]
    first = np.flatnonzero(np.diff(same, prepend=-1))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(same))))
    seen = np.unique(group * len(number) + owner[order]) // len(number)
    often = np.bincount(seen, minlength=len(first)) >= least
    starts = order[often[group]]
    if known is not None:
        begins = np.cumsum(sizes + 1) - sizes - 1
        there = [b + np.flatnonzero(np.isin(run_keys(h, run), known)) for b, h in zip(begins, token_keys(streams))]
        starts = np.union1d(starts, np.concatenate(there)).astype(np.int64)
    delta = np.zeros(len(text) + run + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + run, -1)
    hit = np.cumsum(delta)[: len(text)] > 0
    lo = 0
    for k, n in enumerate(sizes.tolist()):
        masks[k] = hit[lo : lo + n]
        lo += n + 1
    return masks


def own_runs(mask: np.ndarray, run: int) -> np.ndarray:
    """Of a block's covered tokens, those that cover it whole or in a stretch of `run` or more; fewer at an edge belong to a run of the next block."""
    if mask.all() or not mask.any():
        return mask
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    out = np.zeros(len(mask), bool)
    for lo, hi in zip(edges[::2], edges[1::2]):
        out[lo:hi] = hi - lo >= run
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


MANY_HOSTS = 100_000


def main_texts(pages: DataFrame, run: int = 8, least: int = 3, pages_each: int = 512) -> DataFrame:
    """page_id, url, text, n_chars, n_undecided, n_covered, n_repeated for every row of pages (page_id, url, html).

    n_undecided: tokens that structure neither takes as text nor rules out, n_covered: those of them that the host's boilerplate runs took away. n_repeated: all tokens outside of articles in such runs. run must be a power of two.
    """
    if run < 1 or run & (run - 1):
        raise ValueError("run must be a power of two")
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(held_id("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    undecided = (MAIN, OTHER)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.page_id, r.url, r.host, r.u, blocks) for r in batch.itertuples(index=False) for blocks in [page_blocks(r.html)]]
            rows = [(*r, [k for k, _ in blocks], [t for _, t in blocks]) for *r, blocks in out]
            yield pd.DataFrame(rows, columns=["page_id", "url", "host", "u", "kinds", "blocks"])

    shape = "page_id long, url string, text string, n_chars long, n_undecided long, n_covered long, n_repeated long"
    named = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), F.monotonically_increasing_id().alias("u"), "html")  # u tells equal rows apart
    groups = written(named.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / pages_each).alias("groups")), "html-hosts")  # of addresses alone
    if groups.count() <= MANY_HOSTS:  # a few MB; beyond that the join shuffles
        groups = F.broadcast(groups)
    grouped = named.join(groups, "host")
    columns = "page_id long, url string, host string, u long, kinds array<int>, blocks array<string>"
    dealt = grouped.select("page_id", "url", "host", "u", "html").mapInPandas(parse, columns).join(groups, "host").withColumn("_g", F.pmod(F.xxhash64("page_id", "url", "u"), F.col("groups"))).drop("u", "groups")
    many = grouped.filter("groups > 1").select("page_id", "url", "host", "u", "html").mapInPandas(parse, columns)  # parsed again rather than kept: a copy of all text costs more disk than time

    def streams_of(pdf: pd.DataFrame) -> list[list[str]]:
        return [[w for k, t in zip(kinds, blocks) if k != ARTICLE for w in t.split()] for kinds, blocks in zip(pdf["kinds"], pdf["blocks"])]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [np.unique(run_keys(h, run)) for h in token_keys(streams_of(batch))]
            sizes = [len(x) for x in keys]
            part = pd.DataFrame({"host": np.repeat(batch["host"].to_numpy(), sizes), "page_id": np.repeat(batch["page_id"].to_numpy(), sizes), "key": np.concatenate(keys)})
            part = part.drop_duplicates()
            yield part[part.groupby(["host", "key"]).cumcount() < least]  # so many pages of a batch decide

    # Repartitioned once by run: the pages of a run are counted where they are.
    found = many.select("host", "page_id", "kinds", "blocks").mapInPandas(runs, "host string, page_id long, key long")
    found = found.select(F.xxhash64("host").alias("h"), "key", "page_id").repartition(parts(spark), "h", "key").distinct()
    often = written(found.groupBy("h", "key").count().filter(F.col("count") >= least).select("h", "key"), "html-runs")
    each = groups.filter("groups > 1").select("host", F.xxhash64("host").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("_g"))
    known = often.join(each, "h").select("host", "_g", "key")

    def clean(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        streams = streams_of(pdf)
        masks = covered(streams, run, pdf["page_id"].tolist(), least, known["key"].to_numpy(np.int64) if len(known) else None)
        texts, sizes, hits = [], [], []
        for kinds, blocks, stream, mask in zip(pdf["kinds"], pdf["blocks"], streams, masks):
            at, kept, size, hit = 0, [], 0, 0
            for kind, block in zip(kinds, blocks):
                if kind == ARTICLE:
                    kept.append(block)
                    continue
                n = len(block.split())
                if kind in undecided:
                    gone = own_runs(mask[at : at + n], run)
                    kept.append(" ".join(w for w, out in zip(stream[at : at + n], gone) if not out))
                    size, hit = size + n, hit + int(gone.sum())
                at += n
            texts.append("\n".join(k for k in kept if k))
            sizes.append(size)
            hits.append(hit)
        out = {"page_id": pdf["page_id"].tolist(), "url": pdf["url"].tolist(), "text": texts, "n_chars": [len(t) for t in texts], "n_undecided": sizes, "n_covered": hits, "n_repeated": [int(m.sum()) for m in masks]}
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})  # a group may be without pages

    cleaned = dealt.groupBy("host", "_g").cogroup(known.groupBy("host", "_g")).applyInPandas(clean, shape)
    return cleaned.withColumn("page_id", given_id("page_id"))
