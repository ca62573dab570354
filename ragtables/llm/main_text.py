"""Main text of pages: labels of leaf blocks by a conditional random field that learns from labelled pages."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm import crf
from ragtables.llm.dom import Block, leaf_blocks

#: Bound of the training sample: pages, chosen by a hash of the id, and layouts made of each.
TRAINING_PAGES, LAYOUTS = 120, 3
_OUTSIDE = {"tag:nav", "tag:footer", "tag:aside", "tag:form", "tag:menu", "tag:button", "tag:select", "tag:dialog", "tag:fieldset",
            "in:menu", "in:footer", "in:side", "in:related", "in:advert", "in:notice", "in:form", "in:comment", "in:hidden"}


def features(blocks: list[Block]) -> tuple[list[list[str]], list[int]]:
    """Names of the features of each block, and 1 where a block has the same parent's depth as the one before."""
    out, kinds = [], []
    for i, block in enumerate(blocks):
        words = block.text.count(" ") + 1
        names = ["any", *block.around, f"words:{min(6, words.bit_length())}", f"linked:{round(block.linked * 3)}"]
        if block.text[-1] in ".!?…。\"”»":
            names.append("sentence")
        if block.text.startswith("©") or "copyright" in block.text[:60].lower():
            names.append("copyright")
        if any(n in block.around for n in ("tag:article", "tag:main", "in:content")) and not block.around & _OUTSIDE:
            names += ["inside", f"inside:{int('tag:article' in block.around)}"]
        if block.around & _OUTSIDE:
            names.append("outside")
        if i == 0:
            names.append("first")
        if i == len(blocks) - 1:
            names.append("last")
        out.append(names)
        kinds.append(int(i > 0 and block.around == blocks[i - 1].around))
    return out, kinds


def known_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article with the article or main element; None for other pages."""
    if not any(b.around & {"tag:article", "tag:main"} for b in blocks):
        return None
    return [int(bool(b.around & {"tag:article", "tag:main"}) and not b.around & _OUTSIDE) for b in blocks]


def _layout(article: list[str], other: list[str], rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page of the given texts in a layout drawn at random, with the label of each of its blocks."""
    parts: list[str] = []
    labels: list[int] = []

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def put(open_tag: str, texts: list[str], close: str, label: int, each: str = "p", link: bool = False):
        parts.append(open_tag)
        for text in texts:
            inner = html.escape(text)
            parts.append(f"<{each}>" + (f'<a href="/x">{inner}</a>' if link else inner) + f"</{each}>")
            labels.append(label)
        parts.append(close)

    def short(n: int) -> list[str]:
        words = [w for t in other for w in t.split()] or ["home", "about", "news"]
        return [" ".join(pick(words) for _ in range(int(rng.integers(1, 4)))) for _ in range(n)]

    def sentences() -> list[str]:
        pool = (other + article) or ["Some words."]
        return [pick(pool) for _ in range(int(rng.integers(1, 4)))]

    def boilerplate(kind: str):
        if kind == "menu":
            name = pick(['<nav>', '<nav class="main-nav">', '<div class="menu">', '<ul class="navigation">', '<div id="breadcrumbs">', '<div role="navigation">'])
            put(name, short(int(rng.integers(2, 7))), f"</{name[1:].split()[0].rstrip('>')}>", 0, "li", True)
        elif kind == "header":
            name = pick(["<header>", '<header class="site-header">', '<div class="header">', '<div id="masthead">', '<div role="banner">'])
            put(name, short(2), f"</{name[1:].split()[0].rstrip('>')}>", 0, pick(["p", "div", "h2"]), bool(rng.integers(2)))
        elif kind == "footer":
            name = pick(["<footer>", '<footer class="site-footer">', '<div class="footer">', '<div id="footer">', '<div role="contentinfo">'])
            put(name, ["© " + pick(sentences())] + sentences()[:1], f"</{name[1:].split()[0].rstrip('>')}>", 0, pick(["p", "div"]))
        elif kind == "side":
            name = pick(["<aside>", '<div class="sidebar">', '<aside class="widget">', '<div id="right-rail">', '<div class="related">', '<section class="recommended">'])
            put(name, sentences() + short(2), f"</{name[1:].split()[0].rstrip('>')}>", 0, pick(["li", "p", "h3"]), bool(rng.integers(2)))
        elif kind == "advert":
            put(pick(['<div class="ad">', '<div class="ad-slot">', '<div class="advertisement">', '<div class="sponsored">', '<div id="ads">', '<div class="promo">']),
                sentences()[:2], "</div>", 0, pick(["p", "span", "div"]) if rng.integers(2) else "div")
        elif kind == "notice":
            put(pick(['<div class="cookie-banner">', '<div class="notice">', '<div id="newsletter">', '<div class="alert">', '<div class="modal popup">', '<div class="consent">']),
                sentences()[:2], "</div>", 0)
        elif kind == "form":
            put(pick(['<form>', '<form class="search">', '<form id="login">']), short(2), "</form>", 0, pick(["div", "p", "button"]))
        else:
            name = pick(['<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<section id="disqus_thread">', '<div class="replies">'])
            parts.append(name)
            for _ in range(int(rng.integers(1, 4))):
                one = pick(['<div class="comment">', "<div>", "<article>", '<li class="comment">'])
                put(one, sentences()[:2], f"</{one[1:].split()[0].rstrip('>')}>", 0)
            parts.append(f"</{name[1:].split()[0].rstrip('>')}>")

    before, inner, after = (["menu", "header", "advert", "notice", "form"], ["advert", "notice", "side", "form", "comment"],
                            ["side", "comment", "footer", "advert", "form", "menu"])
    parts.append("<html><body>")
    for kind in rng.permutation(before)[: int(rng.integers(1, 4))]:
        boilerplate(str(kind))
    name = pick(["<article>", "<main>", '<div class="post-content">', '<div id="content">', '<div role="main">', '<section class="entry">',
                 '<article class="post">', "<main><article>", '<div class="story-body">'])
    parts.append(name)
    title, *body = article or ["Title"]
    put("", [title], "", 1, pick(["h1", "h2"]))
    cut = int(rng.integers(0, len(body) + 1))
    put("", body[:cut], "", 1, pick(["p", "p", "p", "div"]))
    if rng.integers(2):
        boilerplate(pick(inner))
    for text in body[cut:]:
        put("", [text], "", 1, pick(["p", "p", "p", "li", "blockquote", "h2", "pre"]))
    if rng.integers(3) == 0:
        boilerplate("comment")
    parts.append("".join(f"</{t.split()[0].rstrip('>')}>" for t in reversed(name[1:].split("<"))))
    for kind in rng.permutation(after)[: int(rng.integers(1, 4))]:
        boilerplate(str(kind))
    parts.append("</body></html>")
    return "".join(parts), labels


def labelled_pages(pages: list[str], layouts: int = LAYOUTS, seed: int = 5) -> list[tuple[list[list[str]], list[int], list[int]]]:
    """Training chains: pages that mark their article, and their texts in ``layouts`` other layouts each."""
    rng = np.random.default_rng(seed)
    chains = []
    for page in pages:
        blocks = leaf_blocks(page)
        labels = known_labels(blocks)
        if labels is None or not any(labels):
            continue
        chains.append((*features(blocks), labels))
        article = [b.text for b, y in zip(blocks, labels, strict=True) if y][:40]
        other = [b.text for b, y in zip(blocks, labels, strict=True) if not y]
        for _ in range(layouts):
            made, expected = _layout(article, other, rng)
            found = leaf_blocks(made)
            if len(found) == len(expected):
                chains.append((*features(found), expected))
    return chains


def _train(layouts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = [p for batch in batches for p in pc.fill_null(batch.column("html"), "").to_pylist()]
        yield pa.record_batch([pa.array([crf.train(labelled_pages(pages, layouts)).to_json()])], names=["model"])

    return run


def train(pages: DataFrame, sample: int = TRAINING_PAGES, layouts: int = LAYOUTS) -> crf.Chain:
    """Fit on at most ``sample`` pages that mark their article, chosen by a hash of the id; one task, a model of fixed size."""
    marked = pages.select("page_id", "html").filter(r"html rlike '(?i)<(article|main)[\\s>]'")
    chosen = marked.orderBy(F.xxhash64("page_id"), "page_id").limit(sample).select("html").coalesce(1)
    rows = chosen.mapInArrow(_train(layouts), "model string").collect()
    return crf.Chain.from_json(rows[0]["model"]) if rows else crf.Chain()


def main_text(page: str, model: crf.Chain) -> str:
    """Texts of the blocks that the model labels as article, joined by an empty line."""
    blocks = leaf_blocks(page)
    if not model.index:
        labels = [int(not b.around & _OUTSIDE) for b in blocks]
    else:
        labels = model.decode(*features(blocks))
    return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def _extract(model: crf.Chain):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [main_text(page or "", model) for page in part.column("html").to_pylist()]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                       pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return extract


def extract_pages(pages: DataFrame, model: crf.Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null, empty and textless pages have an empty text. Without a model one is trained on a sample of the pages; if none
    of them marks its article, blocks are judged by the elements around them alone. Rows are kept as they are, repeated
    and without id too; other columns are ignored. Whatever a page holds, reading it takes one step per tag.
    """
    model = train(pages) if model is None else model
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
