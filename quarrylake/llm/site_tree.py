"""Main text of pages by site style trees.

The pages of a host are merged into one tree of element nodes: a node is the path
of labels (tag, classes, id) down to it, and its presentations are the rows of
children that pages give it, runs of one label taken together. Counted over the
host's pages, the entropy of its presentations is a node's importance, and a
text that k of the m pages of a leaf show has the importance 1 - log_m(k). On a
page, a branch's composite importance is its node's, discounted by depth, and the
mean of its children's. A branch whose own importance and all importances below
are low is noise and removed, as is one whose element or name tells that it is a
menu, a header, a footer, a form, a notice, an advert or the like. Where a page
declares its article, what lies outside is removed, and prose directly in it is
kept even if other pages share it: then it is the article that is shared.

Only counts leave the tasks: one per node and presentation and one per leaf and
text, added up before they are exchanged. A host's tree as it is used, its nodes
on MIN_PAGES pages or more and the texts on so many that they are noise, grows
with a small power of the host. Pages are exchanged once, to meet their host's
tree, which is read before them in sorted order; a host with more than its share
of the pages is dealt out with copies of its tree.

Defined cases: a null html is empty and gives the empty text; a page without an
url belongs to a host of its own name, the empty one; repeated pages are pages;
very long pages are read whole; other columns are left out, whatever their names;
an empty table gives an empty result; a page on a host of few pages is judged by
names, links and its declared article alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _common as C
from quarrylake.llm import markup

#: Importance below which a branch or a text is noise; pages from which a host's counts tell anything; pages from which a text is shared.
LEAST, MIN_PAGES, MIN_SHARED = 0.4, 5, 3
#: How much less a node's own presentations weigh with each level above the leaves.
DISCOUNT = 0.9
#: Pages of one host that are dealt to one task, at least.
HOST_PAGES = 1000
#: Hosts with more pages than one in so many are dealt out, besides; so there are at most as many such hosts.
HOST_SHARE = 100_000
#: Pages that one task reads, about.
TASK_PAGES = 5000
NO_ARTICLE = frozenset("head nav footer aside form dialog menu select fieldset search".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption li dd dt td th".split())
DECLARED = (frozenset(("articlebody",)), frozenset(("postcontent",)), frozenset(("entrycontent",)), frozenset(("articlecontent",)), frozenset(("storybody",)), frozenset(("postbody",)))

RESULT = "page_id long, url string, text string, n_chars long"


def host(url: Column) -> Column:
    """The host of an address in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    tree = site_trees(given)
    sizes = given.groupBy(F.xxhash64("host").alias("h")).count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    share = max(HOST_PAGES, total // HOST_SHARE)
    # At most HOST_SHARE hosts are that large.
    large = {r["h"]: -(-r["count"] // share) for r in sizes.where(F.col("count") > share).collect()}
    salts = spark.createDataFrame([(h, n) for h, n in large.items()], "lh long, n int")
    dealt = lambda df: df.join(F.broadcast(salts), F.col("h") == F.col("lh"), "left").withColumn("n", F.coalesce("n", F.lit(1))).drop("lh")
    # Rows of trees: a node with its pages and importance, or a text of a node that is noise.
    marks = dealt(tree).select("h", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(0).alias("page"), "key", "value", *(F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("host", "string"), ("html", "string"))))
    rows = dealt(given.withColumn("h", F.xxhash64("host"))).select(
        "h", F.pmod(F.xxhash64("html", "page_id"), F.col("n")).cast("int").alias("salt"), F.lit(1).alias("page"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), "page_id", "url", "host", "html"
    )
    parts = C.partitions_for(spark, total, TASK_PAGES)
    met = marks.unionByName(rows).repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "page")
    return met.mapInArrow(_texts, RESULT)


def site_trees(pages: DataFrame) -> DataFrame:
    """The trees of all hosts: (h, key, value) for each node (pages and importance) and each text that is noise there.

    ``h`` is the hash of the host, which is part of every key, too.
    """
    seen = pages.select(F.xxhash64("host").alias("h"), "host", "html").mapInArrow(_features, "h long, node long, value long, is_text boolean")
    counts = seen.groupBy("h", "node", "value", "is_text").agg(F.count("*").alias("n"))
    counts = C.spill(counts.where(~F.col("is_text") | (F.col("n") >= MIN_SHARED)), "site-counts")
    own = counts.where("not is_text").groupBy("h", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    own = own.where(F.col("m") >= MIN_PAGES)
    importance = F.greatest(F.lit(0.0), 1 - F.col("nlogn") / F.col("m") / F.log("m"))
    texts = counts.where("is_text").join(own.select("node", "m"), "node").select("h", F.col("value").alias("key"), (1 - F.log("n") / F.log("m")).alias("value")).where(F.col("value") < LEAST)
    return own.select("h", F.col("node").alias("key"), importance.alias("value")).unionByName(texts)


def _hash(*parts: object) -> int:
    """A signed 64-bit hash."""
    n = xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >= 1 << 63 else n


def keys(host: str, nodes: list[markup.Node]) -> list[int]:
    """Each node's place in its host's tree."""
    out: list[int] = []
    for n in nodes:
        out.append(_hash(host, "node") if n.parent < 0 else _hash(out[n.parent], n.label))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a page adds to its host's tree: the presentations of its nodes and the texts of its leaves, each once."""
    for batch in batches:
        hs, ns, vs, ts = [], [], [], []
        for h, host_name, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            nodes, blocks = markup.read(html)
            where = keys(host_name, nodes)
            rows = [["#"] for _ in nodes]
            for n in nodes[1:]:
                if rows[n.parent][-1] != n.label:
                    rows[n.parent].append(n.label)
            # A node that stands on a page more than once shows its presentations as one set.
            shown: dict[int, set] = {}
            for key, row in zip(where, rows, strict=True):
                shown.setdefault(key, set()).add(" ".join(row))
            found = [(key, _hash(key, *sorted(s)), False) for key, s in shown.items()]
            found += {(where[b.node], _hash(where[b.node], "text", b.text), True) for b in blocks}
            hs += [h] * len(found)
            ns += [f[0] for f in found]
            vs += [f[1] for f in found]
            ts += [f[2] for f in found]
        columns = pa.array(hs, pa.int64()), pa.array(ns, pa.int64()), pa.array(vs, pa.int64()), pa.array(ts, pa.bool_())
        yield pa.RecordBatch.from_arrays(list(columns), ["h", "node", "value", "is_text"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The main text of each page; the rows of its host's tree come before it."""
    tree: dict[int, float] = {}
    group = None
    for batch in batches:
        out: list[tuple] = []
        for h, salt, page, key, value, page_id, url, host_name, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (h, salt) != group:
                group, tree = (h, salt), {}
            if not page:
                tree[key] = value
            else:
                text = main_text(host_name, html, tree)
                out.append((page_id, url, text, len(text)))
        kinds = pa.int64(), pa.string(), pa.string(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["page_id", "url", "text", "n_chars"])


def main_text(host_name: str, html: str, tree: dict[int, float]) -> str:
    """The blocks of a page that are not noise by its host's tree, joined by empty lines."""
    nodes, blocks = markup.read(html)
    where = keys(host_name, nodes)
    article = _articles(nodes, blocks)
    inside = [False] * len(nodes)
    named = [False] * len(nodes)
    for k, n in enumerate(nodes):
        inside[k] = k in article or (k > 0 and inside[n.parent])
        named[k] = k not in article and ((k > 0 and named[n.parent]) or _named(n, inside[k]))
    noise = noisy(nodes, blocks, where, tree, named)
    kept = []
    for b in blocks:
        n = nodes[b.node]
        if named[b.node] or (article and not inside[b.node]):
            continue
        if inside[b.node] and (b.node in article or (n.parent in article and n.tag in PROSE)):
            kept.append(b.text)
        elif not noise[b.node] and not _low(b, where, tree) and (inside[b.node] or not (b.linked > 0.8 and n.tag not in PROSE - {"li", "td", "th"})):
            kept.append(b.text)
    return "\n\n".join(kept)


def _low(block: markup.Block, where: list[int], tree: dict[int, float]) -> bool:
    return _hash(where[block.node], "text", block.text) in tree


def noisy(nodes: list[markup.Node], blocks: list[markup.Block], where: list[int], tree: dict[int, float], named: list[bool]) -> list[bool]:
    """Whether each node lies in a branch that is noise: all importances in it are low."""
    sums, parts, loud, level = [0.0] * len(nodes), [0] * len(nodes), [False] * len(nodes), [0] * len(nodes)
    for b in blocks:
        value = 0.0 if named[b.node] else tree.get(_hash(where[b.node], "text", b.text), 1.0)
        sums[b.node] += value
        parts[b.node] += 1
        loud[b.node] |= value >= LEAST
    for k in range(len(nodes) - 1, -1, -1):
        own = 0.0 if named[k] else tree.get(where[k], 1.0)
        below = sums[k] / parts[k] if parts[k] else own
        weight = DISCOUNT ** level[k]
        composite = (1 - weight) * own + weight * below if level[k] else below
        loud[k] |= composite >= LEAST
        p = nodes[k].parent
        if p >= 0:
            sums[p] += composite
            parts[p] += 1
            loud[p] |= loud[k]
            level[p] = max(level[p], level[k] + 1)
    out = [False] * len(nodes)
    for k, n in enumerate(nodes):
        out[k] = not loud[k] or (k > 0 and out[n.parent])
    return out


def _named(node: markup.Node, inside: bool) -> bool:
    """Whether an element or its name says that it is no part of the article."""
    if node.hidden:
        return True
    if node.tag in ("#page", "html", "body", "main"):
        return False
    if node.tag in NO_ARTICLE or (node.tag == "header" and not inside):
        return True
    return not node.words.isdisjoint(markup.BOILERPLATE) or ("header" in node.words and not inside and node.tag not in PROSE)


def _articles(nodes: list[markup.Node], blocks: list[markup.Block]) -> set[int]:
    """The outermost elements that a page declares to be its article, or else its main part; none if it declares none or they are empty."""
    texts = [0] * len(nodes)
    for b in blocks:
        texts[b.node] += len(b.text)
    barred = [False] * len(nodes)
    for k, n in enumerate(nodes):
        barred[k] = k > 0 and (barred[n.parent] or n.tag in NO_ARTICLE - {"form"} or n.hidden or (n.tag not in ("html", "body", "main", "article") and not n.words.isdisjoint(markup.BOILERPLATE)))
    for k in range(len(nodes) - 1, 0, -1):
        if not barred[k]:
            texts[nodes[k].parent] += texts[k]
    ways = (
        lambda n: n.tag == "article" and n.words.isdisjoint(markup.BOILERPLATE),
        lambda n: any(d <= n.words for d in DECLARED),
        lambda n: n.tag == "main" or (n.tag not in ("html", "body") and n.words >= {"main"} and "role=main" in n.label),
    )
    for declares in ways:
        found: set[int] = set()
        under = [False] * len(nodes)
        for k, n in enumerate(nodes):
            under[k] = k > 0 and (under[n.parent] or n.parent in found)
            if k > 0 and not barred[k] and not under[k] and texts[k] and declares(n):
                found.add(k)
        if found:
            return found
    return set()
