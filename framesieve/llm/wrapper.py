"""Article text of web pages by wrapper induction.

Every page is parsed once into a tree of all its block elements; only scripts and other raw elements are left out.  Pages
of a host whose trees have the same kinds of text blocks share a layout.  One page of each layout is its reference; all
its pages are aligned with it by simple tree matching.  What stands at each node of the reference is counted over all of
them: nodes with one text on different pages are template, all others are slots.
The container of the article is the node under which most of the slots' text lies, text in links left out; content are its
slots that are no link lists, and blocks of a page that the reference lacks but that stand in the container.

Elements and names that never stand for an article (dom.APART and the lists beside it) only mark pieces of text.  A layout
of ENOUGH different pages ignores the marks: its wrapper comes from the alignment.  One of fewer pages cannot show what
varies, so its marked pieces are left out before induction.  Pages are different where their unmarked texts are.

Counts are per layout and node, summed before the shuffle; no group is gathered but one reference tree and its counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import stored
from .dom import BLOCK, HEADINGS, parse

#: Weight of a matched node; an equal text adds one.
NODE = 4096
#: As many different pages of a layout tell its template from its slots.
ENOUGH = 3
TEXTS = "page_id long, url string, text string"
TREE = "labels array<long>, parents array<int>, owners array<int>, keys array<long>, sizes array<int>, links array<int>, marks array<boolean>"
PAGES = "page_id long, url string, host string, layout long, whole long, texts array<string>, " + TREE
COUNTED = "host string, layout long, node int, text long, chars long, links long"
WRAPPER = "host string, layout long, keep array<int>, inside array<int>"


def host_of(url: str):
    """The host of a URL column; empty where there is none."""
    return F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))


def _key(text: str, seed: int = 0) -> int:
    return xxh64_intdigest(text.encode("utf-8", "replace"), seed) >> 1


# -- trees -------------------------------------------------------------------------------------------------------------


class Tree:
    """The block elements of a page and their own texts.

    labels: a hash of tag and classes each, the lowest bit set for headings; parents come before children, node 0 is the
    root.  owners, keys, sizes, links, marks: the node, hash, characters, characters in links and mark of each piece of
    text, in page order; texts: the pieces themselves, where they are at hand.
    """

    def __init__(self, labels, parents, owners, keys, sizes, links, marks, texts=()):
        self.labels, self.parents, self.owners, self.texts = labels, parents, owners, texts
        self.keys, self.sizes, self.links, self.marks = keys, sizes, links, marks
        self.children: list[list[int]] = [[] for _ in labels]
        for node, parent in enumerate(parents[1:], 1):
            self.children[parent].append(node)

    @classmethod
    def of(cls, source: str) -> Tree:
        page = parse(source)
        at = {0: 0}
        labels, parents = [0], [-1]
        for e in range(1, len(page.tags)):
            if page.tags[e] in BLOCK:
                at[e] = len(labels)
                labels.append(_key(page.labels[e]) >> 1 << 1 | (page.tags[e] in HEADINGS))
                parents.append(at[page.parents[e]])
            else:
                at[e] = at[page.parents[e]]
        owners, texts, links = ([x[i] for x in page.blocks] for i in range(3))
        marks, nodes = [page.apart[e] for e in owners], [at[e] for e in owners]
        return cls(labels, parents, nodes, [_key(t) for t in texts], [len(t) for t in texts], links, marks, texts)

    def unmarked(self, values) -> list:
        """Of values, one a piece, those of pieces without a mark."""
        return [v for v, mark in zip(values, self.marks) if not mark]

    def paths(self) -> list[int]:
        out = [0]
        for label, parent in zip(self.labels[1:], self.parents[1:]):
            out.append(_key(f"{out[parent]} {label}"))
        return out

    def layout(self) -> int:
        """A hash of the set of paths that hold text."""
        paths = self.paths()
        return _key(" ".join(map(str, sorted({paths[e] for e in self.owners}))))

    def shapes(self, texts: dict | None = None) -> list[tuple[int, int]]:
        """(hash of the subtree's labels, and of its texts where these are given; its weight in a match with an equal one)."""
        below: list[list[int]] = [[] for _ in self.labels]
        sizes, out = [NODE] * len(self.labels), [(0, 0)] * len(self.labels)
        for node in range(len(self.labels) - 1, -1, -1):
            own = texts.get(node, "") if texts else ""
            sizes[node] += own != ""
            out[node] = (_key(f"{self.labels[node]} {below[node]} {own}"), sizes[node])
            if node:
                below[self.parents[node]].append(out[node][0])
                sizes[self.parents[node]] += sizes[node]
        return out

    def node_texts(self, marked: bool = True) -> dict[int, tuple[int, int, int]]:
        """(hash of the text, characters, characters in links) by node; without marked pieces if marked is false."""
        found: dict[int, tuple[int, int, int]] = {}
        for e, key, size, n, mark in zip(self.owners, self.keys, self.sizes, self.links, self.marks):
            if mark and not marked:
                continue
            old = found.get(e)
            found[e] = (_key(f"{old[0]} {key}"), old[1] + size, old[2] + n) if old else (key, size, n)
        return found


def tree_match(a: Tree, b: Tree, most_cells: int = 250_000) -> dict[int, int]:
    """The largest order-preserving matching of nodes with equal labels under matched parents: node of b to node of a.

    Of matchings of one size the one with more equal texts is taken.  Equal subtrees at the ends of two lists of children
    are matched at once; the rest goes through the usual table.  Where that would exceed most_cells, subtrees of equal
    shape at the ends are matched first whatever their texts, which keeps the size of the matching.
    """
    texts = [{e: t[0] for e, t in tree.node_texts().items()} for tree in (a, b)]
    left_same, right_same = a.shapes(texts[0]), b.shapes(texts[1])
    shapes: list = []
    steps: dict[tuple[int, int], tuple] = {}
    sizes: dict[tuple[int, int], int] = {}

    def equal_ends(left, right, own, other):
        low, ends, least = 0, 0, min(len(left), len(right))
        while low < least and own[left[low]][0] == other[right[low]][0]:
            low += 1
        while ends < least - low and own[left[-1 - ends]][0] == other[right[-1 - ends]][0]:
            ends += 1
        heads, tails = zip(left[:low], right[:low]), zip(left[len(left) - ends :], right[len(right) - ends :])
        return [*heads, *tails], left[low : len(left) - ends], right[low : len(right) - ends]

    def solve(x, y):
        if left_same[x][0] == right_same[y][0]:
            sizes[x, y] = left_same[x][1]
            steps[x, y] = (list(zip(a.children[x], b.children[y])), [], [], [[0]])
            return
        sure, left, right = equal_ends(a.children[x], b.children[y], left_same, right_same)
        total = NODE + (x in texts[0] and texts[0][x] == texts[1].get(y)) + sum(left_same[p][1] for p, _ in sure)
        if len(left) * len(right) > most_cells:
            if not shapes:
                shapes.extend((a.shapes(), b.shapes()))
            more, left, right = equal_ends(left, right, *shapes)
            for pair in more:
                if pair not in sizes:
                    yield pair
                total += sizes[pair]
            sure += more
        table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, p in enumerate(left, 1):
            above, row, label = table[i - 1], table[i], a.labels[p]
            for j, q in enumerate(right, 1):
                best = above[j] if above[j] > row[j - 1] else row[j - 1]
                if label == b.labels[q]:
                    if (p, q) not in sizes:
                        yield p, q
                    met = above[j - 1] + sizes[p, q]
                    best = met if met > best else best
                row[j] = best
        steps[x, y] = (sure, left, right, table)
        sizes[x, y] = total + table[-1][-1]

    def begin(x, y):
        if not a.children[x] or not b.children[y]:  # the common case, without a step of its own
            sizes[x, y] = NODE + (x in texts[0] and texts[0][x] == texts[1].get(y))
            return iter(())
        return solve(x, y)

    todo = [begin(0, 0)]
    while todo:  # post-order without recursion: trees may be deep
        pair = next(todo[-1], None)
        if pair is None:
            todo.pop()
        else:
            todo.append(begin(*pair))
    found, pairs = {}, [(0, 0)]
    while pairs:
        x, y = pairs.pop()
        found[y] = x
        if (x, y) not in steps:
            if left_same[x][0] == right_same[y][0]:
                pairs.extend(zip(a.children[x], b.children[y]))
            continue
        sure, left, right, table = steps[x, y]
        pairs.extend(sure)
        i, j = len(left), len(right)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                pairs.append((left[i - 1], right[j - 1]))
                i, j = i - 1, j - 1
    return found


def aligned(reference: Tree, page: Tree) -> list[int]:
    """Per node of page its node in the reference; for one that has none, -1 less the node of its nearest matched ancestor."""
    found = tree_match(reference, page)
    out = [0]
    for node in range(1, len(page.labels)):
        up = out[page.parents[node]]
        out.append(found[node] if node in found else up if up < 0 else -1 - up)
    return out


# -- induction ---------------------------------------------------------------------------------------------------------


def induce(reference: Tree, counts: dict[int, tuple[int, int, int, int]], share: float = 0.7, most_links: float = 0.5):
    """(content nodes, nodes of the container) of a reference.

    counts: per node, or -1 less a node for blocks the reference lacks below it, (distinct pages that have text there,
    distinct texts, characters, characters in links) over all pages of the layout.  A text that three or more different
    pages share is template, whatever page the reference is.
    """
    slots = {e: c for e, c in counts.items() if e < 0 or c[1] > max(1, c[0] // 10) or c[0] < ENOUGH}
    size = len(reference.labels)
    own, heading = [0.0] * size, [False] * size
    for e, (_, _, chars, links) in slots.items():
        at = e if e >= 0 else -1 - e
        if links <= most_links * chars:
            own[at] += chars - links
        heading[at] = heading[at] or e >= 0 and bool(reference.labels[e] & 1)
    for e in range(size - 1, 0, -1):
        own[reference.parents[e]] += own[e]
        heading[reference.parents[e]] = heading[reference.parents[e]] or heading[e]
    at = 0
    while own[at]:
        inner = max(reference.children[at], key=lambda e: (own[e], -e), default=None)
        # Down to the node that still holds nearly all of the slots' text.  A single block is no container, and a heading
        # that varies from page to page belongs to the text that follows it.
        if inner is None or own[inner] < share * own[at] or not reference.children[inner]:
            break
        if any(heading[e] for e in reference.children[at] if e != inner):
            break
        at = inner
    inside = [False] * size
    inside[at] = True
    for e in range(at + 1, size):
        inside[e] = inside[reference.parents[e]]
    keep = [e for e, c in slots.items() if inside[e if e >= 0 else -1 - e] and c[3] <= most_links * c[2]]
    return sorted(keep), [e for e in range(size) if inside[e]]


# -- on Spark ----------------------------------------------------------------------------------------------------------


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_KINDS = [pa.list_(k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())]


def _parse(batches, most: int = 500):
    for whole in batches:
        for low in range(0, whole.num_rows, most):
            batch = whole.slice(low, most)
            trees = [Tree.of(x.as_py() or "") for x in batch.column(3)]
            cells = [[getattr(t, n) for t in trees] for n in _names(TREE)]
            wholes = [_key(" ".join(map(str, t.unmarked(t.keys)))) for t in trees]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array([t.layout() for t in trees], pa.int64()),
                    pa.array(wholes, pa.int64()),
                    pa.array([t.texts for t in trees], pa.list_(pa.string())),
                    *(pa.array(c, k) for c, k in zip(cells, _KINDS)),
                ],
                _names(PAGES),
            )


def _trees(batch, first: int) -> list[Tree]:
    """The trees in the columns of a batch from first on; None where a column is null."""
    columns = [batch.column(i).to_pylist() for i in range(first, first + len(_KINDS))]
    return [Tree(*cells) if cells[0] else None for cells in zip(*columns)]


def _count(batches, most: int = 500):
    for whole in batches:
        for low in range(0, whole.num_rows, most):
            batch = whole.slice(low, most)
            rows: list[tuple] = []
            hosts, layouts, pages = (batch.column(i).to_pylist() for i in range(3))
            trees = zip(hosts, layouts, pages, _trees(batch, 3), _trees(batch, 3 + len(_KINDS)))
            for host, layout, n_pages, page, reference in trees:
                nodes = aligned(reference, page)
                found = page.node_texts(n_pages >= ENOUGH)
                rows += [(host, layout, nodes[e], t, n, k) for e, (t, n, k) in found.items()]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _names(COUNTED))


def _induce(batches):
    for batch in batches:
        hosts, layouts, stats = (batch.column(i) for i in range(3))
        found = []
        for cell, tree in zip(stats.to_pylist(), _trees(batch, 3)):
            counts = {c["node"]: (c["pages"], c["variants"], c["chars"], c["links"]) for c in cell}
            found.append(induce(tree, counts))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [hosts, layouts, pa.array([k for k, _ in found], kind), pa.array([i for _, i in found], kind)], _names(WRAPPER)
        )


def _extract(batches, most: int = 500):
    for whole in batches:
        for low in range(0, whole.num_rows, most):
            batch = whole.slice(low, most)
            (keeps, pages, pieces), texts = (batch.column(i).to_pylist() for i in (2, 3, 4)), []
            trees = zip(keeps, pages, pieces, _trees(batch, 5), _trees(batch, 5 + len(_KINDS)))
            for keep, n_pages, own, page, reference in trees:
                if reference is None or keep is None:
                    texts.append(" ".join(page.unmarked(own)))
                    continue
                nodes, kept = aligned(reference, page), set(keep)
                free = [n_pages >= ENOUGH or not mark for mark in page.marks]
                texts.append(" ".join(t for e, t, f in zip(page.owners, own, free) if f and nodes[e] in kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], _names(TEXTS))


def wrappers(parsed: DataFrame) -> DataFrame:
    """Per host and layout the number of different pages, the reference's tree, keep and inside, from all parsed pages of it;
    copies of a page count once."""
    tree, layout = _names(TREE), ["host", "layout"]
    # Equal pages are one: a copy shows nothing about what varies.
    once = parsed.groupBy(*layout, "whole").agg(F.min("_row").alias("_row"))
    picked = stored(once.groupBy(*layout).agg(F.min("_row").alias("_row"), F.count("*").alias("n")), "wrapper-layouts")
    reference = picked.join(parsed.select("_row", *tree), "_row").select(*layout, "n", *(F.col(c).alias(f"ref_{c}") for c in tree))
    reference = stored(reference, "wrapper-references")
    # Texts stay where they are: hashes and lengths are all that counting needs.
    pages = parsed.select("_row", *layout, *tree).join(once.select("_row"), "_row", "left_semi").where(F.size("keys") > 0)
    refs = [f"ref_{c}" for c in tree]
    rows = pages.join(reference, layout).select(*layout, "n", *tree, *refs).mapInArrow(_count, COUNTED)
    texts = rows.groupBy(*layout, "node", "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    nodes = texts.groupBy(*layout, "node").agg(
        F.sum("n").alias("pages"), F.count("*").alias("variants"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    # As many rows as a reference has nodes, twice at most.
    stats = nodes.groupBy(*layout).agg(F.collect_list(F.struct("node", "pages", "variants", "chars", "links")).alias("stats"))
    made = stats.join(reference, layout).select(*layout, "stats", *refs).mapInArrow(_induce, WRAPPER)
    return stored(made.join(reference, layout).select(*layout, "n", "keep", "inside", *refs), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of pages.

    pages needs page_id, url and html; other columns are left out.  Null or empty html gives an empty text; pages without
    a readable host share one host; repeated rows come back repeated; an empty table gives no row.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    parsed = rows.select("page_id", "url", host_of("url").alias("host"), "html").mapInArrow(_parse, PAGES)
    parsed = stored(parsed.withColumn("_row", F.monotonically_increasing_id()), "wrapper-trees")
    found = wrappers(parsed)
    tree = _names(TREE)
    joined = parsed.join(found, ["host", "layout"], "left")
    return joined.select("page_id", "url", "keep", "n", "texts", *tree, *(f"ref_{c}" for c in tree)).mapInArrow(_extract, TEXTS)
