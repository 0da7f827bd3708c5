"""Main text of web pages by a tree-structured graphical model.

Every block of a page, and every run of text in one, has a hidden label: content
or not. A node's own features (element, hints in class, id and role, length, share
of links, marks of sentences) give its potential; a table of potentials for
parent and child, one for each kind of child, ties it to its parent. Sum-product
messages go from the leaves up and back down, all pages of a batch at once, and
give the exact marginal of each node. A run of text is kept where content is at
least as likely as not.

The weights maximise the likelihood of labelled pages: the gradient is what the
pages have minus what the marginals of nodes and of pairs expect. Labelled pages
are a fixed set of layouts (`labelled_pages.py`), or the caller's own, with the
main text inside elements that have the attribute `data-main`. They are bounded
in number and fitted on the driver.

Rules: scripts, styles, comments in markup and form controls are never text.
Character references are decoded. Blocks become lines: white space within one,
line breaks too, becomes one space. A null page is empty; an empty page, one
without markup or one without content gives what its text runs give, "" if there
are none. Repeated rows and null ids are rows of their own, further columns are
not read, an empty table gives an empty result. Nothing is cut from long pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm import arrays, labelled_pages
from riskpanel.llm.html_tree import HINTS, KINDS, N_HINTS, Forest, Level
from riskpanel.llm.store import bounded_batches

STEPS = 400
RATE = 0.3
PENALTY = 1e-4
#: Most labelled pages that a fit takes.
MOST_LABELLED = 5000

TEXT = KINDS.index("text")
#: Kinds of children with a table of their own: each element kind, and blocks with a hint against content.
PAIRS = len(KINDS) + 1
_AGAINST = sum(1 << i for i, name in enumerate(HINTS) if name != "content")


def subtree(values: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Sums over every node and all nodes below it."""
    total = values.astype(np.float64)
    for level in reversed(levels[1:]):
        level.add(total, total[level.nodes])
    return total


def features(forest: Forest, levels: list[Level]) -> np.ndarray:
    """One row per node."""
    n = len(forest.parent)
    kind, hints = np.array(forest.kind, np.int64), np.array(forest.hints, np.int64)
    own = np.zeros((n, 6))
    flags = np.zeros((n, 2))
    for node, text, linked, _ in forest.runs:
        marks = text.count(".") + text.count("!") + text.count("?")
        own[node] = len(text), min(linked, len(text)), marks, text.count(","), text.count(" ") + 1, 1
        flags[node] = text[-1] in ".!?:;\"'", "©" in text
    chars, linked, marks, commas, words, runs = subtree(own, levels).T
    some = np.maximum(chars, 1)
    size = np.maximum(words, 1)
    is_text = kind == TEXT
    columns = [
        np.ones(n),
        *(kind == k for k in range(len(KINDS))),
        *((hints >> h) & 1 for h in range(N_HINTS)),
        np.log1p(chars) / 8,
        *(chars >= least for least in (25, 80, 200, 800)),
        linked / some,
        linked > 0.5 * chars,
        np.minimum(marks / size, 0.3) * 3,
        np.minimum(commas / size, 0.3) * 3,
        np.minimum(chars / np.maximum(runs, 1), 400) / 400,
        is_text * (words < 6),
        is_text * flags[:, 0],
        flags[:, 1],
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1) if n else np.zeros((0, len(columns)))


def pair_kinds(forest: Forest) -> np.ndarray:
    """Which table of potentials ties a node to its parent."""
    kind, hints = np.array(forest.kind, np.int64), np.array(forest.hints, np.int64)
    return np.where((hints & _AGAINST) != 0, PAIRS - 1, kind)


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Beliefs:
    """Marginals of nodes (content) and of parent and child (both labels)."""

    content: np.ndarray
    pairs: np.ndarray


def pass_messages(unary: np.ndarray, pair: np.ndarray, levels: list[Level], with_pairs: bool = False) -> Beliefs:
    """Sum-product on all trees: up level by level, then down.

    `unary` is the potential of the label content, `pair` (node, parent label,
    own label) that of a node and its parent, both as logarithms.
    """
    n = len(unary)
    below = np.stack([np.zeros(n), unary], axis=1)
    up, above, rest = (np.zeros((n, 2)) for _ in range(3))
    for level in reversed(levels[1:]):
        up[level.nodes] = log_sum(pair[level.nodes] + below[level.nodes][:, None, :], 2)
        level.add(below, up[level.nodes])
    for level in levels[1:]:
        # what the parent believes without this child
        rest[level.nodes] = below[level.parents] + above[level.parents] - up[level.nodes]
        above[level.nodes] = log_sum(pair[level.nodes] + rest[level.nodes][:, :, None], 1)
    belief = below + above
    total = log_sum(belief, 1)
    content = np.exp(belief[:, 1] - total)
    joint = np.exp(pair + rest[:, :, None] + below[:, None, :] - total[:, None, None]) if with_pairs else np.zeros((0, 2, 2))
    return Beliefs(content, joint)


@dataclass(frozen=True)
class PageModel:
    weights: np.ndarray
    pairs: np.ndarray  # (kind of child, parent label, own label)

    def content(self, forest: Forest) -> np.ndarray:
        """Chance that each node is content."""
        levels = forest.levels()
        unary = features(forest, levels) @ self.weights
        return pass_messages(unary, self.pairs[pair_kinds(forest)], levels).content

    def texts(self, pages: list[str | None]) -> list[str]:
        """Main text of each page."""
        forest = Forest()
        for page in pages:
            forest.add(page or "")
        content = self.content(forest)
        lines: list[list[str]] = [[] for _ in pages]
        for node, text, _, _ in forest.runs:
            if content[node] >= 0.5:
                lines[forest.page[node]].append(text)
        return ["\n".join(found) for found in lines]


def labels_of(forest: Forest, levels: list[Level]) -> np.ndarray:
    """1 for marked text runs, and for blocks with more marked than other characters."""
    marked, other = np.zeros(len(forest.parent)), np.zeros(len(forest.parent))
    for node, text, _, is_marked in forest.runs:
        (marked if is_marked else other)[node] = len(text)
    return (subtree(marked, levels) > subtree(other, levels)).astype(np.int64)


def fit(pages: list[str], steps: int = STEPS) -> PageModel:
    """Weights of the largest penalised likelihood of labelled pages, by adaptive gradient steps."""
    if len(pages) > MOST_LABELLED:
        raise ValueError(f"a fit takes at most {MOST_LABELLED} labelled pages")
    forest = Forest(labelled_pages.MARK)
    for page in pages:
        forest.add(page)
    levels, parent = forest.levels(), np.array(forest.parent, np.int64)
    x, y, kinds = features(forest, levels), labels_of(forest, levels), pair_kinds(forest)
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((PAIRS, 2, 2))
    np.add.at(seen, (kinds[child], y[parent[child]], y[child]), 1)
    size = x.shape[1]
    theta, mean, square = np.zeros(size + 4 * PAIRS), np.zeros(size + 4 * PAIRS), np.zeros(size + 4 * PAIRS)
    for step in range(1, steps + 1):
        weights, pairs = theta[:size], theta[size:].reshape(PAIRS, 2, 2)
        found = pass_messages(x @ weights, pairs[kinds], levels, with_pairs=True)
        expected = np.stack([np.bincount(kinds[child], found.pairs[child, a, b], PAIRS) for a in (0, 1) for b in (0, 1)], axis=1).reshape(PAIRS, 2, 2)
        gradient = np.concatenate([x.T @ (y - found.content), (seen - expected).ravel()]) / len(y) - PENALTY * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta = theta + RATE * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return PageModel(theta[:size], theta[size:].reshape(PAIRS, 2, 2))


@lru_cache(maxsize=1)
def layout_model() -> PageModel:
    """The model of the fixed labelled pages."""
    return fit(labelled_pages.pages())


def _extracted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "html"):
                texts = model.value.texts(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return run


def extract(spark: SparkSession, pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(layout_model() if labelled is None else fit(labelled))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(_extracted(model), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
