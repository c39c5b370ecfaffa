"""Topics from the texts themselves: spherical k-means over hashed words, apart from the language.

The model is fitted on all texts. Their vectors are stored once, in blocks of many texts a row; each step (word weights, means of the languages,
a first centre, a round of k-means) is a pass over the blocks, of which the driver gets sums alone. Of each text's vector its language's mean
is taken away first: otherwise the clusters would be the languages. Every text is then given its nearest centre.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.langid import parser_of, text_languages
from gossamer.llm.neardup import _word_hash
from gossamer.session import cut_lineage, spread

#: Clusters, the dimensions that words are hashed to, and rounds of k-means.
TOPICS, DIMENSIONS, ROUNDS = 8, 4096, 15
#: Texts a block, partitions whose sums the driver takes as they are, and the unit of sums: whole numbers add up to the same in any order.
BLOCK_TEXTS, DIRECT, UNIT = 1024, 64, float(1 << 24)
#: Squared distance from its language's mean below which a text has nothing of its own.
LEAST_OWN = 1e-8
BLOCK_SCHEMA = "doc_id array<long>, text_id array<long>, language array<string>, sizes binary, at binary, value binary"

_LONG_WORD = re.compile(r"\w{4,}")


def _dimensions(text: str) -> list[int]:
    return [_word_hash(w) & (DIMENSIONS - 1) for w in _LONG_WORD.findall(text.lower())]


def word_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, 1 + log of counts) of a text's words of at least four letters."""
    found = _dimensions(text)
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0)
    at, n = np.unique(np.array(found, dtype=np.int64), return_counts=True)
    return at, 1 + np.log(n)


def packed_vectors(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_vector`` of many texts: how many dimensions each has, and the dimensions and values of all one after another."""
    found = [_dimensions(t) for t in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(f) for f in found])
    at, times = np.unique(owner * DIMENSIONS + np.fromiter((x for f in found for x in f), dtype=np.int64, count=len(owner)), return_counts=True)
    return np.bincount(at // DIMENSIONS, minlength=len(texts)).astype(np.int32), (at % DIMENSIONS).astype(np.uint16), (1 + np.log(times)).astype(np.float32)


class _Texts:
    """The texts of a block that have words, as unit vectors of weighted words, still with their language's mean."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, value: np.ndarray, weight: np.ndarray):
        self.told = np.flatnonzero(sizes)
        self.sizes = sizes[self.told]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at = at.astype(np.int64)
        weighted = value * weight[self.at]
        norm = np.sqrt(self.sums(weighted * weighted))
        self.value = weighted / np.repeat(np.maximum(norm, 1e-12), self.sizes)
        self.weighs = norm > 0

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.zeros(0)

    def likeness(self, centres: np.ndarray) -> np.ndarray:
        """(texts × centres) products."""
        return np.stack([self.sums(self.value * c[self.at]) for c in centres], axis=1) if len(centres) else np.zeros((len(self.told), 0))


class TopicModel:
    """Centres over weighted words, and the means of the languages."""

    def __init__(self, weight: np.ndarray, means: dict[str | None, np.ndarray], centres: np.ndarray):
        self.weight, self.centres = weight, centres.astype(np.float32)
        #: What a language's mean adds to the likeness with each centre.
        self.shift = {k: centres @ m for k, m in means.items()}

    def topics_of(self, texts: Sequence[str], languages: Sequence[str | None]) -> list[str]:
        """The name of each text's nearest topic, ``t0`` the largest; "other" for a text without words or without a model.
        All texts of a batch together."""
        return self.nearest(*packed_vectors(texts), languages)

    def nearest(self, sizes: np.ndarray, at: np.ndarray, value: np.ndarray, languages: Sequence[str | None]) -> list[str]:
        """``topics_of`` of ``packed_vectors``."""
        out = ["other"] * len(sizes)
        texts = _Texts(sizes, at, value, self.weight)
        if len(self.centres) and len(texts.told):
            none = np.zeros(len(self.centres))
            best = (texts.likeness(self.centres.astype(np.float64)) - np.stack([self.shift.get(languages[i], none) for i in texts.told])).argmax(axis=1)
            for i, b, weighs in zip(texts.told.tolist(), best.tolist(), texts.weighs.tolist()):
                out[i] = f"t{b}" if weighs else "other"
        return out


def block_rows(sizes: np.ndarray, at: np.ndarray, value: np.ndarray, columns: dict[str, list]) -> Iterator[dict[str, object]]:
    """Blocks of at most ``BLOCK_TEXTS`` texts: their vectors as bytes and their other ``columns`` as lists."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(sizes), BLOCK_TEXTS):
        z = min(a + BLOCK_TEXTS, len(sizes))
        part = slice(ends[a], ends[z])
        yield {k: v[a:z] for k, v in columns.items()} | {"sizes": sizes[a:z].tobytes(), "at": at[part].tobytes(), "value": value[part].tobytes()}


def vectors_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, dimensions and values of a block."""
    return np.frombuffer(row.sizes, dtype=np.int32), np.frombuffer(row.at, dtype=np.uint16), np.frombuffer(row.value, dtype=np.float32)


class _Own:
    """Texts with words of a block, without their languages' means: x = value at its dimensions, less scale × mean."""

    SCHEMA = "doc_id binary, text_id binary, language binary, sizes binary, at binary, value binary, scale binary"

    @staticmethod
    def stored(blocks: DataFrame, weight: np.ndarray, names: list, means: np.ndarray) -> DataFrame:
        square, flat = (means * means).sum(axis=1), means.ravel()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    texts, language = _Texts(*vectors_of(row), weight), _codes(row, names)
                    with_mean = texts.sums(texts.value * flat[np.repeat(language * DIMENSIONS, texts.sizes) + texts.at])
                    apart = texts.weighs - 2 * with_mean + square[language]
                    scale = np.where(apart > LEAST_OWN, 1 / np.sqrt(np.maximum(apart, LEAST_OWN)), 0.0)
                    value = (texts.value * np.repeat(scale, texts.sizes)).astype(np.float32)
                    ids = [np.array(x, dtype=np.int64)[texts.told] for x in (row.doc_id, row.text_id)]
                    yield pd.DataFrame([[x.tobytes() for x in (*ids, language, texts.sizes, texts.at.astype(np.uint16), value, scale)]], columns=["doc_id", "text_id", "language", "sizes", "at", "value", "scale"])

        return cut_lineage(blocks.select("doc_id", "text_id", "language", "sizes", "at", "value").mapInPandas(run, _Own.SCHEMA))

    def __init__(self, row, means: np.ndarray):
        self.sizes, at, value = vectors_of(row)
        self.at, self.value = at.astype(np.int64), value.astype(np.float64)
        self.language, self.scale = np.frombuffer(row.language, dtype=np.int64), np.frombuffer(row.scale, dtype=np.float64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.means = means

    def likeness(self, centres: np.ndarray) -> np.ndarray:
        words = np.stack([np.add.reduceat(self.value * c[self.at], self.starts) for c in centres], axis=1)
        return words - self.scale[:, None] * (self.means @ centres.T)[self.language]


def _codes(row, names: list) -> np.ndarray:
    """The places in ``names`` of the languages of a block's texts with words."""
    code = {x: i for i, x in enumerate(names)}
    return np.array([code[row.language[i]] for i in np.flatnonzero(vectors_of(row)[0])], dtype=np.int64)


def _total(blocks: DataFrame, of: Callable[[object], np.ndarray]) -> np.ndarray:
    """Sum over the blocks of whole-numbered arrays; many partitions are summed in two steps, so the driver never gets more than a few dozen."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for row in batch.itertuples():
                own = of(row).astype(np.int64)
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"total": [total.tobytes()]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [np.frombuffer(x, dtype=np.int64) for batch in batches for x in batch["total"]]
        if parts:
            yield pd.DataFrame({"total": [np.sum(parts, axis=0).tobytes()]})

    sums = blocks.drop("doc_id", "text_id").mapInPandas(first, "total binary")
    n = blocks.rdd.getNumPartitions()
    if n > DIRECT:
        sums = sums.repartition(isqrt(n)).mapInPandas(merged, "total binary")
    held = [np.frombuffer(r["total"], dtype=np.int64) for r in sums.collect()]
    return np.sum(held, axis=0) if held else np.zeros(0, dtype=np.int64)


def _least(own_texts: DataFrame, of: Callable[[_Own], np.ndarray], means: np.ndarray) -> np.ndarray:
    """The vector x of the text for which ``of`` gives the least value; of the least ids at equal values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = None
        for batch in batches:
            for row in batch.itertuples():
                if not row.sizes:
                    continue
                own = _Own(row, means)
                value = of(own)
                doc, text = np.frombuffer(row.doc_id, dtype=np.int64), np.frombuffer(row.text_id, dtype=np.int64)
                at = np.flatnonzero(value == value.min())
                i = at[np.lexsort((text[at], doc[at]))[0]]
                key = (float(value[i]), int(doc[i]), int(text[i]))
                if least is None or key < least[0]:
                    x = -own.scale[i] * means[own.language[i]]
                    part = slice(own.starts[i], own.starts[i] + own.sizes[i])
                    x[own.at[part]] += own.value[part]
                    least = key, x
        if least:
            yield pd.DataFrame({"value": [least[0][0]], "doc_id": [least[0][1]], "text_id": [least[0][2]], "x": [least[1].tobytes()]})

    found = own_texts.mapInPandas(run, "value double, doc_id long, text_id long, x binary").orderBy("value", "doc_id", "text_id").first()
    return np.frombuffer(found["x"], dtype=np.float64)


def fit_blocks(blocks: DataFrame, names: Sequence[str], topics: int = TOPICS) -> TopicModel:
    """The model of all texts of stored ``blocks``; ``names``: their languages but null. No texts with words give none."""
    names = [*names, None]

    def counted(row) -> np.ndarray:
        sizes, at, _ = vectors_of(row)
        return np.concatenate([np.bincount(at, minlength=DIMENSIONS), [np.count_nonzero(sizes)]])

    used = _total(blocks, counted)
    if not len(used) or not used[-1]:
        return TopicModel(np.zeros(DIMENSIONS), {}, np.zeros((0, DIMENSIONS)))
    weight = np.log((1 + used[-1]) / (1 + used[:-1]))

    def spoken(row) -> np.ndarray:
        texts = _Texts(*vectors_of(row), weight)
        language = _codes(row, names)
        place = np.repeat(language, texts.sizes) * DIMENSIONS + texts.at
        return np.concatenate([np.bincount(place, np.rint(texts.value * UNIT), len(names) * DIMENSIONS), np.bincount(language, minlength=len(names))])

    sums = _total(blocks, spoken)
    n = sums[-len(names) :]
    means = sums[: -len(names)].reshape(len(names), DIMENSIONS) / UNIT / np.maximum(n, 1)[:, None]
    # Centres as far apart as the texts allow, from the first text on.
    own_texts = _Own.stored(blocks, weight, names, means)
    picked = [_least(own_texts, lambda own: np.zeros(len(own.scale)), means)]
    while len(picked) < min(topics, used[-1]):
        held = np.stack(picked)
        picked.append(_least(own_texts, lambda own: own.likeness(held).max(axis=1), means))
    centres = np.stack(picked)
    size = np.zeros(len(centres), dtype=np.int64)
    for number in range(ROUNDS + 1):

        def nearest(row) -> np.ndarray:
            if not row.sizes:
                return np.zeros(len(centres) * (DIMENSIONS + len(names) + 1))
            own = _Own(row, means)
            k = own.likeness(centres).argmax(axis=1)
            words = np.bincount(np.repeat(k * DIMENSIONS, own.sizes) + own.at, np.rint(own.value * UNIT), len(centres) * DIMENSIONS)
            shares = np.bincount(k * len(names) + own.language, np.rint(own.scale * UNIT), len(centres) * len(names))
            return np.concatenate([words, shares, np.bincount(k, minlength=len(centres))])

        got = _total(own_texts, nearest)
        words, shares, size = np.split(got, np.cumsum([len(centres) * DIMENSIONS, len(centres) * len(names)]))
        sums = (words.reshape(len(centres), DIMENSIONS) - shares.reshape(len(centres), len(names)) @ means) / UNIT
        moved = np.where(size[:, None] > 0, sums, centres)
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-9)
        # The last pass counts the clusters; centres that stay would stay in all further rounds.
        if number == ROUNDS or np.array_equal(moved, centres):
            break
        centres = moved
    return TopicModel(weight, dict(zip(names, means)), centres[np.argsort(-size, kind="stable")])


def fit_topics(texts: Sequence[str], languages: Sequence[str | None], topics: int = TOPICS) -> TopicModel:
    """The model of texts held in memory: what ``fit_blocks`` finds pass by pass. No texts give none."""
    rows = [(word_vector(t), x) for t, x in zip(texts, languages)]
    rows = [(v, x) for v, x in rows if len(v[0])]
    if not rows:
        return TopicModel(np.zeros(DIMENSIONS), {}, np.zeros((0, DIMENSIONS)))
    used = np.zeros(DIMENSIONS)
    for (at, _), _ in rows:
        used[at] += 1
    weight = np.log((1 + len(rows)) / (1 + used))
    x = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for i, ((at, value), _) in enumerate(rows):
        x[i, at] = value * weight[at]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    spoken = np.array([str(s) for _, s in rows])
    means = {}
    for s in dict.fromkeys(s for _, s in rows):
        here = spoken == str(s)
        means[s] = x[here].mean(axis=0)
        x[here] -= means[s]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    # Centres as far apart as the texts allow, from the first on.
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(topics, len(rows)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    centres = x[picked]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    size = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
    return TopicModel(weight, means, centres[np.argsort(-size, kind="stable")])


def fitted_topics(documents: DataFrame, training: dict[str, str]) -> TopicModel:
    """The model of all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = parser_of(training) if training else None
        for batch in batches:
            texts = batch["text"].tolist()
            columns = {"doc_id": batch["doc_id"].tolist(), "text_id": batch["text_id"].tolist(), "language": text_languages(parser, texts)}
            yield pd.DataFrame(block_rows(*packed_vectors(texts), columns), columns=["doc_id", "text_id", "language", "sizes", "at", "value"])

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    return fit_blocks(cut_lineage(spread(rows).mapInPandas(run, BLOCK_SCHEMA)), sorted(training))
