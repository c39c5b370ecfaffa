"""Near-duplicate records: many universal hash minima, banding, signature verification, connected components.

1. Each text becomes the set of its word shingles, hashed to 64 bits; ``N_HASHES`` universal hashes keep their least value each.
2. Texts with equal shingle sets collapse to one class, so copies cost one row from here on.
3. Bands of ``ROWS`` minima are equi-joined; each candidate pair is verified on the signature (one byte a minimum). Buckets
   that a hot group fills are compared block by block instead, which gives links enough for the same components.
4. Verified links form components by alternating large-star and small-star.
5. A component is cut into blocks of about ``BLOCK`` classes. Two blocks meet in one task only if a candidate pair of step 3 lies across
   them, and of each block only the classes of such pairs come, so the work grows with the candidates and not with the square of a
   component; the pairs of a meeting are verified on their signatures, then on their exact shingle sets.

The probability that a pair of similarity s shares no band is (1 - s**ROWS)**BANDS: 1.5e-4 at 0.7, 5e-8 at 0.8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.html import is_html, page_text, visible_text
from gossamer.llm.components import connected_components
from gossamer.llm.frames import frame
from gossamer.session import cut_lineage, spread

BANDS, ROWS = 32, 4
N_HASHES = BANDS * ROWS
#: Signatures agree on a share of minima with a standard error under 0.045; verification keeps pairs down to SLACK under the threshold.
SLACK = 0.18
BLOCK = 64
#: Shingles hashed at a time.
PIECE = 4096
#: Buckets of more classes are compared block by block.
BIG = 256
_WORD = re.compile(r"\w+")
_rng = np.random.RandomState(20240229)
# Universal hashing modulo 2**64 with odd multipliers, of which the upper 32 bits are kept (multiply-shift).
_MULT = (_rng.randint(0, 2**63, N_HASHES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.randint(0, 2**63, N_HASHES, dtype=np.int64).astype(np.uint64)
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@lru_cache(maxsize=1 << 17)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _P2
    return h ^ (h >> np.uint64(29))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ordered_shingles(words: list[str], width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words in order; texts shorter than that have none."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = _mix(out * _P1 + h[k : k + n] + _P3)
    return out


def shingle_set(words: list[str], width: int) -> np.ndarray:
    """``ordered_shingles``, sorted and distinct."""
    return np.unique(ordered_shingles(words, width))


def text_shingles(words: list[str], width: int) -> np.ndarray:
    """The shingle set of a text; a text of fewer words than ``width`` has one shingle of all its words."""
    return shingle_set(words, min(width, len(words)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """``N_HASHES`` minima of universal hashes, 32 bits each, by pieces of the set, so a long text needs no more memory. The set must
    not be empty."""
    least = np.full(N_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), PIECE):
            hashed = _MULT[:, None] * shingles[at : at + PIECE]
            hashed += _ADD[:, None]
            np.minimum(least, hashed.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, with the band's number mixed in."""
    rows = sig.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _P3
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = _mix(key * _P1 + rows[:, k])
    return key.view(np.int64)


def set_id(shingles: np.ndarray) -> int:
    """64-bit name of a shingle set: equal sets, equal names."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(shingles.tobytes()), dtype=np.int64)[0])


def sketches(texts: DataFrame, read, schema_in: list[str], width: int, min_words: int) -> DataFrame:
    """(key, cls, sig, keys) of each row with at least ``min_words`` words: class of its shingle set, byte signature, band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, cls, sig, keys = [], [], [], []
            for row in zip(*[batch[c] for c in ["key", *schema_in]]):
                words = words_of(read(*row[1:]))
                if len(words) < max(min_words, 1):
                    continue
                s = text_shingles(words, width)
                minima = signature(s)
                key.append(row[0])
                cls.append(set_id(s))
                sig.append(minima.astype(np.uint8).tobytes())
                keys.append(band_keys(minima))
            yield frame(key=key, cls=cls, sig=sig, keys=keys)

    return spread(texts).mapInPandas(run, f"key {texts.schema['key'].dataType.simpleString()}, cls long, sig binary, keys array<long>")


def _agreement():
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(-1, N_HASHES)
        y = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(-1, N_HASHES)
        return pd.Series((x == y).mean(axis=1))

    return run


def _blocked(rows: DataFrame, group: str, n: str) -> DataFrame:
    """``rows`` once for each pair of blocks of its ``group`` (of ``n`` rows) that its block belongs to: columns lo, hi and mine."""
    nb = F.ceil(F.col(n) / BLOCK).cast("int")
    placed = rows.withColumn("nb", nb).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("lo"), F.greatest(o, F.col("mine")).alias("hi")))
    kept = [c for c in rows.columns if c != n]
    return placed.select(*kept, "mine", F.explode(pairs).alias("pair")).select(*kept, "mine", "pair.lo", "pair.hi")


def _near_rows(sig: np.ndarray, mine: np.ndarray, i: int, least: float, crossing: bool) -> np.ndarray:
    """Rows after ``i`` whose signatures agree with its on a share of ``least``, of the other block if ``crossing``."""
    near = np.flatnonzero((sig[i + 1 :] == sig[i]).mean(axis=1) >= least) + i + 1
    return near[mine[near] != mine[i]] if crossing else near


def class_links(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, hot, stars) of ``classes`` (cls, sig, keys, a row a class).

    ``pairs`` (a, b): class pairs that share a bucket of up to ``BIG`` classes and agree on their signatures. ``hot`` (band, cls): the rows of
    larger buckets. ``stars`` (a, b): links of those. A hot bucket is cut into blocks that meet pairwise; each meeting compares all its
    signatures, but gives only a star for each of its connected parts: the same components come out, and neither a task's memory nor
    the edges of a meeting grow with the bucket. Its pairs are found by the meetings of ``candidate_meetings``.
    """
    banded = classes.select("cls", F.explode("keys").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(banded.join(sizes, "band"))
    sigs = classes.select("cls", "sig")
    small = shared.where(F.col("n") <= BIG).select("cls", "band")
    pairs = small.withColumnRenamed("cls", "a").join(small.withColumnRenamed("cls", "b"), "band").where("a < b").select("a", "b").distinct()
    both = pairs.join(sigs.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b")
    agreeing = both.where(_agreement()("sa", "sb") >= threshold - SLACK).select("a", "b")

    def stars(group: pd.DataFrame) -> pd.DataFrame:
        crossing = group["lo"].iloc[0] != group["hi"].iloc[0]
        sig = np.frombuffer(b"".join(group["sig"]), dtype=np.uint8).reshape(-1, N_HASHES)
        mine, cls = group["mine"].to_numpy(), group["cls"].to_numpy()
        root = Roots(len(group))
        for i in range(len(group) - 1):
            for j in _near_rows(sig, mine, i, threshold - SLACK, crossing).tolist():
                root.join(i, j)
        out = [(int(cls[root.of(i)]), int(cls[i])) for i in range(len(group)) if root.of(i) != i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    hot = shared.where(F.col("n") > BIG)
    return cut_lineage(agreeing), hot.select("band", "cls"), _blocked(hot.join(sigs, "cls"), "band", "n").groupBy("band", "lo", "hi").applyInPandas(stars, "a long, b long")


class Roots:
    """Union and find over the rows of one meeting."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def of(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        x, y = self.of(i), self.of(j)
        self.root[max(x, y)] = min(x, y)


def candidate_meetings(components: DataFrame, pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """(component, lo, hi, cls, mine): which classes meet where, so that every candidate pair meets exactly once.

    Classes are placed in blocks of their component by hash. A pair brings its two classes to the meeting of their blocks; a hot
    bucket brings together whole blocks of a component that it has classes in, and those once, however many buckets they share.
    """
    sized = components.groupBy("component").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("vertex"), F.ceil(F.col("n") / BLOCK)).cast("int")
    placed = cut_lineage(components.join(sized, "component").select(F.col("vertex").alias("cls"), "component", block.alias("mine")))
    ends = pairs.join(placed.select(F.col("cls").alias("a"), "component", F.col("mine").alias("x")), "a").join(placed.select(F.col("cls").alias("b"), F.col("mine").alias("y")), "b")
    lo, hi = F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")
    both = F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("x").alias("mine")), F.struct(F.col("b").alias("cls"), F.col("y").alias("mine")))).alias("end")
    by_pair = ends.select("component", lo, hi, both).select("component", "lo", "hi", "end.cls", "end.mine").distinct()
    blocks = hot.join(placed, "cls").select("band", "component", "mine").distinct()
    facing = blocks.withColumnRenamed("mine", "lo").join(blocks.withColumnRenamed("mine", "hi"), ["band", "component"]).where("lo <= hi").select("component", "lo", "hi").distinct()
    sides = facing.select("component", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("mine"))
    by_block = sides.join(placed, ["component", "mine"]).select("component", "lo", "hi", "cls", "mine")
    return by_pair.unionByName(by_block).distinct()


def _meeting_links(group: pd.DataFrame, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, jaccard) of the rows of a meeting, in order of cls, whose shingle sets reach the threshold; across its two blocks if it has two."""
    sig = np.frombuffer(b"".join(group["sig"]), dtype=np.uint8).reshape(-1, N_HASHES)
    sets = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
    mine, crossing = group["mine"].to_numpy(), group["lo"].iloc[0] != group["hi"].iloc[0]
    for i in range(len(group) - 1):
        x = sets[i]
        for j in _near_rows(sig, mine, i, threshold - SLACK, crossing).tolist():
            y = sets[j]
            small, large = (x, y) if len(x) < len(y) else (y, x)
            if len(small) < threshold * len(large):
                continue
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            shared = int((large[at] == small).sum())
            similarity = shared / (len(x) + len(y) - shared)
            if similarity >= threshold:
                yield i, j, similarity


def verified_pairs(meetings: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard), a < b, of the class pairs in ``meetings`` (component, lo, hi, mine, cls, sig, shingles) that reach the threshold."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls", ignore_index=True)
        cls = group["cls"].tolist()
        out = [(cls[i], cls[j], s) for i, j, s in _meeting_links(group, threshold)]
        return pd.DataFrame(out, columns=["a", "b", "jaccard"]).astype({"a": "int64", "b": "int64", "jaccard": "float64"})

    return meetings.groupBy("component", "lo", "hi").applyInPandas(run, "a long, b long, jaccard double")


def linked_classes(meetings: DataFrame, threshold: float) -> DataFrame:
    """(cls, n_links, root): per meeting and class its verified links there, and the least class it is joined with there; no pairs."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls", ignore_index=True)
        cls = group["cls"].tolist()
        count, root = [0] * len(cls), Roots(len(cls))
        for i, j, _ in _meeting_links(group, threshold):
            count[i] += 1
            count[j] += 1
            root.join(i, j)
        out = [(cls[i], n, cls[root.of(i)]) for i, n in enumerate(count) if n]
        return pd.DataFrame(out, columns=["cls", "n_links", "root"]).astype("int64")

    return meetings.groupBy("component", "lo", "hi").applyInPandas(run, "cls long, n_links long, root long")


class NearDuplicates:
    """The operator over texts read by ``read`` from the columns ``inputs`` of ``texts`` (with a unique name ``key`` a text).

    Rows with a null key don't count; a key given twice counts once; texts under ``min_words`` words, null and empty texts
    belong to no group; a text of fewer words than ``width`` is one shingle of them all; an empty table gives empty results; texts are read whole. Other columns play no part.
    """

    def __init__(self, texts: DataFrame, read, inputs: list[str], width: int = 5, threshold: float = 0.8, min_words: int = 1):
        self.texts, self.read, self.inputs, self.width, self.threshold, self.min_words = texts.where("key IS NOT NULL").select("key", *inputs), read, inputs, width, threshold, min_words
        sketched = cut_lineage(sketches(self.texts, read, inputs, width, min_words))
        #: (key, cls), each key once.
        self.members = sketched.select("key", "cls").distinct()
        #: One row a class: its name, its least key, its signature and band keys. Equal sets have equal sketches, so any will do.
        classes = sketched.groupBy("cls").agg(F.min("key").alias("rep"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
        self.pairs, self.hot, stars = class_links(classes, threshold)
        self.components = cut_lineage(connected_components(self.pairs.unionAll(stars)))
        self.classes = classes.drop("keys")

    def meetings(self) -> DataFrame:
        """(component, lo, hi, mine, cls, sig, shingles): ``candidate_meetings`` with the classes' sketches and sets."""
        width, read, inputs = self.width, self.read, self.inputs

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sets = [text_shingles(words_of(read(*row)), width).tobytes() for row in zip(*[batch[c] for c in inputs])]
                yield frame(cls=batch["cls"], sig=batch["sig"], shingles=sets)

        held = self.components.join(self.classes, self.components["vertex"] == self.classes["cls"]).select("cls", "sig", F.col("rep").alias("key"))
        # A body stored twice comes twice; one of the two is enough.
        rows = held.join(self.texts, "key").dropDuplicates(["cls"])
        sets = rows.mapInPandas(run, "cls long, sig binary, shingles binary")
        return candidate_meetings(self.components, self.pairs, self.hot).join(sets, "cls")

    def class_pairs(self) -> DataFrame:
        """(a, b, jaccard), a < b: the different classes that are near-duplicates, verified on their shingle sets."""
        return verified_pairs(self.meetings(), self.threshold)

    def groups(self) -> DataFrame:
        """(key, cls, group_id, n_copies, n_links): per text its class, its group (the least class joined with it by verified
        links), the texts with the same shingle set, and the classes it is linked to. A text like no other is its own group.

        Links are counted where they are verified and joined there to stars, so no pair leaves its task."""
        linked = cut_lineage(linked_classes(self.meetings(), self.threshold))
        parts = connected_components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b")))
        degree = linked.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
        copies = self.members.groupBy("cls").agg(F.count("*").alias("n_copies"))
        return (
            self.members.join(copies, "cls")
            .join(parts.select(F.col("vertex").alias("cls"), F.col("component").alias("group_id")), "cls", "left")
            .join(degree, "cls", "left")
            .select("key", "cls", F.coalesce("group_id", "cls").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )

    def key_pairs(self) -> DataFrame:
        """(key_a, key_b), key_a < key_b: all pairs of different keys whose texts reach the threshold, copies among them."""
        pairs = self.class_pairs().select("a", "b")
        same = self.members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
        linked = pairs.unionAll(same)
        left = self.members.select(F.col("cls").alias("a"), F.col("key").alias("ka"))
        right = self.members.select(F.col("cls").alias("b"), F.col("key").alias("kb"))
        wide = linked.join(left, "a").join(right, "b").where("a <> b OR ka < kb")
        return wide.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def body_duplicates(bodies: DataFrame, width: int = 3, threshold: float = 0.7, min_words: int = 60) -> NearDuplicates:
    """The operator over the visible text of HTML bodies, keyed by content_hash."""
    html = bodies.where(is_html(bodies["content_type"]) & bodies["body"].isNotNull())
    return NearDuplicates(
        html.select(F.col("content_hash").alias("key"), "body", "content_type"),
        lambda body, content_type: visible_text(page_text(body, content_type)),
        ["body", "content_type"], width, threshold, min_words,
    )


def duplicate_bodies(bodies: DataFrame) -> DataFrame:
    """(content_hash_a, content_hash_b), a < b: different HTML bodies of at least 60 words of visible text whose sets of three
    consecutive words reach a Jaccard similarity of 0.7. Bodies stored twice count once; null hashes and bodies never."""
    return body_duplicates(bodies).key_pairs().select(F.col("key_a").alias("content_hash_a"), F.col("key_b").alias("content_hash_b"))


def stored_text(body: bytes | None, content_type: str | None) -> str:
    """Visible text of an HTML body, any other text as it is; images, PDF files and unreadable bodies have none."""
    kind = (content_type or "").strip().lower()
    html = "text/html" in kind or "application/xhtml+xml" in kind
    if not html and kind and not kind.startswith("text/"):
        return ""
    page = page_text(body, content_type)
    return visible_text(page) if html else page


def body_groups(bodies: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, cls, group_id, n_copies, n_links) of every stored body by content_hash, as ``NearDuplicates.groups``.

    A body without words has no text to compare: it is a class of its own, named by its key.
    """
    rows = bodies.where("content_hash IS NOT NULL").select(F.col("content_hash").alias("key"), "body", "content_type")
    found = NearDuplicates(rows, stored_text, ["body", "content_type"], width, threshold, 1).groups()
    own = F.xxhash64(F.lit("no words"), "key")
    rest = rows.select("key").distinct().join(found.select("key"), "key", "left_anti")
    return found.unionByName(rest.select("key", own.alias("cls"), own.alias("group_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")))
