"""Mixing sources to target weights: iterative proportional fitting over token margins, then calibrated sampling.

1. Tokens of each text are counted with a public tokenizer; equal texts count as one, whatever rows they come from. A text's language
   is found by the automata of ``langid``, which learn from a bounded labelled text a language, its topic by the clusters of ``topics``, fitted on all texts.
2. Tokens are summed per cell (source, language, topic): a table bounded by the product of the margins' categories.
3. Cell weights (expected uses of a text) are raked to the source shares, and towards the language and topic margins, within
   0 and the source's cap. The total is the largest for which every source can give its share.
4. Each text gets the whole part of its weight as copies and one more with the probability of the rest; the probability's
   threshold is calibrated per source on a histogram of all texts, so the realised shares meet the targets up to a histogram bucket.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.frames import frame
from gossamer.llm.langid import parser_of, text_languages, training_texts
from gossamer.llm.topics import BLOCK_SCHEMA, TopicModel, block_rows, fit_blocks, packed_vectors, vectors_of
from gossamer.session import cut_lineage, spread

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
BUCKETS = 4096
_encodings: dict[str, object] = {}


def encoding_of(path: str):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def sized_texts(documents: DataFrame, tokenizer: str | None = None, training: dict[str, str] | None = None, topics: TopicModel | None = None) -> DataFrame:
    """(doc_id, text_id, n_tokens, topic, source, language) of every text; source trimmed and in lower case, "" if null; language "none" if it is in none.

    Texts are read once: their word vectors are stored in blocks, on which the topics are fitted and then named.
    """
    path = tokenizer or os.path.join(TOKENIZER_DIR, TOKENIZER_FILE)
    training = training_texts(documents) if training is None else training

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding_of(path).encode_ordinary
        parser = parser_of(training) if training else None
        for batch in batches:
            texts = batch["text"].tolist()
            columns = {
                "doc_id": batch["doc_id"].tolist(),
                "text_id": [int(np.frombuffer(xxhash.xxh3_64_digest(t.encode("utf-8", "surrogatepass")), dtype=np.int64)[0]) for t in texts],
                "language": text_languages(parser, texts),
                "n_tokens": [len(encode(t)) for t in texts],
                "source": batch["source"].tolist(),
            }
            yield pd.DataFrame(block_rows(*packed_vectors(texts), columns), columns=[*columns, "sizes", "at", "value"])

    source = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", source.alias("source"))
    blocks = cut_lineage(spread(rows).mapInPandas(run, f"{BLOCK_SCHEMA}, n_tokens array<long>, source array<string>"))
    model = fit_blocks(blocks, sorted(training)) if topics is None else topics

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                named = model.nearest(*vectors_of(row), row.language)
                yield frame(doc_id=row.doc_id, text_id=row.text_id, n_tokens=row.n_tokens, topic=named, source=row.source, language=[x or "none" for x in row.language])

    return blocks.mapInPandas(name, "doc_id long, text_id long, n_tokens long, topic string, source string, language string")


def distinct_texts(sized: DataFrame, wanted: list[str]) -> DataFrame:
    """One row a text: that of its least doc_id among the rows of a ``wanted`` source, if it has one. A hash group is merged by partial
    aggregation, so copies cost no task its memory."""
    row = F.struct((~F.col("source").isin(wanted)).alias("other") if wanted else F.lit(True).alias("other"), "doc_id", "n_tokens", "topic", "source", "language")
    return sized.groupBy("text_id").agg(F.min(row).alias("r")).select("text_id", "r.*").drop("other")


def margin_targets(cells: pd.DataFrame, margin: str, wanted: dict[str, float] | None = None) -> pd.Series:
    """Target share of each category of a margin: the ``wanted`` ones scaled to 1, the corpus's own shares if none are given."""
    natural = cells.groupby(margin)["tokens"].sum()
    if wanted:
        natural = pd.Series({k: float(wanted.get(k, 0.0)) for k in natural.index})
    return natural / natural.sum() if natural.sum() else natural


def cell_weights(cells: pd.DataFrame, targets: pd.DataFrame, rounds: int = 200, margins: dict[str, dict[str, float]] | None = None) -> pd.DataFrame:
    """``cells`` (source, language, topic, tokens) with ``weight``: expected uses of a text, within 0 and the source's cap.

    Source shares hold exactly; language and topic margins are approached as far as the caps allow. ``margins`` gives their target
    shares by category; a margin without has the corpus's own shares, which the change of sources would otherwise shift. A source with no tokens but
    a target makes that share impossible: the others keep their proportions.
    """
    cells = cells.copy()
    targets = targets[targets["target_share"] > 0].groupby("source", as_index=False).agg(target_share=("target_share", "sum"), max_repeats=("max_repeats", "max"))
    cells = cells.merge(targets, on="source", how="inner")
    if cells.empty or not cells["tokens"].sum():
        return cells.assign(weight=0.0)
    held = cells.groupby("source")["tokens"].sum()
    share = cells.drop_duplicates("source").set_index("source")["target_share"]
    share = share / share.sum()
    cap = cells.drop_duplicates("source").set_index("source")["max_repeats"].astype(float)
    total = float((held * cap / share).min())
    want = {"source": share * total}
    for margin in ("language", "topic"):
        want[margin] = margin_targets(cells, margin, (margins or {}).get(margin)) * total
    tokens, caps = cells["tokens"].to_numpy(float), cells["max_repeats"].to_numpy(float)
    w = np.minimum(1.0, caps)
    codes = {m: (cells[m].astype("category").cat.codes.to_numpy(), want[m].reindex(sorted(want[m].index)).to_numpy(float)) for m in want}

    def source_exact(w: np.ndarray) -> np.ndarray:
        code, goal = codes["source"]
        for _ in range(60):
            # Cells at their cap stay; the others of the source share what is missing in proportion.
            got = np.bincount(code, weights=w * tokens, minlength=len(goal))
            full = w >= caps - 1e-12
            fixed = np.bincount(code, weights=np.where(full, w * tokens, 0), minlength=len(goal))
            loose = got - fixed
            grow = np.where(got < goal - 1e-9, np.divide(goal - fixed, loose, out=np.ones_like(goal), where=loose > 0), np.divide(goal, got, out=np.ones_like(goal), where=got > 0))
            shrink = got >= goal - 1e-9
            w = np.minimum(np.where(shrink[code], w * grow[code], np.where(full, w, w * grow[code])), caps)
            if np.abs(np.bincount(code, weights=w * tokens, minlength=len(goal)) - goal).max() <= 1e-9 * total:
                break
        return w

    for _ in range(rounds):
        before = w
        for margin in ("language", "topic"):
            code, goal = codes[margin]
            got = np.bincount(code, weights=w * tokens, minlength=len(goal))
            w = np.minimum(w * np.divide(goal, got, out=np.ones_like(goal), where=got > 0)[code], caps)
        w = source_exact(np.maximum(w, 1e-9))
        if np.abs(w - before).max() < 1e-6:
            break
    return cells.assign(weight=w)


def _plan(targets: DataFrame) -> pd.DataFrame:
    """The targets as they count: sources trimmed and in lower case. A small fixed table."""
    named = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    return named.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").toPandas()


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, margins: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, source, language, topic, n_tokens, copies) of the texts in the mixture, copies from 1 to the source's max_repeats.

    ``targets``: source, target_share, max_repeats, a small fixed table. Null ids and texts never take part, nor do sources
    without a target (null source included); texts collected twice are one text, of a target source if any of its rows is; empty texts have
    no tokens and are left out. The draw is a hash of the text, so a retried task draws the same. An empty corpus or no targets gives no row.
    """
    return _drawn(documents, targets, tokenizer, margins)[0]


def _drawn(documents: DataFrame, targets: DataFrame, tokenizer: str | None, margins: dict[str, dict[str, float]] | None) -> tuple[DataFrame, pd.DataFrame]:
    """The mixture, and the cells of the target sources with their weights."""
    plan = _plan(targets)
    names = plan["source"].unique().tolist()
    texts = cut_lineage(distinct_texts(sized_texts(documents, tokenizer), names).where("n_tokens > 0"))
    # Bounded by sources × languages × topics, whatever the corpus holds.
    cells = texts.where(F.col("source").isin(names) if names else F.lit(False)).groupBy("source", "language", "topic").agg(F.sum("n_tokens").alias("tokens")).toPandas()
    weights = cell_weights(cells, plan, margins=margins)
    spark = documents.sparkSession
    table = spark.createDataFrame(
        [(r.source, r.language, r.topic, float(r.weight), int(r.max_repeats)) for r in weights.itertuples()], "source string, language string, topic string, weight double, cap int"
    )
    u = F.pmod(F.xxhash64("text_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    base = F.floor(F.col("weight") + F.lit(1e-9)).cast("int")
    drawn = texts.join(F.broadcast(table), ["source", "language", "topic"]).withColumn("base", base).withColumn("rest", F.greatest(F.col("weight") - F.col("base"), F.lit(0.0)))
    # A text gets its extra copy if u < rest; score orders texts by how soon they would get it as the threshold grows from 0.
    drawn = drawn.withColumn("score", F.when((F.col("rest") > 1e-9) & (F.col("base") < F.col("cap")), u / F.col("rest")))
    # Even steps up to 4, then steps of equal ratio without an end.
    bucket = F.when(F.col("score") < 4, F.col("score") * F.lit(BUCKETS / 4)).otherwise(F.lit(BUCKETS) + F.log2(F.col("score") / 4) * F.lit(BUCKETS / 4))
    scored = drawn.withColumn("bucket", F.when(F.col("score").isNotNull(), F.floor(bucket).cast("int")))
    held = scored.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("base")).alias("sure")).toPandas()
    goal = (weights["weight"] * weights["tokens"]).groupby(weights["source"]).sum() if len(weights) else {}
    limits = []
    for source, part in held.groupby("source"):
        missing = float(goal[source]) - float(part["sure"].sum())
        part = part.dropna(subset=["bucket"]).sort_values("bucket")
        sums = np.concatenate([[0.0], part["tokens"].to_numpy(float).cumsum()])
        take = int(np.abs(sums - missing).argmin())
        limits.append((source, int(part["bucket"].iloc[take - 1]) if take else -1))
    limit = spark.createDataFrame(limits, "source string, last_bucket int")
    copies = F.col("base") + F.coalesce((F.col("bucket") <= F.col("last_bucket")).cast("int"), F.lit(0))
    mixed = scored.join(F.broadcast(limit), "source").withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "language", "topic", "n_tokens", "copies")
    return mixed, weights


def mixture_shares(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, margins: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(margin, category, target_share, actual_share, n_texts, n_tokens, most_copies) of the margins source, language and topic: every
    target source and every category of the target sources' texts, with zeros if it gave nothing. No texts give the sources alone."""
    mixed, weights = _drawn(documents, targets, tokenizer, margins)
    plan = _plan(targets)
    goals = [("source", str(k), float(v)) for k, v in plan.groupby("source")["target_share"].sum().items()]
    for margin in ("language", "topic"):
        if len(weights) and weights["tokens"].sum():
            goals += [(margin, str(k), float(v)) for k, v in margin_targets(weights, margin, (margins or {}).get(margin)).items()]
    wanted = documents.sparkSession.createDataFrame(goals, "margin string, category string, target_share double")
    sides = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("category")) for m in ("source", "language", "topic")])).alias("side")
    used = F.col("n_tokens") * F.col("copies")
    per = mixed.select(sides, "n_tokens", "copies").groupBy("side.margin", "side.category").agg(F.count("*").alias("n_texts"), F.sum(used).alias("n_tokens"), F.max("copies").alias("most_copies"))
    joined = wanted.join(per, ["margin", "category"], "left")
    total = per.where("margin = 'source'").agg(F.sum("n_tokens")).scalar()
    return joined.select(
        "margin", "category", "target_share", F.coalesce(F.col("n_tokens") / total, F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
