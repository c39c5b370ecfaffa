"""Language of documents and paragraphs by cross-parsing entropy.

Of each language a suffix automaton of labelled text is built. A paragraph is parsed greedily into longest matches against each
automaton; the language that needs the fewest phrases a character wins. Paragraphs are parsed together: one transition table holds
all automata, a matrix of states advances all paragraphs in all languages by one character a step.

The labelled rows are a bounded sample (``SAMPLE_DOCS`` a language, by hash of the id, ``SAMPLE_CHARS`` of each), cleaned by
cross-validation because labels lie: a paragraph stays only if automata built from the other half agree with its label.

A text that needs more phrases a character than chance matches would give is in none of the languages and gets null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm.frames import frame
from gossamer.session import spread

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pl", "pt", "sv")
# Spellings of the languages by ISO 639-1, 639-2 (both variants) and English name.
SPELLINGS = {
    "de": ("de", "deu", "ger", "german"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pl": ("pl", "pol", "polish"),
    "pt": ("pt", "por", "portuguese"),
    "sv": ("sv", "swe", "swedish"),
}
SAMPLE_DOCS = 80
SAMPLE_CHARS = 4000
TRAIN_CHARS = 20_000
#: Texts are parsed side by side in pieces of so many characters; a phrase that a cut divides counts once.
PIECE = 1024
#: Most phrases a character against ``TRAIN_CHARS`` of training text, for a text to be in the language: matches of under three
#: characters are chance. Shorter training text matches less, by the ratio of the logarithms.
MOST_RATE = 0.35
#: A paragraph in another language than its document must have so many letters and win by so much over the document's language.
LEAST_LETTERS, LEAST_MARGIN = 40, 0.3
_LIMIT = 0x250
_ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßąćęłńśźżœ0.,'-"
_SIZE = len(_ALPHABET) + 1  # the last code is any other character


def _code_table() -> np.ndarray:
    table = np.full(_LIMIT, _SIZE - 1, dtype=np.uint8)
    for i, c in enumerate(_ALPHABET):
        table[ord(c)] = i
    for c in "123456789":
        table[ord(c)] = _ALPHABET.index("0")
    for c in "\t\n\r\xa0":
        table[ord(c)] = 0
    return table


_CODES = _code_table()


def encode(text: str) -> np.ndarray:
    """Codes of the lower-cased text: letters, blank, digit, a little punctuation, and one code for the rest."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _CODES[np.minimum(points, _LIMIT - 1)]


def suffix_automaton(codes: np.ndarray) -> np.ndarray:
    """Transition table (states × alphabet, -1 for none) of the suffix automaton of a code sequence; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(go), _SIZE), -1, dtype=np.int32)
    for state, moves in enumerate(go):
        for c, to in moves.items():
            table[state, c] = to
    return table


class CrossParser:
    """Phrase counts of texts against one automaton a language."""

    def __init__(self, training: dict[str, str]):
        self.languages = tuple(sorted(training))
        tables, start = [], 0
        self.root = np.zeros(len(self.languages), dtype=np.int32)
        for i, language in enumerate(self.languages):
            t = suffix_automaton(encode(training[language]))
            t[t >= 0] += start
            self.root[i] = start
            start += len(t)
            tables.append(t)
        #: Per language the phrases a character beyond which a text isn't in it.
        self.most = np.array([MOST_RATE * np.log(TRAIN_CHARS) / np.log(min(TRAIN_CHARS, max(100, len(training[x])))) for x in self.languages])
        # States are held as the place of their row, so that a move is one addition and one look.
        table = np.concatenate(tables)
        self.root *= _SIZE
        self.table = np.where(table < 0, -1, table * _SIZE).astype(np.int32).ravel()
        first = self.table.reshape(-1, _SIZE)[self.root // _SIZE].T
        #: (alphabet × languages): where a phrase that begins with a character goes; the root if the language lacks it.
        self.entry = np.where(first < 0, self.root, first).astype(np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts × languages) phrase counts; an empty text has no phrase."""
        pieces: list[np.ndarray] = []
        owner: list[int] = []
        opens: list[int] = []
        for i, text in enumerate(texts):
            codes = encode(text)
            for at in range(0, len(codes), PIECE):
                pieces.append(codes[at : at + PIECE])
                owner.append(i)
                opens.append(at == 0)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int32)
        if not pieces:
            return out
        lengths = np.array([len(p) for p in pieces])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        width = int(lengths[0])
        codes = np.zeros((width, len(pieces)), dtype=np.uint8)
        for row, k in enumerate(order):
            codes[: len(pieces[k]), row] = pieces[k]
        active = np.searchsorted(-lengths, -np.arange(1, width + 1), side="right")
        state = np.tile(self.root, (len(pieces), 1))
        # Each piece but a text's first goes on with the phrase that the cut divided.
        count = np.repeat(np.array(opens, dtype=np.int32)[order][:, None], len(self.languages), axis=1)
        held = np.empty_like(state)
        for t in range(width):
            n = active[t]
            c = codes[t, :n]
            now, nxt = state[:n], held[:n]
            now += c[:, None]
            np.take(self.table, now, out=nxt, mode="clip")
            miss = nxt < 0
            count[:n] += miss
            np.copyto(nxt, self.entry[c], where=miss)
            state, held = held, state
        np.add.at(out, np.asarray(owner)[order], count)
        return out


    def strange(self, phrases: np.ndarray, best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which texts of so many phrases and characters are in none of the languages."""
        return phrases[np.arange(len(best)), best] > self.most[best] * sizes


_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTER = re.compile(r"[\W\d_]+")


def n_letters(text: str) -> int:
    return len(_NO_LETTER.sub("", text))


_parsers: dict[int, CrossParser] = {}


def parser_of(training: dict[str, str]) -> CrossParser:
    """The parser of this training text, built once a process."""
    key = hash(tuple(sorted(training.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(training)
    return _parsers[key]


def text_languages(parser: CrossParser | None, texts: list[str]) -> list[str | None]:
    """The language of each text as a whole; null for texts without letters and those in none of the languages."""
    if parser is None or not texts:
        return [None] * len(texts)
    phrases = parser.phrases(texts).astype(np.float64)
    best = phrases.argmin(axis=1)
    strange = parser.strange(phrases, best, np.array([len(t) for t in texts], dtype=np.float64))
    return [None if bad or not _LETTER.search(t) else parser.languages[b] for t, b, bad in zip(texts, best, strange)]


def label_language(label: Column) -> Column:
    """Two-letter code that a label names in any case, with any region, in two or three letters or in English; else null."""
    stem = F.regexp_extract(F.lower(F.trim(label)), "^([a-z]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(stem.isin(*names), code).otherwise(out)
    return out


def clean_training(rows: pd.DataFrame, train_chars: int = TRAIN_CHARS) -> dict[str, str]:
    """Training text a language from labelled rows (label, text, rank), without the paragraphs that the other half's automata contradict."""
    paragraphs = [(r.label, p, int(r["rank"]) % 2) for _, r in rows.iterrows() for p in r.text.split("\n\n") if len(p) >= 80]
    if not paragraphs:
        return {}

    def joined(keep) -> dict[str, str]:
        out: dict[str, list[str]] = {}
        for (label, p, half), ok in zip(paragraphs, keep):
            if ok:
                out.setdefault(label, []).append(p)
        return {k: "\n".join(v) for k, v in out.items()}

    def cut(texts: dict[str, str], most: int) -> dict[str, str]:
        return {k: v[:most] for k, v in texts.items()}

    languages = sorted({label for label, _, _ in paragraphs})
    keep = np.ones(len(paragraphs), dtype=bool)
    for _ in range(2):
        agrees = np.zeros(len(paragraphs), dtype=bool)
        for half in (0, 1):
            texts = joined([k and h != half for k, (_, _, h) in zip(keep, paragraphs)])
            mine = [i for i, (_, _, h) in enumerate(paragraphs) if h == half]
            if not texts or not mine:
                continue
            even = min(train_chars // 2, max(2000, min(len(v) for v in texts.values())))
            parser = CrossParser(cut(texts, even))
            best = parser.phrases([paragraphs[i][1] for i in mine]).argmin(axis=1)
            for i, b in zip(mine, best):
                # A language that the other half lacks can't be checked.
                agrees[i] = parser.languages[b] == paragraphs[i][0] or paragraphs[i][0] not in parser.languages
        keep = agrees
    clean = joined(keep)
    for language in languages:
        clean.setdefault(language, joined(np.ones(len(paragraphs), dtype=bool))[language])
    # Automata of equal length: otherwise the language with more text matches longer. A language short of text keeps what it has.
    return cut(clean, train_chars)


def training_texts(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, train_chars: int = TRAIN_CHARS) -> dict[str, str]:
    """Cleaned training text a language, at most ``train_chars`` each, from at most ``sample_docs`` labelled documents a language.

    Labels are counted first; texts move only for about four times the rows that the sample takes, however many have a label.
    """
    labelled = documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where("label IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    near = F.lit(False)
    for label, n in counts.items():
        near = near | ((F.col("label") == label) & (place < int(min(1.0, 4 * sample_docs / n) * (1 << 32))))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(place, "doc_id"))
    rows = labelled.where(near).withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("label", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "rank").toPandas()
    return clean_training(rows, train_chars)


def language_rows(documents: DataFrame, training: dict[str, str]) -> DataFrame:
    """(doc_id, para_no, lang, confidence, label, doc_lang): para_no 0 the document's language, from 1 each paragraph's own; its label as given.

    A document's language is that of most characters of its paragraphs, paragraph by paragraph. Confidence: by how much the winner
    undercuts the runner-up's phrases, 0 to 1; a document's is the mean of its paragraphs, weighted by length. A paragraph of
    under ``LEAST_LETTERS`` letters, or that beats its document's language by less than ``LEAST_MARGIN``, has the document's
    language. A paragraph in none of the languages has null, and so has a document most of whose letters stand in such. Null, empty and
    letterless texts, and all texts if ``training`` is empty, get language null and confidence 0. Texts are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = parser_of(training) if training else None
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            paragraphs = [[] if t is None else t.split("\n\n") for t in texts]
            flat = [p for ps in paragraphs for p in ps]
            letters = np.array([n_letters(p) for p in flat], dtype=np.int64)
            sizes = np.array([len(p) for p in flat], dtype=np.float64)
            phrases = parser.phrases(flat).astype(np.float64) if parser and flat else np.zeros((len(flat), 1))
            best = phrases.argmin(axis=1) if len(flat) else np.zeros(0, dtype=np.int64)
            foreign = parser.strange(phrases, best, sizes) if parser and flat else np.zeros(len(flat), dtype=bool)
            doc_id, para_no, lang, confidence, labels, doc_lang = [], [], [], [], [], []
            at = 0

            def add(number: int, language: str | None, sure_of: float, whole: str | None) -> None:
                doc_id.append(doc)
                para_no.append(number)
                lang.append(language)
                confidence.append(max(0.0, float(sure_of)))
                labels.append(label)
                doc_lang.append(whole)

            for doc, label, ps in zip(ids, batch["lang"], paragraphs):
                span = slice(at, at + len(ps))
                at += len(ps)
                own, p, size, strange = best[span], phrases[span], sizes[span], foreign[span]
                usable = letters[span] >= LEAST_LETTERS
                if not parser or not size.sum() or not letters[span].any():
                    add(0, None, 0.0, None)
                    continue
                weigh = size * usable if usable.any() else size
                share = np.bincount(own, weights=weigh * ~strange, minlength=p.shape[1])
                if (weigh * strange).sum() > share.sum():
                    add(0, None, 0.0, None)
                    continue
                top = np.flatnonzero(share == share.max())
                main = int(top[0] if len(top) == 1 else top[p[:, top].sum(axis=0).argmin()])
                second = np.partition(p, 1, axis=1)[:, 1] if p.shape[1] > 1 else p[:, 0] + 1
                sure = 1 - p[np.arange(len(ps)), own] / np.maximum(second, 1)
                differs = usable & ~strange & (own != main) & (p[np.arange(len(ps)), own] <= (1 - LEAST_MARGIN) * p[:, main])
                whole = parser.languages[main]
                add(0, whole, (sure * size).sum() / size.sum(), whole)
                for i in range(len(ps)):
                    if ps[i].strip():
                        if usable[i] and strange[i]:
                            add(i + 1, None, 0.0, whole)
                        else:
                            add(i + 1, parser.languages[own[i] if differs[i] else main], sure[i], whole)
            yield frame(doc_id=doc_id, para_no=para_no, lang=lang, confidence=confidence, label=labels, doc_lang=doc_lang)

    schema = "doc_id long, para_no int, lang string, confidence double, label string, doc_lang string"
    return spread(documents.select("doc_id", "text", "lang").where("doc_id IS NOT NULL")).mapInPandas(run, schema)


_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def language_segments(documents: DataFrame, training: dict[str, str]) -> DataFrame:
    """(doc_id, para_no, seg_no, lang, confidence, text): the segments of one language of every paragraph, both numbered from 1.

    A paragraph is cut into sentences; a sentence of at least ``LEAST_LETTERS`` letters that beats its paragraph's language by ``LEAST_MARGIN`` has its
    own, all others the paragraph's; neighbours of one language are one segment. A paragraph's language is that of most characters of
    its sentences. Language null as in ``language_rows``; blank paragraphs have no segment; null texts neither.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = parser_of(training) if training else None
        for batch in batches:
            units = [(doc, k + 1, s) for doc, text in zip(batch["doc_id"], batch["text"]) for k, p in enumerate(text.split("\n\n")) for s in _SENTENCE.split(p.strip()) if s]
            flat = [s for _, _, s in units]
            sizes = np.array([len(s) for s in flat], dtype=np.float64)
            letters = np.array([n_letters(s) for s in flat], dtype=np.int64)
            phrases = parser.phrases(flat).astype(np.float64) if parser and flat else np.zeros((len(flat), 1))
            best = phrases.argmin(axis=1) if flat else np.zeros(0, dtype=np.int64)
            strange = parser.strange(phrases, best, sizes) if parser and flat else np.ones(len(flat), dtype=bool)
            rows: list[list] = []
            at = 0
            while at < len(units):
                to = at
                while to < len(units) and units[to][:2] == units[at][:2]:
                    to += 1
                p, own, size = phrases[at:to], best[at:to], sizes[at:to]
                told = ~strange[at:to] & (letters[at:to] > 0)
                share = np.bincount(own, weights=size * told, minlength=p.shape[1])
                main = int(share.argmax()) if told.any() else -1
                second = np.partition(p, 1, axis=1)[:, 1] if p.shape[1] > 1 else p[:, 0] + 1
                for i in range(to - at):
                    long = letters[at + i] >= LEAST_LETTERS
                    if long and not told[i] or main < 0:
                        k = -1
                    else:
                        k = int(own[i]) if long and p[i, own[i]] <= (1 - LEAST_MARGIN) * p[i, main] else main
                    sure = 0.0 if k < 0 else max(0.0, float(1 - p[i, k] / max(second[i], 1))) if k == own[i] else 0.0
                    if i and rows[-1][3] == k:
                        last = rows[-1]
                        last[4] = (last[4] * last[6] + sure * size[i]) / (last[6] + size[i])
                        last[5] += " " + flat[at + i]
                        last[6] += size[i]
                    else:
                        rows.append([*units[at][:2], 1 if not i else rows[-1][2] + 1, k, sure, flat[at + i], size[i]])
                at = to
            out = [(d, n, k, None if x < 0 else parser.languages[x], float(c), t) for d, n, k, x, c, t, _ in rows]
            yield pd.DataFrame(out, columns=["doc_id", "para_no", "seg_no", "lang", "confidence", "text"])

    rows = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return spread(rows).mapInPandas(run, "doc_id long, para_no int, seg_no int, lang string, confidence double, text string")


def mixed_segments(documents: DataFrame) -> DataFrame:
    """(doc_id, para_no, seg_no, lang, confidence, n_chars) of the segments of paragraphs that mix languages."""
    rows = language_segments(documents, training_texts(documents))
    mixed = F.max("seg_no").over(Window.partitionBy("doc_id", "para_no")) > 1
    return rows.select("doc_id", "para_no", "seg_no", "lang", "confidence", F.length("text").alias("n_chars"), mixed.alias("mixed")).where("mixed").drop("mixed")


def corrected_labels(documents: DataFrame) -> DataFrame:
    """(doc_id, para_no, lang): para_no 0 for documents whose label is missing, names no language or another than most of the text is in;
    from 1 for paragraphs in another language than their document. Documents without a recognisable language have no row."""
    rows = language_rows(documents, training_texts(documents)).where("lang IS NOT NULL")
    label = label_language(F.col("label"))
    wrong = (F.col("para_no") == 0) & ~F.col("lang").eqNullSafe(label)
    mixed = (F.col("para_no") > 0) & (F.col("lang") != F.col("doc_lang"))
    return rows.where(wrong | mixed).select("doc_id", "para_no", "lang")


def language_report(documents: DataFrame) -> DataFrame:
    """(doc_id, para_no, lang, confidence) of every document and paragraph."""
    return language_rows(documents, training_texts(documents)).select("doc_id", "para_no", "lang", "confidence")
