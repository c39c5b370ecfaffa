"""Leakage, mixing and languages."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gossamer.llm import langid, leakage, mixing, topics


# Leakage


def brute_leaks(docs, items, run=leakage.RUN):
    def grams(t):
        w = leakage.words_of(t or "")
        return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}

    held = {i: grams(t) for i, t in items if i is not None}
    return {(d, i) for d, t in docs if d is not None for i, g in held.items() if g & grams(t)}


def leak_case():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(5, 60))) for i in range(25)] + [(100, None), (None, text(30)), (101, ""), (102, "a " * 12), (103, "Same same " * 10)]
    docs = []
    for d in range(120):
        words = text(rng.randint(0, 120)).split()
        source = rng.choice(items)[1]
        if source and rng.random() < 0.6:
            s = source.split()
            n = rng.choice([12, 13, 14, len(s)])
            at = rng.randint(0, max(0, len(s) - n))
            words[rng.randint(0, len(words)) : 0] = s[at : at + n]
        docs.append((d, ", ".join(words).upper() if d % 3 else "  ".join(words)))
    docs += [(500, None), (None, items[0][1]), (501, ""), (502, "same " * 50), (503, " ".join(x for _, x in items if x) * 40)]
    return docs, items


@pytest.mark.parametrize("most", [leakage.MAX_BITS, 1 << 10])
def test_leaks_match_brute_force(spark, monkeypatch, most):
    """Also with filters too small for the items, which only keep more for the join."""
    monkeypatch.setattr(leakage, "MAX_BITS", most)
    docs, items = leak_case()
    d = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("words", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    got = [tuple(r) for r in leakage.leaked_items(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items)


def test_report(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, " ".join(item.split()[:13])), (3, "none of it"), (4, item), (4, item)], "doc_id long, text string")
    row = leakage.leak_report(docs, spark.createDataFrame([(7, item), (8, "never seen anywhere " * 4), (None, item)], "item_id long, text string")).first()
    assert (row["item_id"], row["n_docs"], row["n_whole"], row["max_containment"]) == (7, 3, 2, 1.0)


def test_edited_passages_are_found(spark):
    """Items hidden in long documents with a word changed, dropped or added in about every dozen; recall against brute force."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(rng.choice([12, 25, 40, 70, 110, 200, 400])) for i in range(60)}
    docs = {}
    for d in range(240):
        passage = []
        for w in items[d % 60]:
            move = rng.random()
            passage += [rng.choice(vocabulary)] if move < 0.03 else [] if move < 0.05 else [w, rng.choice(vocabulary)] if move < 0.07 else [w]
        docs[d] = text(rng.randint(0, 600)) + passage + text(rng.randint(0, 600))

    def grams(words):
        return {tuple(words[i : i + leakage.WIDTH]) for i in range(len(words) - leakage.WIDTH + 1)}

    held = {i: grams(w) for i, w in items.items()}
    truth = {(d, i) for d, words in docs.items() for g in [grams(words)] for i, h in held.items() if len(h & g) >= 0.5 * len(h)}
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = leakage.contained(rows, asked, 0.5).groupBy("doc_id", "item_id").agg(F.sum("n_shared").alias("n"))
    got = {(r[0], r[1]) for r in found.collect() if r[2] >= 0.5 * len(held[r[1]])}
    assert len(truth) > 150 and got <= truth and len(got) >= 0.95 * len(truth)


def test_slices_hold_all_texts():
    texts = ["a" * n for n in (3, 4, 10, 1, 1, 0, 9)]
    assert list(leakage.text_slices(texts, 8)) == [(0, 2), (2, 3), (3, 6), (6, 7)] and list(leakage.text_slices([])) == []


def test_partitions_bound_the_chance_to_miss():
    for part in (*leakage.item_partitions(0.5), leakage.run_partition(13)):
        assert (1 - part.similarity) ** part.n_minima <= leakage.MISS * 1.001 or part.n_minima == 512
    shingles = leakage.ordered_shingles([f"w{i}" for i in range(40)], 5)
    by_hand = [(leakage._MULT[0] * shingles[s : s + 9] + leakage._ADD[0]).min() for s in range(0, 36, 9)]
    assert leakage.block_minima(shingles, np.arange(0, 36, 9), 1)[0].tolist() == by_hand


# Mixing


def test_weights_meet_the_shares_within_the_caps():
    cells = pd.DataFrame([("a", "en", "x", 1000.0), ("a", "de", "x", 200.0), ("a", "en", "y", 300.0), ("b", "en", "x", 100.0), ("b", "de", "y", 50.0), ("z", "en", "x", 999.0)], columns=["source", "language", "topic", "tokens"])
    targets = pd.DataFrame([("a", 0.6, 1), ("b", 0.4, 3)], columns=["source", "target_share", "max_repeats"])
    got = mixing.cell_weights(cells, targets)
    mass = (got["weight"] * got["tokens"]).groupby(got["source"]).sum()
    assert mass["a"] / mass.sum() == pytest.approx(0.6, abs=1e-6) and "z" not in mass
    assert (got["weight"] <= got["max_repeats"] + 1e-9).all() and (got["weight"] >= 0).all()
    assert mass.sum() == pytest.approx(min(1500 / 0.6, 450 / 0.4), rel=1e-6)


def test_weights_of_nothing():
    empty = pd.DataFrame(columns=["source", "language", "topic", "tokens"])
    assert mixing.cell_weights(empty, pd.DataFrame([("a", 1.0, 1)], columns=["source", "target_share", "max_repeats"])).empty


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        source = rng.choice(["Web ", "web", "forum", "notes", None, "other"])
        rows.append((i, f"text number {i} " + "word " * rng.randint(5, 60), rng.choice(["en", "DE", None, "fr"]), source))
    rows += [(10_000 + i, rows[i][1], "en", "web") for i in range(200)]  # texts collected twice
    rows += [(20_000 + i, "copied text " * 20, "en", "notes") for i in range(900)]  # a hot text
    rows += [(30_000, None, "en", "web"), (None, "x", "en", "web"), (30_001, "", "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("weight", F.lit(0)).withColumn("copies", F.lit(0)).repartition(5)
    targets = spark.createDataFrame([("web", 0.5, 1), ("forum", 0.3, 2), (" NOTES", 0.2, 3)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_mixture(mixed):
    docs, targets = mixed
    rows = mixing.mixture(docs, targets).toPandas()
    assert rows["doc_id"].is_unique and set(rows["source"]) == {"web", "forum", "notes"}
    caps = {"web": 1, "forum": 2, "notes": 3}
    assert all(1 <= c <= caps[s] for s, c in zip(rows["source"], rows["copies"]))
    texts = docs.select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    used = rows.groupby(rows["doc_id"].map(texts))["copies"].sum()
    assert used.max() <= 3 and rows["doc_id"].map(texts).is_unique
    mass = (rows["n_tokens"] * rows["copies"]).groupby(rows["source"]).sum()
    for source, share in (("web", 0.5), ("forum", 0.3), ("notes", 0.2)):
        assert mass[source] / mass.sum() == pytest.approx(share, abs=0.01)


def test_shares_are_reported(mixed, spark):
    docs, targets = mixed
    rows = mixing.mixture_shares(docs, targets).collect()
    got = {r["category"]: r for r in rows if r["margin"] == "source"}
    for margin in ("source", "language", "topic"):
        assert sum(r["actual_share"] for r in rows if r["margin"] == margin) == pytest.approx(1.0)
        assert sum(r["target_share"] for r in rows if r["margin"] == margin) == pytest.approx(1.0)
    assert got["web"]["most_copies"] == 1
    none = mixing.mixture_shares(docs.limit(0), targets).collect()
    assert {r["n_tokens"] for r in none} == {0} and len(none) == 3


def test_a_copy_in_a_target_source_keeps_its_text(spark):
    docs = spark.createDataFrame([(1, "same words here", "en", None), (2, "same words here", "en", "web"), (3, "same words here", "en", "web"), (4, "other words there", "en", "none such")], "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("web", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert [(r["doc_id"], r["copies"]) for r in mixing.mixture(docs, targets).collect()] == [(2, 2)]


def test_margins_are_raked_to_what_is_asked():
    cells = pd.DataFrame([(s, x, t, 100.0) for s in "ab" for x in ("de", "en") for t in ("t0", "t1")], columns=["source", "language", "topic", "tokens"])
    targets = pd.DataFrame([("a", 0.5, 4), ("b", 0.5, 4)], columns=["source", "target_share", "max_repeats"])
    got = mixing.cell_weights(cells, targets, margins={"language": {"de": 0.45, "en": 0.55}})
    mass = (got["weight"] * got["tokens"]).groupby(got["language"]).sum()
    assert mass["de"] / mass.sum() == pytest.approx(0.5, abs=0.06)  # the caps leave no room: all are used four times
    loose = targets.assign(max_repeats=[4, 40])
    got = mixing.cell_weights(cells, loose, margins={"language": {"de": 0.45, "en": 0.55}})
    assert mixing.margin_targets(cells, "language").to_dict() == {"de": 0.5, "en": 0.5} and len(got) == 8


def test_topics_are_found_apart_from_the_language():
    rng = random.Random(4)
    fields = {"bread": "dough crust oven flour loaf rye malt crumb", "boats": "mast keel rudder anchor harbour tide mooring sail"}
    common = {"en": "this that with from have were their about", "nl": "deze voor niet naar heeft werden hun over"}
    texts, spoken, field = [], [], []
    for i in range(240):
        f, x = rng.choice(list(fields)), rng.choice(list(common))
        # Each field has words of its own in either language.
        words = [w + ("en" if x == "nl" else "") if rng.random() < 0.5 else w for w in rng.choices(fields[f].split(), k=12)] + rng.choices(common[x].split(), k=20)
        rng.shuffle(words)
        texts.append(" ".join(words)), spoken.append(x), field.append(f)
    model = topics.fit_topics(texts, spoken, 2)
    named = model.topics_of(texts, spoken)
    pairs = {(n, f): sum(a == n and b == f for a, b in zip(named, field)) for n in set(named) for f in fields}
    assert len(set(named)) == 2 and sum(sorted(pairs.values())[-2:]) >= 0.9 * len(texts)
    assert model.topics_of(["", "a b c"], ["en", None]) == ["other", "other"] and topics.fit_topics([], []).topics_of(["dough"], [None]) == ["other"] and model.topics_of([], []) == []


def _field_texts(n: int) -> list[str]:
    rng = random.Random(6)
    fields = [[f"{a}{b}word" for b in "abcdefghijklmn"] for a in "bcdfghkl"]
    return [" ".join(rng.choices(fields[rng.randrange(8)], k=14) + rng.choices(["about", "these", "their"], k=4) + ([f"rare{i}"] if i % 9 == 0 else [])) for i in range(n)]


def test_topics_are_fitted_on_all_texts(spark):
    texts = _field_texts(4000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, whole = topics.fitted_topics(docs.repartition(5), {}), topics.fit_topics(texts, [None] * len(texts))
    assert np.allclose(model.weight, whole.weight) and np.allclose(model.centres, whole.centres, atol=1e-4)
    again = topics.fitted_topics(docs.repartition(2), {})
    assert np.array_equal(model.centres, again.centres)  # whatever the partitions
    none = topics.fitted_topics(docs.limit(0), {})
    assert len(none.centres) == 0


def test_blocks_give_the_model_of_their_texts(spark, monkeypatch):
    texts = [*_field_texts(600), "", "a b"]
    spoken = [("en", "nl", None)[i % 3] for i in range(len(texts))]
    monkeypatch.setattr(topics, "BLOCK_TEXTS", 50)
    monkeypatch.setattr(topics, "DIRECT", 3)  # sums in two steps
    ids = list(range(len(texts)))
    rows = list(topics.block_rows(*topics.packed_vectors(texts), {"doc_id": ids, "text_id": ids, "language": spoken}))
    assert len(rows) == 13
    columns = ["doc_id", "text_id", "language", "sizes", "at", "value"]
    blocks = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], topics.BLOCK_SCHEMA).repartition(7)
    model, whole = topics.fit_blocks(blocks, ["en", "nl"]), topics.fit_topics(texts, spoken)
    assert np.allclose(model.centres, whole.centres, atol=1e-4) and all(np.allclose(model.shift[x], whole.shift[x], atol=1e-4) for x in ("en", "nl", None))
    assert model.topics_of(texts, spoken) == whole.topics_of(texts, spoken)


# Languages


def longest_matches(text, training):
    """Phrases of a greedy parse, by substring search."""
    decode = lambda t: "".join(map(chr, langid.encode(t) + 1))
    text, training = decode(text), decode(training)
    count = 0
    for start in range(0, len(text), langid.PIECE):
        piece, at = text[start : start + langid.PIECE], 0
        while at < len(piece):
            n = 1
            while at + n < len(piece) and piece[at : at + n + 1] in training:
                n += 1
            if piece[at : at + n] not in training:
                n = 1
            at += n
            count += 1
        count -= start > 0
    return count


def test_phrases_match_substring_search():
    rng = random.Random(1)
    training = {lang: "".join(rng.choice("abc dé1.") for _ in range(400)) for lang in ("de", "en")}
    texts = ["", "a", "zzz", "abc abc", "".join(rng.choice("abc dé1.x") for _ in range(300)), "ab" * 900]
    parser = langid.CrossParser(training)
    got = parser.phrases(texts)
    for i, text in enumerate(texts):
        for j, lang in enumerate(parser.languages):
            # A character that the training text lacks is skipped by both as a phrase break.
            if all(c in training[lang] for c in text):
                assert got[i, j] == longest_matches(text, training[lang])
    assert (got[0] == 0).all()


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "en-GB": "en", "eng": "en", "deu": "de", "ger": "de", "pt_BR": "pt", " sv ": "sv", "fre": "fr", "unknown": None, "und": None, "": None, "x": None, "da": None, "German": "de"}
    df = spark.createDataFrame(list(cases.items()), "l string, want string")
    assert df.where(~langid.label_language(F.col("l")).eqNullSafe(F.col("want"))).collect() == []


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    training = langid.training_texts(docs)
    assert set(training) <= set(langid.LANGUAGES) and len(training) >= 5
    assert all(len(t) <= langid.TRAIN_CHARS for t in training.values())
    samples = {
        "de": "Die alte Brücke führt über den Bach und wird nach dem ersten Regen immer wieder geprüft.",
        "en": "The old bridge leads across the brook and is checked again and again after the first rain.",
        "fr": "Le vieux pont passe sur la rivière et il est toujours contrôlé après la première pluie.",
        "es": "El puente viejo cruza el río y siempre se revisa después de la primera lluvia del año.",
    }
    parser = langid.CrossParser(training)
    for lang, text in samples.items():
        if lang in training:
            assert parser.languages[int(parser.phrases([text]).argmin())] == lang


def test_rows_of_dirty_documents(spark):
    english, german = "The old bridge leads across the small brook near the village and nobody knows why. ", "Die alte Brücke führt über den kleinen Bach beim Dorf und niemand weiß, warum das so ist. "
    training = {"en": english * 20, "de": german * 20}
    rows = [
        (1, f"{english}\n\n{german}\n\n{english}", "en"), (2, german * 3, None), (3, None, "en"), (4, "", "de"), (5, "12345 !!", "de"), (6, english, "eng"), (7, english, "de-AT"),
        (8, german + "\n\n" + "kurz", "und"), (None, english, "en"), (9, english * 2000, "EN"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("para_no", F.lit(5)).withColumn("label", F.lit("x"))
    got = {(r["doc_id"], r["para_no"]): (r["lang"], r["doc_lang"]) for r in langid.language_rows(df, training).collect()}
    assert got[1, 0] == ("en", "en") and got[1, 2] == ("de", "en") and got[1, 1] == ("en", "en")
    assert got[2, 0] == ("de", "de") and got[9, 0] == ("en", "en")
    assert got[3, 0] == got[4, 0] == got[5, 0] == (None, None)
    assert got[8, 2] == ("de", "de")
    assert None not in {k[0] for k in got}
    assert langid.language_rows(df, {}).where("lang IS NOT NULL").count() == 0


def test_confidence_lies_between_0_and_1(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert langid.language_report(docs).where("confidence < 0 OR confidence > 1 OR confidence IS NULL").count() == 0


def test_clean_training_drops_wrong_labels():
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    text = lambda letters: "\n\n".join(" ".join(word(letters) for _ in range(30)) for _ in range(3))
    rows = [("de", text("abcde"), i) for i in range(20)] + [("en", text("vwxyz"), i) for i in range(20)] + [("de", text("vwxyz"), 20 + i) for i in range(4)]
    clean = langid.clean_training(pd.DataFrame(rows, columns=["label", "text", "rank"]))
    assert not set("vwxyz") & set(clean["de"]) and len(clean["en"]) > 1000
    assert np.isfinite(len(clean["de"]))


TRAINING = {
    "en": "The old bridge leads across the small brook near the village and nobody knows why. People walk over it in the morning and come back in the evening when the lamps are lit. " * 12,
    "de": "Die alte Brücke führt über den kleinen Bach beim Dorf und niemand weiß, warum das so ist. Morgens gehen die Leute hinüber und kommen abends zurück, wenn die Lampen brennen. " * 12,
}


def test_other_languages_and_no_letters_get_null(spark):
    greek = "Η παλιά γέφυρα οδηγεί πάνω από το μικρό ρυάκι κοντά στο χωριό και κανείς δεν ξέρει γιατί. "
    english = TRAINING["en"][:170]
    rows = [(1, greek * 2, "el"), (2, "9" * 90, None), (3, "$%& " * 40, None), (4, f"{english}\n\n{greek}", "en"), (5, f"{greek}\n\n{greek}\n\n{english}", "en"), (6, "旧桥横跨村庄附近的小溪，没有人知道它为什么还在那里，但是每个人都走过它，每天早上和晚上都会有人从桥上走过。", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["para_no"]): (r["lang"], r["confidence"]) for r in langid.language_rows(df, TRAINING).collect()}
    assert [got[k, 0] for k in (1, 2, 3, 5, 6)] == [(None, 0.0)] * 5
    assert got[4, 0][0] == "en" and got[4, 1][0] == "en" and got[4, 2] == (None, 0.0)


def test_segments_within_a_paragraph(spark):
    en = ["The old bridge leads across the small brook near the village and nobody knows why.", "People walk over it in the morning and come back in the evening."]
    de = "Morgens gehen die Leute hinüber und kommen abends zurück, wenn die Lampen brennen."
    rows = [(1, f"{en[0]} {en[1]} {de} {en[0]}\n\n{de}"), (2, " ".join(en)), (3, None), (None, de), (4, ""), (5, "Ok. Ja.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = {(r["doc_id"], r["para_no"], r["seg_no"]): (r["lang"], r["text"]) for r in langid.language_segments(df, TRAINING).collect()}
    assert got[1, 1, 1] == ("en", " ".join(en)) and got[1, 1, 2] == ("de", de) and got[1, 1, 3] == ("en", en[0]) and got[1, 2, 1] == ("de", de)
    assert got[2, 1, 1][0] == "en" and (2, 1, 2) not in got and {k[0] for k in got} == {1, 2, 5}
    assert langid.language_segments(df, {}).where("lang IS NOT NULL").count() == 0


def test_long_paragraphs_need_no_more_phrases():
    """A cut text counts a divided phrase once."""
    text = TRAINING["en"][: 3 * langid.PIECE]
    parser = langid.CrossParser({"en": text})
    assert parser.phrases([text])[0, 0] == 1
