"""Quality rules, language identification, toxicity, licences: against brute force and held-out rows."""

from __future__ import annotations

import functools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexarium.llm import language_id, license_scan, quality_rules, toxicity
from lexarium.llm import queries as q
from lexarium.llm import textbatch as tb

from . import brute

ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"
ODD_ROWS = [(1, None, None, None, None, "x", "y"), (2, "", "en", "s", 0, None, None), (2, "", "en", "s", 0, None, None), (None, "the of and 123", "en", None, 1, None, None), (3, "   \n\t", "xx", "s", 4, None, None), (4, "word " * 30_000, "en", "s", 1, None, None), (5, "12345 ---", "de", "t", 1, None, None)]


def arr(texts):
    return tb.texts_of(pa.array(texts, pa.string()))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "c", "\n"]), max_size=40).map(" ".join), min_size=1, max_size=5))
def test_suffix_arrays_find_all_repeats(texts):
    w = tb.words(arr(texts))
    got = quality_rules.longest_repeats(w.row, w.code)
    want = [brute.repeats(t) for t in texts]
    assert [got[w.row == i].tolist() for i in range(len(texts))] == want
    for k in (1, 2, 3, 6):
        assert quality_rules.covered(w.row, got, k, len(texts)).tolist() == [brute.covered(x, k) for x in want]


def test_quality_columns():
    text = "one two three one two three\n# x\n# x\n \n" + "w " * 3 + "é|é"
    row = quality_rules.measure(arr([text, None, ""])).to_pylist()
    assert row[0]["n_words"] == 14 and row[0]["n_dup_lines"] == 1 and row[0]["n_symbols"] == 3
    assert row[0]["word_chars"] == sum(len(x) for x in text.split())
    assert row[1]["n_words"] == 0 and row[1]["base_failed"] and not row[2]["kept"]


def test_quality_rules_on_odd_rows(spark, odd):
    got = quality_rules.assess(odd)
    assert got.count() == len(ODD_ROWS)
    assert quality_rules.keep_good(odd).count() == 0 and quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.assess(odd.where("false")).collect() == []


def test_quality_keeps_good_labels(spark, small):
    rows = q.op9_quality_rules(spark, small).toPandas().merge(pd.read_parquet(f"{small}/labels.parquet"), on="doc_id")
    long_enough = rows[(rows.quality == 1) & (rows.n_words >= 50)]
    assert long_enough.kept.mean() > 0.97
    assert rows[rows.quality == 0].kept.mean() < 0.7


SENTENCES = {"en": "the house of the king was in the town and they had been there for the day", "de": "das haus des königs war in der stadt und sie sind dort für den tag gewesen", "fr": "la maison du roi était dans la ville et ils y ont été pour la journée"}


def samples(lang, n, seed):
    rnd, words = random.Random(seed), SENTENCES[lang].split()
    return [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(n)]


def test_language_models():
    models = language_id.train({k: samples(k, 30, 1) for k in SENTENCES})
    assert models.languages == ["de", "en", "fr"]
    texts = [t for k in SENTENCES for t in samples(k, 10, 2)]
    lang, score, rejected = language_id.predict(models, arr(texts), np.zeros(30, bool))
    assert lang == [k for k in SENTENCES for _ in range(10)] and score.min() > 0.9 and not rejected.any()
    lang, score, rejected = language_id.predict(models, arr(["", "123", "жзй жзй жзй жзй жзй " * 5]), np.array([True, False, False]))
    assert lang[:2] == ["und", "und"] and score[:2].tolist() == [0, 0] and rejected.all()
    lang, _, _ = language_id.predict(language_id.train({}), arr(["word"]), np.zeros(1, bool))
    assert lang == ["und"]


def brute_kneser_ney(texts, setting):
    """Cross-entropies by recursion over plain counts."""
    words = Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower()))
    counts = {n: Counter() for n in range(1, setting.order + 1)}
    for w, times in words.items():
        padded = f" {w} "
        for i in range(len(padded)):
            if i - setting.order + 1 >= 0:
                counts[setting.order][padded[i - setting.order + 1 : i + 1]] += times
        for n in range(2, setting.order):
            counts[n][padded[:n]] += times if n <= len(padded) else 0
    for n in range(setting.order - 1, 0, -1):
        for g in set(counts[n + 1]):
            counts[n][g[1:]] += 1

    def prob(gram):
        n = len(gram)
        if not n:
            return 1 / setting.alphabet
        c = counts[n]
        rest = [x for g, x in c.items() if g[:-1] == gram[:-1]]
        if not rest:
            return prob(gram[1:])
        ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        return max(c.get(gram, 0) - d, 0) / sum(rest) + d * len(rest) / sum(rest) * prob(gram[1:])

    def entropy(text):
        found = [f" {w} " for w in re.findall(r"[^\W\d_]+", text.lower())]
        steps = [-np.log(prob(p[max(0, i + 1 - setting.order) : i + 1])) for p in found for i in range(1, len(p))]
        return np.mean(steps) if steps else np.nan

    return entropy


@pytest.mark.parametrize("group", [32, 1])
def test_language_models_equal_plain_kneser_ney(group):
    setting = language_id.Training(group=group)
    drawn = {k: samples(k, 8, 3) for k in SENTENCES}
    models = language_id.train(drawn, setting)
    texts = ["the stadt of étaient", "x", "das haus haus", "zzz the"]
    got, _ = language_id.cross_entropies(models, arr(texts))
    for k, lang in enumerate(models.languages):
        entropy = brute_kneser_ney(drawn[lang], setting)
        assert np.allclose(got[:, k], [entropy(t) for t in texts], atol=1e-4), lang


def test_bounded_models_and_ties():
    drawn = {k: samples(k, 30, 1) for k in SENTENCES}
    small = language_id.train(drawn, language_id.Training(grams=40))
    texts = [t for k in SENTENCES for t in samples(k, 5, 2)]
    assert language_id.predict(small, arr(texts), np.zeros(15, bool))[0] == [k for k in SENTENCES for _ in range(5)]
    twins = language_id.train({"b": drawn["en"], "a": drawn["en"], "none": ["123"]})
    assert twins.languages == ["a", "b"] and set(language_id.predict(twins, arr(texts[:5]), np.zeros(5, bool))[0]) == {"a"}


def test_pruned_contexts_sum_to_one():
    letters = "abcdefgh"
    rng = random.Random(4)
    lower = {c: w / 36 for w, c in enumerate(letters, 1)}
    p, back = {}, {}
    for h in "xyz":
        seen = rng.sample(letters, 5)
        back[h] = 0.3
        for c in seen:
            p[h + c] = 0.7 / 5 + 0.3 * lower[c]
    kept = {g for g in p if rng.random() < 0.5} | {"xa" if "xa" in p else next(g for g in p if g[0] == "x")}
    new = language_id.renormalised(kept, p, lambda g: lower[g[1:]])
    for h in {g[0] for g in kept}:
        assert sum(p[h + c] if h + c in kept else new[h] * lower[c] for c in letters) == pytest.approx(1, abs=1e-12)
    whole = language_id.renormalised(set(p), p, lambda g: lower[g[1:]])
    assert all(whole[h] == pytest.approx(0.3) for h in "xyz")


def test_every_language_is_learned_as_train_does(spark):
    rows = [(i, t, f"{k}{v}", "s") for v in range(3) for k in SENTENCES for i, t in enumerate(samples(k, 12, v))]
    docs = spark.createDataFrame(rows + [(99, "123", "none", "s"), (100, None, "de0", "s")], "doc_id long, text string, lang string, source string").repartition(4)
    models = language_id.learn(docs, language_id.Training(group=4), folds=1000)
    assert models.languages == sorted({r[2] for r in rows}) and [g.width for g in models.groups] == [4, 4, 1]
    lang, _, _ = language_id.predict(models, arr([t for t in samples("fr", 5, 9)]), np.zeros(5, bool))
    assert {x[:2] for x in lang} == {"fr"}


def test_language_query_on_held_out_rows(spark, small):
    rows = q.op7_language_id(spark, small).toPandas().merge(pd.read_parquet(f"{small}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert (rows[rows.held_out].lang_pred == rows[rows.held_out].lang).mean() > 0.95


def test_language_on_odd_rows(spark, odd):
    models = language_id.learn(odd)
    got = language_id.identify(odd, models).collect()
    assert len(got) == len(ODD_ROWS) and {r["lang_pred"] for r in got} <= {"und", *models.languages}
    assert language_id.keep_identified(odd, models).columns == odd.columns
    assert language_id.learn(odd.where("false")).languages == []


def toxic_corpus(n=600, seed=5):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(60)]
        if i % 5 == 0:
            t[rnd.randrange(60)] = rnd.choice(["vilewort", "vilewortig", "badword"])
        texts.append(" ".join(t))
        toxic.append(int(i % 5 == 0))
    return texts, np.array(toxic)


def made_index(setting=toxicity.Setting(block=8, neighbours=5)):
    texts, toxic = toxic_corpus()
    features = toxicity._select(texts, toxic, setting)
    n = sum(map(len, features))
    return toxicity.index_of(list(range(len(texts))), texts, toxic, np.ones(len(texts)), features, np.ones(n), setting), texts


def dense(index):
    """The index as a matrix of features and examples."""
    rows = np.zeros((len(index.idf), len(index.toxic)))
    for f in range(len(index.idf)):
        at = slice(index.start[f], index.start[f + 1])
        rows[f, index.ids[at]] = index.weights[at]
    index.unfolded()
    for f in np.flatnonzero(index.row_of >= 0):
        blocks = [rows[f, b : b + index.setting.block].max() for b in range(0, rows.shape[1], index.setting.block)]
        assert np.allclose(index.maxima[index.row_of[f]], blocks)
    return rows


@pytest.mark.parametrize("k", [1, 5, 25, 10_000])
def test_block_max_neighbours_are_exact(k):
    index, texts = made_index()
    row, feat, times = toxicity.featured(arr(texts), index.features, index.first)
    weight = toxicity._vectors(row, feat, times, index.idf, len(texts))
    rows = dense(index)
    for i in np.unique(row)[::17]:
        at = row == i
        ids, sims = index.nearest(feat[at], weight[at], k)
        every = np.where((e := weight[at] @ rows[feat[at]]) > 1e-9, np.round(e, 6), 0)
        want = sorted(np.flatnonzero(every > 0), key=lambda j: (-every[j], j))[:k]
        assert np.allclose(sims, every[want], atol=2e-6) and (ids[0] == want[0])
        assert set(ids[sims > sims[-1] + 1e-5].tolist()) == {j for j in want if every[j] > sims[-1] + 1e-5}


def test_blocks_stay_closed():
    """Two subjects without a common word: the other subject's blocks are never opened."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcd") + rnd.choice("efgh") * 3 + ("x" if i % 2 else "y") + rnd.choice("klmnop") for _ in range(40)) for i in range(640)]
    toxic = np.array([int(i % 10 == 0) for i in range(640)])
    setting = toxicity.Setting(neighbours=5)
    features = toxicity._select(texts, toxic, setting)
    index = toxicity.index_of(list(range(640)), texts, toxic, np.ones(640), features, np.ones(sum(map(len, features))), setting)
    index.opened = index.closed = 0
    toxicity.score_texts(index, arr(texts[:40]))
    assert index.closed >= 0.4 * (index.opened + index.closed)


def brute_score(index, texts, toxic, stands_for, text):
    """The calibrated share of votes, from plain dictionaries."""
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    names = [[s.as_py() for s in f] for f in index.features]

    def vector(t):
        counts = Counter()
        for w in words(t):
            for k, kind in enumerate(toxicity.KINDS):
                f = w if kind == 0 else w[:kind] if len(w) > kind else None
                if f is not None and f in names[k]:
                    counts[index.first[k] + names[k].index(f)] += 1
        got = {f: (1 + np.log(c)) * index.idf[f] for f, c in counts.items()}
        norm = np.sqrt(sum(x * x for x in got.values()))
        return {f: x / norm for f, x in got.items()}

    mine = vector(text)
    if not mine:
        return index.nothing
    sims = sorted(((round(sum(x * v.get(f, 0.0) for f, x in mine.items()), 6), i) for i, v in enumerate(map(vector, texts))), reverse=True)[: index.setting.neighbours]
    votes = [(s * s * stands_for[i], toxic[i]) for s, i in sims if s > 0]
    clean = index.setting.doubt * index.setting.neighbours * np.mean(stands_for)
    return index.calibrated(sum(w * t for w, t in votes) / (sum(w for w, _ in votes) + clean))


def test_scores_equal_plain_votes():
    texts, toxic = toxic_corpus(60, 8)
    setting, stands_for = toxicity.Setting(neighbours=7, block=4), np.where(toxic == 1, 1.0, 3.0)
    features = toxicity._select(texts, toxic, setting)
    index = toxicity.index_of(list(range(60)), texts, toxic, stands_for, features, np.linspace(1, 2, sum(map(len, features))), setting)
    more, _ = toxic_corpus(12, 11)
    got, _ = toxicity.score_texts(index, arr([*more, "zzz", ""]))
    assert np.allclose(got, [brute_score(index, texts, toxic, stands_for, t) for t in [*more, "zzz", ""]], atol=1e-4)


def test_samples_are_bounded_however_ids_repeat(spark):
    rows = [(1, f"text number {i} word{i % 7}") for i in range(300)] + [(2, "vile vile"), (3, "other words here"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    index = toxicity.learn(docs, labels, toxicity.Setting(sample_bytes=2000))
    assert 0 < len(index.names) < 120
    assert toxicity.score(docs, index).count() == len(rows)


def test_toxicity_finds_new_examples():
    index, _ = made_index()
    texts, toxic = toxic_corpus(200, 9)
    score, evidence = toxicity.score_texts(index, arr([*texts, ""]))
    assert ((score[:-1] >= 0.7) == (toxic == 1)).mean() > 0.97
    assert score[-1] == index.nothing < 0.3 and any(evidence)


def test_toxicity_retrieves_examples_without_toxic_words():
    index, texts = made_index()
    assert len(index.names) == len(texts)
    copies = [i for i in range(len(texts)) if i % 5 and i % 7 == 0]
    _, evidence = toxicity.score_texts(index, arr([" ".join(texts[i].split()[:-3]) for i in copies]))
    assert [e[0] for e in evidence] == copies


def test_toxicity_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (2, None, 0), (None, 1, 1), (77, 1, 0)], "doc_id long, toxic int, quality int")
    index = toxicity.learn(odd, labels)
    got = toxicity.score(odd, index).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert toxicity.score(odd.where("false"), toxicity.learn(odd, labels.where("false"))).collect() == []


def test_toxicity_query_on_held_out_rows(spark):
    small = "/root/testdata/sf0.01"
    rows = q.op3_toxicity(spark, small).toPandas().merge(pd.read_parquet(f"{small}/labels.parquet"), on="doc_id")
    held = rows[rows.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]).all()
    found = held[held.predicted == 1]
    assert found.toxic.mean() > 0.9 and (held[held.toxic == 1].predicted.mean()) > 0.6
    again = q.op3_toxicity(spark, small).toPandas().set_index("doc_id").score
    assert again[rows.doc_id].tolist() == rows.score.tolist()


PHRASES = [(p.split(), label) for p, label in license_scan.PHRASES]


whole_scanner = functools.cache(license_scan.Scanner.build)


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    found = [(i, label) for i in range(len(words)) for p, label in PHRASES if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from("mit license apache general public MIT License gnu the é zz".split()), max_size=30).map(lambda w: "-".join(w)), min_size=1, max_size=4))
def test_licence_places(texts):
    scanner = whole_scanner()
    assert [r[:5] for r in license_scan.scan_texts(scanner, arr(texts))] == [brute_places(t) for t in texts]


def notes():
    return license_scan.templates_of(bodies=(), notes=license_scan.licences.NOTES)


def test_matching_statistics():
    scanner, rnd = license_scan.Scanner.build(templates=notes()), random.Random(1)
    sequences = [list(t.words) for t in scanner.templates] + [p for p, _ in PHRASES]
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    words = list(scanner.vocabulary)
    for _ in range(60):
        text = [rnd.choice(words) for _ in range(10)] + rnd.choice(sequences)[:12] + [rnd.choice(words) for _ in range(5)]
        got = [n for _, _, n in scanner.statistics([scanner.vocabulary[w] for w in text], [False] * len(text))]
        assert got == [max(k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in inside) for i in range(len(text))]


def scanned(*texts):
    return license_scan.scan_texts(whole_scanner(), arr(list(texts)))


def test_whole_licences_are_told_apart():
    for label, family, text in license_scan.licences.BODIES:
        row = scanned(f"Copyright (c) 2024 Someone\n{text}\nand more")[0]
        assert label in row[5].split(","), (label, row[5])
        spans = [s for s in row[7] if s["label"] == label]
        assert max(s["covered"] for s in spans) == 1.0 and max(s["end"] - s["start"] + 1 for s in spans) == len(license_scan.words_of(text))
    two, three = (next(t for label, _, t in license_scan.licences.BODIES if label == name) for name in ("BSD-2-Clause", "BSD-3-Clause"))
    assert [r[5] for r in scanned(two, three)] == ["BSD-2-Clause", "BSD-3-Clause"]


def test_sections_of_long_licences():
    whole = {label: license_scan.licences._whole(label) for label in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")}
    names = "GPL,GNU,LGPL,AGPL,MPL,CC0,BSD,MIT,Apache".split(",")
    for label, row in zip(whole, scanned(*whole.values()), strict=True):
        others = {x for x in row[5].split(",") if any(x.startswith(n) for n in names)} - {label}
        assert label in row[5].split(",") and not others, (label, row[5])
    gpl = whole["GPL-3.0"]
    fourth = gpl[gpl.index("4. Conveying Verbatim Copies") : gpl.index("5. Conveying Modified")]
    first = whole["CC0-1.0"][whole["CC0-1.0"].index("2. Waiver.") : whole["CC0-1.0"].index("3. Public License")]
    shared = whole["GPL-2.0"][whole["GPL-2.0"].index("Each time you redistribute the Program") :][:60]
    rows = scanned(fourth, " ".join(fourth.split()[:12]), first, shared)
    assert "GPL-3.0" in rows[0][5].split(",") and rows[1][5] == "" and rows[2][5] == "CC0-1.0" and rows[3][5] == ""


def test_chains_of_many_places():
    chains = [(i, 3 * (i % 7), 2 + i % 5, i // 2) for i in range(30)]
    places = list(range(4, 40, 3))
    slow = [c for at in places for c in license_scan._grown(chains[:30], 32, 4, [at])]
    assert license_scan._grown(chains, 32, 4, places) == slow and len(chains) * len(places) > license_scan.FEW >= len(chains)
    began = time.perf_counter()
    scanned("of this license " * 4_000)
    assert time.perf_counter() - began < 60


def test_edited_licences_and_single_clauses():
    mit = license_scan.licences.MIT
    words = mit.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 25 != 7)
    clause = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    third = license_scan.licences._BSD_THIRD
    rows = scanned(edited, clause, third, " ".join(words[:20]), f"{mit} {'filler ' * 50} {mit}", " ".join(reversed(words)))
    assert [r[5] for r in rows] == ["MIT", "BSD", "BSD-3-Clause", "", "MIT", ""]
    assert rows[0][6] > 0.8 and 0 < rows[3][6] < 0.5
    twice = [s for s in rows[4][7] if s["covered"] == 1.0 and s["end"] - s["start"] > 150]
    assert len(twice) == 2 and twice[0]["end"] < twice[1]["start"]


def brute_chain(words, template, rules):
    """The most words of a template that matches cover which rise in both, with bounded gaps in the text: by longest chains over all common runs."""
    runs = [(i, j) for i in range(len(words)) for j in range(len(template)) if words[i] == template[j] and (not i or not j or words[i - 1] != template[j - 1])]
    found = []
    for i, j in runs:
        k = 0
        while i + k < len(words) and j + k < len(template) and words[i + k] == template[j + k]:
            k += 1
        if k >= rules.least_match:
            found.append((i, j, k))
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a b c d e f g h x y".split()), min_size=1, max_size=40), st.lists(st.sampled_from("a b c d e f g h".split()), min_size=4, max_size=14))
def test_chains_cover_what_common_runs_allow(words, template):
    rules = license_scan.Rules(short=0, covered=0.01)
    scanner = license_scan.Scanner.build(phrases=(), templates=(license_scan.Template("t", "t", tuple(template)),), rules=rules)
    row = license_scan.scan_texts(scanner, arr([" ".join(words)]))[0]
    runs = brute_chain(words, template, rules)
    longest = max((k for _, _, k in runs), default=0)
    assert row[6] >= longest / len(template) - 1e-9 and row[6] <= 1
    assert (row[6] > 0) == bool(runs)
    for span in row[7]:
        inside = words[span["start"] : span["end"] + 1]
        assert len([w for w in inside if w in template]) >= round(span["covered"] * len(template))


def test_licence_notes(spark, odd):
    scanner = license_scan.Scanner.build()
    texts = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License", "nothing here", "licensed under cc by"]
    rows = license_scan.scan_texts(scanner, arr(texts))
    assert [r[5] for r in rows] == ["CC-BY-NC-4.0", "MIT,mit", "", ""] and rows[2][6] == 0
    assert license_scan.scan(odd).count() == len(ODD_ROWS) and license_scan.scan(odd.where("false")).collect() == []


def test_licence_query(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet").set_index("doc_id").text
    for r in q.op5_license_scan(spark, small).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_places(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
