"""Toxicity, mixing and licences: planted signals, held-out rows, calibration."""

import random
import re
import textwrap
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import licenses, mixing, toxicity

BAD = ["vexword", "gorblat", "snarfle"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for n in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        toxic, low = int(n % 7 == 0), int(n % 3 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", ","]))
        if low:
            words += [f"j{rng.randrange(30)}" for _ in range(len(words))]
        rows.append((n, " ".join(words), f"src{n % 5}", 1.0, "x"))
        labels.append((n, 1 - low, toxic))
    rows += [(1000, None, None, 1.0, "x"), (1001, "", "src1", 1.0, "x"), (1002, "W3 Vexword! gorblat", "src1", 1.0, "x"), (1002, "w4 w5", "src1", 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, evidence string")
    return docs, spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).toPandas()
    truth = labels.toPandas().dropna()
    truth = truth[truth.doc_id < 900].astype(int)
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert 120 < len(held) < 240 and (held.predicted == held.toxic).mean() > 0.98
    # Calibrated: the mean score is the share of toxic rows.
    assert abs(held.score.mean() - held.toxic.mean()) < 0.05
    odd = got[got.doc_id == 1002].sort_values("score")
    assert odd.predicted.tolist() == [0, 1] and len(odd.evidence.iloc[1]) == toxicity.NEIGHBOURS
    assert set(odd.evidence.iloc[1]) <= set(truth[truth.toxic == 1].doc_id)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(got[got.predicted == 0].doc_id)


def test_nearest_examples_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    rows = []
    for n in range(700):
        terms = rng.choice(40, rng.integers(1, 6), replace=False).tolist()
        rows.append((n, int(rng.integers(2)), toxicity.unit({t: int(rng.integers(1, 4)) for t in terms}, np.ones(40))))
    index = toxicity.Index(rows, 40)
    for _ in range(60):
        query = toxicity.unit({t: 1 for t in rng.choice(40, rng.integers(1, 6), replace=False).tolist()}, np.ones(40))
        cosine = [(-round(sum(w * r[2].get(t, 0.0) for t, w in query.items()), 12), r[0]) for r in rows]
        want = [i for c, i in sorted(cosine)[:15] if c < 0]
        assert index.ids[index.nearest(query, 15)[0]].tolist() == want


def test_terms_are_whole_words_or_beginnings():
    terms = {t: n for n, t in enumerate(["trash", "lowe*", "a", "ab", "abcd*"])}
    rng = random.Random(0)
    finder = toxicity.Finder(terms)
    for _ in range(2000):
        text = "".join(rng.choice("abcd loweitrash_12² .") for _ in range(rng.randint(0, 20)))
        want = {}
        for word in toxicity.WORD.findall(text.lower()):
            for t in toxicity.terms_of(word):
                if t in terms:
                    want[terms[t]] = want.get(terms[t], 0) + 1
        assert dict(finder(text)) == want


def test_every_document_meets_its_nearest_example(spark):
    """Toxic and clean examples share all their words; copies of them and texts without spaces are searched all the same."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3))
    words = [word() for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(200)] + ["東京都に住む人々", "天気がとても良い"]
    keys = [n for n in range(2000) if zlib.crc32(str(n).encode()) % 5][: len(texts)]
    labels = spark.createDataFrame([(k, n % 2) for n, k in enumerate(keys)], "doc_id long, toxic int")
    copies = [(5000 + n, t) for n, t in enumerate(texts)] + [(9000, "私は京都に住む"), (9001, "qqqq")]
    docs = spark.createDataFrame([*zip(keys, texts), *copies], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[5000 + n].evidence[0] == k for n, k in enumerate(keys))
    assert got[9000].evidence == [keys[-2]] and got[9001].evidence == []


def test_without_labels(spark, labelled, no_docs):
    docs, labels = labelled
    none = labels.where("toxic = 3")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def test_rates_meet_their_targets(labelled):
    docs, labels = labelled
    shares = (0.5, 0.4, 0.1)
    rows = mixing.mixing_rates(docs, labels, shares).toPandas()
    assert len(rows) == docs.count() and (rows.rate >= 0).all()
    assert np.allclose(rows[["p_high", "p_low", "p_toxic"]].sum(axis=1), 1)
    words = rows.n_words.sum()
    for share, name in zip(shares, mixing.DOMAINS):
        assert abs((rows.n_words * rows[f"p_{name}"] * rows.rate).sum() / words - share) < 2e-3
    truth = labels.toPandas().dropna().astype(int)
    own = rows.merge(truth, on="doc_id")
    assert own[own.quality == 1].p_high.mean() > own[own.quality == 0].p_high.mean() + 0.3
    assert rows[rows.doc_id == 1000].n_words.tolist() == [0]


def test_rates_are_those_of_least_squares(spark):
    rng = np.random.default_rng(5)
    own = rng.dirichlet([0.6, 0.4, 0.3], 60)
    words = rng.integers(1, 900, 60)
    members = spark.createDataFrame([(n, int(w), p.tolist()) for n, (w, p) in enumerate(zip(words, own))], "doc_id long, n_words long, posteriors array<double>")
    wanted = np.array([1.0, 0.6, 0.2])
    rates = mixing.fit_rates(members, wanted, relative=True, most=1.0)
    rate = np.ones(60)
    target = wanted * (words[:, None] * own).sum(0)
    scale = 1 / ((words[:, None] * own**2).sum(0))
    for _ in range(20_000):
        rate = np.clip(rate - 0.3 * own @ (scale * ((rate * words) @ own - target)), 0, 1)
    loss = lambda r: (scale * ((r * words) @ own - target) ** 2).sum() / words.sum()
    assert loss(rates.of(own)) < loss(rate) + 1e-3 and (rates.of(own) <= 1).all()


def test_mixing_keeps_columns_and_handles_nothing(labelled, spark):
    docs, labels = labelled
    kept = mixing.sampled(docs, labels, (1.0, 0.2, 0.0))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert mixing.sampled(docs, labels, (1.0, 1.0, 1.0)).count() == docs.count()
    none = docs.where("doc_id < 0")
    assert mixing.sampled(none, labels, (1.0, 0.2, 0.0)).count() == 0
    assert mixing.mixing_rates(none, labels, (1.0, 0.0, 0.0)).count() == 0


def test_ids_of_sampled_rows(spark, labelled):
    """Ids 0 and null are drawn by chance as all others are."""
    docs, labels = labelled
    rows = [(None if n % 2 else 0, f"w{n} w{n % 7} j{n % 30}", "src1") for n in range(600)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string").union(docs.select("doc_id", "text", "source"))
    kept = mixing.sampled(odd, labels, (0.5, 0.5, 0.5)).toPandas()
    assert 0.3 < kept.doc_id.isna().sum() / 301 < 0.7
    assert len(kept[kept.doc_id == 0]) in (0, 1, 300, 301)


def test_licences(spark, no_docs):
    notice = licenses.TEMPLATES["bsd"][1]
    texts = [
        "Licensed under the Apache License, Version 2.0.", "plain words\nReleased under the MIT License.\nmore", "my driving license is old",
        f"x\n{notice}.\nLicensed under CC BY-SA 4.0", "This work is licensed under the GNU General Public License, version 3.",
        "Distributed under the Some Other Software License", None, "", "wir gehen mit dem Hund", "a " * 50_000 + "\nLicensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 2."]
    rows = [(n, t, 1, 2.0) for n, t in enumerate(texts)] + [(0, texts[0], 1, 2.0), (1, None, 1, 2.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int, probability double")
    result = licenses.license_scan(frame)
    got = result.orderBy("doc_id", F.desc("n_notices")).collect()
    want = {0: [["apache-2.0"], ["apache-2.0"]], 1: [["mit"], []], 2: [[]], 3: [["bsd", "cc-by-sa-4.0"]], 4: [["gpl-3.0"]], 5: [[]], 6: [[]],
            7: [[]], 8: [[]], 9: [["cc-by-nc-4.0"]], 10: [["gpl-2.0"]]}
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.families)
        assert (r.probability >= licenses.PROBABILITY) == bool(r.families)
    assert found == want
    plan = result._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.license_scan(no_docs).count() == 0


def test_versions_are_told_apart(spark):
    gpl = "licensed under the GNU General Public License, version {}"
    cc = "licensed under a Creative Commons Attribution{} 4.0 International License"
    given = [(gpl.format(2), "gpl-2.0"), (gpl.format(3), "gpl-3.0"), (cc.format(""), "cc-by-4.0"), (cc.format("-ShareAlike"), "cc-by-sa-4.0"),
             (cc.format("-NonCommercial"), "cc-by-nc-4.0"), ("licensed under the GNU Lesser General Public License, version 2.1", "lgpl"),
             ("licensed under the GNU Lesser General Public License, version 3", "lgpl"), ("licensed under the GNU Affero General Public License, version 3", "agpl-3.0"),
             ("Licensed under CC BY 4.0", "cc-by-4.0"), ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"), ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0")]
    texts = [(before + text + ".", family) for text, family in given for before in ("", "This work is ", "All of it is ")]
    frame = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.families for r in licenses.license_scan(frame).collect()}
    assert [found[n] for n in range(len(texts))] == [[family] for _, family in texts]


def test_ngrams_of_long_paragraphs(spark):
    """Against plain n-grams; 50,000 words of one paragraph take time in proportion to their number."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["License", "version", "2.0", "the", "gnu-x", "of", "permitted", "(c)", "a"]) for _ in range(n)) for n in (0, 1, 2, 3, 40, 50_000)]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: set(r.grams) for r in licenses.with_grams(frame).collect()}
    assert time.time() - start < 60
    for n, text in enumerate(texts):
        words = re.findall(r"[a-z]+[0-9]*(?:-[a-z0-9.]*[a-z0-9])*|[0-9]+(?:\.[0-9]+)*", text.lower())
        plain = {" ".join(words[k : k + size]) for size in (1, 2, 3) for k in range(len(words) - size + 1)}
        assert got[n] == {g for g in plain if re.search(f"(?:^| |-)(?:{licenses.MARKS})", g)}


def test_every_family_has_a_notice_that_is_found(spark):
    notices = [(f, t) for f, texts in licenses.TEMPLATES.items() for t in texts]
    frame = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(notices)], "doc_id long, text string")
    found = {r.doc_id: r.families for r in licenses.license_scan(frame).collect()}
    assert {notices[n][0] for n, families in found.items() if families == [notices[n][0]]} == set(licenses.TEMPLATES)
    assert all(found[n] == ["unlicense"] for n, (family, _) in enumerate(notices) if family == "unlicense")


def test_wrapped_and_double_notices(spark):
    gpl = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as "
           "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
    mit, bsd = licenses.TEMPLATES["mit"][1], licenses.TEMPLATES["bsd"][1]
    mpl = licenses.TEMPLATES["mpl-2.0"][1] + ". If a copy of the MPL was not distributed with this file, you can obtain one at the web site."
    texts = [(gpl.format(""), ["gpl-3.0"]), (gpl.format("Lesser "), ["lgpl"]), (bsd, ["bsd"]), (mit, ["mit"]), (mpl, ["mpl-2.0"])]
    rows = [("Some file\n#\n" + textwrap.fill(t, 40, initial_indent="# ", subsequent_indent="# ") + "\n#\nimport os", want) for t, want in texts]
    rows.append(("You may use it under the Apache License, Version 2.0 or the MIT License.", ["apache-2.0", "mit"]))
    frame = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licenses.license_scan(frame).collect()}
    assert got == {n: want for n, (_, want) in enumerate(rows)}


def test_memory_of_the_toxicity_index():
    """Making an index takes a small part more than the index; copies of all weights would take several times as much."""
    rng = np.random.default_rng(3)
    own = [np.unique((20_000 * rng.random(300) ** 4).astype(np.int32)) for _ in range(4_000)]
    sizes, terms = np.array([len(t) for t in own]), np.concatenate(own)
    examples = toxicity.Examples(np.arange(4_000), rng.integers(0, 2, 4_000), sizes, terms, rng.integers(1, 9, len(terms)).astype(np.uint16))
    model = toxicity.Model({}, np.ones(20_000), examples, (1.0, 1.0), 0.5, 0.5)
    tracemalloc.start()
    index = model.index
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = sum(getattr(index, name).nbytes for name in ("tables", "row", "weight", "starts"))
    assert most < kept + 32 * len(terms), (most, kept, len(terms))
    assert (np.diff(index.row)[np.setdiff1d(np.arange(len(index.row) - 1), index.starts[1:] - 1)] != 0).all()


def test_postings_of_the_toxicity_index_take_few_bytes():
    """Each worker holds them: 12 bytes a posting took executors of the pipeline over their memory."""
    rng = np.random.default_rng(8)
    own = [np.unique((20_000 * rng.random(300) ** 2).astype(np.int32)) for _ in range(3_000)]
    sizes, terms = np.array([len(t) for t in own]), np.concatenate(own)
    counts = np.where(rng.random(len(terms)) < 0.01, rng.integers(2, 40, len(terms)), 1).astype(np.uint16)
    idf = 1 + rng.random(20_000)
    index = toxicity.Index.of(np.arange(3_000), rng.integers(0, 2, 3_000), sizes, terms, counts, idf)
    assert index.row.nbytes + index.weight.nbytes < 4 * len(terms)
    weights = (1 + np.log(counts)) * idf[terms]
    row = np.repeat(np.arange(3_000), sizes)
    weights /= np.sqrt(np.bincount(row, weights * weights))[row]
    for n in range(0, 3_000, 100):
        mine = np.zeros(20_000)
        mine[terms[row == n]] = weights[row == n]
        cosine = np.bincount(row, mine[terms] * weights)
        want = np.lexsort((np.arange(3_000), -np.round(np.minimum(cosine, 1), 12)))[:15]
        at, score = index.nearest({int(t): float(mine[t]) for t in np.flatnonzero(mine)}, 15)
        assert index.ids[at].tolist() == want.tolist() and np.allclose(score, cosine[want], atol=1e-12)


def test_terms_are_packed_whole():
    finder = toxicity.Finder({t: n for n, t in enumerate(["ab", "abcd*", "abcdx", *map(str, range(997)), "zz"])})
    texts = ["", "zz ab abcdx ab", "q", "abcdy " * 300, ""]
    table = finder.table(texts)
    assert all((a == b).all() for a, b in zip(toxicity.unpacked(toxicity.packed(*table)), table))
    assert [dict(finder(t)) for t in texts] == [{}, {0: 2, 1: 1, 2: 1, 1000: 1}, {}, {1: 300}, {}]
    assert [len(x) for x in toxicity.unpacked(toxicity.packed(*finder.table(["", "q"])))] == [2, 0, 0]


def test_toxicity_with_kept_terms_is_the_same(labelled, no_docs):
    docs, labels = labelled
    rows = lambda frame: sorted((r.doc_id, r.held_out, r.score, r.predicted, r.evidence) for r in frame.collect())
    assert str(rows(toxicity.rated(docs, labels))) == str(rows(toxicity.score(docs, toxicity.fit(docs, labels))))
    assert toxicity.rated(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.rated(docs, labels.where("toxic = 3")).collect()} == {0.0}
