"""The training-data operators against brute force, and on odd tables."""

import collections
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkcells.llm import ann_tree, chat_rotation, langid, license_scan, line_dedup, packing, quality_rules, simhash, sp_sampling, toxicity
from sparkcells.llm.common import cut
from sparkcells.llm.queries import ORACLES, PIECES, QUERIES, VOCABULARY, vocabulary

SMALL = "/root/testdata/sf0.001"
LONG = "Many words stand here, and ever so many more. " * 8000
ODD = [(1, "Released under the MIT License.\nsame line for everybody here"), (2, None), (3, ""), (None, "same line for everybody here"), (1, "Released under the MIT License.\nsame line for everybody here"),
       (4, LONG), (5, "  \n\t\n"), (6, "same line for everybody here\nSAME LINE FOR EVERYBODY HERE  \nown"), (7, "zwölf Größen 中文 😀 été")]
CLASH = ["id", "key", "node", "own_text", "own_id", "band", "lang", "fp0", "found", "bitmap", "n_words", "sequence_id", "_row_key"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 120").cache()


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_license_scan(docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = {}
    for i, text in pairs(docs):
        own = word.findall(text.translate({k: k + 32 for k in range(65, 91)}))
        at = [(j, t.label) for t in license_scan.PHRASES for j in range(len(own)) if own[j : j + len(t.words)] == t.words]
        want[i] = (len(own), sorted(at))
    got = {r["id"]: (r["n_words"], sorted((x["first"], x["label"]) for x in r["found"] if x["name"].startswith("phrase"))) for r in license_scan.scan(docs).collect()}
    assert got == want


def test_license_scan_bridges_gaps(spark):
    text = "intro words Redistribution and use in source and binary forms, with or without any modification, are permitted provided that following conditions are met end"
    found = license_scan.scan(spark.createDataFrame([(1, text), (2, "redistribution of tea")], "doc_id long, text string")).collect()
    assert [{x["label"] for x in r["found"]} for r in sorted(found, key=lambda r: r["id"])] == [{"bsd"}, set()]


def test_license_scan_tells_rivals_apart(spark):
    """Notices that differ in the one deciding word: the one that covers the text best counts."""
    rows = [(k, "words before. " + t.text + " and words after") for k, t in enumerate(license_scan.NOTICES)]
    found = {r["id"]: {x["label"] for x in r["found"] if not x["name"].startswith("phrase")} for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: {t.label} for k, t in enumerate(license_scan.NOTICES)}


def test_license_scan_odd(odd, empty):
    found = license_scan.scan(odd).collect()
    assert len(found) == len(ODD) and sum(bool(r["found"]) for r in found) == 2
    assert license_scan.scan(empty).count() == 0


def test_quality_counts():
    found = quality_rules.count([b"a b c a b c x", b"", b"one\none\n \n \nTWO # $", "é é é é".encode()])
    assert found["n_words"].tolist() == [7, 0, 5, 4] and found["word_chars"].tolist() == [7, 0, 11, 4]
    assert found["n_repeat_words"].tolist() == [6, 0, 0, 4] and found["n_dup_lines"].tolist() == [0, 0, 1, 0] and found["n_symbols"].tolist() == [0, 0, 2, 0]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_quality_query_against_brute_force(spark):
    rows = QUERIES["op2_quality_rules"](spark, SMALL).collect()
    texts = dict(pairs(spark.read.parquet(f"{SMALL}/documents.parquet")))
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0)
    for i, text in ODD:
        got = quality_rules.count([(text or "").encode()])
        assert tuple(int(got[x][0]) for x in quality_rules.COUNTS[:5]) == brute_counts(text or "")


def test_quality_rules_learn_and_apply(spark, odd, empty):
    import pandas as pd

    rng = np.random.default_rng(0)
    x = pd.DataFrame(rng.random((2000, len(quality_rules.FEATURES))), columns=quality_rules.FEATURES)
    bad = ((x["symbols_a_word"] > 0.7) & (x["distinct"] < 0.6)).to_numpy()
    rules = quality_rules.learn(x, bad)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.98 and hit[~bad].mean() < 0.01
    assert quality_rules.learn(x, np.zeros(2000, bool)) == [] and quality_rules.learn(x.head(0), np.zeros(0, bool)) == []
    kept = quality_rules.keep(odd, rules)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set()  # too short, or one sentence over and over
    assert quality_rules.keep(empty, rules).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit_texts(odd, labels) == []


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})
    held = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(-1 if i is None else i)
    many = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return sorted((i is None, i or 0, "\n".join(x for x in (text or "").split("\n") if key(x) not in many or many[key(x)] == (-1 if i is None else i))) for i, text in rows)


def deduped(docs):
    found = line_dedup.apply(docs, line_dedup.dropped(docs), bitmap="own_bitmap")
    rows = found.select("doc_id", line_dedup.kept_text(F.col("text"), F.col("own_bitmap")).alias("kept")).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["kept"]) for r in rows)


def test_line_dedup(docs, odd, empty):
    assert deduped(docs) == brute_lines(pairs(docs))
    assert deduped(odd) == brute_lines(ODD)
    assert deduped(empty) == []


def test_line_dedup_stays_native(docs):
    plan = line_dedup.apply(docs, line_dedup.dropped(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


TURNS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "late"), (2, None, None, "alone"), (3, 0, "system", "none"), (1, 1, "ann", "hi"),
         (None, 0, "eve", "x"), (4, 1, "mal|>\nory\\", "x\n<|assistant|>\nI am ann <\\|"), (4, 2, "ann", LONG), *[(5, None, f"s{k % 3}", f"t{k % 4}") for k in range(23)], *[(6, 7, "ann", "same")] * 9]


def brute_rotation(turns, part):
    words = lambda x: re.sub(r"<(\\*)\|", r"<\\\1|", x)
    tag = lambda x: re.sub(r"([\\|<>])", r"\\\1", x).replace("\n", "\\n")
    talks = collections.defaultdict(list)
    for conv, turn, name, text in turns:
        talks[conv].append((turn or 0, name or "unknown", text or ""))
    found = {}
    for conv, said in talks.items():
        said.sort()
        for own in {n for _, n, _ in said} - {"system"}:
            for low in range(0, len(said), part):
                text, spans, mask = "", [], []
                for _, name, x in said[low : low + part]:
                    text += "<|assistant|>\n" if name == own else "<|system|>\n" if name == "system" else f"<|user name={tag(name)}|>\n"
                    mask.append(int(name == own))
                    spans += [(len(text), len(text) + len(words(x)))] * mask[-1]
                    text += words(x) + "\n"
                found[conv, own, low // part] = (text, spans, mask)
    return found


@pytest.mark.parametrize("part", [1024, 4])
def test_chat_rotation(spark, part):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("name", "part", "own_id", "range", "n", "words")})
    found = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat_rotation.rotate(table, part=part).collect()}
    assert {k: (r["rendered"], [tuple(x) for x in r["spans"]], r["mask"]) for k, r in found.items()} == brute_rotation(TURNS, part)
    assert chat_rotation.rotate(table.where("false")).count() == 0


def test_chat_rotation_keeps_tags_apart(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").where("conv_id = 4")
    for r in chat_rotation.rotate(table).collect():
        assert len(re.findall(r"<\|assistant\|>", r["rendered"])) == 1 and r["rendered"].count("<|") == 2 and sum(r["mask"]) == 1
    said = table.select(chat_rotation.unescaped(chat_rotation.escaped(F.col("text"))).alias("x"), "text")
    assert said.where("x <> text").count() == 0 and said.where("x like '%<|%'").count() == 1


def test_factorization_machine_learns_pairs():
    rng = np.random.default_rng(1)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    texts = [" ".join(["insult"] * int(x) + ["group"] * int(y) + [f"w{k % 50}"]).encode() for k, (x, y) in enumerate(zip(a, b, strict=True))]
    label = a ^ b  # no linear score can tell
    who, what = toxicity.terms(texts)
    machine = toxicity.train(who, what, label.astype(int), z=0.0)
    assert ((machine.scores(texts) >= 0.5) == label).mean() > 0.95


def test_factorization_machine_learns_pairs_as_it_is_used():
    rng = np.random.default_rng(1)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    texts = [" ".join(["insult"] * int(x) + ["group"] * int(y) + [f"w{k % 50}", f"z{k % 37}"]).encode() for k, (x, y) in enumerate(zip(a, b, strict=True))]
    label = a ^ b
    machine = toxicity.train(*toxicity.terms(texts), label.astype(int))
    assert ((machine.scores(texts) >= 0.5) == label).mean() > 0.95


def test_factorization_machine_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["insult", "group", "kind", "word", "thing", "another", "longerword"], 6)).encode() for _ in range(300)] + [b"", b"unknown only"]
    who, what = toxicity.terms(texts)
    machine = toxicity.train(who, what, (rng.random(302) < 0.4).astype(int), prior=0.2)
    place = {int(p): k for k, p in enumerate(machine.places)}
    for k, got in enumerate(machine.scores(texts)):
        own = [place[int(p)] for p in what[who == k] if int(p) in place]
        raw = machine.bias + sum(machine.weights[i] for i in own) + sum(machine.factors[i] @ machine.factors[j] for n, i in enumerate(own) for j in own[:n])
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-9
    assert len(machine.places) and np.abs(machine.factors).max() > 0


def test_factorization_machine_finds_insults_with_groups():
    """Neither term tells anything alone, and both stand among much else."""
    rng = np.random.default_rng(5)
    n = 6000
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    noise = [" ".join(f"w{x}" for x in rng.integers(0, 400, 12)) for _ in range(n)]
    texts = [f"{'insult' if x else 'praise'} {t} {'thatgroup' if y else 'thatthing'}".encode() for x, y, t in zip(a, b, noise, strict=True)]
    label = a == b
    learn = np.arange(n) % 5 != 0
    who, what = toxicity.terms([t for t, x in zip(texts, learn, strict=True) if x])
    machine = toxicity.train(who, what, label[learn].astype(int))
    assert ((machine.scores([t for t, x in zip(texts, learn, strict=True) if not x]) >= 0.5) == label[~learn]).mean() > 0.95


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op5_toxicity_fm"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    order = found["score"].rank()
    p = found["toxic"].sum()
    assert (order[found["toxic"] == 1].sum() - p * (p + 1) / 2) / (p * (len(found) - p)) > 0.75


def test_toxicity_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    constant = toxicity.fit(odd, none)
    rows = spark.createDataFrame([(1000 + k, f"{'bad' if k % 2 else 'good'} words here {k % 7}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(1000 + k, k % 2) for k in range(400)] + [(1, 0), (4, 1), (None, 1), (6, None)], "doc_id long, toxic int").unionByName(spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    every = odd.unionByName(rows.union(rows.limit(40)), allowMissingColumns=True)
    trained = toxicity.fit(every, labels)
    assert len(trained.places)
    for machine in (constant, trained):
        found = toxicity.score(odd, machine, ["doc_id", "key", "own_text"])
        assert found.count() == len(ODD) and found.where("score between 0 and 1").count() == len(ODD)
        assert found.where("doc_id = 1").select("score").distinct().count() == 1
        assert found.where("doc_id in (2, 3)").select("score").distinct().count() == 1
        assert toxicity.score(empty, machine, empty.columns, name="own").count() == 0
    again = toxicity.fit(every.repartition(7), labels)
    assert (again.factors == trained.factors).all() and (again.weights == trained.weights).all()  # the order of arrival doesn't matter


@pytest.mark.parametrize("options", [{}, {"sample": 120, "leaf": 60, "leaf_rows": 25}])
def test_nearest_recall_and_scores(spark, options):
    """Every fifth row asks; the second case grows its leaves on."""
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = table.orderBy("vec_id").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    got = ann_tree.nearest(table, F.col("vec_id") % 5 == 0, **options).toPandas()
    hits = 0
    for i in np.flatnonzero(ids % 5 == 0):
        score = ann_tree.cosine(x, np.broadcast_to(x[i], x.shape))
        score[i] = -9
        best = ids[np.lexsort((ids, -score))[:5]]
        own = got[got["query_id"] == ids[i]].sort_values("rank")
        hits += len(set(best) & set(own["vec_id"]))
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and own["score"].is_monotonic_decreasing
        assert np.allclose(own["score"], score[np.searchsorted(ids, own["vec_id"])], atol=1e-13)
    assert hits >= 0.9 * len(got)


def test_nearest_ties_across_leaves(spark):
    """Clusters with equal scores in many small leaves: ties go to the smaller id wherever its row lies."""
    rng = np.random.default_rng(2)
    rows = [(int(k), (np.round(rng.normal(size=4)) * (1 + k % 3)).tolist()) for k in range(600)]
    rows = [(k, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for k, v in rows]
    got = ann_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, sample=200, leaf=10, leaf_rows=20, recall=1.0).toPandas()
    x = np.array([v for _, v in rows])
    for q in range(0, 600, 50):
        score = np.round(ann_tree.cosine(x, np.broadcast_to(x[q], x.shape)), 12)
        score[q] = -9
        best = np.lexsort((np.arange(600), -score))[:5]
        own = got[got["query_id"] == q].sort_values("rank")
        assert np.allclose(own["score"], score[best], atol=1e-11)


def test_grown_tree_descends_to_its_parts():
    rng = np.random.default_rng(1)
    unit = ann_tree._unit(rng.normal(size=(400, 6)))
    tree = ann_tree.build(unit, leaf=100)
    leaves = tree.descend(unit)
    grown = ann_tree.grown(tree, {int(k): ann_tree.build(unit[leaves == k], leaf=10) for k in np.unique(leaves)})
    after = grown.descend(unit)
    assert len(grown.leaves) > len(tree.leaves) and np.bincount(after).max() <= 40 and (grown.n[after] == 0).all()
    walked = grown.walk(unit[:5], len(grown.leaves))
    assert all(sorted(x) == sorted(grown.leaves.tolist()) for x in walked)


def test_nearest_odd(spark):
    v = [1.0, 2.0]
    rows = [(0, v), (50, [2.0, 4.0]), *[(k, [3.0, 1.0]) for k in range(1, 30)], (100, None), (150, [0.0, 0.0]), (200, [float("nan"), 1.0]), (250, [1.0, None]), (300, [1.0, 2.0, 3.0]), (None, v), (0, v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "vector", "leaf")})
    found = ann_tree.nearest(table, F.col("vec_id") % 50 == 0).collect()
    assert {r["query_id"] for r in found} == {0, 50}
    assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == 0), key=lambda r: r["rank"])] == [50, 1, 2, 3, 4]
    assert ann_tree.nearest(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_with_repeated_ids(spark):
    near = [(1, [1.0, 0.01 * j]) for j in range(12)]  # one id, many near vectors
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (50, [1.0, 0.5]), (50, [1.0, 0.5]), *near, *near, *[(k, [1.0, float(k)]) for k in range(2, 9)]]
    found = ann_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50)}
    assert got == {0: [1, 50, 2, 3, 4], 50: [1, 0, 2, 3, 4]}
    hot = [(0, [1.0, 2.0]), (50, [2.0, 4.0]), *[(k, [3.0, 1.0]) for k in range(1, 30)], (0, [1.0, 2.0])]
    found = ann_tree.nearest(spark.createDataFrame(hot, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 50] == [0, 1, 2, 3, 4]


def enumerated(own, segment):
    """The chance of every segmentation of a stretch, from the pieces' scores alone."""

    def paths(i):
        if i == len(segment):
            yield (), 0.0
        for j in range(i + 1, len(segment) + 1):
            piece = own.score.get(segment[i:j])
            if piece is None and j == i + 1:
                piece = (*own._bytes(segment[i]), own.unknown)
            if piece is not None:
                for rest, more in paths(j):
                    yield tuple(piece[:-1]) + rest, piece[-1] + more

    found = dict(paths(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {ids: np.exp(x - total) for ids, x in found.items()}


@pytest.mark.parametrize("text", ["there", "an ode", "été"])
def test_sampling_matches_the_distribution(text):
    """Order, distinctness, decoding, and how often each segmentation is first and among the three."""
    own = sp_sampling.Vocabulary(vocabulary(PIECES))
    chance = {(): 1.0}
    for segment in own.segments(text):
        chance = {a + b: p * q for a, p in chance.items() for b, q in enumerated(own, segment).items()}
    assert abs(sum(chance.values()) - 1) < 1e-9
    first, seen, score = collections.Counter(), collections.Counter(), collections.defaultdict(float)
    draws = 4000
    drawn = own.samples([text] * draws, np.arange(draws, dtype=np.int64) * 7919 + 13, 3)
    rows = [[(tuple(np.split(x.ids, np.cumsum(x.n_ids)[:-1])[i]), x.logs[i], x.perturbed[i], x.inclusion[i]) for x in drawn] for i in range(200)]
    for row in rows:
        assert len({x[0] for x in row}) == min(3, len(chance)) and all(own.decode(list(x[0])) == text for x in row)
        assert [x[2] for x in row] == sorted((x[2] for x in row), reverse=True)
        assert all(abs(np.exp(x[1]) - chance[x[0]]) < 1e-9 for x in row)
    for k, x in enumerate(drawn):
        for ids, inclusion in zip(np.split(x.ids, np.cumsum(x.n_ids)[:-1]), x.inclusion, strict=True):
            first[tuple(ids)] += k == 0
            seen[tuple(ids)] += 1
            score[tuple(ids)] += chance[tuple(ids)] / inclusion
    keys = sorted(chance, key=chance.get)[::-1][:400]
    p = np.array([chance[k] for k in keys])
    noise = np.random.default_rng(0).gumbel(size=(20000, len(p))) + np.log(np.maximum(p, 1e-300))
    within = (np.argpartition(-noise, 3, 1)[:, :3][:, :, None] == np.arange(len(p))).any(1).mean(0)
    for k, want, inside in list(zip(keys, p, within, strict=True))[:5]:
        assert abs(first[k] / draws - want) < 0.03 and abs(seen[k] / draws - inside) < 0.04
        assert abs(score[k] / draws - want) < 0.06  # the inclusion score makes the sum of chances unbiased


def test_sampling_takes_all_where_there_are_few():
    own = sp_sampling.Vocabulary(vocabulary(PIECES))
    likely = lambda x: {ids for ids, p in enumerated(own, own.segments(x)[0]).items() if p > 1e-9}
    text = next(x for x in ("an", "the", "of", "in", "été", "is") if 1 < len(likely(x)) < 9)
    want = likely(text)
    for seed in range(20):
        found = own.sample(text, 12, seed)
        assert {tuple(x[0]) for x in found} == want and len(found) == len(want) and all(x[3] == 1 for x in found)


def test_sampling_is_by_row():
    """A row's segmentations don't depend on its batch."""
    texts = ["", "some words here", LONG[:5000], "zwölf Größen 中文 😀 été", "x" * 300, "  \n\t\n", "a▁b"]
    seeds = np.arange(len(texts), dtype=np.int64) * 31 - 5
    own = sp_sampling.Vocabulary(vocabulary(PIECES))
    batch = own.samples(texts, seeds, 3)
    for i, (text, seed) in enumerate(zip(texts, seeds.tolist(), strict=True)):
        alone = sp_sampling.Vocabulary(vocabulary(PIECES)).sample(text, 3, seed)
        for (ids, log, value, chance), x in zip(alone, [x for x in batch if i in x.rows], strict=True):
            at = int(np.flatnonzero(x.rows == i)[0])
            assert np.split(x.ids, np.cumsum(x.n_ids)[:-1])[at].tolist() == ids and (x.logs[at], x.perturbed[at], x.inclusion[at]) == (log, value, chance)


def test_sampling_keeps_what_is_met_again(monkeypatch):
    """A store that runs over drops what was met once; common words aren't looked up anew."""
    own = sp_sampling.Vocabulary(vocabulary(PIECES), kept=4000)
    looked = []
    pieces = own._pieces
    monkeypatch.setattr(own, "_pieces", lambda codes, *more: looked.append(len(codes)) or pieces(codes, *more))
    common = " ".join(LONG[:400].split()[:30])
    rare = [" ".join("".join(x) for x in np.random.default_rng(k).choice(list("aehinorst"), (60, 9))) for k in range(12)]
    sizes = []
    for text in rare:
        own.samples([common] * 3 + [text], np.arange(4), 3)
        looked.clear()
        own.samples([common], np.arange(1), 3)
        sizes.append(sum(looked))
    assert sum(sizes) == 0


def test_sampling_bounds_few_edges(monkeypatch):
    """Bounds are worked out near a path's start, where the largest are; the rest of a long text needs none."""
    own = sp_sampling.Vocabulary(vocabulary(PIECES))
    numbers = []
    uniform = sp_sampling._uniform
    monkeypatch.setattr(sp_sampling, "_uniform", lambda base, place: numbers.append(len(place)) or uniform(base, place))
    text = " ".join(["there and over another interesting segmentation"] * 500)
    drawn = own.samples([text], np.array([5]), 3)
    assert drawn[0].sizes[0] > 3000 and sum(numbers) < 1500
    monkeypatch.setattr(sp_sampling, "SPREAD", 1e9)  # all bounds
    for x, y in zip(drawn, own.samples([text], np.array([5]), 3), strict=True):
        assert x.ids.tolist() == y.ids.tolist() and (x.logs == y.logs).all() and (x.perturbed == y.perturbed).all() and (x.inclusion == y.inclusion).all()


def test_sampling_with_equal_hashes_and_small_stores(monkeypatch):
    """Neither hashes of stretches that clash nor a store that runs over change a result."""
    texts = ["some words here", "", "here words some", LONG[:3000], "zwölf 中文 😀 中文", "x" * 300, "a▁b some", "", "here"]
    seeds = np.arange(len(texts), dtype=np.int64) * 17 + 3
    drawn = lambda own: [[a.tolist() for a in (x.rows, x.ids, x.n_ids, x.logs, x.perturbed, x.inclusion)] for x in own.samples(texts, seeds, 3)]
    want = drawn(sp_sampling.Vocabulary(vocabulary(PIECES)))
    for kept in (0, 500, 5000):
        own = sp_sampling.Vocabulary(vocabulary(PIECES), kept=kept)
        assert all(drawn(own) == want for _ in range(4))
    monkeypatch.setattr(sp_sampling.Vocabulary, "_hashed", staticmethod(lambda codes, begin, sizes: sizes.astype(np.uint64) % np.uint64(2)))
    own = sp_sampling.Vocabulary(vocabulary(PIECES), kept=500)
    assert all(drawn(own) == want for _ in range(4))


def test_sampling_round_trips(odd, empty):
    path = vocabulary(PIECES)
    found = sp_sampling.sampled(odd, path, [F.col("doc_id")], ["doc_id", "key", "own_text"])
    assert found.where("not round_trip").count() == 0
    assert found.where("doc_id = 4").count() == 3  # the very long text too
    assert found.where("doc_id = 2 or doc_id = 3").count() == 2
    assert found.where("doc_id = 1").groupBy("sample").agg(F.count_distinct("ids").alias("n")).where("n <> 1").count() == 0  # seeded by the key
    assert sp_sampling.sampled(empty, path, [F.col("doc_id")], ["doc_id"]).count() == 0
    assert sp_sampling.Vocabulary(path).sample("a▁b é\n中", 1, 1)[0][0]


def test_packing(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    path = vocabulary(VOCABULARY)
    exact = Tokenizer.from_file(path)
    special = spark.createDataFrame([(1, "hello <|endoftext|> world"), (2, "<|endoftext|>"), (3, "a<|endoftext|><|endoftext|> b 中 <|endof"), *[(None, "same words")] * 90], "doc_id long, text string")
    assert exact.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    for table in (docs, odd, special):
        made = cut(packing.pieces(table, path))
        packed = packing.pack(made, group=50)
        found = packed.toPandas().sort_values(["sequence_id", "offset"])
        assert (found.groupby("sequence_id")["length"].sum() <= 1024).all()
        assert (found["offset"] == found.groupby("sequence_id")["length"].cumsum() - found["length"]).all()
        want = collections.Counter()
        for i, text in pairs(table):
            ids = np.array([*exact.encode(text, add_special_tokens=False).ids, 2], "<u4")
            cuts = [0, *range(len(ids) - (-(-len(ids) // 1024) - 1) * 1024, len(ids) + 1, 1024)]
            want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
        got = collections.Counter((None if i != i or i is None else int(i), *rest) for i, *rest in found[["id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
        assert got == want
    assert found["sequence_id"].nunique() > 1 and (found["sequence_id"].max() >> 32) > 0  # copies of one row meet several groups
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_best_fit_holds_every_capacity():
    lengths = np.random.default_rng(2).integers(1, 1024, 3000)
    for rule in ("dot", "norm"):
        bins = packing.best_fit(lengths, (1024.0, 4.0, 400_000.0), (1.0, 0.2, 0.2), rule)
        free = lengths**2 <= 400_000
        assert np.bincount(bins, lengths).max() <= 1024 and np.bincount(bins).max() <= 4
        assert np.bincount(bins[free], lengths[free] ** 2).max() <= 400_000
    # tokens alone: a sequence can't hold more documents than tokens or cost more than its square, so these never bind
    bins = packing.best_fit(lengths, (1024.0, 1024.0, 1024.0**2), (1.0, 0.05, 0.05))
    free = packing.best_fit(lengths, (1024.0, 1e9, 1e18), (1.0, 0.05, 0.05))
    bound = packing.best_fit(lengths, (1024.0, 2.0, 0.8 * 1024**2), (1.0, 0.05, 0.05))
    assert bins.max() <= 1.01 * free.max() and bound.max() > bins.max()
    assert bins.max() + 1 <= 1.02 * lengths.sum() / 1024


def brute_groups(rows):
    def own(text):
        found = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
        shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
        bits = [sum(xxhash.xxh64_intdigest(x, 42) >> k & 1 for x in shingles) * 2 > len(shingles) for k in range(64)]
        return sum(1 << k for k, x in enumerate(bits) if x)

    prints = [own(text) for _, text in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((i is None, i or 0, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root, strict=True))


def test_simhash(docs, odd, empty):
    for table in (docs, odd):
        got = simhash.near_duplicates(table, words=3, bits=2).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got) == brute_groups(pairs(table))
    assert simhash.near_duplicates(empty).count() == 0


def brute_components(prints, bits):
    """The smallest index reachable over pairs at most ``bits`` apart."""
    label = np.full(len(prints), -1)
    for seed in range(len(prints)):
        front = [seed] if label[seed] < 0 else []
        while front:
            i = front.pop()
            label[i] = seed
            hit = np.flatnonzero((np.bitwise_count(prints ^ prints[i]) <= bits) & (label < 0))
            label[hit] = seed
            front += hit.tolist()
    return label


def test_cells_lose_no_pair():
    rng = np.random.default_rng(4)
    one = int(simhash.REFERENCES[0])
    for bits in (1, 2, 3):
        groups = simhash.exact_cells(bits)
        for _ in range(300):
            x = int(rng.integers(0, 1 << 63))
            y = x ^ sum(1 << int(k) for k in rng.choice(64, bits, replace=False))
            unlike = [[(z ^ one) >> 2 * k & 3 for k in range(simhash.BLOCKS)] for z in (x, y)]
            counts = [[v.bit_count() for v in z] for z in unlike]
            assert any(all(counts[0][k] == counts[1][k] for k in group) for group in groups)


@pytest.mark.parametrize("hot", [4096, 40])
def test_pivot_links_against_brute_force(spark, hot):
    """Random fingerprints, and one dense group whose cells are split into slabs."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base[rng.integers(0, 400, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    dense = np.full(600, base[0])
    for _ in range(5):
        dense ^= np.uint64(1) << rng.integers(0, 24, 600, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, near, dense]))
    for bits in (1, 2):
        rows = spark.createDataFrame([(int(k), int(x)) for k, x in enumerate(prints.view(np.int64))], "node long, fp0 long")
        table = simhash.pivot_table(rows)
        some = table.where("node = 7").first()
        far = np.array([some[w] for w in simhash.WORDS], np.int64).view(np.uint8)
        assert (far == np.bitwise_count(simhash.REFERENCES ^ prints[7])).all()
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(simhash.celled(table, bits, hot), bits)).collect()}
        assert [roots.get(k, k) for k in range(len(prints))] == brute_components(prints, bits).tolist()


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(chain).collect()} == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_one_of_each(spark, odd):
    assert simhash.one_of_each(odd).select("doc_id").where("doc_id = 1").count() == 1
    words = [f"w{k}" for k in range(400)]
    near = words.copy()
    near[200] = "changed"
    rows = spark.createDataFrame([(5, " ".join(words)), (9, " ".join(near)), (7, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(rows).collect()) == [5, 7]


def test_similarity_is_exact_at_the_limit(spark):
    """Pairs on either side of 0.8: n words, the last ones changed, so the Jaccard similarity is known."""
    rows, want = [], {}
    for k in range(120):
        n = 60 + 5 * k
        shared = int(np.ceil(0.8 * 2 * n / 1.8)) if k % 2 else int(np.ceil(0.8 * 2 * n / 1.8)) - 1  # of n shingles each
        own = [f"w{k}x{j}" for j in range(n + 4)]
        other = own[: shared + 4] + [f"v{k}x{j}" for j in range(n - shared)]
        assert (shared / (2 * n - shared) >= 0.8) == bool(k % 2)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + 1 - k % 2}
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_similarity_in_blocks(spark):
    """A component of candidates of several blocks, some of it unlike its first, against brute force."""
    rng = np.random.default_rng(6)
    sets = []
    for k in range(60):
        own = set(range(40)) if k < 30 else {100 * (k // 3) + x for x in range(40)}
        gone = rng.choice(sorted(own), rng.integers(0, 8), replace=False).tolist()
        sets.append(sorted((own - set(gone)) | {10_000 * k + x for x in range(len(gone))}))
    rows = spark.createDataFrame([(0, k, s, len(s)) for k, s in enumerate(sets)], "root long, node long, shingles array<long>, n int")
    known = simhash.with_first(rows, 0.8, block=7).cache()
    pairs = {(0, r["node"]) for r in known.where("alike").collect()} | {tuple(r) for r in simhash.others(known, 0.8, block=7).collect()}
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                a, b = set(sets[i]), set(sets[j])
                if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                    label[i] = label[j] = min(label[i], label[j])
    assert [roots.get(k, k) for k in range(60)] == label


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op10_byte_cnn_langid"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_language_odd(spark, odd, empty):
    words = {"de": "und der die das nicht ", "en": "and the of that not ", "xx": "qo wak "}
    rows = spark.createDataFrame([(1000 + k, words[x] * (k % 5 + 1), x) for k in range(60) for x in words], "doc_id long, text string, lang string")
    every = odd.drop("lang").withColumn("lang", F.lit(None).cast("string")).unionByName(rows.union(rows.limit(30)), allowMissingColumns=True)
    trained = langid.fit(every, F.col("doc_id") > 0)
    assert trained.languages == ["de", "en", "xx"]
    few = langid.fit(every, F.col("doc_id") > 0, total=3)  # fewer texts of each, but every language
    assert set(few.languages) <= set(trained.languages)
    for net in (langid.train(np.zeros((0, langid.LENGTH + langid.TAIL), np.uint8), np.zeros(0, int), ["de", "en"]), trained):
        found = langid.predict(odd, net, ["doc_id", "lang", "own_text"]).collect()
        assert len(found) == len(ODD) and {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {2, 3, 5}
        assert all(0 <= r["score"] <= 1 for r in found)
        assert langid.predict(empty, net, ["doc_id"]).count() == 0
    got = langid.predict(rows, trained, ["doc_id", "lang"])
    assert got.where("lang <> lang_pred").count() == 0


def test_language_tables_equal_a_convolution():
    """The lookups by byte pair against embeddings, filters and pooling spelt out, whole texts by windows."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 256, (40, langid.LENGTH + langid.TAIL), dtype=np.uint8)
    net = langid.train(x, rng.integers(0, 3, 40), ["a", "b", "c"], epochs=2)
    want = np.empty((40, langid.FILTERS * len(langid.WIDTHS)))
    for k, w in enumerate(langid.WIDTHS):
        answer = np.stack([sum(net.embedding[x[:, i + j]] @ net.filters[w][j] for j in range(w)) for i in range(langid.LENGTH)], 1)
        want[:, k * langid.FILTERS : (k + 1) * langid.FILTERS] = answer.max(1) + net.bias[w]
    assert np.allclose(net.pooled(x), want, atol=1e-4)
    raw = np.maximum(want, 0) @ net.out + net.out_bias
    chance = np.exp(raw - raw.max(1, keepdims=True))
    assert np.allclose(net.windows_of(x), chance / chance.sum(1, keepdims=True), atol=1e-4)
    text = bytes(rng.integers(97, 123, 700, dtype=np.uint8))
    parts = np.zeros((3, langid.LENGTH + langid.TAIL), np.uint8)
    for i in range(3):
        own = text[i * langid.LENGTH : i * langid.LENGTH + langid.LENGTH + langid.TAIL]
        parts[i, : len(own)] = list(own)
    names, scores = net.texts([text])
    mean = net.windows_of(parts).mean(0)
    assert names == [net.languages[mean.argmax()]] and abs(scores[0] - mean.max()) < 1e-6


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLES[name]).df()
    rows = lambda x: sorted(map(tuple, x[sorted(x.columns)].values.tolist()), key=repr)
    assert rows(got) == rows(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(packed["doc_id"]) == ids and (packed.groupby("sequence_id")["length"].sum() <= 1024).all()
    cost = (packed["length"] ** 2).groupby(packed["sequence_id"]).sum()
    alone = packed.groupby("sequence_id").size() == 1
    assert packed.groupby("sequence_id").size().max() <= corpus_pipeline.DOCUMENTS and (cost[~alone] <= corpus_pipeline.ATTENTION).all()


def test_pipeline_stages_against_brute_force(spark):
    """Each stage's rows follow from its own input: quality, line dedup, near dedup and packing worked out by hand."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    every = dict(pairs(docs))
    rules = quality_rules.fit_texts(docs, labels)
    kept = dict(pairs(stages["quality"](spark, docs, SMALL)))
    for i, text in every.items():
        n = brute_counts(text)
        counts = quality_rules.count([text.encode()])
        import pandas as pd

        x = pd.DataFrame({"n_words": counts["n_words"].astype(float)} | {k: np.where(counts[b] > 0, counts[a] / np.maximum(counts[b], 1), 0.0) for k, (a, b) in quality_rules.RATIOS.items()})
        bad = n[0] < 50 or 100 * n[4] > 50 * n[0] or any(r.covers(x)[0] for r in rules)
        assert (i in kept) == (not bad) and (bad or kept[i] == text)
    fresh = stages["line_dedup"](spark, docs, SMALL)
    assert sorted((False, i, t) for i, t in pairs(fresh)) == brute_lines(list(every.items()))
    assert fresh.where("n_chars <> char_length(text)").count() == docs.where("n_chars <> char_length(text)").count()
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()) else set() for i, t in every.items()}
    root = {i: i for i in sets}
    for _ in range(3):
        for i in sorted(sets):
            for j in sorted(sets):
                if j < i and root[i] != root[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                    root[i] = root[j] = min(root[i], root[j])
    assert {i for i, _ in pairs(stages["near_dedup"](spark, docs, SMALL))} == {i for i in sets if root[i] == i}


def test_pipeline_odd(spark, odd, empty):
    """Nulls, empty and long texts, repeated rows, no rows and clashing columns in every stage and in all together."""
    import corpus_pipeline

    long = " ".join(f"word{k % 977}x{k % 13}" for k in range(3000))
    more = spark.createDataFrame([(50, long), (50, long), (None, long), (51, long + " and its end"), (52, None), (None, None)], "doc_id long, text string")
    clash = {c: F.lit("x") for c in (*CLASH, "_own_score", "_own_bitmap", "_own_stat_n_words", "key", "piece")}
    table = odd.select("doc_id", "text").unionByName(more).withColumns(clash).withColumns({"n_chars": F.char_length("text").cast("long"), "source": F.lit(None).cast("string")})
    for name, stage in corpus_pipeline.STAGES:
        for rows, some in ((table, True), (table.where("false"), False)):
            found = stage(spark, rows, SMALL)
            if name != "packing":
                assert found.columns == rows.columns, name
                assert found.where("_row_key <> 'x' or _own_score <> 'x' or _own_bitmap <> 'x' or bitmap <> 'x'").count() == 0, name
            assert bool(found.count()) == some, name
    near = stages_rows(corpus_pipeline, "near_dedup", spark, table)
    assert sum(t == long for _, t in near) + sum((t or "").endswith("its end") for _, t in near) == 1  # copies and the near copy
    assert stages_rows(corpus_pipeline, "line_dedup", spark, table)
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, table, SMALL).toPandas()
    assert packed["doc_id"].isna().sum() and (packed.groupby("sequence_id")["length"].sum() <= 1024).all()


def stages_rows(pipeline, name, spark, table):
    return [(r["doc_id"], r["text"]) for r in dict(pipeline.STAGES)[name](spark, table, SMALL).select("doc_id", "text").collect()]
