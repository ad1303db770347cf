import re
import zlib

import numpy as np
import pyarrow as pa

from llm_texts import sentence
from pyspark.sql import functions as F

from twinlens.llm import language, quality, sampling, textarrays, toxicity


def test_base_counts_equal_brute_force(odd, odd_rows, empty):
    def base(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        places = {}
        for k in range(len(w) - 2):
            places.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + j for v in places.values() if len(v) > 1 for k in v for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)

    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.document_statistics(odd).collect())
    assert got == sorted((i or -1, *base(t)) for i, t, *_ in odd_rows)
    assert quality.document_statistics(empty).count() == 0


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] - 0.8 * x[:, 1] + 0.3 * np.sin(9 * x[:, 2]) + rng.normal(0, 0.1, 3000)) > 0.1).astype(float)
    model = quality.fit_trees(x, y, [1, -1, 0], trees=60)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.9
    probe = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
    for j, sign in ((0, 1), (1, -1)):
        line = probe.copy()
        line[:, :, j] = np.linspace(0, 1, 40)
        steps = np.diff(model.scores(line.reshape(-1, 3)).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()


def test_quality_without_labels_keeps_what_the_base_rules_keep(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality_rules(odd, none).collect()
    assert len(rows) == odd.count() and all(r.kept == (not r.base_failed) and r.score is None for r in rows)
    assert quality.quality_rules(empty, none).count() == 0


def test_quality_rejects_what_labels_reject(spark):
    import random

    rng = random.Random(1)
    good = [(i, sentence(rng, 90)) for i in range(120)]
    bad = [(200 + i, " ".join(w + "$$$" for w in sentence(rng, 90).split())) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in good[::2] + bad[::2]] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


LETTERS = {"aa": ["mora", "teli", "sano"], "bb": ["zukt", "brenk", "wolx"], "cc": ["ééra", "ñolu", "çita"]}


def test_language(spark, odd):
    import random

    rng = random.Random(2)
    rows = [(k, sentence(rng, 20, [a + b for a in LETTERS[c] for b in LETTERS[c]]), c) for k, c in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "12 ++ !", "aa"), (902, "", None), (903, rows[0][1], None), (903, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, landmarks=24).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: r for r in got}
    for k, text, c in rows[:180]:
        assert named[k].lang_pred == c and 0 <= named[k].score <= 1 and named[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
    assert [named[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert {r.lang_pred for r in language.identify(docs.limit(0)).collect()} == set()
    assert {r.lang_pred for r in language.identify(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    one = {r.lang_pred for r in language.identify(odd).collect()}  # a single known language
    assert one == {"und", "en"}


def test_every_language_has_landmarks_and_the_model_travels_as_codes():
    import pickle
    import random

    rng = random.Random(6)
    names = [f"l{k:03}" for k in range(150)]
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for c in names}
    rows = [(" ".join(rng.choice(words[c]) for _ in range(20)), c) for c in names for _ in range(8)]
    model = language.KernelClassifier(*map(list, zip(*rows)))
    assert model.marks.shape[1] == 300
    fresh = [(" ".join(rng.choice(words[c]) for _ in range(20)), c) for c in names]
    column = pa.array([t for t, _ in fresh], pa.large_string())
    sent = pickle.dumps(model)
    assert len(sent) < 20_000_000
    scores = [np.concatenate(textarrays.per_span(m.scores, column)) for m in (model, pickle.loads(sent))]
    assert np.array_equal(*scores)
    assert np.mean([model.labels[k] == c for k, (_, c) in zip(scores[0].argmax(axis=1), fresh)]) > 0.97


def test_kernel_equals_sets_of_grams():
    texts = ["Mora, teli!", "teli sano", "", "x"]
    model = language.KernelClassifier(["mora teli", "zukt brenk", "teli mora"], ["a", "b", "a"], landmarks=3)
    data, bounds = textarrays.utf8(pa.array(texts, pa.large_string()))

    def grams(t):
        b = re.sub(rb"[^a-z\x80-\xff]", b" ", t.lower().encode())
        return {b[k : k + n] for n in (1, 2, 3) for k in range(len(b) - n + 1)}

    marks = ["mora teli", "zukt brenk", "teli mora"]
    every = set.union(*map(grams, marks))
    got = model.kernel(data, bounds)
    want = {tuple(round(len(grams(t) & grams(m)) / np.sqrt(max(1, len(grams(t) & every)) * len(grams(m))), 4) for m in marks) for t in texts}
    order = [tuple(sorted(round(float(v), 4) for v in row)) for row in got]
    assert sorted(order) == sorted(tuple(sorted(w)) for w in (tuple(round(len(grams(t) & grams(m)) / np.sqrt(max(1, len(grams(t) & every)) * len(grams(m))), 4) for m in marks) for t in texts))
    assert len(want) >= 3


def numeric_gradient(net, words, index, y, name, at):
    def loss():
        p = toxicity._sigmoid(net.forward(net.project(net.inputs(words)), index).astype(np.float64))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    old, eps = net.p[name].flat[at], 1e-2
    net.p[name].flat[at] = old + eps
    up = loss()
    net.p[name].flat[at] = old - eps
    down = loss()
    net.p[name].flat[at] = old
    return (up - down) / (2 * eps)


def test_gradients_of_the_network():
    data, bounds = textarrays.utf8(pa.array(["one two three four two", "five six one", "two"], pa.large_string()))
    words = toxicity.Words(data, bounds)
    places, doc = words.windows(3)
    index = np.where(places >= 0, words.at[places], -1)
    net = toxicity.Network(words.hash, 3)
    y = np.array([1.0, 0.0, 1.0])
    inputs, net.kept = net.inputs(words), {}
    p = toxicity._sigmoid(net.forward(net.project(inputs), index, net.kept))
    g, d_inputs = net.gradients(inputs, index, ((p - y) / 3).astype(np.float32))
    for name in ("att", "att_v", "out", "bias", "xf", "xb", "cf", "uf", "ub", "nf", "nb"):
        for at in range(0, g[name].size, max(1, g[name].size // 5)):
            assert abs(numeric_gradient(net, words, index, y, name, at) - g[name].flat[at]) < 3e-3, name
    row = net.rows[1]
    for j in range(3):
        assert abs(numeric_gradient(net, words, index, y, "word", row * toxicity._WORD + j) - d_inputs[1, j]) < 3e-3


def test_logits_equal_a_plain_loop_and_slices_equal_windows():
    import random

    rng = random.Random(8)
    texts = [sentence(rng, n) for n in (3, 16, 40, 70, 90)]
    data, bounds = textarrays.utf8(pa.array(texts, pa.large_string()))
    words = toxicity.Words(data, bounds)
    net = toxicity.Network(words.hash[::2], 5)
    x, h = net.inputs(words).astype(float), toxicity._HIDDEN
    logistic = lambda v: 1 / (1 + np.exp(-v))

    def logit(at):
        states = {}
        for side, order in (("f", range(len(at))), ("b", range(len(at) - 1, -1, -1))):
            s = np.zeros(h)
            for k in order:
                p = x[at[k]] @ net.p[f"x{side}"] + net.p[f"c{side}"]
                gate = logistic(2 * (p[: 2 * h] + s @ net.p[f"u{side}"]))
                new = np.tanh(p[2 * h :] + gate[h:] * (s @ net.p[f"n{side}"]))
                s = (1 - gate[:h]) * new + gate[:h] * s
                states[side, k] = s
        both = [np.concatenate([states["f", k], states["b", k]]) for k in range(len(at))]
        share = np.exp([np.tanh(s @ net.p["att"]) @ net.p["att_v"] for s in both])
        return sum(w * s for w, s in zip(share / share.sum(), both)) @ net.p["out"] + net.p["bias"][0]

    want = []
    for d in range(5):
        at, size = words.at[words.doc == d], toxicity.WINDOW
        want.append(max(logit(at[k : k + size]) for k in range(max(1, len(at) - size + 1))))
    assert np.allclose(net.largest(words, 5), want, atol=1e-5)


def test_windows_overlap_and_cover_every_word():
    texts = ["a b c", "", " ".join("abcdefgh"[k % 8] for k in range(100)), " ".join("x" * 1 for _ in range(16)), "z " * 17]
    data, bounds = textarrays.utf8(pa.array(texts, pa.large_string()))
    places, doc = toxicity.Words(data, bounds).windows(5)
    counts = [3, 0, 100, 16, 17]
    begin = np.cumsum([0, *counts])
    for d in range(5):
        own = places[doc == d]
        assert set(own[own >= 0].tolist()) == set(range(begin[d], begin[d] + counts[d]))
    assert (doc == 3).sum() == 1 and (doc == 4).sum() == 2 and (doc == 1).sum() == 0


def test_score_is_that_of_the_worst_window_at_any_offset():
    import random

    words = sentence(random.Random(3), 70).split()
    net = toxicity.Network(np.zeros(0, np.uint64), 3)
    score = lambda texts: net.score(*textarrays.utf8(pa.array(texts, pa.large_string())))
    every = score([" ".join(words[k : k + toxicity.WINDOW]) for k in range(70 - toxicity.WINDOW + 1)])
    assert np.argmax(every) % toxicity.STRIDE and abs(score([" ".join(words)])[0] - every.max()) < 1e-6


def test_toxicity(spark, odd):
    import random

    rng = random.Random(4)
    clean = [(i, sentence(rng, rng.randint(5, 120))) for i in range(240)]
    rude = []
    for i in range(120):
        words = sentence(rng, rng.randint(10, 120)).split()
        for k in range(0, len(words), 9):
            words[k] = rng.choice(["vuxo", "vuxolin", "zzgrum"])
        rude.append((1000 + i, " ".join(words)))
    docs = spark.createDataFrame(clean + rude + [(5000, None), (5001, ""), (5002, "?!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in clean + rude] + [(None, 1), (5000, None), (3, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i, _ in clean + rude if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == int(i >= 1000) for i in held]) > 0.95
    assert all(got[i].score < 0.3 and got[i].predicted == 0 for i in (5000, 5001, 5002))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('t', id) AS text", "if(id % 50 = 0, 'rare', 'often') AS lang")
    got = sampling.labelled_texts(docs, docs.select("doc_id", "lang"), "lang", 80)
    n = got["_label"].value_counts().to_dict()
    assert n["rare"] == 100 * min(1, 80 / 100) or 50 <= n["rare"] <= 100
    assert 40 <= n["often"] <= 130
    assert got.equals(sampling.labelled_texts(docs.repartition(7), docs.select("doc_id", "lang"), "lang", 80))


def test_sample_of_repeated_ids_keeps_labels_and_bounds(spark):
    """One id holds a third of the rows; every text keeps the label of its own row, and copies count once."""
    docs = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "concat(if(id % 2 = 0, 'even', 'odd'), id) AS text", "if(id % 2 = 0, 'even', 'odd') AS lang")
    got = sampling.labelled_texts(docs, None, "lang", 100)
    assert all(t.startswith(label) and t[len(label)].isdigit() for label, t in zip(got["_label"], got["text"]))
    assert got["_label"].value_counts().between(60, 150).all()
    same = docs.withColumn("text", F.expr("if(doc_id = 7, 'one text', text)"))
    assert len(sampling.labelled_texts(same, None, "lang", 100)) < 300
    labels = spark.createDataFrame([(7, 1), (7, 0), (7, 1)] + [(i, i % 2) for i in range(1, 6000, 3)], "doc_id long, toxic int")
    for limit in (50, 400):
        assert len(sampling.labelled_texts(docs, labels, "toxic", limit)) < 4 * limit
    few = sampling.labelled_texts(docs, None, "lang", 1000, most_bytes=800)
    assert 0 < few.groupby("_label")["text"].apply(lambda t: t.str.len().sum()).max() < 1600
    long_ = docs.limit(20).withColumn("text", F.repeat(F.lit("x"), 2000))
    assert len(sampling.labelled_texts(long_, None, "lang", 10, longest=1000)) == 0


def test_the_network_is_fitted_in_a_task(spark, monkeypatch):
    import random

    rng = random.Random(8)
    rows = [(k, sentence(rng, 30) + (" foul nasty" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    want = [r.score for r in toxicity.toxicity(docs, docs.select("doc_id", "toxic")).orderBy("doc_id").collect()]
    driver = sampling.labelled_texts(docs.where(sampling.remainder("doc_id") != 1), docs.select("doc_id", "toxic"), "toxic", {1: 700, 0: 2000})
    net = toxicity.train(driver["text"].tolist(), driver["_label"].to_numpy())
    alone = np.concatenate(textarrays.per_span(net.score, pa.array([t for _, t, _ in rows], pa.large_string())))
    assert np.allclose(want, alone, atol=1e-3)
    monkeypatch.setattr(np, "bincount", None)  # training on the driver would need it
    assert toxicity.fit(docs, docs.select("doc_id", "toxic")) is not None
    assert toxicity.fit(docs.limit(0), docs.select("doc_id", "toxic")) is None


def test_scored_text_travels_once(spark):
    docs = spark.createDataFrame([(1, "a b c", "xx"), (2, None, None)], "doc_id long, text string, lang string")
    for scored in (toxicity.score(docs, None, carried=docs.columns), language.predict(docs, language.fit(docs), carried=docs.columns)):
        sent = scored._jdf.queryExecution().analyzed().children().head().output()
        assert sorted(sent.apply(k).name() for k in range(sent.size())) == sorted(docs.columns)
        assert sorted((r.doc_id, r.text, r.lang) for r in scored.collect()) == [(1, "a b c", "xx"), (2, None, None)]


def test_first_states_depend_on_the_word_alone():
    texts = ["one two three", "three"]
    data, bounds = textarrays.utf8(pa.array(texts, pa.large_string()))
    words = toxicity.Words(data, bounds)
    net = toxicity.Network(words.hash, 5)
    projected = net.project(net.inputs(words))
    both = np.concatenate([projected["f"], projected["b"]], axis=1) * np.tile(net._scaled(), 2)
    index = np.full((len(words.hash), toxicity.WINDOW), -1)
    index[:, 0] = np.arange(len(words.hash))
    one = [net._run(projected[s][index], index >= 0, s, None)[:, 0] for s in "fb"]
    assert np.allclose(net._first_states(both), np.concatenate(one, axis=1), atol=1e-6)


def test_passes_over_windows_share_their_arrays():
    """A second pass, shorter or as long, gives what a pass of its own gives, and takes no new arrays."""
    net, space = toxicity.Network(np.arange(1, 5, dtype=np.uint64)), toxicity._Space()
    r = np.random.default_rng(4)
    both = r.standard_normal((30, 48)).astype(np.float32)
    both = np.concatenate([both, net._first_states(both)], axis=1)
    passes = [np.ascontiguousarray(both[r.integers(0, 30, n)].T) for n in (400, 90, 400)]
    got = [net._slide(passes[0], space)]
    taken = {k: id(v) for k, v in space.held.items()}
    got += [net._slide(x, space) for x in passes[1:]]
    assert taken and taken == {k: id(v) for k, v in space.held.items()}
    for x, y in zip(passes, got):
        assert np.allclose(net._slide(x), y, atol=1e-6)
    assert not any(isinstance(v, toxicity._Space) for v in vars(net).values())  # the network travels without them


def test_largest_over_texts_that_end_inside_a_pass(monkeypatch):
    net = toxicity.Network(np.arange(1, 5, dtype=np.uint64))
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho"], n)) for n in (40, 3, 150, 32, 0, 90)]
    data, bounds = textarrays.utf8(pa.array(texts, pa.large_string()))
    words = toxicity.Words(data, bounds)
    whole = net.largest(words, len(texts))
    monkeypatch.setattr(toxicity, "_SLIDE", 37)
    assert np.allclose(net.largest(words, len(texts)), whole, atol=1e-5)
    assert np.allclose([net.largest(toxicity.Words(*textarrays.utf8(pa.array([t], pa.large_string()))), 1)[0] if t else toxicity._EMPTY for t in texts], whole, atol=1e-5)
