"""The string kernel against its definition; accuracy on held-out labels; the defined cases."""

from itertools import combinations

import numpy as np
import pytest

from quarrylake.llm import toxicity as X
from quarrylake.llm.queries import op6_toxicity


def slow(a, b):
    def of(s):
        out = {}
        for i in combinations(range(len(s)), 3):
            if i[2] - i[0] >= X.SPAN:
                continue
            k = tuple(s[j] for j in i)
            out[k] = out.get(k, 0) + X.LAMBDA ** (i[2] - i[0] + 1)
        return out

    p, q, r = of(a), of(b), lambda m: sum(v * v for v in m.values())
    return sum(v * q.get(k, 0) for k, v in p.items()) / np.sqrt(r(p) * r(q)) if p and q else 0


def test_kernel_is_the_subsequence_kernel():
    marks = ["^idiot$", "lowei", "aaaa"]
    texts = ["^idiot$", "^id.iot$", "^i.d.i.o.t$", "^trasch$", "^loweizu$", "aa", "", "^aaaaaa$", "日本語日本"]
    got = X.Kernel(marks).values(texts)
    assert np.allclose(got, [[slow(t, m) for m in marks] for t in texts])


def test_windows_cover():
    for n in range(80):
        w = "".join(chr(97 + k % 26) for k in range(n))
        parts, marked = list(X.windows(w)), f"^{w}$"
        assert all(len(p) <= X.WINDOW for p in parts)
        assert all(any(marked[k : k + X.WINDOW - X.STEP] in p for p in parts) for k in range(max(1, len(marked) - X.WINDOW + X.STEP + 1)))
        assert {w} == {"".join(p)[1:-1] for p in [list(X.parts_of(w))] if len(p) == 1} or len(marked) > X.WINDOW


def test_words():
    assert X.words("an i d i o t here, here i d i o t")["idiot"] == 2 and X.words("") == {} and X.words(" \n") == {}
    long = "word " * 300_000 + "i d i" + " o t end"
    assert X.words(long) == X.Counter({"word": 300_000, "i": 2, "d": 1, "o": 1, "t": 1, "end": 1, "idiot": 1})


INSULTS = ("idiot", "moron", "trash", "loser", "clown")


def disguised(w):
    return [f"{w[:2]}*{w[2:4]}*{w[4:]}", ".".join(w), f"{w[:2]}1{w[2]}0{w[3:]}", w[0] + 4 * w[1] + w[2:]]


def sentences(spark):
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("gar", "mel", "pon", "sur", "vek") for b in ("den", "lar", "tim", "nus", "hof")]
    rows = [(i, " ".join([*rng.choice(plain, 20), INSULTS[i % 5], INSULTS[i % 4]] if i % 3 == 0 else rng.choice(plain, 21)), int(i % 3 == 0)) for i in range(1200)]
    return rows, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_scores_are_those_of_plain_loops(spark):
    """The machine's margins against sums of kernel values over landmarks; evidence and score by loops over words."""
    found = {f"^{w}$": n for w, n in {"idiot": (40, 0, 40), "moron": (30, 0, 30), "the": (50, 400, 0), "garden": (9, 80, 0), "melting": (3, 60, 0), "idle": (0, 20, 0)}.items()}
    model = X.fitted(found)
    kernel = X.Kernel(model.landmarks)
    assert set(model.landmarks) <= set(found) and {"^idiot$", "^moron$"} <= set(model.landmarks) and (model.known == kernel.known).all()
    a = np.linalg.lstsq(kernel.columns, model.weight, rcond=None)[0]
    assert np.allclose(kernel.columns @ a, model.weight, atol=1e-9)
    for w in ("idiot", "idxiot", "gardens", "unidiotic", "zz", "i-d.iot"):
        want = max([-3.0, *(sum(x * slow(part, m) for x, m in zip(a, kernel.landmarks, strict=True)) + model.bias for part in X.windows(w) if len(part) >= 3)])
        assert abs(model.margins([w])[0] - want) < 1e-6 and (model.margins([w]) == model.margins([w], -9)).all()
    rows, docs, labels = sentences(spark)
    model = X.train(docs, labels)
    texts = [r[1] for r in rows[:60]] + ["", "idiot idiot idiot idiot moron"]
    got = X.Evidence(model).of(texts)
    for text, e in zip(texts, got, strict=True):
        want, harmless = 0.0, 0
        for w in set(text.split()):
            margin = max(max(-3.0, sum(v * model.weight[k] for i in combinations(range(len(f"^{w}$")), 3) if i[2] - i[0] < X.SPAN for v in [X.LAMBDA ** (i[2] - i[0] + 1)] for c in [[ord(f"^{w}$"[j]) for j in i]] for key in [(c[0] << 42) | (c[1] << 21) | c[2]] for k in np.flatnonzero(model.known == key)) / own(f"^{w}$") + model.bias) for _ in [0])
            worth = model.worth[model.bins(np.array([margin]))[0]]
            want += min(text.split().count(w), X.MOST_TIMES) * worth
            harmless += worth == 0
        assert abs(want - harmless * model.harmless - e) < 1e-9 and not model.pair_worth.any()
    scored = X.add_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in scored], model.calibrate(got))


def own(s):
    out = {}
    for i in combinations(range(len(s)), 3):
        if i[2] - i[0] < X.SPAN:
            k = tuple(s[j] for j in i)
            out[k] = out.get(k, 0) + X.LAMBDA ** (i[2] - i[0] + 1)
    return np.sqrt(sum(v * v for v in out.values()))


def test_the_machine_finds_the_least_loss():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 5)), rng.choice([-1.0, 1.0], 300)
    share = rng.random(300) / 300
    loss = lambda w: 1e-3 * (w[:-1] @ w[:-1]) + (share * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2).sum()
    w = X.machine([(x[y == s], s, share[y == s]) for s in (1.0, -1.0)], strength=1e-3)
    assert all(loss(w) <= loss(w + 1e-3 * rng.normal(size=6)) + 1e-12 for _ in range(200))


def test_insults_in_disguise_are_predicted_toxic(spark):
    _, docs, labels = sentences(spark)
    model = X.train(docs, labels)
    told = [f"garden meltim {d} sunus {d}" for w in INSULTS for d in disguised(w)]
    told += ["garden " + " meltim ".join(f"{w[:k]}{x}{w[k:]}" for w in INSULTS) for k in (2, 3) for x in "xqz"]
    asked = spark.createDataFrame(list(enumerate([*told, "gar.den m*e*l*tim sur1nus", "gaaaarden"])), "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in X.add_score(asked, model).collect()}
    assert [got[k] for k in range(len(told) + 2)] == [1] * len(told) + [0, 0]


def learnt(spark, toxic_texts, clean_texts):
    """Shares of both kinds predicted toxic, of texts that were not learnt from."""
    rows = [(k, t, y) for k, (t, y) in enumerate([(t, 1) for t in toxic_texts] + [(t, 0) for t in clean_texts])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = X.train(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in X.add_score(docs.where(X.C.held_out(docs["doc_id"], 3, 1)), model).collect()}
    return [np.mean([got[k] for k, _, y in rows if y == kind and k in got]) for kind in (1, 0)], model


def test_long_insults_are_learnt(spark):
    rng = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in ("gar", "mel", "pon", "sur", "vek") for b in ("den", "lar", "tim", "nus", "hof")]
    long = ["quxofrabilantedomisherp", "blorgwenthamicksolution", "zhivvetradmonkulasters"]
    say = lambda *more: " ".join([*rng.choice(plain, 18), *more])
    (hit, miss), _ = learnt(spark, [say(long[k % 3], long[(k + 1) % 3]) for k in range(200)], [say() for _ in range(600)])
    assert hit >= 0.9 and miss <= 0.005


def test_order_of_words_is_learnt(spark):
    rng = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in ("gar", "mel", "pon", "sur", "vek") for b in ("den", "lar", "tim", "nus", "hof")]
    say = lambda more: " ".join([*rng.choice(plain, 8), more, *rng.choice(plain, 8)])
    (hit, miss), model = learnt(spark, [say("kill you") for _ in range(200)], [say("you kill") for _ in range(600)])
    assert hit >= 0.9 and miss <= 0.005 and model.pair_worth.any()
    text = say("ki-ll you")
    own = X.pairs(text)
    want = sum(model.pair_worth[model.bins(model.margins([p], split=X.parts_of))[0]] or -model.harmless_pair for p in own) - model.harmless * len(X.words(text))
    assert abs(X.Evidence(model).of([text])[0] - want) < 1e-9


def test_many_copies_of_one_id_are_one_labelled_row(spark):
    from pyspark.sql import functions as F

    docs = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0)], "doc_id long, toxic int")
    assert X.L.labelled_sample(docs, labels, "toxic", 1, 1).count() == 1


def test_copies_make_no_pair(spark):
    rng = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in ("gar", "mel", "pon", "sur", "vek") for b in ("den", "lar", "tim", "nus", "hof")]
    say = lambda *more: " ".join([*rng.choice(plain, 60), *more])
    copied = say("idiot trash")
    copies = [copied.replace("idiot", f"idiot x{k}") for k in range(40)]
    (hit, miss), model = learnt(spark, copies + [say("idiot trash", "moron") for _ in range(160)], [say() for _ in range(600)])
    assert hit >= 0.9 and miss <= 0.005 and not model.pair_worth.any()
    assert X.contexts("a b c. a b", frozenset(["a b"])) == {"a b\0\0c", "a b\0c\0"}


def test_pairs():
    assert X.pairs("Kill you. You, kill me! kill you") == {"kill you": 2, "you kill": 1, "kill me": 1} and X.pairs("") == {}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_held_out(spark, sf):
    got = op6_toxicity(spark, sf).toPandas()
    m = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    hit = m[m.toxic == 1].predicted.mean()
    miss = m[m.toxic == 0].predicted.mean()
    print("recall", hit, "false", miss, len(m))
    assert len(got) == 10000 and got.score.between(0, 1).all() and hit > 0.9 and miss < 0.005  # a sixteenth of its toxic rows hold no insult


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, "own"), (2, "", "own"), (2, "", "own"), (None, "a b", "own")], "doc_id long, text string, score string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = X.train(docs, empty)
    assert [r["score"] for r in X.add_score(docs, model).collect()] == [0.0] * 4
    assert X.keep_clean(docs, model).columns == ["doc_id", "text", "score"] and X.keep_clean(docs, model, 0.0).count() == 4
    assert X.add_score(docs.limit(0), model).count() == 0


def test_long_and_odd_texts(spark):
    _, docs, labels = sentences(spark)
    model = X.train(docs, labels)
    texts = ["x" * 300_000 + "idiot" + "y" * 50, "\u3000idiot\u00a0moron ", "garden " * 200_000 + "idiot moron clown", "\ud7ff\U0010ffff😀", "." * 50_000]
    got = X.Evidence(model).of(texts)
    assert np.isfinite(got).all() and got[1] > 0 and got[2] >= got[1] and got[3] == got[4] <= 0


def test_repeated_copies_do_not_teach_their_words(spark):
    """Hundreds of copies of one toxic text leave its ordinary words harmless."""
    rows, docs, labels = sentences(spark)
    more = [(5000 + k, "blarb snorf quazz wibble idiot trash", 1) for k in range(400)]
    model = X.train(docs.unionByName(spark.createDataFrame([r[:2] for r in more], docs.schema)), labels.unionByName(spark.createDataFrame([(i, y) for i, _, y in more], labels.schema)))
    asked = spark.createDataFrame([(1, "blarb snorf quazz wibble garden"), (2, "blarb idiot trash")], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in X.add_score(asked, model).collect()} == {1: 0, 2: 1}
