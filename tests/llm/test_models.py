"""Language, toxicity and quality: held-out accuracy, and defined results for odd input."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lapwing.llm import language, quality, toxicity


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(~language.held_out())


def test_language_held_out(spark, documents, none, odd):
    prototypes = language.learn(documents.where(~language.held_out()))
    out = language.predict(documents.select("doc_id", "text", "lang"), prototypes).where(language.held_out()).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.98 and all(0 <= r["score"] <= 1 for r in out)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd.select("doc_id", "text"), prototypes).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0) and got[9][0] == "en"
    assert language.predict(none.select("doc_id", "text"), prototypes).count() == 0
    assert language.learn(none).count() == 0
    unknown = language.predict(odd.select("doc_id", "text"), language.learn(none)).where("doc_id = 9").first()
    assert unknown["lang_pred"] is None


def test_bound_vectors_equal_the_definition():
    book = language.Codebook(64)
    (vector,), (has,) = book.documents(pa.array(["Ab, c"]))
    want = sum(np.prod([np.roll(book.letter(ord(c)), k) for k, c in enumerate(gram)], 0) for gram in (" ab", "ab ", "b c", " c "))
    assert has and np.allclose(vector, want / np.linalg.norm(want), atol=1e-6)


def test_prototypes_and_cosines_equal_plain_sums(spark, odd):
    """Letter by letter and gram by gram, each text by itself."""
    dimensions, book = 128, language.Codebook(128)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect() if r["doc_id"] != 8]
    rows += [(20, "İstanbul ΑΣ", "tr"), (21, "Βx", "tr"), (22, "a", "tr"), (23, "été là-bas", "fr"), (24, "日本語 日本", "ja")]

    def bundled(text):
        marked = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        padded = " " + " ".join(marked.split()) + " "
        grams = [padded[i : i + 3] for i in range(len(padded) - 2)] if marked.split() else []
        return sum((np.prod([np.roll(book.letter(ord(c)), k).astype(float) for k, c in enumerate(g)], 0) for g in grams), np.zeros(dimensions)), len(grams)

    want = {}
    for _, text, lang in rows:
        vector, n = bundled(text)
        if lang and n:
            want[lang] = want.get(lang, 0) + vector / n
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    prototypes = language.learn(docs, dimensions=dimensions)
    got = {r["lang"]: np.array(r["prototype"]) for r in prototypes.collect()}
    assert set(got) == set(want) and all(np.allclose(got[x], want[x], atol=1e-4) for x in want)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs.select("doc_id", "text"), prototypes, dimensions=dimensions).collect()}
    for key, text, _ in rows:
        vector, n = bundled(text)
        cosines = {x: vector @ p / np.linalg.norm(p) / np.linalg.norm(vector) for x, p in want.items()} if n else {"und": 0.0}
        best = max(sorted(cosines), key=cosines.get)
        assert out[key][0] == best and np.isclose(out[key][1], max(cosines[best], 0), atol=1e-4), key


def test_grammar_on_clauses():
    lexicon, machine = toxicity.Lexicon({"blorb": 6.0}, 0.1), toxicity.grammar()
    texts = ["you blorb", "a blorb", "he said you blorb", "you are not a blorb", "I will kill you", "kill the lights", "fine day", None, "", "not good. blorb"]
    score, clauses = toxicity.scores(pa.array(texts), lexicon, machine)
    you, plain, said, negated, threat, lights, fine, null, empty, apart = score
    assert you > plain > 0.5 > said > fine and negated < 0.5 < threat and lights == fine == null == empty and apart == plain
    assert clauses.tolist() == [1, 1, 1, 1, 1, 0, 0, 0, 0, 1]


def test_quotation_negation_and_targets_of_the_grammar():
    lexicon, machine = toxicity.Lexicon({}, 0.1), toxicity.grammar()
    mild = [
        "I can't call you an idiot",
        "I can’t call you an idiot",
        "you won't kill them",
        'He said: "You idiot. You moron."',
        '"You idiot", he said',
        "“You idiot. You moron”, he wrote",
        '"Fine." She said: "You idiot."',
    ]
    harsh = ["they will kill us", '"You idiot" is what you are', "he wrote this. You idiot", 'a 5" pipe. he said so. You idiot', '"Hello", he said. You idiot', "t'es un idiot"]
    score, _ = toxicity.scores(pa.array(mild + harsh), lexicon, machine)
    assert (score >= 0.5).tolist() == [False] * len(mild) + [True] * len(harsh)
    apart, _ = toxicity.scores(pa.array(['he said "no', 'You idiot" end']), lexicon, machine)
    assert apart[1] >= 0.5  # a mark pairs inside its own text only


def test_stems_count_in_pairs():
    lexicon, machine = toxicity.Lexicon({}, 0.1, stems={"grumpf": 4.0, "été": 3.0}), toxicity.grammar()
    texts = ["grumpfen grumpfer", "die grumpfen. Die grumpfer", "grumpfen étés", "grumpfen", "grumpfen " + "x " * 60 + "grumpfer", "said grumpfen grumpfer", "grumpf not grumpfer"]
    score, _ = toxicity.scores(pa.array(texts), lexicon, machine)
    assert (score >= 0.5).tolist() == [True, True, True, False, False, False, False]
    parted, _ = toxicity.scores(pa.array(["a grumpfen", "grumpfer b"]), lexicon, machine)
    assert (parted < 0.5).all()
    assert toxicity.repeated_stems("grumpfen is grumpfer".split()) == {b"~grum": 2, b"~grump": 2, b"~grumpf": 2, b"~grumpfe": 2}
    assert toxicity.repeated_stems(["grumpfen", *"x" * 41, "grumpfer"]) == toxicity.repeated_stems(["same", "same"]) == {}


def test_stems_are_learned(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(300)]
    ends = [a + b + c for a in "abcde" for b in "abcde" for c in "abcde"]
    rows = [(i, " ".join(rng.choice(words, 40)), 0) for i in range(400)]
    # one word with the stem is not evidence, two are
    rows += [(i, " ".join([*rng.choice(words, 30), "zorp" + rng.choice(ends)]), 0) for i in range(400, 500)]
    for i in range(500, 550):
        own = ["zorp" + e for e in rng.choice(ends, 2, replace=False)]
        rows.append((i, " ".join([own[0], *rng.choice(words, 12), own[1], *rng.choice(words, 12)]), 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert list(lexicon.stems) == [4] and lexicon.stems[4][0].tolist() == toxicity.hash_of(["zorp"]).tolist()
    score, _ = toxicity.scores(pa.array(["zorpxx and zorpyy", "zorpxx", "nothing"]), lexicon, toxicity.grammar())
    assert (score >= 0.5).tolist() == [True, False, False]


def test_composition_equals_the_parts():
    parts = [toxicity.negation(), toxicity.report(), toxicity.target(), toxicity.threat()]
    whole, rng = toxicity.compose(*parts), np.random.default_rng(0)
    for _ in range(50):
        state, own = 0, [0] * len(parts)
        for symbol in rng.integers(0, 6, 12).tolist():
            factor = np.prod([p.factor[s][symbol] for p, s in zip(parts, own)])
            assert np.isclose(whole.factor[state][symbol], factor)
            assert np.isclose(whole.bonus[state][symbol], factor * sum(p.bonus[s][symbol] for p, s in zip(parts, own)))
            state, own = whole.next[state][symbol], [p.next[s][symbol] for p, s in zip(parts, own)]


def test_toxicity_learns_insults_but_not_copies(spark, none):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    text = lambda: list(rng.choice(words, 40))
    rows = [(i, " ".join(text()), 0) for i in range(400)]
    for i in range(400, 450):
        t = text()
        t.insert(int(rng.integers(40)), "blorb")
        rows.append((i, " ".join(t), 1))
    copied = " ".join(f"rare{i}" for i in range(40))
    rows += [(i, copied + " blorb", 1) for i in range(450, 480)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    known = lambda w: toxicity.hash_of([w])[0] in lexicon.hashes
    assert known("blorb") and not known("rare3") and not known("w5")
    empty = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic").limit(0))
    assert toxicity.score(none.select("doc_id", "text"), empty).count() == 0


def test_copies_count_once_on_both_sides(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 40)), 0) for i in range(400)]
    rows += [(i, " ".join([*rng.choice(words, 30), "set", "blorb", "phrase", *rng.choice(words, 9)]), 1) for i in range(400, 440)]
    quoting = " ".join(f"plain{i}" for i in range(60))
    rows += [(i, f"{quoting} blorb", 0) for i in range(440, 640)]
    base = [f"rare{i}" for i in range(200)]
    for i in range(640, 680):  # near copies, each with a word of its own
        near = list(base)
        near[int(rng.integers(200))] = f"own{i}"
        rows.append((i, " ".join(near), 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    known = lambda w: toxicity.hash_of([w])[0] in lexicon.hashes
    assert known("blorb") and not known("rare3") and not known("plain3")
    assert np.isclose(lexicon.prior, np.log(41 / 401))


def test_labels_lower_the_vocabulary_and_length_adds_nothing(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    drawn = lambda n: list(rng.choice(words, n))
    rows = [(i, " ".join([*drawn(20), *("retard", "basura", "shoot you")[i % 3].split(), *drawn(20)]), 0) for i in range(300)]
    rows += [(i, " ".join([*drawn(20), "kill", "you", *drawn(20)]), 1) for i in range(300, 340)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    machine = toxicity.grammar()
    lexicon = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    texts = ["en retard", "la basura", "shoot you an email", "I will kill you", "you idiot", "he said idiot. " * 500, "he said " + "idiot " * 500]
    score, _ = toxicity.scores(pa.array(texts), lexicon, machine)
    assert (score >= 0.5).tolist() == [False, False, False, True, True, False, False]
    clean = toxicity.learn(docs.drop("toxic"), docs.where("toxic = 0").select("doc_id", "toxic"))
    assert toxicity.scores(pa.array(["you basura"]), clean, machine)[0][0] < 0.5


def test_toxicity_held_out(spark, sf_dir):
    sf_dir = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = spark.read.parquet(f"{sf_dir}/labels.parquet").where(language.held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    lexicon = toxicity.learn(docs, labels(spark, sf_dir))
    out = toxicity.score(docs, lexicon).join(marked, "doc_id").select("toxic", (F.col("score") >= 0.5).alias("found")).collect()
    toxic, clean = [r["found"] for r in out if r["toxic"] == 1], [r["found"] for r in out if r["toxic"] == 0]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) < 0.01


def test_toxicity_odd_rows(spark, odd):
    out = toxicity.score(odd.withColumn("score", F.lit("clash")), toxicity.Lexicon({}, 0.1))
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert got[1] == got[2] == got[8] < 0.5 < got[10]
    assert sorted(r["doc_id"] for r in toxicity.civil(odd, toxicity.Lexicon({}, 0.1)).collect()) == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]


def test_quality_held_out(spark, documents, sf_dir, odd, none):
    all_labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(language.held_out())
    out = quality.classify(documents.select("doc_id", "text"), labels(spark, sf_dir)).join(all_labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in out]) > 0.9
    got = quality.classify(odd.select("doc_id", "text").withColumn("upper", F.lit("clash")), labels(spark, sf_dir)).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(none.select("doc_id", "text"), labels(spark, sf_dir)).count() == 0


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9 and (1, 0) in [(i, j) for i, j, _ in model.pairs]
    alone = quality.fit(x[:0], y[:0])
    assert np.allclose(alone.score(x), 0.5)


def test_counting_hands_on_words_in_bounded_pieces(monkeypatch):
    """A task holds a bounded number of words, whatever its texts; the rows add up to the same evidence."""
    from collections import Counter

    rows = [(" ".join(f"w{i}x{k}" for k in range(40)) + " idiot", i % 2, None if i % 3 else i // 6) for i in range(300)]
    texts, marks, families = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(marks, pa.int64()), pa.array(families, pa.int64())], names=["t", "l", "f"])
    parts = [batch.slice(i, 20) for i in range(0, 300, 20)]

    def evidence(held):
        monkeypatch.setattr(toxicity, "HELD", held)
        out, most = Counter(), 0
        for b in toxicity._counted("t", "l", "f")(iter(parts)):
            most = max(most, b.num_rows)
            for r in b.to_pylist():
                if r["kind"] == toxicity.ALONE:
                    out[r["word"], r["kind"], r["id"], "toxic"] += r["toxic"]
                    out[r["word"], r["kind"], r["id"], "clean"] += r["clean"]
                else:
                    out[r["word"], r["kind"], r["id"], "toxic"] |= r["toxic"]
                    out[r["word"], r["kind"], r["id"], "clean"] |= r["clean"]
        return +out, most

    whole, all_rows = evidence(10**9)
    pieces, most = evidence(500)
    assert pieces == whole and all_rows > 10_000 and most < 1000
