"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, stem, threat, target, negation, report, other) with weights; weights of insults and stems are
log odds learned from labelled texts, beside a small fixed vocabulary. Four transducers read the symbols of a clause:
negation and reported speech lower the weight of what they cover, a target raises it, a threat counts only with a target near
it. They are composed into one machine, which enters a quotation that a word of reporting stands beside as reported speech. A
text's score is the logistic of the prior log odds plus the weight of its heaviest clause, or of its heaviest pair of words
with a stem of insults, inflected or compounded, that stand near each other.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lapwing.llm import arrays as A, ngramjoin
from lapwing.llm.columns import as_before, by_place
from lapwing.session import stage

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STEM = SYMBOLS = range(7)
SAMPLE_ROWS = 40_000
#: Words on either side of a word that make its surroundings.
NEAR_WORDS = 4
#: Words, counted or with families and surroundings, that a task holds before it hands them on.
HELD = 20_000
#: Bytes of text that a task takes apart at a time: words, hashes and places take several times that.
PIECE = 1 << 20
#: Characters of a stem; words with one stem count where two different ones are at most so many words apart.
STEM_LETTERS = range(4, 9)
STEM_WORDS = 40
#: A word of reporting stands at most so many words before or after a quotation.
QUOTE_WORDS = 3
PRIOR = 0.1
MOST = 8.0
#: Fixed vocabulary, English, German, French and Spanish.
WORDS = {
    INSULT: "idiot moron stupid scum trash loser pathetic worthless disgusting imbecile bastard dumbass retard idioten trottel dummkopf abschaum connard imbécile salaud estúpido imbécil basura",
    THREAT: "kill hurt destroy beat burn shoot stab strangle smash töten umbringen schlagen tuer frapper matar golpear",
    TARGET: "you your yours u us he she they them him her these those du dich dir ihr euch sie tu te toi vous ils eux tú ti usted ustedes ellos",
    NEGATION: "not never no nobody without cannot isn aren wasn weren don doesn didn won wouldn couldn shouldn mustn haven hasn hadn nicht kein keine nie pas jamais sans nunca sin",
    REPORT: "said says say wrote writes quoted quote quotes claimed called reported according sagte schrieb berichtete déclaré écrit selon dijo escribió según",
}
SEED_WEIGHT = 3.0
THREAT_WEIGHT = 4.0
#: As many labelled rows as the weight of a vocabulary word is worth.
VOCABULARY_ROWS = 4
#: Hits at most so many words apart add up.
SUM_WORDS = 20
#: Bytes that part words: all of ASCII but digits and lower-case letters (texts are lower-cased before).
SEPARATORS = np.r_[0x00:0x30, 0x3A:0x61, 0x7B:0x80]
CLAUSE_ENDS = b".!?;\n"


class Transducer:
    """States from 0; `step(state, symbol)` gives the next state and a (factor, bonus) for the symbol's weight."""

    def __init__(self, states: int, step):
        self.states = states
        self.next = [[step(s, x)[0] for x in SYMBOLS] for s in range(states)]
        self.factor = [[step(s, x)[1] for x in SYMBOLS] for s in range(states)]
        self.bonus = [[step(s, x)[2] for x in SYMBOLS] for s in range(states)]
        # share of the weight of the last threat that falls due here
        self.due = [[(*step(s, x), 0.0)[3] for x in SYMBOLS] for s in range(states)]


def compose(*parts: Transducer) -> Transducer:
    """One machine that runs all parts on the same symbols: factors multiply, bonuses and dues add."""
    names = list(itertools.product(*[range(p.states) for p in parts]))
    place = {n: i for i, n in enumerate(names)}

    def step(state, symbol):
        now = names[state]
        after = place[tuple(p.next[s][symbol] for p, s in zip(parts, now))]
        factor = math.prod(p.factor[s][symbol] for p, s in zip(parts, now))
        return after, factor, factor * sum(p.bonus[s][symbol] for p, s in zip(parts, now)), factor * sum(p.due[s][symbol] for p, s in zip(parts, now))

    return Transducer(len(names), step)


def negation(reach: int = 4, left: float = 0.1) -> Transducer:
    """For some words after a negation, weights nearly vanish."""
    return Transducer(reach + 1, lambda s, x: (reach if x == NEGATION else max(s - 1, 0), left if s and x in (INSULT, STEM, THREAT, TARGET) else 1.0, 0.0))


def report(left: float = 0.15) -> Transducer:
    """After a word of reporting, the rest of the clause counts less."""
    return Transducer(2, lambda s, x: (1 if s or x == REPORT else 0, left if s else 1.0, 0.0))


def target(gain: float = 1.5, late: float = 1.0) -> Transducer:
    """An insult after a target weighs more; a target after an insult adds to it. States: none, target seen, insult seen."""

    def step(s, x):
        if x == INSULT:
            return (1 if s == 1 else 2), (gain if s == 1 else 1.0), 0.0
        if x == TARGET:
            return 1, 1.0, (late if s == 2 else 0.0)
        return s, 1.0, 0.0

    return Transducer(3, step)


def threat(reach: int = 3) -> Transducer:
    """A threat counts, with its own weight, when a target follows within a few words."""
    return Transducer(reach + 1, lambda s, x: (reach if x == THREAT else 0 if x == TARGET else max(s - 1, 0), 1.0, 0.0, 1.0 if s and x == TARGET else 0.0))


def grammar() -> Transducer:
    return compose(negation(), report(), target(), threat())


def clause_hits(machine: Transducer, symbols: list[int], weights: list[float], quoted: bool = False):
    """(place, value, whether nothing lowers it, place of the insult or threat) of each hit in a clause. A stem alone has no
    value. A clause of a reported quotation begins as if a word of reporting stood before it."""
    state, threat_at = (machine.next[0][REPORT] if quoted else 0), -1
    for i, (symbol, weight) in enumerate(zip(symbols, weights)):
        factor, due = machine.factor[state][symbol], machine.due[state][symbol]
        value = machine.bonus[state][symbol]
        if symbol == INSULT:
            value += factor * weight
        if due:
            value += due * weights[threat_at]
        if value > 0 or symbol in (INSULT, STEM) or due:
            yield i, value, factor >= 1, threat_at if due else i
        # of threats that wait for a target, the heaviest counts
        if symbol == THREAT and not (machine.due[state][TARGET] and weights[threat_at] > weight):
            threat_at = i
        state = machine.next[state][symbol]


def clause_weight(hits) -> float:
    """The largest hit that negation or reporting lowers, or the largest sum of other hits within a few words, so that a
    clause does not weigh more only because it is long."""
    best, now, held = 0.0, 0.0, deque()
    for i, value, full, _ in hits:
        if not full:
            best = max(best, value)
            continue
        held.append((i, value))
        now += value
        while held[0][0] <= i - SUM_WORDS:
            now -= held.popleft()[1]
        best = max(best, now)
    return best


def _words(texts: pa.Array):
    raw, offsets = A.joined(pc.utf8_lower(pc.fill_null(texts, "")))
    codes = raw.copy()
    codes[np.isin(codes, SEPARATORS.astype(np.uint8))] = 0
    starts, ends, first = A.spans(codes, offsets)
    return raw, offsets, codes, starts, ends, first


def hash_of(words: list[str]) -> np.ndarray:
    _, _, codes, starts, ends, first = _words(pa.array(words, pa.string()))
    if len(starts) != len(words):
        raise ValueError("a lexicon entry must be one word")
    return A.word_hashes(codes, starts, ends)


def fitted(weight: float, toxic: int, clean: int, prior: float) -> float:
    """A weight of the vocabulary after evidence: it counts as much as a few rows, and is 0 where labels speak against it."""
    log_odds = math.log(prior / (1 - prior))
    share = (toxic + VOCABULARY_ROWS / (1 + math.exp(-log_odds - weight))) / (toxic + clean + VOCABULARY_ROWS)
    return min(max(math.log(share / (1 - share)) - log_odds, 0.0), MOST)


class Lexicon:
    """Words with kind and weight. `vocabulary` has weights that labels gave to words of the fixed vocabulary; 0 removes one."""

    def __init__(self, learned: dict[str, float], prior: float, vocabulary: dict[str, float] | None = None, stems: dict[str, float] | None = None):
        usual = {INSULT: SEED_WEIGHT, THREAT: THREAT_WEIGHT}
        entries = {w: (kind, usual.get(kind, 0.0)) for kind, words in WORDS.items() for w in words.split()}
        for word, weight in (vocabulary or {}).items():
            entries[word] = (entries[word][0], weight)
        # what labels say about a word outweighs the vocabulary; only words of no other kind become insults
        for word, weight in learned.items():
            if word not in entries or entries[word][0] == INSULT:
                entries[word] = (INSULT, weight)
        entries = {w: (k, x) for w, (k, x) in entries.items() if x > 0 or k not in usual}
        hashes = hash_of(list(entries))
        order = np.argsort(hashes)
        self.names = [list(entries)[i] for i in order]
        self.hashes = hashes[order]
        self.symbols = np.array([k for k, _ in entries.values()])[order]
        self.weights = np.array([w for _, w in entries.values()], float)[order]
        self.prior = math.log(prior / (1 - prior))
        # stems by their length in bytes, none the beginning of another
        self.stems = {}
        for size in sorted({len(x.encode()) for x in stems or {}}):
            own = {x: w for x, w in stems.items() if len(x.encode()) == size}
            found = hash_of(list(own))
            order = np.argsort(found)
            self.stems[size] = found[order], np.array(list(own.values()))[order]


def reported_quotes(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, doc: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, how many quotation marks stand before it, and whether it is in a quotation with a word of reporting
    close before or behind it. Marks of a text open and close in turn; a last one without a partner opens nothing."""
    mark = raw == 0x22
    # the curly marks U+201C to U+201F, by their last byte
    mark[2:] |= (raw[:-2] == 0xE2) & (raw[1:-1] == 0x80) & (raw[2:] >= 0x9C) & (raw[2:] <= 0x9F)
    marks = np.r_[0, np.cumsum(mark)]
    before, begin, end = marks[starts], marks[offsets[doc]], marks[offsets[doc + 1]]
    inside = ((before - begin) % 2 == 1) & (before < end)
    head = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (doc[1:] != doc[:-1])])  # words between the same marks
    tail = np.r_[head[1:], len(starts)]
    said = np.r_[0, np.cumsum(symbols == REPORT)]
    low = np.maximum(head - QUOTE_WORDS, np.searchsorted(doc, doc[head]))
    high = np.minimum(tail + QUOTE_WORDS, np.searchsorted(doc, doc[head], "right"))
    reported = inside[head] & ((said[head] > said[low]) | (said[high] > said[tail]))
    return before, np.repeat(reported, tail - head)


def clauses(texts: pa.Array, lexicon: Lexicon):
    """(text, first word, symbols, weights, places in the lexicon, whether quoted) of each clause with an insult, a stem of
    one or a threat."""
    raw, offsets, codes, starts, ends, first = _words(texts)
    if not len(starts):
        return
    hashes = A.word_hashes(codes, starts, ends)
    place = np.minimum(np.searchsorted(lexicon.hashes, hashes), len(lexicon.hashes) - 1)
    known = lexicon.hashes[place] == hashes
    symbols = np.where(known, lexicon.symbols[place], OTHER)
    weights = np.where(known, lexicon.weights[place], 0.0)
    # "n't" of any verb; a word of its own, or with a curly apostrophe, U+2019, the end of one
    cut = np.flatnonzero((ends - starts == 1) & (raw[starts] == ord("t")) & (starts > 1))
    symbols[cut[(raw[starts[cut] - 1] == ord("'")) & (raw[starts[cut] - 2] == ord("n"))]] = NEGATION
    cut = np.flatnonzero((ends - starts > 5) & (raw[ends - 1] == ord("t")))
    symbols[cut[np.all([raw[ends[cut] - 5 + k] == b for k, b in enumerate("n’".encode())], axis=0)]] = NEGATION
    for size, (stems, odds) in lexicon.stems.items():
        at = np.flatnonzero((ends - starts >= size) & (symbols == OTHER))
        found = A.word_hashes(codes, starts[at], starts[at] + size)
        stem = np.minimum(np.searchsorted(stems, found), len(stems) - 1)
        same = stems[stem] == found
        symbols[at[same]], weights[at[same]] = STEM, odds[stem[same]]
    stops = np.r_[0, np.cumsum(np.isin(raw, np.frombuffer(CLAUSE_ENDS, np.uint8)))]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    marks, quoted = reported_quotes(raw, offsets, starts, doc, symbols)
    # a clause ends at a clause mark, with its text, or where a reported quotation begins or ends
    new = (stops[starts[1:]] != stops[starts[:-1]]) | (doc[1:] != doc[:-1]) | ((marks[1:] != marks[:-1]) & (quoted[1:] | quoted[:-1]))
    clause = np.cumsum(np.r_[False, new])
    begin = np.searchsorted(clause, np.arange(clause[-1] + 2))
    for c in np.unique(clause[np.isin(symbols, (INSULT, STEM, THREAT))]).tolist():
        a, b = begin[c], begin[c + 1]
        yield doc[a], a, symbols[a:b].tolist(), weights[a:b].tolist(), place[a:b], bool(quoted[a])


def scores(texts: pa.Array, lexicon: Lexicon, machine: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, from its heaviest clause or pair of stems, and how many of its clauses matched."""
    most, matched = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    last, last_at, last_weight = -1, 0, 0.0
    for doc, begin, symbols, weights, _, quoted in clauses(texts, lexicon):
        hits = list(clause_hits(machine, symbols, weights, quoted))
        weight = clause_weight(hits)
        for i, _, full, _ in hits:
            if full and symbols[i] == STEM:
                if last == doc and begin + i - last_at <= STEM_WORDS:
                    weight = max(weight, (weights[i] + last_weight) / 2)
                last, last_at, last_weight = doc, begin + i, weights[i]
        if weight > 0:
            most[doc] = max(most[doc], weight)
            matched[doc] += 1
    return 1 / (1 + np.exp(-np.clip(lexicon.prior + most, -30, 30))), matched


def vocabulary_hits(texts: pa.Array, lexicon: Lexicon, machine: Transducer) -> list[dict[bytes, bytes]]:
    """Of each text, the insults and threats of the vocabulary that count there in full, as " word"; " " is any threat."""
    out = [{} for _ in range(len(texts))]
    for doc, _, symbols, weights, places, quoted in clauses(texts, lexicon):
        for _, _, full, at in clause_hits(machine, symbols, weights, quoted):
            if full and symbols[at] in (INSULT, THREAT):
                word = lexicon.names[places[at]].encode()
                out[doc][b" " + word] = word
                if symbols[at] == THREAT:
                    out[doc][b" "] = word
    return out


def repeated_stems(words: list[str]) -> dict[bytes, int]:
    """"~stem" and a place of each stem of two different words near each other."""
    last, out = {}, {}
    for i, word in enumerate(words):
        for size in STEM_LETTERS:
            if size >= len(word):
                break
            stem = word[:size]
            before = last.get(stem)
            if before and i - before[0] <= STEM_WORDS and before[1] != word:
                out.setdefault(stem, i)
            last[stem] = (i, word)
    return {b"~" + stem.encode(): i for stem, i in out.items()}


ALONE, FAMILY, CONTEXT = range(3)


def _counted(text: str, label: str, family: str):
    """In how many texts of either label each word occurs; words of copied texts once for each family and label; the
    different surroundings of each word, where it first stands in a text. A task hands on what it has whenever that is much,
    so a word has several rows."""

    def rows(counts, once):
        words = list(counts[0].keys() | counts[1].keys())
        once = list(once)
        columns = [
            pa.array([w.decode() for w in words] + [w.decode() for w, _, _, _ in once], pa.string()),
            pa.array([ALONE] * len(words) + [k for _, k, _, _ in once], pa.int32()),
            pa.array([None] * len(words) + [x for _, _, x, _ in once], pa.int64()),
            pa.array([counts[1][w] for w in words] + [int(t) for _, _, _, t in once], pa.int64()),
            pa.array([counts[0][w] for w in words] + [int(not t) for _, _, _, t in once], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["word", "kind", "id", "toxic", "clean"])

    def run(batches):
        counts, once = (Counter(), Counter()), set()
        plain, machine = Lexicon({}, PRIOR), grammar()
        for batch in (piece for whole in batches for piece in A.pieces(whole, text, PIECE)):
            hits = vocabulary_hits(batch.column(text), plain, machine)
            lowered = pc.utf8_lower(pc.fill_null(batch.column(text), "")).to_pylist()
            for value, value_label, own, hit in zip(lowered, batch.column(label).to_pylist(), batch.column(family).to_pylist(), hits):
                is_toxic = value_label == 1
                words = value.encode().translate(_PARTING).split()
                first = dict(zip(reversed(words), range(len(words) - 1, -1, -1)))
                first |= {mark: first[w] for mark, w in hit.items()} | repeated_stems([w.decode() for w in words])
                once.update((w, CONTEXT, zlib.crc32(b" ".join([*words[max(i - NEAR_WORDS, 0) : i], b"", *words[i + 1 : i + 1 + NEAR_WORDS]])), is_toxic) for w, i in first.items())
                if own is None:
                    counts[is_toxic].update([b"", *first])  # the empty word counts texts
                else:
                    once.update((w, FAMILY, own, is_toxic) for w in [b"", *first])
                if len(once) + len(counts[0]) + len(counts[1]) > HELD:
                    yield rows(counts, once)
                    counts, once = (Counter(), Counter()), set()
        yield rows(counts, once)

    return run


_PARTING = bytes(32 if b in set(SEPARATORS.tolist()) else b for b in range(256))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Insults and their log odds from labelled texts.

    Fits on at most `sample_rows` labelled rows, the first by a digest of the key; all of them where there are fewer. Null
    labels and texts without words teach nothing. A word is an insult if at least four fifths of its evidence is toxic and
    beyond chance at the size of the vocabulary. Evidence of a label, toxic and clean alike, is the number of texts with the
    word, copies and near copies (the families of `ngramjoin`) once, or that of its different surroundings of four words on
    either side, if there are fewer (a passage in many texts). So copies neither make insults of the other words of a toxic
    text nor hide an insult that a clean one quotes.
    A stem is the beginning of words, four to eight characters; its evidence are texts in which two different words with it
    stand near each other, under the same rules. Of stems that begin each other the best attested one stays, and its words
    are no insults of their own.
    Words of the vocabulary start from its weight, which evidence raises, lowers or removes; threats from a weight fitted
    to all of them. Only hits that the grammar counts in full are evidence there. Without labels only the vocabulary counts.
    """
    A.small_batches(docs.sparkSession)
    chosen = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where("_key is not null and _label is not null")
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(sample_rows)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")  # at most sample_rows pairs of numbers
    rows = stage(rows.select(F.monotonically_increasing_id().alias("_row"), "_text", "_label"), "sample")
    families = ngramjoin.classes(rows, "_row", "_text").where("n_shingles > 0").select("_row", F.col("component_id").alias("_family"))
    copied = families.groupBy("_family").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_family", F.col("_family").alias("_copied"))
    families = families.join(F.broadcast(copied), "_family", "left").select("_row", "_copied")  # at most sample_rows pairs of numbers
    rows = rows.join(F.broadcast(families), "_row").select("_text", "_label", "_copied")
    counted = rows.mapInArrow(_counted("_text", "_label", "_copied"), "word string, kind int, id bigint, toxic bigint, clean bigint")
    once = counted.groupBy("word", "kind", "id").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = lambda c: F.when(F.col("kind") == ALONE, F.col(c)).otherwise(F.least(F.col(c), F.lit(1)))
    total = lambda c, kinds: F.coalesce(F.sum(F.when(kinds, seen(c))), F.lit(0))
    texts, around = F.col("kind") != CONTEXT, (F.col("kind") == CONTEXT) | (F.col("word") == "")
    counted = once.groupBy("word").agg(*[F.least(total(c, texts), total(c, around)).alias(c) for c in ("toxic", "clean")])
    counted = stage(counted, "words")
    whole = counted.where("word = ''").first()
    n_toxic, n_clean = (whole["toxic"], whole["clean"]) if whole else (0, 0)
    if not n_toxic + n_clean:
        return Lexicon({}, PRIOR)
    prior = n_toxic / (n_toxic + n_clean)
    settled = min(max(prior, 0.01), 0.4) if n_toxic else PRIOR
    seen = {r["word"][1:]: (r["toxic"], r["clean"]) for r in counted.where("word like ' %'").collect()}  # at most the vocabulary
    usual = fitted(THREAT_WEIGHT, *seen.pop("", (0, 0)), settled)
    vocabulary = {w: fitted(SEED_WEIGHT, *seen.get(w, (0, 0)), settled) for w in WORDS[INSULT].split()}
    vocabulary |= {w: fitted(usual, *seen.get(w, (0, 0)), settled) for w in WORDS[THREAT].split()}
    if not n_toxic:
        return Lexicon({}, settled, vocabulary)
    counted = counted.where("word not like ' %'").withColumn("stem", F.col("word").startswith("~"))
    n_words = counted.count()  # one more than the words
    counted = counted.where("word <> ''")
    share = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1)
    gain = F.col("toxic") * F.log(share / prior) + F.col("clean") * F.log((1 - share) / max(1 - prior, 1e-9))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    kept = counted.withColumn("odds", odds).withColumn("gain", gain).where((gain > math.log(n_words) + 3) & (share >= 0.8))
    kept = kept.select("word", "stem", "odds", "gain").collect()  # of a bounded sample
    stems = {}
    for r in sorted((r for r in kept if r["stem"]), key=lambda r: (-r["gain"], r["word"])):
        stem = r["word"][1:]
        if not any(stem.startswith(x) or x.startswith(stem) for x in stems):
            stems[stem] = min(r["odds"], MOST)
    # a stem explains its words
    learned = {r["word"]: min(r["odds"], MOST) for r in kept if not r["stem"] and not r["word"].startswith(tuple(stems))}
    return Lexicon(learned, settled, vocabulary, stems)


def _scored(text: str, lexicon: Lexicon, keep_text: bool):
    def run(batches):
        machine = grammar()
        for whole in batches:
            for batch in A.pieces(whole, text, PIECE):
                score, matched = scores(batch.column(text), lexicon, machine)
                kept = batch if keep_text else batch.drop_columns([text])
                yield A.of_rows(kept, score=pa.array(score), matched_clauses=pa.array(matched))

    return run


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Columns of `docs` (the text on request) with score (0 to 1) and matched_clauses.

    Null and empty texts have the prior's score; texts of any length are read whole; repeated rows are scored each; an
    empty table stays empty; columns called like the results are replaced.
    """
    A.small_batches(docs.sparkSession)
    rows = docs.drop("score", "matched_clauses")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep_text or f.name != text)
    return rows.mapInArrow(_scored(text, lexicon, keep_text), f"{shape}, score double, matched_clauses bigint")


def civil(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5, text: str = "text") -> DataFrame:
    """Rows of `docs` whose score is below the limit; same columns and values, whatever their names."""
    rows, (text,) = by_place(docs, text)
    return as_before(score(rows, lexicon, text, keep_text=True).where(F.col("score") < limit), docs)
